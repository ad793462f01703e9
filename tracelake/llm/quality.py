"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of a text are Spark column expressions.
2. On a bounded, labelled sample, boosted depth-limited trees are grown; every root-to-node path is a conjunctive rule.
3. A lasso logistic regression over the rules (proximal gradient) keeps a few of them; an unpenalised refit of the kept
   ones takes the shrinkage out of the probabilities.
4. The kept rules are compiled to one Spark column: score = sigmoid(bias + sum of weights of the rules that hold).

Bound: at most SAMPLE rows per label are used to fit, in one task; the driver sees their ids and the rules. Every path of
TREES trees of DEPTH levels is a candidate of the lasso, at most TREES * (2^(DEPTH + 1) - 2) of them.
Defined cases: null text counts as empty and scores like an empty text; repeated rows keep a row each; with no labelled
rows or one class only, the score is that class's share (0.5 without any) and no rule is used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import fit_on_sample, held_out, labelled, table, unused

SAMPLE, TREES, DEPTH, L1 = 6000, 24, 3, 2e-3
THRESHOLD = 0.7
MOD, REST = 4, 2


def statistics(text: Column) -> dict[str, Column]:
    """Plain counts and shares; every one is defined for the empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    tokens = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n_words = F.greatest(F.size(tokens), F.lit(1)).cast("double")
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    same_next = F.size(F.filter(F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    return {
        "log_chars": F.log(n),
        "log_words": F.log(n_words),
        "word_length": n / n_words,
        "blank_share": without(" \n\t") / n,
        "digit_share": without("0123456789") / n,
        "stop_share": without(".!?") / n,
        "comma_share": without(",;:") / n,
        "symbol_share": without("#%$&*@~^+=<>\\_") / n,
        "bar_share": without("|") / n,
        "bracket_share": without("()[]{}") / n,
        "line_share": without("\n") / n,
        "upper_share": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        "repeat_share": same_next.cast("double") / n_words,
        "distinct_share": F.size(F.array_distinct(tokens)).cast("double") / n_words,
    }


@dataclass
class Rules:
    """Each rule: [(statistic, '<=' or '>', cut), ...]; score = sigmoid(bias + weights of rules that hold)."""

    rules: list[list[tuple[str, str, float]]]
    weights: list[float]
    bias: float

    def column(self, stats: dict[str, str]) -> Column:
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            cond = F.lit(True)
            for name, sign, cut in rule:
                c = F.col(stats[name])
                cond = cond & ((c <= F.lit(float(cut))) if sign == "<=" else (c > F.lit(float(cut))))
            z = z + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray) -> np.ndarray:
    v = np.unique(np.quantile(x, np.linspace(0.01, 0.99, 33)))
    return v


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, path: list, out: list) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, value); every node's path below the root is added to out."""
    value = g[rows].sum() / (h[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return [(rows, value)]
    best = (1e-6, None, None)
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for j in range(x.shape[1]):
        col = x[rows, j]
        for c in _cuts(col):
            left = col <= c
            k = int(left.sum())
            if k < least or len(rows) - k < least:
                continue
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - base
            if gain > best[0]:
                best = (gain, j, c)
    if best[1] is None:
        return [(rows, value)]
    _, j, c = best
    left = x[rows, j] <= c
    leaves = []
    for part, sign in ((rows[left], "<="), (rows[~left], ">")):
        own = [*path, (j, sign, float(c))]
        out.append(own)
        leaves += _grow(x, g, h, part, depth - 1, least, own, out)
    return leaves


def _holds(rule: list, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for j, sign, c in rule:
        on &= (x[:, j] <= c) if sign == "<=" else (x[:, j] > c)
    return on


def _logistic(r: np.ndarray, y: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the bias is not penalised."""
    n, p = r.shape
    a = np.hstack([r, np.ones((n, 1))])
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / n)
    w = z = np.zeros(p + 1)
    t = 1.0
    for _ in range(steps):
        new = z - step * (a.T @ (_sigmoid(a @ z) - y) / n)
        new[:p] = np.sign(new[:p]) * np.maximum(np.abs(new[:p]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:p], float(w[p])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], share: float, *, trees: int = TREES, depth: int = DEPTH, l1: float = L1) -> Rules:
    """share: of label 1 among all labelled rows; the sample may be balanced otherwise."""
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(y) or y.min() == y.max():
        return Rules([], [], prior if len(y) else 0.0)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    rng, f, paths = np.random.default_rng(7), np.full(len(y), prior), []
    least = max(4, len(y) // 200)
    for _ in range(trees):
        p = _sigmoid(f)
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        for leaf, value in _grow(x, weight * (y - p), weight * p * (1 - p) + 1e-9, rows, depth, least, [], paths):
            f[leaf] += 0.3 * np.clip(value, -4, 4)
    seen, rules, cols = set(), [], []
    for path in paths:
        on = _holds(path, x)
        key = on.tobytes()
        if key not in seen and 0 < on.mean() < 1:
            seen.add(key)
            rules.append(path)
            cols.append(on)
    if not rules:
        return Rules([], [], prior)
    r = np.array(cols, float).T
    order = np.argsort(-np.abs(r.T @ (y - y.mean())) / np.sqrt(r.sum(0)))
    w, _ = _logistic(r[:, order], y.astype(float), l1, 400)
    kept = order[np.abs(w) > 1e-6]
    w, b = _logistic(r[:, kept], y.astype(float), 1e-5, 800)
    shift = prior - float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))  # back from the sample's balance
    return Rules([[(names[j], s, c) for j, s, c in rules[k]] for k in kept], w.tolist(), b + shift)


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = MOD, rest: int = REST, sample: int = SAMPLE) -> Rules:
    rows = labelled(docs, labels, label, mod, rest).where("y in (0, 1)")
    stats = statistics(F.col("text"))
    names = list(stats)

    def train(got: list, counts: dict) -> Rules:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        data = np.array([[r[k] for k in names] for r in got], float).reshape(-1, len(names))
        return fit(data, np.array([r["y"] for r in got], int), names, share)

    return fit_on_sample(rows.select("doc_id", "y", *[c.alias(k) for k, c in stats.items()]), "y", sample, ("y", *names), train)


def scored(docs: DataFrame, rules: Rules, *, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in keep, score and predicted (under names, which docs' columns in keep must not have), a row per row of docs."""
    stats = statistics(F.col("text"))
    kept = [F.col(f"`{c}`") for c in keep]
    own = {n: unused(docs, f"stat_{n}") for n in sorted({n for r in rules.rules for n, _, _ in r})}
    x = docs.select(*kept, *[stats[n].alias(c) for n, c in own.items()])
    return x.select(*kept, rules.column(own).alias(names[0])).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, rules)
    return out.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score", "predicted")
