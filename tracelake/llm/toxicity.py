"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Inputs of a word: what a gated recurrent unit has read of its characters, in order, a learned vector of the word, and the
log-odds of the word and of its strongest character prefix in toxic against other labelled documents (leave-one-out while
training). Two more GRUs read a window of WIDTH words in both directions, attention pools their states, a logistic unit
scores the window. Windows begin every STRIDE words, so each overlaps half of the next, and cover the whole text; a document
has the score of its highest window.

Training: at most SAMPLE labelled documents of each label (bound of the fit); of each, the windows with the highest
log-odds and one other; a fixed number of Adam steps, so the fit costs the same whatever the corpus.

Defined cases: null and wordless texts are one empty window; words are runs of letters and digits, longer ones are cut in
pieces of LETTERS; repeated rows keep a row each; without labelled rows of both labels every score is the share of label 1
(or 0).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import fit_on_sample, held_out, labelled, table, with_text_columns

SAMPLE, WIDTH, STRIDE, HIDDEN, BUCKETS, EMBEDDINGS, DIM, STEPS, BATCH = 3000, 32, 16, 8, 1 << 18, 4096, 4, 300, 256
LETTERS, CODES, READER = 16, 1024, 3  # characters of a word, numbers for them, size of the unit that reads them
MOD, REST = 5, 0
SHORTEST, LONGEST = 3, 10  # bytes of a prefix
_WORD = re.compile(rf"[^\W_]{{1,{LETTERS}}}")
_KNOWN = 120_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def buckets(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its bucket, and those of its prefixes (flat, with their starts)."""
    word, flat, starts = [], [], []
    for t in tokens:
        b = t.encode("utf-8", "surrogatepass")
        word.append(crc32(b))
        starts.append(len(flat))
        c = crc32(b[:SHORTEST], 3)
        flat.append(c)
        for k in range(SHORTEST, min(len(b), LONGEST)):
            c = crc32(b[k : k + 1], c)
            flat.append(c)
    return np.array(word, np.int64) % BUCKETS, np.array(flat, np.int64) % BUCKETS, np.array(starts, np.int64)


def letters(tokens: list[str]) -> np.ndarray:
    """The characters of every word by number, set to the right; 0: none."""
    cp = np.frombuffer("".join(t.rjust(LETTERS, "\0") for t in tokens).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, LETTERS)
    return np.where(cp < CODES // 2, cp, CODES // 2 + cp % (CODES // 2)).astype(np.int32)


def odds(toxic: np.ndarray, other: np.ndarray, share: float, k: float = 4.0) -> np.ndarray:
    """Shrunk log-odds of counts of documents, against the overall share."""
    x = np.log((np.maximum(toxic, 0) + k * share) / (np.maximum(other, 0) + k * (1 - share))) - np.log(share / (1 - share))
    return (np.clip(x, -4, 6) / 2).astype(np.float32)


class Lexicon:
    """Log-odds of words and prefixes by bucket."""

    def __init__(self, docs: Iterable[list[str]], y: np.ndarray):
        self.counts = np.zeros((2, 2, BUCKETS), np.int32)  # label, word or prefix
        for tokens, label in zip(docs, y):
            w, p, _ = buckets(list(dict.fromkeys(tokens)))
            self.counts[label, 0, np.unique(w)] += 1
            self.counts[label, 1, np.unique(p)] += 1
        self.share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.tables = self.odds_without(0, 0)

    def odds_without(self, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(odds(self.counts[1, i] - toxic, self.counts[0, i] - other, self.share) for i in (0, 1))

    def __getstate__(self):
        return {"tables": self.tables, "share": self.share}


def statistics(parts, tables) -> np.ndarray:
    w, p, starts = parts
    if not len(w):
        return np.zeros((0, 2), np.float32)
    return np.stack([tables[0][w], np.maximum.reduceat(tables[1][p], starts)], 1)


def starts_of(n: int, width: int = WIDTH) -> range:
    return range(0, max(1, n - (width - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of an array of its own, which it overwrites."""
    np.maximum(x, -60, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    def __init__(self, seed: int = 11, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        d, h, c = 2 + DIM + READER, hidden, READER
        g = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"ew": g(EMBEDDINGS, DIM, scale=0.05), "ec": g(CODES, DIM), "wc": g(DIM, 3 * c), "uc": g(c, 3 * c), "bc": np.zeros(3 * c, np.float32), "o": g(2 * h), "a": g(2 * h), "c": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"w{k}": g(d, 3 * h), f"u{k}": g(h, 3 * h), f"b{k}": np.zeros(3 * h, np.float32)}
        self.h = h

    def spelled(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """What the reader of characters holds at the end of each word."""
        p, h = self.p, READER
        known, s = p["ec"] @ p["wc"] + p["bc"], np.zeros((len(codes), READER), p["uc"].dtype)
        for t in range(codes.shape[1]):
            m = (codes[:, t] > 0)[:, None].astype(s.dtype)
            g, v = known.take(codes[:, t], 0), s @ p["uc"]
            rz = _sigmoid(g[:, : 2 * h] + v[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            c = 2 * _sigmoid(2 * (g[:, 2 * h :] + r * v[:, 2 * h :])) - 1
            if keep is not None:
                keep.append((s, r, z, c, v[:, 2 * h :], m))
            s = s + m * (1 - z) * (c - s)
        return s

    def spelled_back(self, codes: np.ndarray, kept: list, ds: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        known, du = np.zeros((CODES, 3 * READER), ds.dtype), np.zeros_like(p["uc"])
        for t in range(codes.shape[1] - 1, -1, -1):
            s, r, z, c, vc, m = kept[t]
            on = ds * m
            dc = on * (1 - z) * (1 - c * c)
            dz = on * (s - c) * z * (1 - z)
            dr = dc * vc * r * (1 - r)
            np.add.at(known, codes[:, t], np.concatenate([dr, dz, dc], 1))
            dv = np.concatenate([dr, dz, dc * r], 1)
            du += s.T @ dv
            ds = ds * (1 - m) + on * z + dv @ p["uc"].T
        return {"wc": p["ec"].T @ known, "bc": known.sum(0), "ec": known @ p["wc"].T, "uc": du}

    def inputs(self, word: np.ndarray, spelled: np.ndarray, stat: np.ndarray) -> np.ndarray:
        return np.concatenate([stat, self.p["ew"][word % EMBEDDINGS], spelled], 1).astype(np.float32)

    def read(self, gates: list[np.ndarray], u: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
        """States of one direction from the inputs' share of the gates, step by step."""
        h, n = self.h, len(gates[0])
        s, out = np.zeros((n, h), np.float32), []
        for g in gates:
            v = s @ u
            rz = _sigmoid(g[:, : 2 * h] + v[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            c = _sigmoid(2 * (g[:, 2 * h :] + r * v[:, 2 * h :]))  # tanh by the cheaper exp
            c += c
            c -= 1
            if keep is not None:
                keep.append((s, r, z, c, v[:, 2 * h :]))
            s = c + z * (s - c)
            out.append(s)
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """states: window, step, 2h. Attention, pooled state and logit."""
        e = np.where(mask, states @ self.p["a"], np.float32(-30))
        e = np.exp(e - e.max(1, keepdims=True))
        att = e / e.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", att, states)
        return att, pooled, pooled @ self.p["o"] + self.p["c"][0]

    def logits(self, table_: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """table_: gates of both directions for every known word, row 0 for none; ids: window, step."""
        out, w, h3 = np.empty(len(ids), np.float32), ids.shape[1], 3 * self.h
        fw, bw = np.ascontiguousarray(table_[:, :h3]), np.ascontiguousarray(table_[:, h3:])
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            f = self.read([fw.take(part[:, t], 0) for t in range(w)], self.p["uf"])
            b = self.read([bw.take(part[:, t], 0) for t in reversed(range(w))], self.p["ub"])[::-1]
            states = np.concatenate([np.stack(f, 1), np.stack(b, 1)], 2)
            out[at : at + 1024] = self.pool(states, part > 0)[2]
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        return np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], 1)

    def step(self, word, which, codes, stat, mask, y, weight) -> dict[str, np.ndarray]:
        """Gradients of the weighted log-loss of a batch; the first two axes of the inputs are window and step. which: the
        row of codes that has a word's characters."""
        n, t = mask.shape
        p, h = self.p, self.h
        some, which = np.unique(which.reshape(-1), return_inverse=True)
        codes, letters_kept = codes[some], []
        spelled = self.spelled(codes, letters_kept)
        x = self.inputs(word.reshape(-1), spelled[which], stat.reshape(n * t, 2)).reshape(n, t, -1) * mask[..., None]
        kept = {"f": [], "b": []}
        states, order = {}, {"f": list(range(t)), "b": list(range(t))[::-1]}
        for k in "fb":
            g = x @ p[f"w{k}"] + p[f"b{k}"]
            s = self.read([g[:, j] for j in order[k]], p[f"u{k}"], kept[k])
            states[k] = np.stack(s if k == "f" else s[::-1], 1)
        both = np.concatenate([states["f"], states["b"]], 2)
        att, pooled, z = self.pool(both, mask)
        q = 1 / (1 + np.exp(-z))
        self.loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).mean())
        dz = (weight * (q - y) / n).astype(np.float32)
        grad = {"o": pooled.T @ dz, "c": np.array([dz.sum()], np.float32)}
        dpool = dz[:, None] * p["o"]
        datt = np.einsum("nh,nth->nt", dpool, both)
        de = att * (datt - (att * datt).sum(1, keepdims=True)) * mask
        dboth = att[..., None] * dpool[:, None] + de[..., None] * p["a"]
        grad["a"] = np.einsum("nt,nth->h", de, both)
        dx = np.zeros_like(x)
        for k, part in (("f", dboth[..., :h]), ("b", dboth[..., h:])):
            dg, ds, du = np.zeros((n, t, 3 * h), np.float32), np.zeros((n, h), np.float32), np.zeros_like(p[f"u{k}"])
            for i in range(t - 1, -1, -1):
                j = order[k][i]
                s, r, zt, c, vc = kept[k][i]
                ds = ds + part[:, j]
                dc = ds * (1 - zt) * (1 - c * c)
                dzt = ds * (s - c) * zt * (1 - zt)
                dr = dc * vc * r * (1 - r)
                dg[:, j] = np.concatenate([dr, dzt, dc], 1)
                dv = np.concatenate([dr, dzt, dc * r], 1)
                du += s.T @ dv
                ds = ds * zt + dv @ p[f"u{k}"].T
            grad[f"u{k}"], grad[f"b{k}"] = du, dg.sum((0, 1))
            grad[f"w{k}"] = np.einsum("ntd,ntg->dg", x, dg)
            dx += dg @ p[f"w{k}"].T
        dx = (dx * mask[..., None]).reshape(n * t, -1)
        grad["ew"], ds = np.zeros_like(p["ew"]), np.zeros_like(spelled)
        np.add.at(grad["ew"], word.reshape(-1) % EMBEDDINGS, dx[:, 2 : 2 + DIM])
        np.add.at(ds, which, dx[:, 2 + DIM :])
        return grad | self.spelled_back(codes, letters_kept, ds)


def train(texts: list[str | None], y: np.ndarray, *, steps: int = STEPS, seed: int = 5) -> tuple[Lexicon, Network]:
    # words are cut twice rather than kept: the driver then holds no more than the texts and the chosen windows
    lex, net, rng = Lexicon((words(t) for t in texts), y), Network(), np.random.default_rng(seed)
    without = {1: lex.odds_without(1, 0), 0: lex.odds_without(0, 1)}
    word, which, stat, mask, label = [], [], [], [], []
    number: dict[str, int] = {"": 0}
    for text, own in zip(texts, y.tolist()):
        tokens = words(text)
        parts = buckets(tokens)
        f = statistics(parts, without[own])
        first = list(starts_of(len(tokens)))
        heat = [np.maximum(f[s : s + WIDTH], 0).sum() for s in first]
        best = np.argsort(heat)[::-1][: 1 if own else 2].tolist()
        for s in {first[k] for k in best} | (set() if own else {first[int(rng.integers(len(first)))]}):
            m = len(tokens[s : s + WIDTH])
            pad = lambda a, s=s: np.concatenate([a[s : s + m], np.zeros((WIDTH - m, *a.shape[1:]), a.dtype)])
            word.append(pad(parts[0]))
            which.append(pad(np.array([number.setdefault(x, len(number)) for x in tokens[s : s + WIDTH]], np.int64), 0))
            stat.append(pad(f))
            mask.append(np.arange(WIDTH) < m)
            label.append(own)
    word, which, stat, mask, label = (np.array(v) for v in (word, which, stat, mask, label))
    codes = letters([*number])
    mask[:, 0] |= ~mask.any(1)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in "ab")
    for i in range(1, steps + 1):
        k = rng.integers(0, len(label), BATCH)
        grad = net.step(word[k], which[k], codes, stat[k], mask[k], label[k].astype(np.float32), np.ones(BATCH, np.float32))
        rate = 0.01 * min(1, 2 * (1 - i / steps) + 0.05)
        for n, g in grad.items():
            m1[n] = 0.9 * m1[n] + 0.1 * g
            m2[n] = 0.99 * m2[n] + 0.01 * g * g
            net.p[n] = (net.p[n] - rate * (m1[n] / (1 - 0.9**i)) / (np.sqrt(m2[n] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
    return lex, net


class Scorer:
    """Keeps the gates of the words it has seen, at most about _KNOWN of them; the oldest are then computed anew."""

    def __init__(self, lex: Lexicon, net: Network):
        self.lex, self.net = lex, net
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = self.net.gates(np.zeros((1, 2 + DIM + READER), np.float32))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = [words(t) for t in texts]
        new = list({t for d in docs for t in d} - self.known.keys())
        if len(self.known) + len(new) > _KNOWN and self.known:
            self.forget()
            new = list({t for d in docs for t in d})
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            parts = buckets(some)
            self.known.update(zip(some, range(len(self.table), len(self.table) + len(some))))
            self.table = np.concatenate([self.table, self.net.gates(self.net.inputs(parts[0], self.net.spelled(letters(some)), statistics(parts, self.lex.tables)))])
        get, out = self.known.__getitem__, np.zeros(len(docs))
        ids, owner = [], []
        for i, d in enumerate(docs):
            n = len(starts_of(len(d)))
            row = np.zeros((n - 1) * STRIDE + WIDTH, np.int32)
            row[: len(d)] = list(map(get, d))
            ids.append(np.lib.stride_tricks.sliding_window_view(row, WIDTH)[::STRIDE])
            owner.append(np.full(n, i))
        if ids:
            z = self.net.logits(self.table, np.concatenate(ids))
            best = np.full(len(docs), -np.inf)
            np.maximum.at(best, np.concatenate(owner), z)
            out = 1 / (1 + np.exp(-best))
        return out


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", mod: int = MOD, rest: int = REST, sample: int = SAMPLE):
    rows = labelled(docs, labels, label, mod, rest).where("y in (0, 1)")

    def fit(got: list, _: dict):
        y = np.array([r["y"] for r in got], int)
        if not len(y) or y.min() == y.max():
            return float(y.mean()) if len(y) else 0.0
        return train([r["text"] for r in got], y)

    return fit_on_sample(rows, "y", sample, ("y", "text"), fit)


def scored(docs: DataFrame, model, *, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in keep, score and predicted (under names, which docs' columns in keep must not have), a row per row of
    docs. The model (about 3 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        if isinstance(shared.value, float):
            return lambda texts: [[shared.value] * len(texts)]
        scorer = Scorer(*shared.value)
        return lambda texts: [scorer.scores(texts)]

    return with_text_columns(docs, list(keep), make, f"`{names[0]}` double", most_chars=2_000_000).withColumn(names[1], (F.col(f"`{names[0]}`") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score", "predicted")
