"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of its labelled text. A text is cross-parsed against
it: from the current place, the longest match with the training text is one phrase, then the next one begins. The number
of phrases times the bits of a pointer into the training text, by the number of symbols parsed, is the cross-entropy; the
language with the least one wins.

Texts are lower-cased, all but letters become one blank, and the UTF-8 bytes of the rest are the symbols, so that no script
loses letters. They are parsed whole, in segments of SEGMENT symbols (a phrase ends with its segment, for every language
alike), so that many segments advance through the automata together as numpy gathers.

Bound: CHARS letters and blanks of training text per language, taken evenly from at most SAMPLE documents, from each at a
place of the whole text that a hash of its doc_id chooses. All lang values are learned; the automata of a model, which is
broadcast, take at most MEMORY bytes: with many languages each has less training text.
Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the language first in order;
without labelled rows everything is `und`; repeated rows keep a row each; score is 1 - least / second least entropy,
and 1 if only one language was learned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import held_out, spread_sample, table, with_text_columns

CHARS, SAMPLE, SEGMENT, MEMORY = 40_000, 400, 256, 256 << 20
MOD, REST = 3, 1


def automaton(text: list[int], size: int) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton; -1: none. State 0 is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table_ = np.full((len(nxt), size), -1, np.int32)
    for s, d in enumerate(nxt):
        if d:
            table_[s, list(d)] = list(d.values())
    return table_


def letters() -> np.ndarray:
    """The lower-case letter of every code point below 65536 that is a letter, blanks for the others."""
    out = np.full(65536, 32, np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def symbols(text: str | None, lut: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes of the text's letters in lower case, with one blank between words."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = lut[np.minimum(cp, 65535)]
    far = np.flatnonzero(cp > 65535)
    if len(far):
        s[far] = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 32 for c in map(chr, cp[far].tolist())]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    s = s[keep]
    s = s[1:] if len(s) and s[0] == 32 else s
    if len(s) and s.max() > 127:
        return np.frombuffer(s.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    return s.astype(np.uint8)


class Model:
    """languages; of each the numbers of the bytes it has (the last one for all others), an automaton and a pointer's bits."""

    def __init__(self, samples: dict[str, list[str]], chars: int = CHARS, memory: int = MEMORY):
        lut = letters()
        chars = max(1, min(chars, memory // max(1, len(samples) * 2 * 64 * 4)))
        texts = {}
        for k, v in sorted(samples.items()):
            parts, each = [bytes(symbols(t, lut)).decode() for t in v], -(-chars // max(1, len(v)))
            texts[k] = " ".join(p[:each] for p in parts if p)[:chars].encode()
        texts = {k: np.frombuffer(t, np.uint8) for k, t in texts.items() if t}
        self.languages, self.codes, self.tables = list(texts), [], []
        for t in texts.values():
            own = np.unique(t)
            codes = np.full(256, len(own), np.int32)
            codes[own] = np.arange(len(own))
            self.codes.append(codes)
            self.tables.append(automaton(codes[t].tolist(), len(own) + 1))
        self.bits = [math.log2(max(2, len(t))) for t in texts.values()]


def phrases(rows: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Phrases of every row of symbols; sizes descend. A row ends its last phrase."""
    n, width = rows.shape
    state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
    flat, size = trans.reshape(-1), trans.shape[1]
    alive = np.searchsorted(-sizes, -np.arange(width), "left")  # rows with more than j symbols
    for j in range(width):
        m = int(alive[j])
        if not m:
            break
        c, s = rows[:m, j], state[:m]
        to = flat.take(s * size + c)
        failed = np.flatnonzero(to < 0)
        if len(failed):
            began = s[failed] > 0  # a phrase was open: it ends before this symbol
            count[failed] += began
            again = flat.take(c[failed].astype(np.int32))
            single = again < 0  # the symbol never occurs in training: a phrase by itself
            count[failed] += single
            to[failed] = np.where(single, 0, again)
        state[:m] = to
    return count + (state > 0)


def classify(texts: list[str | None], model: Model, lut: np.ndarray) -> tuple[list[str], list[float]]:
    segs, owner = [], []
    total = np.zeros(len(texts))
    has = [False] * len(texts)
    for i, t in enumerate(texts):
        s = symbols(t, lut)
        has[i] = bool(len(s))
        total[i] = max(1, len(s))
        for a in range(0, len(s), SEGMENT):
            segs.append(s[a : a + SEGMENT])
            owner.append(i)
    k = len(model.languages)
    entropy = np.zeros((len(texts), k))
    if segs and k:
        sizes = np.array([len(s) for s in segs])
        order = np.argsort(-sizes, kind="stable")
        rows = np.zeros((len(segs), SEGMENT), np.uint8)
        for r, o in enumerate(order.tolist()):
            rows[r, : sizes[o]] = segs[o]
        who = np.array(owner)[order]
        for j in range(k):
            entropy[:, j] = np.bincount(who, phrases(model.codes[j][rows], sizes[order], model.tables[j]), len(texts)) * model.bits[j] / total
    names, scores = [], []
    for i in range(len(texts)):
        if not has[i] or not k:
            names.append("und")
            scores.append(0.0)
            continue
        best = int(np.argmin(entropy[i]))
        rest = np.delete(entropy[i], best)
        names.append(model.languages[best])
        scores.append(float(1 - entropy[i, best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
    return names, scores


def learn(docs: DataFrame, *, mod: int = MOD, rest: int = REST, sample: int = SAMPLE, chars: int = CHARS) -> Model:
    size = F.lit(max(200, 2 * chars // sample))  # of a piece, blanks and marks included
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    rows = docs.select("doc_id", "lang", F.substr("text", place, size).alias("t")).where(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    samples: dict[str, list[str]] = {}
    for r in spread_sample(rows, "lang", sample, "lang", "t"):
        samples.setdefault(r["lang"], []).append(r["t"])
    return Model(samples, chars)


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred and score, one row per row of docs. The model (at most MEMORY or so) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        lut = letters()
        return lambda texts: list(classify(texts, m, lut))

    return with_text_columns(docs, list(keep), make, "lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "lang_pred", "score")
