"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a sequence of tokens: runs of at most 12 characters without ASCII white space, East Asian characters one by one. A
longer run is cut by its content: a token ends with a vowel, a mark, one of some digits or a character outside ASCII; where none is
near, characters stand alone; the last 12 or fewer characters are one token. Where a token ends depends only on what follows
its beginning, so text that is shifted, with or without blanks, is soon cut at the same places again.
Every k-gram of tokens has the rolling polynomial hash of its tokens' hashes modulo 2^31 - 1 (k terms; with k of 3 no longer than
a rolled update); the least hash of every window of w
is chosen. Hash and position share one long, (hash, -position), so that the least long is the least hash and, among equal
ones, the rightmost. Distinct minima, in order, are the fingerprint; their positions (token numbers) are kept. Any two
texts that share w + k - 1 tokens in a row share a fingerprint member.

The next document (descending doc_id) comes from a window function inside buckets of neighbouring ids; bucket bounds are
approximate quantiles of doc_id (at most BUCKETS, the only thing the driver sees). The first document of each bucket is
also dealt, as a ghost, to the bucket before it, so texts are shuffled once.

Defined cases: null counts as the empty text; a text of fewer than k tokens has one member, the hash of the whole
text; two equal fingerprints have likeness 1; equal doc_ids are ordered by their texts' hash; null doc_ids come last; a
table of one row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import table

K, W, PRIME, BASE, BUCKETS, ROWS = 3, 3, (1 << 31) - 1, 1_000_003, 16_384, 512


_EAST = r"\x{2E80}-\x{D7FF}\x{20000}-\x{3FFFF}"
#: Characters that no cut follows: in longer runs a token ends with any other.
_INNER = "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ5-9+%~"
TOKEN = rf"[{_EAST}]|[^\s{_EAST}]{{1,12}}(?![^\s{_EAST}])|[{_INNER}]{{0,23}}[^\s{_INNER}{_EAST}]|[^\s{_EAST}]"


def minima(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds column out: the distinct window minima of a text in order, each (hash << 32) + (2^32 - 1 - position)."""
    h = f"__{out}"
    last = (1 << 32) - 1
    df = df.withColumn(h, F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda c: F.hash(c).cast("long").bitwiseAND(PRIME) % PRIME))
    roll = "a"
    for j in range(1, k):
        roll = f"({roll} * {BASE}L + get({h}, i + {j})) % {PRIME}L"
    short = F.array(F.shiftleft(F.hash(text).cast("long").bitwiseAND(PRIME) % PRIME, 32) + F.lit(last))
    n = F.size(h)
    df = df.select("*", F.when(n < k, short).otherwise(F.slice(F.expr(f"transform({h}, (a, i) -> shiftleft({roll}, 32) + ({last}L - i))"), 1, F.greatest(n - (k - 1), F.lit(1)))).alias(f"{h}2")).drop(h)
    more = ", ".join(f"get({h}2, i + {j})" for j in range(1, w))  # null beyond the end, which least() skips
    least = F.expr(f"transform({h}2, (a, i) -> least(a, {more}))") if w > 1 else F.col(f"{h}2")
    chosen = F.array_distinct(F.slice(least, 1, F.greatest(F.size(f"{h}2") - (w - 1), F.lit(1))))
    return df.withColumn(out, chosen).drop(f"{h}2")


def position(v: Column) -> Column:
    """Of the packed long: the number of the k-gram's first token."""
    return (F.lit((1 << 32) - 1) - v.bitwiseAND((1 << 32) - 1)).cast("int")


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda v: F.shiftright(v, 32).cast("int")))


def fingerprints(docs: DataFrame, *, k: int = K, w: int = W) -> DataFrame:
    """doc_id, text, n_chars, selected: array of (hash, position) in order. One row per row of docs."""
    d = minima(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "mins", k, w)
    pairs = F.transform("mins", lambda v: F.struct(F.shiftright(v, 32).cast("int").alias("hash"), position(v).alias("position")))
    return d.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), pairs.alias("selected"))


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def printed(fp: str) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(PRIME)), 8, "0")), ""))


def with_next(rows: DataFrame, *cols: str) -> DataFrame:
    """Adds next_<col>: that column of the row which follows in descending doc_id, the first one's after the last."""
    spark, half = rows.sparkSession, 64
    ids = rows.select("doc_id")
    n = ids.count()
    if not n:
        return rows.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in cols])
    parts = max(1, min(BUCKETS, n // ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0]
    cuts = sorted(set(cuts or []))[: parts - 1] if parts > 1 else []
    fine, coarse = F.array(*[F.lit(x) for x in cuts]).cast("array<bigint>"), F.array(*[F.lit(x) for x in cuts[::half]]).cast("array<bigint>")
    below = lambda arr: F.size(F.filter(arr, lambda x: x <= F.col("doc_id")))
    at = F.greatest(below(coarse) - 1, F.lit(0)) * half
    bucket = F.coalesce(at + F.size(F.filter(F.slice(fine, at + 1, half), lambda x: x <= F.col("doc_id"))), F.lit(-1)) if cuts else F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    heads = ids.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.max("doc_id").alias("head")).orderBy("b").collect()  # at most BUCKETS + 1 rows
    order = [r["b"] for r in heads]
    pairs = [(r["head"], order[(i + 1) % len(order)]) for i, r in enumerate(heads)]
    ghosts = spark.createDataFrame(pairs, "head long, b int")
    g = rows.join(F.broadcast(ghosts), rows["doc_id"].eqNullSafe(ghosts["head"])).select(*rows.columns, "b", F.lit(1).alias("ghost"))
    own = rows.select("*", bucket.cast("int").alias("b"), F.lit(0).alias("ghost"))
    w = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    led = own.unionByName(g).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return led.where("ghost = 0").drop("b", "ghost")


def edited(docs: DataFrame, *, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_text, fp, positions, edited_fp, next_fp: fingerprints of each text (with the places of all that
    was selected, in order), of its edit and of the next text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(minima(d, "text", "mins", k, w), "text", "mins")
    n = F.length("text")
    gone = F.floor(n / 3).cast("int")
    d = d.select("doc_id", "mins", hashes(F.col("next_mins")).alias("next_fp"), n.cast("long").alias("n_chars"), F.concat(F.left("text", n - gone), F.left("next_text", gone)).alias("edited_text"))
    d = minima(d, "edited_text", "edited", k, w)
    return d.select("doc_id", "n_chars", "edited_text", hashes(F.col("mins")).alias("fp"), F.transform("mins", position).alias("positions"), hashes(F.col("edited")).alias("edited_fp"), "next_fp")


def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edited(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), printed("fp").alias("fingerprint"),
        printed("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "positions",
    )
