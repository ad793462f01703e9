"""Names that are near each other, found without comparing all pairs.

Two names are at most d edits apart only if leaving out at most d characters of each can give the same text. So both sides
post all such remainders of their different names, meet by them, and only those that meet are compared. A name of n characters
posts some n * n / 2 remainders for two edits. Remainders are posted as hashes; chance meetings are told apart by the comparison.

Defined cases: null names meet nothing; equal names are at distance 0; repeated names are compared once; the empty name is a
name. Short names are near most others: the pairs are then the result, and as many as it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import bound


def remainders(name: Column, most: int) -> Column:
    """All texts that leaving out at most `most` characters gives, each once."""
    shorter = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
    out = level = F.array(name)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def near(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """left, right, distance of the different names (column name) of both sides that are at most `most` edits apart."""
    def posted(side: DataFrame, called: str) -> DataFrame:
        names = side.select(F.col("name").cast("string").alias(called)).where(F.col(called).isNotNull()).distinct()
        return names.select(called, F.explode(bound(F.col(called), lambda n: F.transform(remainders(n, most), lambda r: F.xxhash64(r)))).alias("rest"))

    met = posted(left, "left").join(posted(right, "right"), "rest").select("left", "right").where(F.abs(F.length("left") - F.length("right")) <= most).distinct()
    return met.select("left", "right", F.levenshtein("left", "right", most).cast("long").alias("distance")).where(F.col("distance").between(0, most))


def closest(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """name, nearest, distance: of every different name of left the nearest of right, of equally near ones the first."""
    n = near(left, right, most)
    best = n.groupBy(F.col("left").alias("name")).agg(F.min(F.struct("distance", "right")).alias("b"))
    return best.select("name", F.col("b.right").alias("nearest"), "b.distance")
