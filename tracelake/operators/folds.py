"""Order-dependent folds as windows and ordered aggregates. seq is the position in the store, the only total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUPERVISION = ("architect_verdict", "bounces_to_approval", "bugs_filed", "warnings")


def phase_key() -> Column:
    """By path where the record has one, else by phase and project; a path never equals an id."""
    return F.when(F.col("phase_doc_path").isNotNull(), F.struct(F.lit("path").alias("kind"), F.col("phase_doc_path").alias("a"), F.lit("").alias("b"))).otherwise(
        F.struct(F.lit("id").alias("kind"), F.col("phase_id").alias("a"), F.coalesce("project_id", F.lit("")).alias("b"))
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """One review per key: greatest ts, of equals the first in the store."""
    r = reviews.select(phase_key().alias("key"), F.struct("ts", (-F.col("seq")).alias("back")).alias("o"), F.struct(*SUPERVISION, "failure_class").alias("review"))
    return r.groupBy("key").agg(F.max_by("review", "o").alias("review"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Adds key and latest: true on every run whose ts is its key's greatest (all of equals)."""
    keyed = runs.withColumn("key", phase_key())
    return keyed.withColumn("latest", F.rank().over(Window.partitionBy("key").orderBy(F.col("ts").desc())) == 1)


def fold_reviews(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Runs, the latest ones of each reviewed key with the latest review's supervision fields, nulls included."""
    joined = latest_runs(runs).join(latest_reviews(reviews), "key", "left")
    hit = F.col("latest") & F.col("review").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col(f"review.{c}")).otherwise(F.col(c)) for c in SUPERVISION}).drop("key", "latest", "review")


def last_write_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key (null keys are keys), with first_seq, the key's first position, as place in the result."""
    packed = F.struct(*rows.columns)
    g = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(packed, "seq").alias("r"), F.min("seq").alias("first_seq"))
    return g.select("r.*", "first_seq")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    g = rows.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return g.select("r.*")


def changed_only(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of fresh that stored does not hold with the same values in every column; nulls are equal."""
    same = [fresh[c].eqNullSafe(stored[c]) for c in fresh.columns]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return fresh.join(stored, cond, "left_anti")
