"""Scorecard, capability profile, cost to ship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import metrics as m
from tracelake.operators import folds

DIMENSIONS = ("model", "tag", "settings")


def filtered(runs: DataFrame, model: str | None, tags: list[str]) -> DataFrame:
    out = runs if model is None else runs.where(F.col("model") == model)
    return out.where(m.has_tags(tags)) if tags else out


def scorecard(runs: DataFrame, dimension: str, *, model: str | None = None, tags: list[str] | None = None, min_runs: int = 0) -> DataFrame:
    """One row per (model, key). Untagged runs vanish by tag, a repeated tag counts again. Order: key, runs descending, model."""
    r = filtered(runs, model, tags or [])
    key = {"model": F.lit(""), "tag": F.explode("tags"), "settings": m.settings_label()}[dimension]
    r = r.withColumn("key", key)
    rate = lambda c: F.avg(c.cast("double"))
    measured = F.col("context_efficiency.peak_context_pct") > 0
    verdict = F.col("architect_verdict")
    out = r.groupBy("model", "key").agg(
        F.count("*").alias("n_runs"), rate(m.gates_all_pass()).alias("gates_pass_rate"), F.avg("parse_failure_rate").alias("parse_failure_rate_mean"), F.avg("length_finish_rate").alias("length_finish_rate_mean"),
        F.avg("repairs_per_call").alias("repairs_per_call_mean"), F.avg("tool_success_rate").alias("tool_success_rate_mean"), rate(F.col("verifier_retries")).alias("verifier_retries_mean"), rate(F.col("turns")).alias("turns_mean"),
        F.avg("wall_clock_s").alias("wall_clock_s_mean"), rate(F.col("escalated")).alias("escalation_rate"), F.count("architect_verdict").alias("n_with_verdict"), rate(verdict == "approved_first_try").alias("approved_first_try_rate"),
        rate(F.col("bounces_to_approval")).alias("bounces_to_approval_mean"), F.avg(F.when(measured, F.col("context_efficiency.peak_context_pct"))).alias("peak_context_pct_mean"), rate(F.when(measured, m.reclaimed_total())).alias("tokens_reclaimed_mean"),
    )
    return out.where(F.col("n_runs") >= min_runs).orderBy("key", F.col("n_runs").desc(), "model")


def failure_ranking(runs: DataFrame, reviews: DataFrame, *, model: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Per (model, tag): how often each failure class was given to the latest runs, and its rank. Which run is latest is
    decided over all runs, before any filter."""
    r = filtered(folds.latest_runs(runs).where("latest"), model, tags or []).join(folds.latest_reviews(reviews), "key")
    hits = r.select("model", F.explode("tags").alias("tag"), "review").select("model", "tag", F.explode("review.failure_class").alias("failure_class"))
    n = hits.where("failure_class <> 'none'").groupBy("model", "tag", "failure_class").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return n.withColumn("rank", F.row_number().over(Window.partitionBy("model", "tag").orderBy(F.col("n").desc(), "failure_class")))


def cost_to_ship(runs: DataFrame, reviews: DataFrame, *, model: str | None = None) -> DataFrame:
    """Per reviewed phase: attempts and summed tokens (saturating at 32 bits), metadata of its latest attempt (first of equals), whether it shipped."""
    r = filtered(runs, model, []).withColumn("key", folds.phase_key())
    total = lambda c: F.least(F.sum(f"tokens.{c}"), F.lit(m.U32).cast("long")).alias(c)
    last = F.max_by(F.struct("phase_id", "milestone_id", "project_id"), F.struct("ts", (-F.col("seq")).alias("b")))
    g = r.groupBy("key").agg(F.count("*").alias("attempts"), total("input_tokens"), total("output_tokens"), total("cache_read_tokens"), total("cache_write_tokens"), last.alias("x"))
    g = g.join(folds.latest_reviews(reviews), "key")
    return g.select("x.*", "attempts", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", F.coalesce(m.shipped(F.col("review.architect_verdict")), F.lit(False)).alias("shipped")).orderBy(F.col("milestone_id").asc_nulls_first(), "phase_id")


def profile(runs: DataFrame, reviews: DataFrame, *, model: str | None = None, tags: list[str] | None = None, min_runs: int = 0) -> DataFrame:
    """One row per (model, tag): strengths over all its runs, n_reviews of its latest ones, and their failure classes, the most
    frequent first, as array of (failure_class, n). Which run is latest is decided over all runs, before any filter."""
    folded = folds.fold_reviews(runs, reviews)
    rate = lambda c: F.avg(c.cast("double"))
    verdict = F.col("architect_verdict")
    strengths = filtered(folded, model, tags or []).withColumn("tag", F.explode("tags")).groupBy("model", "tag").agg(
        F.count("*").alias("n_runs"), rate(m.gates_all_pass()).alias("gates_pass_rate"), F.avg("tool_success_rate").alias("tool_success_rate_mean"), F.avg("parse_failure_rate").alias("parse_failure_rate_mean"), rate(F.col("escalated")).alias("escalation_rate"),
        F.count("architect_verdict").alias("n_with_verdict"), rate(verdict == "approved_first_try").alias("approved_first_try_rate"), rate(F.col("bounces_to_approval")).alias("bounces_to_approval_mean"),
    )
    hits = filtered(folds.latest_runs(runs).where("latest"), model, tags or []).join(folds.latest_reviews(reviews), "key").select("model", F.explode("tags").alias("tag"))
    counts = failure_ranking(runs, reviews, model=model, tags=tags).groupBy("model", "tag").agg(F.sort_array(F.collect_list(F.struct("rank", "failure_class", "n"))).alias("x"))
    out = strengths.join(hits.groupBy("model", "tag").agg(F.count("*").alias("n_reviews")), ["model", "tag"], "left").join(counts, ["model", "tag"], "left")
    out = out.withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0).cast("bigint"))).withColumn("failure_classes", F.transform("x", lambda c: F.struct(c["failure_class"].alias("failure_class"), c["n"].alias("n")))).drop("x")
    return out.where(F.col("n_runs") >= min_runs).orderBy("tag", F.col("n_runs").desc(), "model")


def by_id(runs: DataFrame, prefix: str) -> DataFrame:
    """The one run whose id begins with prefix; an error if none or several do."""
    found = runs.withColumn("run_id", m.run_id(F.col("ts"), F.col("model"), F.col("phase_id"))).where(F.col("run_id").startswith(prefix))
    ids = [r["run_id"] for r in found.select("run_id").orderBy("run_id").limit(11).collect()]
    if not ids:
        raise LookupError(f"no run matches id '{prefix}'")
    if len(ids) > 1:
        raise LookupError(f"id '{prefix}' is ambiguous: {', '.join(ids[:10])}{' ...' * (len(ids) > 10)}")
    return found


def run_table(runs: DataFrame, now: int) -> DataFrame:
    """The cells of the run listing, newest first."""
    from tracelake.functions import present as p

    gate = lambda g: p.gate_cell(F.col(f"gates.{g}"))
    t = runs.select(
        "seq", "ts", m.run_id(F.col("ts"), F.col("model"), F.col("phase_id")).alias("run_id"), p.age(F.greatest(F.lit(now) - F.col("ts"), F.lit(0))).alias("age"), "model", p.phase_label(F.col("phase_doc_path"), F.col("phase_id")).alias("phase"), "status",
        F.concat(*[gate(g) for g in ("fmt", "build", "lint", "test")]).alias("gates"), m.compact_count(F.col("tokens.input_tokens")).alias("input"), m.compact_count(F.col("tokens.output_tokens")).alias("output"),
        p.speed_cell(m.tokens_per_second(F.col("tokens.output_tokens"), F.col("gen_time_s"))).alias("speed"), m.compact_count(m.reclaimed_total()).alias("reclaimed"), m.settings_label().alias("settings"),
    )
    return t.orderBy(F.col("ts").desc(), "seq").drop("ts")
