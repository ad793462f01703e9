"""Usage from transcripts of assistants: JSON lines of any shape, two folder layouts, sums per session, model and skill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.metrics import zulu_millis
from tracelake.operators import folds


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """path, line, value of <folder>/<session>.jsonl and <folder>/<session>/subagents/*.jsonl; no other folder is read."""
    root = folder.rstrip("/")
    out = None
    for pattern in (f"{root}/*.jsonl", f"{root}/*/subagents/*.jsonl"):
        try:
            some = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line")).alias("line"), "value")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], "path string, line struct<at:bigint,line:bigint>, value string")


def usage(lines: DataFrame) -> DataFrame:
    """session, path, line, message_id, model, skill, token counts and ts of the lines that report an assistant's usage.

    The session is the file's stem, or the folder above `subagents`. The cache writes are split by their age if they come as
    an object, else the flat count is of five minutes. Counts that are no whole numbers of 0 or more count 0."""
    v = F.try_parse_json("value")
    text = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", f"$.{p}", "variant"))
    count = lambda p: F.coalesce(F.when((kind(p) == "BIGINT") & (F.try_variant_get("v", f"$.{p}", "bigint") >= 0), F.try_variant_get("v", f"$.{p}", "bigint")), F.lit(0).cast("bigint"))
    said = lambda p: F.when(kind(p) == "STRING", text(p))
    u = "message.usage"
    split = F.coalesce(kind(f"{u}.cache_creation").startswith("OBJECT"), F.lit(False))
    five, hour, flat = count(f"{u}.cache_creation.ephemeral_5m_input_tokens"), count(f"{u}.cache_creation.ephemeral_1h_input_tokens"), count(f"{u}.cache_creation_input_tokens")
    parts = F.split("path", "/")
    nested = F.element_at(parts, -2) == "subagents"
    session = F.when((F.size(parts) > 2) & nested, F.element_at(parts, -3)).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""))
    d = lines.where(F.trim("value") != "").select("path", "line", F.inline(F.array(F.struct(v.alias("v"))))).where("v is not null").where((said("type") == "assistant") & said("message.id").isNotNull() & F.try_variant_get("v", f"$.{u}", "variant").isNotNull())
    return d.select(
        session.alias("session"), "path", "line", text("message.id").alias("message_id"), F.coalesce(said("message.model"), F.lit("unknown")).alias("model"), F.coalesce(F.nullif(said("attributionSkill"), F.lit("")), F.lit("other")).alias("skill"),
        count(f"{u}.input_tokens").alias("input"), F.when(split, five + hour).otherwise(flat).alias("cache_creation"), count(f"{u}.cache_read_input_tokens").alias("cache_read"), count(f"{u}.output_tokens").alias("output"),
        F.when(split, five).otherwise(flat).alias("cache_creation_5m"), F.when(split, hour).otherwise(F.lit(0).cast("bigint")).alias("cache_creation_1h"), F.coalesce(zulu_millis(F.coalesce(said("timestamp"), F.lit(""))), F.lit(0).cast("bigint")).alias("ts"),
    )


def kept(use: DataFrame) -> DataFrame:
    """One row per message id, over all files: the first by path, component by component, and line."""
    order = use.withColumn("__parts", F.split("path", "/"))
    return folds.first_wins(order, "message_id", ["__parts", "line"]).drop("__parts")


def buckets(use: DataFrame, project: str | None = None) -> DataFrame:
    """Ledger rows: sums of the kept messages by session, model and skill."""
    sums = [F.sum(c).alias(c) for c in ("input", "cache_creation", "cache_read", "output", "cache_creation_5m", "cache_creation_1h")]
    g = kept(use).groupBy(F.col("session").alias("session_id"), "model", "skill").agg(*sums, F.count("*").alias("messages"), F.greatest(F.max("ts"), F.lit(0)).alias("last_ts"))
    return g.select(F.lit(project).cast("string").alias("project_id"), "session_id", "model", "skill", F.struct("input", "cache_creation", "cache_read", "output").alias("tokens"), "cache_creation_5m", "cache_creation_1h", "messages", "last_ts")


def outcome(use: DataFrame, fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: messages kept, duplicates left out, sessions, records to append and records the store holds unchanged."""
    k = kept(use).agg(F.count("*").alias("messages"), F.count_distinct("session").alias("sessions"))
    n = use.agg(F.count("*").alias("all"))
    new = folds.changed_only(fresh, stored.select(*fresh.columns)).agg(F.count("*").alias("records"))
    total = fresh.agg(F.count("*").alias("buckets"))
    one = k.join(F.broadcast(n)).join(F.broadcast(new)).join(F.broadcast(total))  # a row each
    return one.select("messages", (F.col("all") - F.col("messages")).alias("duplicates"), "sessions", "records", (F.col("buckets") - F.col("records")).alias("unchanged"))
