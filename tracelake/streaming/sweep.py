"""Streams: periodic harvest of rotated log files, and stateless change-gated following."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.folds import changed_only, last_write_wins


def follow(spark: SparkSession, path: str, schema: str, every: str = "500 milliseconds"):
    """A stream of JSON lines from files that are rotated, never appended to. Without a new file there is no batch. Returns (frame, trigger)."""
    return spark.readStream.schema(schema).json(path), {"processingTime": every}


def harvest_sweep(stream: DataFrame, ledger_path: str, keys: list[str], checkpoint: str, trigger: dict | None = None):
    """Appends the batch's buckets that the stored ledger does not hold yet, so a repeated harvest appends nothing. Rows carry seq."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = last_write_wins(batch, keys).drop("first_seq", "seq")
        try:
            stored = spark.read.parquet(ledger_path)
        except Exception as e:  # nothing is stored before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            fresh.withColumn("seq", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(ledger_path)
            return
        current = last_write_wins(stored, keys).drop("first_seq", "seq")
        changed_only(fresh, current.select(*fresh.columns)).withColumn("seq", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(ledger_path)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()


def due(spark: SparkSession, folder: str, watermark: int | None) -> int | None:
    """The time (ms) of the transcript changed last, if that is after the watermark; else null. Only names and times are read."""
    root, top = folder.rstrip("/"), None
    for pattern in (f"{root}/*.jsonl", f"{root}/*/subagents/*.jsonl"):
        try:
            files = spark.read.format("binaryFile").load(pattern)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        t = files.agg(F.max(F.unix_millis("modificationTime")).alias("t")).first()["t"]
        top = t if top is None else max(top, t or top)
    return top if top is not None and (watermark is None or top > watermark) else None


def sweep_once(spark: SparkSession, folder: str, watermark: int | None, merge) -> int | None:
    """merge(usage of all transcripts) if one changed after the watermark; the new watermark. If merge fails the watermark stays,
    so that the next sweep tries again."""
    from tracelake.operators import harvest

    now = due(spark, folder, watermark)
    if now is None:
        return watermark
    try:
        merge(harvest.usage(harvest.transcripts(spark, folder)))
    except Exception as e:
        spark.sparkContext._jvm.org.apache.logging.log4j.LogManager.getLogger("tracelake.sweep").warn(f"the sweep failed: {e}")
        return watermark
    return now


def newest_files(files: DataFrame, most: int = 20) -> DataFrame:
    """name of the `most` recovery files with the highest number, `cmd-output-<number>.log`; the others may go."""
    n = F.regexp_extract("name", r"^cmd-output-.*?([0-9]*)\.log$", 1).try_cast("bigint")
    return files.where(F.col("name").rlike(r"^cmd-output-.*\.log$")).orderBy(F.coalesce(n, F.lit(0)).desc(), "name").limit(most)
