"""Session logs: one JSON-lines file per session, each line a record of ts, turn and one event of seventeen kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.functions import text as t

_DIAGNOSTIC = "struct<path:string,line:bigint,column:bigint,severity:string,message:string,code:string>"
#: The payloads of all kinds side by side; fields that a kind does not have are null. JSON of unknown shape is kept as text.
EVENT = (
    "struct<event_type:string,session_id:string,model:string,phase:string,rendered:string,raw:string,tool_call:struct<name:string,arguments:string>,"
    f"failure:struct<raw:string,detected_format:string,feedback:string>,name:string,succeeded:boolean,output_preview:string,output_bytes:bigint,diagnostics:array<{_DIAGNOSTIC}>,"
    "reason:string,turn:bigint,stage:string,files_changed:array<struct<path:string,added:bigint,removed:bigint>>,message:string,status:string,turns:bigint,"
    "input_tokens:bigint,output_tokens:bigint,context_pct:double,context_used:bigint,context_window:bigint,tokens_before:bigint,tokens_after:bigint,"
    "messages_signaturized:bigint,messages_evicted:bigint,filter:string,path:string,reads_evicted:bigint,tokens_reclaimed:bigint,tokens_saved:bigint,prior_turn:bigint,"
    "id:string,title:string,state:string,window:bigint,distinct_targets:bigint>"
)
KINDS = [
    "session_start", "prompt", "completion", "parsed", "parse_failed", "tool_result", "verify", "hard_fail", "progress", "session_end", "metrics", "compaction", "output_filtered",
    "read_evicted", "read_deduped", "task_update", "novelty_sample",
]
#: Free text of an event that may hold secrets.
_SECRET = ("rendered", "raw", "output_preview", "reason", "message", "title")


def parsed(lines: DataFrame) -> DataFrame:
    """session, seq, ts, turn, event, arguments and value (the line as it stands) of (session, seq, value). No version is asked
    for; blank, malformed, ill-typed lines and unknown kinds are left out. arguments: a call's, with sorted keys, so that
    equal ones are equal text."""
    r = F.from_json("value", f"ts bigint, turn bigint, event {EVENT}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # a generator keeps the optimiser from putting the parse into every expression that uses a field of it
    out = lines.select("session", "seq", "value", F.inline(F.array(F.struct(r.alias("r"))))).where(F.col("r._bad").isNull() & F.col("r.ts").isNotNull() & F.col("r.turn").isNotNull() & F.col("r.event.event_type").isin(KINDS))
    return out.select("session", "seq", "r.ts", "r.turn", "r.event", F.to_json(F.try_parse_json("r.event.tool_call.arguments")).alias("arguments"), "value")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all logs in a folder, in order of (session, seq): session is the file's name, seq orders a file's lines."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.jsonl").select(F.col("_metadata.file_name").alias("session"), F.col("_metadata.file_block_start").alias("at"), "value")
    # lines of a block come in order; blocks of a file are ordered by where they begin
    return parsed(files.select("session", F.struct("at", F.monotonically_increasing_id().alias("line")).alias("seq"), "value"))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """name, modified (ms) of the logs in a folder; only names and times are read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_millis("modificationTime").alias("modified"))


def latest(logs: DataFrame) -> str | None:
    """The log changed last; of equal times the first by name."""
    r = logs.orderBy(F.col("modified").desc(), "name").select("name").first()
    return r and r["name"]


def resolved(logs: DataFrame, needle: str | None = None) -> str | None:
    """The latest log, or the first by name that contains the needle."""
    if needle is None:
        return latest(logs)
    r = logs.where(F.contains("name", F.lit(needle))).orderBy("name").select("name").first()
    return r and r["name"]


def redacted(event: Column) -> Column:
    """Secrets masked field by field, in tool arguments too, so that the record always stays a record."""
    call, args = event["tool_call"], event["tool_call"]["arguments"]
    masked = t.redact_secrets(args)
    safe = F.coalesce(F.to_json(F.try_parse_json(masked)), F.to_json(F.struct(masked.alias("redacted"))))
    parts = []
    for f in StructType.fromDDL(f"e {EVENT}")["e"].dataType.names:
        if f == "tool_call":
            parts.append(F.when(call.isNotNull(), F.struct(call["name"].alias("name"), F.when(args.isNotNull(), safe).alias("arguments"))).alias(f))
        else:
            parts.append((t.redact_secrets(event[f]) if f in _SECRET else event[f]).alias(f))
    return F.struct(*parts)


def append(records: DataFrame, path: str) -> None:
    """Writes records (ts, turn, event) as JSON lines with secrets masked; null fields are left out."""
    records.select(F.to_json(F.struct("ts", "turn", redacted(F.col("event")).alias("event"))).alias("value")).write.mode("append").text(path)


def replayed(log: DataFrame) -> DataFrame:
    """Per session what calibration needs: model and outcome, the last that was said ('(unknown)' and 'unknown' if none was)."""
    last = lambda kind, field: F.max_by(F.col(f"event.{field}"), F.when(F.col("event.event_type") == kind, F.col("seq")))
    return log.groupBy("session").agg(F.coalesce(last("session_start", "model"), F.lit("(unknown)")).alias("model"), F.coalesce(last("session_end", "status"), F.lit("unknown")).alias("outcome"))
