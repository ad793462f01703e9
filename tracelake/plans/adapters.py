"""The engine's native tables, derived from the provided ones. Each is one SQL text that Spark and DuckDB both run, so that
an oracle differs from its query in the operator alone. {epoch} is the dialect's epoch milliseconds of a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_EPOCH = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {0})"
DUCK_EPOCH = "(epoch_us({0}) // 1000)"

RUNS = """
select o_orderkey as seq, {epoch:o_orderdate} as ts, o_orderpriority as model, cast(o_custkey as {string}) as phase_id,
 case when o_custkey % 3 <> 0 then concat('doc/', cast(o_custkey as {string})) end as phase_doc_path, o_orderstatus as tag1, c_mktsegment as tag2,
 o_orderstatus = 'P' as escalated, k > 0 and disc <= 0.09 as fmt, tax <= 0.07 as build, low >= 2 as lint,
 case when o_orderkey % 10 <> 0 then price >= 20000 end as test,
 (o_orderkey % 4) / cast(4 as double) as parse_failure_rate, (o_orderkey % 8) / cast(8 as double) as repairs_per_call,
 o_orderkey % 3 as verifier_retries, (o_orderkey % 16) / cast(16 as double) as tool_success_rate, cast(coalesce(k, 0) as bigint) as turns,
 cast(coalesce(qty, 0) as double) as wall_clock_s, cast(o_orderkey % 5 as double) as gen_time_s,
 coalesce(qty, 0) as input_tokens, coalesce(ext, 0) as output_tokens, coalesce(qty, 0) * 2 as cache_read_tokens, cast(coalesce(k, 0) as bigint) as cache_write_tokens,
 case when o_orderkey % 4 <> 0 then (o_orderkey % 4) / cast(4 as double) end as length_finish_rate,
 cast((o_orderkey % 5) * 20 as double) as peak_context_pct, o_orderkey % 11 * 10 as reclaimed,
 case o_orderkey % 3 when 1 then cast(0.5 as double) when 2 then cast(1 as double) end as temperature, case when o_orderkey % 2 = 0 then o_orderkey % 4 end as seed,
 concat('p', cast(o_custkey % 3 as {string})) as project_id, case when o_custkey % 5 <> 0 then concat('M', cast(o_custkey % 5 as {string})) end as milestone_id
from orders join customer on c_custkey = o_custkey
left join (select l_orderkey, count(*) as k, max(l_discount) as disc, max(l_tax) as tax, min(l_quantity) as low, max(l_extendedprice) as price,
  cast(sum(cast(l_quantity as bigint)) as bigint) as qty, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as ext from lineitem group by l_orderkey) l on l_orderkey = o_orderkey
"""

REVIEWS = """
select c_custkey as seq, cast({base} + (c_custkey % 7) * 1000 as bigint) as ts, cast(c_custkey - c_custkey % 2 as {string}) as phase_id,
 case when (c_custkey - c_custkey % 2) % 3 <> 0 then concat('doc/', cast(c_custkey - c_custkey % 2 as {string})) end as phase_doc_path,
 concat('p', cast((c_custkey - c_custkey % 2) % 3 as {string})) as project_id,
 case c_mktsegment when 'BUILDING' then 'approved_first_try' when 'MACHINERY' then 'approved_after_bounce' when 'HOUSEHOLD' then 'escalated' else 'rejected' end as verdict,
 cast(c_nationkey % 4 as bigint) as bounces, cast(c_nationkey % 5 as bigint) as bugs, case when c_nationkey % 3 = 0 then cast(c_nationkey as bigint) end as warnings,
 case c_nationkey % 4 when 0 then 'none' when 1 then 'logic_error' when 2 then 'spec_bug' else 'missed_test' end as class1, case c_nationkey % 2 when 0 then 'logic_error' else 'style' end as class2
from customer
"""

LEDGER = """
select l_orderkey * 10 + l_linenumber as seq, case when l_suppkey % 5 <> 0 then concat('p', cast(l_suppkey % 3 as {string})) end as project_id,
 concat('s', cast(l_suppkey as {string})) as session_id, l_returnflag as model, l_linestatus as skill, cast(l_quantity as bigint) as input, cast(floor(l_extendedprice) as bigint) as output,
 cast(l_partkey as bigint) as cache_read, cast(l_linenumber as bigint) as c5m, cast(l_orderkey % 100 as bigint) as c1h, {epoch:l_shipdate} as last_ts from lineitem
"""

SESSION = """
select cast(user_id as {string}) as session, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as seq, {epoch:ts} as ts,
 cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 4.0) as bigint) as turn0, event_type as tool, props as arguments, event_type = 'purchase' as mutating,
 cast(round(value * 100) as bigint) as output_bytes, event_id % 5 as errors, event_id % 9 = 0 as blank from events
"""

#: Steps of sessions with tools and arguments of the engine's own vocabulary.
STEPS = """
select cast(user_id as {string}) as session, cast(row_number() over (partition by user_id order by ts, event_id) * 3 as bigint) as seq, {epoch:ts} as ts, cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 4.0) as bigint) as turn,
 case event_type when 'purchase' then 'patch' when 'click' then 'read_file' when 'view' then 'search' when 'signup' then 'bash' else 'symbols' end as tool,
 case event_id % 4 when 0 then concat(chr(123), concat('"path":"p1"', chr(125))) when 1 then concat(chr(123), concat('"name":"n2"', chr(125))) when 2 then concat(concat(chr(123), '"command":"run '), concat(cast(event_id % 10 as {string}), concat('"', chr(125)))) else concat(chr(123), concat('"x":1', chr(125))) end as arguments,
 event_type = 'purchase' as mutating, cast(round(value * 100) as bigint) as output_bytes, event_id % 5 as errors, event_id % 3 = 0 as blank, concat('gate ', cast(event_id % 2 as {string})) as feedback from events
"""

#: Activities, some of them written twice for the same phase, kind and time.
ACTIVITIES = """
select o_orderkey as seq, {epoch:o_orderdate} as ts, cast(o_custkey % 40 as {string}) as phase_id, case o_orderkey % 3 when 0 then 'draft' when 1 then 'dispatch' else 'assist' end as activity,
 case when o_orderkey % 4 > 0 then o_orderstatus end as model, cast(floor(o_totalprice) as bigint) as input, concat('p', cast(o_custkey % 3 as {string})) as project_id from orders
"""

#: Session records: what each event of a session says.
LOG = """
select cast(user_id as {string}) as session, n as seq, {epoch:ts} as ts, cast(floor(n / 4.0) as bigint) as turn, event_id, v, n as n,
 case when n = 1 and user_id % 7 > 0 then 'session_start' when n = c and user_id % 3 > 0 then 'session_end' else case event_id % 13 when 0 then 'parsed' when 1 then 'tool_result' when 2 then 'verify' when 3 then 'completion' when 4 then 'metrics' when 5 then 'compaction' when 6 then 'output_filtered'
  when 7 then 'progress' when 8 then 'task_update' when 9 then 'read_evicted' when 10 then 'parse_failed' when 11 then 'read_deduped' else 'metrics' end end as event_type,
 event_type as word, concat('m', cast(user_id % 3 as {string})) as model, event_id % 2 = 0 as succeeded, cast(event_id % 4 as bigint) as diagnostics, cast(n * 100 as bigint) as input_tokens, cast(n * 10 + v % 50 as bigint) as output_tokens, (event_id % 100) / cast(100 as double) as context_pct,
 cast(v - event_id % 700 + 300 as bigint) as less, cast(event_id % 5 as {string}) as task, concat('t', cast(event_id % 7 as {string})) as title, case event_id % 3 when 0 then 'done' when 1 then 'active' else 'pending' end as state,
 case when event_id % 2 = 0 then 'complete' else 'hard_fail' end as status, cast(floor(n / 5.0) as bigint) as said_turn
from (select *, cast(round(value * 100) as bigint) as v, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as n, cast(count(*) over (partition by user_id) as bigint) as c from events) e
"""

#: Lines of assistants' transcripts: two layouts, repeated message ids, cache counts as object, number and absent, odd times.
TRANSCRIPTS = """
select case when event_id % 3 = 0 then concat(concat('/t/s', cast(user_id % 20 as {string})), '/subagents/a.jsonl') else concat(concat('/t/s', cast(user_id % 20 as {string})), '.jsonl') end as path, event_id as line,
 concat('s', cast(user_id % 20 as {string})) as session, case when event_id % 17 = 0 then 'user' else 'assistant' end as type, concat('id', cast(event_id % 4000 as {string})) as message_id,
 case when event_id % 5 > 0 then concat('m', cast(event_id % 2 as {string})) end as model, case event_id % 4 when 0 then '' when 1 then event_type end as skill, cast(round(value) as bigint) as input, event_id % 1000 as output, event_id % 300 as five, event_id % 70 as hour, event_id % 6 as shape,
 event_id % 11 > 0 as has_usage, {epoch:ts} as ts from events
"""

NAMES = {"log": LOG, "transcripts": TRANSCRIPTS, "activities": ACTIVITIES, "runs": RUNS, "reviews": REVIEWS, "ledger": LEDGER, "session": SESSION, "steps": STEPS}


def _text(name: str, epoch: str, string: str) -> str:
    sql = NAMES[name].replace("{string}", string).replace("{base}", "946684800000")
    while (at := sql.find("{epoch:")) >= 0:
        end = sql.index("}", at)
        sql = sql[:at] + epoch.format(sql[at + 7 : end]) + sql[end + 1 :]
    return sql


def duck(*names: str) -> str:
    """A WITH clause of the named tables for DuckDB."""
    return "with " + ",\n".join(f"{n} as ({_text(n, DUCK_EPOCH, 'varchar')})" for n in names)


def flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _text(name, SPARK_EPOCH, "string")
    frames = {}
    for t in ("orders", "customer", "lineitem", "events"):
        for before in ("from ", "join "):
            if f"{before}{t}" in sql:
                frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                sql = sql.replace(f"{before}{t}", f"{before}{{{t}}}")
    return spark.sql(sql, **frames)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flat(spark, sf_dir, "runs")
    return r.select(
        "seq", "ts", "model", F.struct("temperature", "seed").alias("generation_params"), "phase_id", "phase_doc_path", F.array("tag1", "tag2").alias("tags"),
        F.lit("complete").alias("status"), "escalated", F.struct("fmt", "build", "lint", "test").alias("gates"), "parse_failure_rate", "repairs_per_call", "verifier_retries",
        "tool_success_rate", "turns", "wall_clock_s", "gen_time_s", F.struct("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens").alias("tokens"),
        F.lit(None).cast("bigint").alias("warnings"), F.lit(None).cast("bigint").alias("bugs_filed"), F.lit(None).cast("bigint").alias("bounces_to_approval"), F.lit(None).cast("string").alias("architect_verdict"),
        "length_finish_rate", F.struct("peak_context_pct", F.lit(0).cast("bigint").alias("compaction_count"), F.col("reclaimed").alias("compaction_tokens_reclaimed"), F.lit(0).cast("bigint").alias("output_filtered_tokens"), F.lit(0).cast("bigint").alias("read_evicted_tokens"), F.lit(0).cast("bigint").alias("read_deduped_tokens")).alias("context_efficiency"),
        "project_id", "milestone_id",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flat(spark, sf_dir, "reviews")
    return r.select("seq", "ts", "phase_id", "phase_doc_path", "project_id", F.col("verdict").alias("architect_verdict"), F.col("bounces").alias("bounces_to_approval"), F.col("bugs").alias("bugs_filed"), "warnings", F.array("class1", "class2").alias("failure_class"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flat(spark, sf_dir, "ledger")
    return r.select("seq", "project_id", "session_id", "model", "skill", F.struct("input", (F.col("c5m") + F.col("c1h")).alias("cache_creation"), "cache_read", "output").alias("tokens"), F.col("c5m").alias("cache_creation_5m"), F.col("c1h").alias("cache_creation_1h"), F.lit(1).cast("bigint").alias("messages"), "last_ts")


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "session").withColumnRenamed("turn0", "turn")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "steps")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flat(spark, sf_dir, "activities")
    none = F.lit(0).cast("bigint")
    return r.select("seq", "ts", F.lit(None).cast("string").alias("phase_doc_path"), "phase_id", "project_id", F.lit(None).cast("string").alias("milestone_id"), "activity", F.lit(None).cast("string").alias("outcome"), "model", F.struct("input", none.alias("cache_creation"), none.alias("cache_read"), none.alias("output")).alias("tokens"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session records, read back from the lines they are written as."""
    from tracelake.sources import session_log

    r = flat(spark, sf_dir, "log")
    is_ = lambda *kinds: F.col("event_type").isin(*kinds)
    of = lambda kinds, c, name: F.when(is_(*kinds), c).alias(name)
    diagnostic = F.struct(F.lit("p").alias("path"), F.lit(1).alias("line"), F.lit("error").alias("severity"), F.lit("m").alias("message"))
    call = F.struct(F.col("word").alias("name"), F.struct(F.col("v").alias("z"), F.col("task").alias("a")).alias("arguments"))
    event = F.struct(
        "event_type", of(["session_start"], F.col("session"), "session_id"), of(["session_start"], F.col("model"), "model"), of(["session_start"], F.lit("phase-1"), "phase"), of(["parsed"], call, "tool_call"),
        of(["tool_result"], F.col("word"), "name"), of(["tool_result"], F.col("succeeded"), "succeeded"), of(["tool_result"], F.lit("out"), "output_preview"), of(["tool_result"], F.col("v"), "output_bytes"),
        of(["verify"], F.slice(F.array(diagnostic, diagnostic, diagnostic), 1, F.col("diagnostics").cast("int")), "diagnostics"), of(["completion"], F.concat(F.lit("<think>hm</think>"), "word"), "raw"),
        of(["metrics"], F.col("input_tokens"), "input_tokens"), of(["metrics"], F.col("output_tokens"), "output_tokens"), of(["metrics"], F.col("context_pct"), "context_pct"), of(["metrics"], F.col("v"), "context_used"), of(["metrics"], F.lit(65536), "context_window"),
        of(["compaction", "output_filtered"], F.col("v"), "tokens_before"), of(["compaction", "output_filtered"], F.col("less"), "tokens_after"), of(["progress"], F.col("said_turn"), "turn"), of(["progress"], F.col("title"), "stage"), of(["progress"], F.col("word"), "message"),
        of(["task_update"], F.col("task"), "id"), of(["task_update"], F.col("title"), "title"), of(["task_update"], F.col("state"), "state"), of(["read_evicted"], F.col("v"), "tokens_reclaimed"), of(["read_deduped"], F.col("v"), "tokens_saved"),
        of(["parse_failed"], F.struct(F.col("title").alias("feedback")), "failure"), of(["session_end"], F.col("status"), "status"), of(["session_end"], F.col("said_turn"), "turns"),
    )
    line = F.to_json(F.struct("ts", "turn", event.alias("event")))
    return session_log.parsed(r.select("session", "seq", F.inline(F.array(F.struct(line.alias("value"))))))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, value (JSON)."""
    r = flat(spark, sf_dir, "transcripts")
    split = F.struct(F.col("five").alias("ephemeral_5m_input_tokens"), F.col("hour").alias("ephemeral_1h_input_tokens"))
    plain = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("hour").alias("cache_read_input_tokens"), F.when(F.col("shape") > 1, F.col("five")).alias("cache_creation_input_tokens"), F.when(F.col("shape") % 2 == 0, split).alias("cache_creation"))
    message = F.struct(F.col("message_id").alias("id"), "model", F.when(F.col("has_usage"), plain).alias("usage"))
    time = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return r.select("path", "line", F.inline(F.array(F.struct(F.to_json(F.struct("type", F.when(F.col("shape") != 5, time).otherwise("soon").alias("timestamp"), F.col("skill").alias("attributionSkill"), message.alias("message"))).alias("value")))))
