"""Session logs: search, tail, turn, status, update intervals. Every order is (session, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.present import activity_switch


def clamp(limit: int, default: int, most: int = 50) -> int:
    return min(limit or default, most)


def search(log: DataFrame, *, event_type: str | None = None, tool: str | None = None, text: str | None = None, limit: int = 0) -> DataFrame:
    """The first matches in log order, of parsed session records: event_type is exact, tool a part of the name of a tool call or
    result (other events have none), text a part of the whole record as it is written, keys included, in any case as given."""
    out = log
    if event_type is not None:
        out = out.where(F.col("event.event_type") == event_type)
    if tool is not None:
        name = F.when(F.col("event.event_type") == "parsed", F.col("event.tool_call.name")).when(F.col("event.event_type") == "tool_result", F.col("event.name"))
        out = out.where(F.coalesce(F.contains(name, F.lit(tool)), F.lit(False)))
    if text is not None:
        out = out.where(F.contains("value", F.lit(text)))
    return out.orderBy("session", "seq").limit(clamp(limit, 20))


def truncated(found: int, limit: int = 0) -> bool:
    """Whether a search says that it was cut off. Its total comes from a search of its own, which the same limit of 50 cuts, so
    with that limit it never says so."""
    return min(found, clamp(50, 20)) > clamp(limit, 20)


def tail(log: DataFrame, limit: int = 0) -> DataFrame:
    """The last rows of every session, ascending."""
    k = F.row_number().over(Window.partitionBy("session").orderBy(F.col("seq").desc()))
    return log.withColumn("__k", k).where(F.col("__k") <= clamp(limit, 10)).drop("__k").orderBy("session", "seq")


def turn(log: DataFrame, number: int) -> DataFrame:
    return log.where(F.col("turn") == number)


def newest(runs: DataFrame, limit: int = 0) -> DataFrame:
    """Newest first, stable; 0 is no limit."""
    out = runs.orderBy(F.col("ts").desc(), "seq")
    return out.limit(limit) if limit else out


def _is(kind: str):
    return F.col("event.event_type") == kind


def _last(kind: str, field):
    """Of the group: the field of the last event of a kind."""
    return F.max_by(F.col(f"event.{field}") if isinstance(field, str) else field, F.when(_is(kind), F.col("seq")))


def intervals(log: DataFrame) -> DataFrame:
    """session, gap (ms since the record before, if later), rate (output tokens a second since the metrics before, if later)."""
    w = Window.partitionBy("session").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda c: F.last(F.when(_is("metrics"), c), ignorenulls=True).over(before)
    gap, dt = F.col("ts") - F.lag("ts").over(w), F.col("ts") - of(F.col("ts"))
    out = F.greatest(F.col("event.output_tokens") - of(F.col("event.output_tokens")), F.lit(0))
    return log.withColumns({"gap": F.when(gap > 0, gap), "rate": F.when(_is("metrics") & (dt > 0), out / (dt / 1000.0))})


def status(log: DataFrame) -> DataFrame:
    """The latest state of every session. Statistics of update intervals (whole milliseconds) and of throughput only where
    there are two or more. latest_turn is the last progress's, or of an end after it if that is higher."""
    w = Window.partitionBy("session")
    d = intervals(log).withColumn("progress_at", F.max(F.when(_is("progress"), F.col("seq"))).over(w))
    late = F.max(F.when(_is("session_end") & (F.coalesce(F.col("seq") > F.col("progress_at"), F.lit(True))), F.col("event.turns")))
    minus = lambda kind: F.sum(F.when(_is(kind), F.greatest(F.col("event.tokens_before") - F.col("event.tokens_after"), F.lit(0))).otherwise(0))
    total = lambda kind, c: F.sum(F.when(_is(kind), F.col(f"event.{c}")).otherwise(0))
    count = lambda kind: F.count_if(_is(kind))
    g = d.groupBy("session").agg(
        _last("session_start", "session_id").alias("session_id"), _last("session_start", "model").alias("model"), _last("session_start", "phase").alias("phase"),
        F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.greatest(F.coalesce(_last("progress", "turn"), F.lit(0)), F.coalesce(late, F.lit(0))).cast("bigint").alias("latest_turn"), F.count("*").alias("events"),
        _last("progress", "stage").alias("stage"), _last("progress", "message").alias("message"), _last("progress", "files_changed").alias("files_changed"), _last("session_end", "status").alias("ended"), _last("hard_fail", "reason").alias("hard_fail_reason"),
        count("parse_failed").alias("parse_failures"), _last("parse_failed", "failure.feedback").alias("parse_feedback"), _last("verify", F.size("event.diagnostics")).cast("bigint").alias("diagnostics"),
        _last("tool_result", "name").alias("last_tool"), _last("tool_result", "succeeded").alias("last_tool_ok"),
        _last("metrics", "input_tokens").alias("input_tokens"), _last("metrics", "output_tokens").alias("output_tokens"), _last("metrics", "context_pct").alias("context_pct"), _last("metrics", "context_used").alias("context_used"), _last("metrics", "context_window").alias("context_window"),
        count("compaction").alias("compactions"), total("compaction", "tokens_before").alias("compaction_before"), total("compaction", "tokens_after").alias("compaction_after"),
        count("output_filtered").alias("filtered"), minus("output_filtered").alias("filtered_tokens"), count("read_evicted").alias("evicted"), total("read_evicted", "tokens_reclaimed").alias("evicted_tokens"), count("read_deduped").alias("deduped"), total("read_deduped", "tokens_saved").alias("deduped_tokens"),
        F.count("gap").alias("gaps"), F.min("gap").alias("gap_min"), F.floor(F.sum("gap") / F.count("gap")).cast("long").alias("gap_avg"), F.max("gap").alias("gap_max"),
        F.count("rate").alias("rates"), F.min("rate").alias("rate_min"), F.avg("rate").alias("rate_avg"), F.max("rate").alias("rate_max"),
    )
    some = {c: F.when(F.col("gaps") >= 2, F.col(c)) for c in ("gap_min", "gap_avg", "gap_max")} | {c: F.when(F.col("rates") >= 2, F.col(c)) for c in ("rate_min", "rate_avg", "rate_max")}
    t = tasks(log).groupBy("session").agg(F.count("*").alias("tasks_total"), F.count_if(F.col("state") == "done").alias("tasks_done"), F.count_if(F.col("state") == "active").alias("tasks_active"))
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tasks_total", "tasks_done", "tasks_active")}
    return g.withColumns(some).join(t, "session", "left").withColumns(zero)


def tasks(log: DataFrame) -> DataFrame:
    """session, id, title, state of every task as it was last said, with place, where it was first seen."""
    u = log.where(_is("task_update"))
    g = u.groupBy("session", F.col("event.id").alias("id")).agg(F.max_by(F.struct("event.title", "event.state"), "seq").alias("x"), F.min("seq").alias("place"))
    return g.select("session", "id", "x.title", "x.state", "place")


def context_efficiency(log: DataFrame) -> DataFrame:
    """Per session: the highest context use and what compaction, filters, eviction and dedupe saved."""
    saved = F.greatest(F.col("event.tokens_before") - F.col("event.tokens_after"), F.lit(0))
    total = lambda kind, c: F.coalesce(F.sum(F.when(_is(kind), c)), F.lit(0)).cast("bigint")
    return log.groupBy("session").agg(
        F.greatest(F.coalesce(F.max(F.when(_is("metrics"), F.col("event.context_pct"))), F.lit(0.0)), F.lit(0.0)).alias("peak_context_pct"), F.count_if(_is("compaction")).alias("compaction_count"),
        total("compaction", saved).alias("compaction_tokens_reclaimed"), total("output_filtered", saved).alias("output_filtered_tokens"), total("read_evicted", F.col("event.tokens_reclaimed")).alias("read_evicted_tokens"), total("read_deduped", F.col("event.tokens_saved")).alias("read_deduped_tokens"),
    )


def run_rates(counts: DataFrame) -> DataFrame:
    """Adds the rates of a run to its counts: 0 where nothing was tried, but a null share of length-limited finishes."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.withColumns({
        "tool_success_rate": zero(share("successes", "calls")), "parse_failure_rate": zero(share("parse_failures", "parse_attempts")),
        "repairs_per_call": zero(share("repairs", "calls")), "length_finish_rate": share("length_finishes", "finishes"),
    })


#: What the one who ran a session counts beside its log.
COUNTED = "repairs bigint, finishes bigint, length_finishes bigint, verifier_retries bigint, gen_time_s double, gates struct<fmt:boolean,build:boolean,lint:boolean,test:boolean>, tags array<string>"


def run_record(log: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """One run per ended session: rates from its events, context efficiency, tokens of its last metrics, and what counted
    (session and the columns of COUNTED, a row a session) tells. A session that is not counted has no repairs, retries or
    finishes, thus no share of length-limited ones, and unknown gates."""
    counted = log.sparkSession.createDataFrame([], f"session {log.schema['session'].dataType.simpleString()}, {COUNTED}") if counted is None else counted
    counts = log.groupBy("session").agg(
        F.count_if(_is("tool_result") & F.col("event.succeeded")).alias("successes"), F.count_if(_is("tool_result")).alias("calls"), F.count_if(_is("parse_failed")).alias("parse_failures"), F.count_if(_is("parsed") | _is("parse_failed")).alias("parse_attempts"),
    )
    counts = counts.join(counted, "session", "left").fillna(0, ["repairs", "finishes", "length_finishes", "verifier_retries"]).fillna(0.0, ["gen_time_s"])
    s = status(log).where("ended is not null")
    r = s.join(run_rates(counts), "session").join(context_efficiency(log), "session")
    return r.select(
        "session", F.col("last_ts").alias("ts"), "model", F.col("phase").alias("phase_id"), F.col("ended").alias("status"), (F.col("ended") != "complete").alias("escalated"), F.col("latest_turn").alias("turns"),
        ((F.col("last_ts") - F.col("started_at")) / 1000).alias("wall_clock_s"), "tool_success_rate", F.col("parse_failure_rate"), "repairs_per_call", "length_finish_rate", "verifier_retries", "gen_time_s", "gates", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("input_tokens", F.lit(0).cast("bigint")).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0).cast("bigint")).alias("output_tokens"), "peak_context_pct", "compaction_count", "compaction_tokens_reclaimed", "output_filtered_tokens", "read_evicted_tokens", "read_deduped_tokens",
    )


def paired(log: DataFrame) -> DataFrame:
    """session, seq, name of every tool call with the seq and success of its result: the first result after it and before the
    next call; events of other kinds between them do not matter."""
    w = Window.partitionBy("session").orderBy("seq")
    own = log.where(_is("parsed") | _is("tool_result")).select("session", "seq", _is("parsed").alias("call"), F.col("event.tool_call.name").alias("name"), F.lead(_is("tool_result")).over(w).alias("answered"), F.lead("seq").over(w).alias("result_seq"), F.lead("event.succeeded").over(w).alias("succeeded"))
    return own.where("call").select("session", "seq", "name", F.when(F.col("answered"), F.col("result_seq")).alias("result_seq"), F.when(F.col("answered"), F.col("succeeded")).alias("succeeded"))


def visible(log: DataFrame, hidden: list[str]) -> DataFrame:
    """Without the events whose switch is off. Progress is off unless the caller says otherwise."""
    return log.where(~activity_switch(F.col("event.event_type")).isin(hidden)) if hidden else log


def elapsed(log: DataFrame) -> DataFrame:
    """Adds elapsed: milliseconds since the session's first record, before any filter."""
    first = F.first("ts").over(Window.partitionBy("session").orderBy("seq"))
    return log.withColumn("elapsed", F.greatest(F.col("ts") - first, F.lit(0)))


def duration(status: DataFrame, now: int) -> DataFrame:
    """Adds duration: of a running session until now, of an ended one until its last record."""
    return status.withColumn("duration", F.greatest(F.when(F.col("ended").isNull(), F.lit(now)).otherwise(F.col("last_ts")) - F.col("started_at"), F.lit(0)))


def progress(status: DataFrame) -> DataFrame:
    """Adds percent of tasks done (0 without tasks), how far compaction shrank the context (null if to nothing) and a band of use
    (null where it was not measured)."""
    pct = F.round(F.col("context_pct") * 100)
    return status.withColumns({
        "percent": F.when(F.col("tasks_total") > 0, F.round(100.0 * F.col("tasks_done") / F.col("tasks_total"))).otherwise(0.0).cast("bigint"),
        "ratio": F.when(F.col("compaction_after") > 0, F.col("compaction_before") / F.col("compaction_after")),
        "band": F.when(pct.isNull() | (F.col("context_pct") == 0), F.lit(None).cast("string")).when(pct >= 80, "high").when(pct >= 50, "middle").otherwise("low"),
    })


def tool_scores(log: DataFrame, succeeded: str) -> DataFrame:
    """Laplace-smoothed success of every tool."""
    s = F.count_if(F.expr(succeeded))
    return log.groupBy("tool").agg(F.count("*").alias("calls"), ((s + 1) / (F.count("*") + 2)).alias("score"))


def newest_changed(calls: DataFrame, most: int = 5) -> DataFrame:
    """session, path, last, rank: of every session the files that its calls (session, seq, tool, path, to) changed last. A moved
    file counts under its new name."""
    from tracelake.functions.present import mutates

    path = F.when(F.col("tool") == "move_file", F.col("to")).otherwise(F.col("path"))
    files = calls.where(mutates(F.col("tool"))).groupBy("session", path.alias("path")).agg(F.max("seq").alias("last")).where("path is not null")
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("last"), "path")).cast("long")
    return files.withColumn("rank", rank).where(F.col("rank") <= most)


def coverage(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """tasks (id) with the last state that states (id, seq, state) give them; pending where they give none."""
    last = states.groupBy("id").agg(F.max_by("state", "seq").alias("state"))
    return tasks.join(last, "id", "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def within_ttl(records: DataFrame, now: int, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """What pruning keeps: records (ts) not older than the time to live, which itself is kept."""
    return records.where(F.col("ts") >= max(now - ttl_ms, 0))
