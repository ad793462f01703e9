"""Stall and loop detectors over ordered tool calls, as window expressions, and their calibration.

A log has a row per step of a session: session, seq, tool, arguments (canonical JSON), mutating, output_bytes, errors, blank and
feedback. Distance is counted in rows, never in seq, which may begin anywhere and have gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import present

#: Thresholds where a caller gives none.
DEFAULTS = {
    "identical": 6, "persistence": 6, "output": 102_400, "empty": 3, "feedback": 5, "window": 8, "most": 2, "flood_window": 6, "flood_limit": 262_144, "stall": 60, "novelty_window": 24, "novelty_floor": 6,
}


def ordered():
    return Window.partitionBy("session").orderBy("seq")


def _trailing(n: int):
    return ordered().rowsBetween(1 - n, 0)


def call_key() -> Column:
    return F.to_json(F.struct("tool", "arguments"))


def read_target(tool: str = "tool", arguments: str = "arguments") -> Column:
    """What a call looks at, by the tool's category: a read its path or else name, a search its path or else `.`, a command
    its text without digits; any other call, and one without these, is itself."""
    field = lambda name: F.get_json_object(arguments, f"$.{name}")
    raw = F.concat(F.col(tool), F.lit("("), F.coalesce(F.col(arguments), F.lit("null")), F.lit(")"))
    kind = present.tool_category(F.col(tool))
    return (
        F.when(kind == "read", F.coalesce(field("path"), field("name"), raw))
        .when(kind == "search", F.coalesce(field("path"), F.lit(".")))
        .when(kind == "run", F.coalesce(F.translate(field("command"), "0123456789", ""), raw))
        .otherwise(raw)
    )


def _runs(log: DataFrame, broken) -> DataFrame:
    """Adds island: rows since the last break share a number."""
    return log.withColumn("island", F.sum(F.when(broken, 1).otherwise(0)).over(ordered()))


def identical_run(log: DataFrame) -> DataFrame:
    """Per session the longest run of equal (tool, arguments)."""
    same = F.lag("tool").over(ordered()).eqNullSafe(F.col("tool")) & F.lag("arguments").over(ordered()).eqNullSafe(F.col("arguments"))
    return _runs(log, ~same).groupBy("session", "island").agg(F.count("*").alias("n")).groupBy("session").agg(F.max("n").alias("value"))


def read_only_run(log: DataFrame) -> DataFrame:
    """Per session the longest run of calls that change nothing; 0 if none."""
    i = _runs(log, F.col("mutating")).groupBy("session", "island").agg(F.count_if(~F.col("mutating")).alias("n"))
    return i.groupBy("session").agg(F.max("n").alias("value"))


def persistence(log: DataFrame) -> DataFrame:
    """Per session the longest run of error counts above zero that never fall; a fall begins a new run of one; 0 if no count
    is above zero. Rows without a count are no sample."""
    e = F.col("errors")
    before = F.lag("errors").over(ordered())
    i = _runs(log.where("errors is not null"), (e == 0) | F.coalesce(e < before, F.lit(True)) | (before == 0))
    return i.groupBy("session", "island").agg(F.count_if(e > 0).alias("n")).groupBy("session").agg(F.max("n").alias("value"))


def oscillation(log: DataFrame, window: int = 8) -> DataFrame:
    """Per session the least number of distinct calls in a full window."""
    d = log.select("session", F.size(F.collect_set(call_key()).over(_trailing(window))).alias("d"), F.count("*").over(_trailing(window)).alias("k")).where(F.col("k") == window)
    return d.groupBy("session").agg(F.min("d").cast("long").alias("value"))


def flood(log: DataFrame, window: int = 6) -> DataFrame:
    """Per session the greatest output of a full window."""
    d = log.select("session", F.sum("output_bytes").over(_trailing(window)).alias("d"), F.count("*").over(_trailing(window)).alias("k")).where(F.col("k") == window)
    return d.groupBy("session").agg(F.max("d").alias("value"))


def novelty(log: DataFrame, window: int = 6) -> DataFrame:
    """A sample per full window of calls without a mutation between them: the distinct things they look at."""
    over = Window.partitionBy("session", "island").orderBy("seq").rowsBetween(1 - window, 0)
    i = _runs(log, F.col("mutating")).where("not mutating").select("session", "island", "seq", read_target().alias("target"))
    return i.select("session", F.size(F.collect_set("target").over(over)).cast("long").alias("value"), F.count("*").over(over).alias("k")).where(F.col("k") == window).select("session", "value")


def empty_run(log: DataFrame) -> DataFrame:
    """Per session the longest run of blank completions; 0 if none."""
    i = _runs(log, ~F.col("blank")).groupBy("session", "island").agg(F.count_if("blank").alias("n"))
    return i.groupBy("session").agg(F.max("n").alias("value"))


SIGNALS = {"identical_run": identical_run, "read_only_run": read_only_run, "persistence": persistence, "oscillation": oscillation, "flood": flood, "novelty": novelty, "empty_run": empty_run}


def samples(log: DataFrame, *, window: int = 8, flood_window: int = 6, novelty_window: int = 6) -> DataFrame:
    """signal, session, value of all seven signals. The log is shuffled and sorted once: every window is over (session, seq), and
    runs are counted by the distance to the last row that broke them."""
    w, n = ordered(), F.col("__n")
    same = F.lag("tool").over(w).eqNullSafe(F.col("tool")) & F.lag("arguments").over(w).eqNullSafe(F.col("arguments")) & (F.row_number().over(w) > 1)
    d = log.select("session", "seq", "mutating", "output_bytes", "blank", read_target().alias("__target"), call_key().alias("__key"), F.row_number().over(w).alias("__n"), same.alias("__same"))
    since = lambda broken: n - F.coalesce(F.max(F.when(broken, n)).over(w), F.lit(0))
    d = d.select(
        "session", "seq", "__n", "__target", (since(~F.col("__same")) + 1).alias("identical_run"), since(F.col("mutating")).alias("read_only_run"), since(~F.col("blank")).alias("empty_run"),
        F.when(n >= window, F.size(F.collect_set("__key").over(_trailing(window)))).alias("oscillation"), F.when(n >= flood_window, F.sum("output_bytes").over(_trailing(flood_window))).alias("flood"),
    )
    fresh = F.when(F.col("read_only_run") >= novelty_window, F.size(F.collect_set("__target").over(_trailing(novelty_window))))
    d = d.select("*", fresh.cast("long").alias("novelty"))
    top = ["identical_run", "read_only_run", "empty_run", "flood"]
    one = d.groupBy("session").agg(*[F.max(c).cast("long").alias(c) for c in top], F.min("oscillation").cast("long").alias("oscillation"))
    each = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("value")) for c in [*top, "oscillation"]])
    wide = one.select("session", F.explode(each).alias("x")).select("x.signal", "session", "x.value").unionByName(d.select(F.lit("novelty").alias("signal"), "session", F.col("novelty").alias("value"))).where("value is not null")
    return wide.unionByName(persistence(log).select(F.lit("persistence").alias("signal"), "session", F.col("value").cast("long").alias("value")))


_GROUP = ["signal", "model", "outcome"]


def value_counts(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What calibration needs of sessions: signal, model, outcome, value, n (samples of the value), and rows of null value with runs, the
    number of sessions that gave a sample. Over all models as '(all)' too. Counts of different sessions add up."""
    both = samples(log).join(outcomes, "session").withColumn("model", F.explode(F.array("model", F.lit("(all)"))))
    counts = both.groupBy(*_GROUP, "value").agg(F.count("*").alias("n")).withColumn("runs", F.lit(0).cast("bigint"))
    runs = both.select(*_GROUP, "session").distinct().groupBy(*_GROUP).agg(F.count("*").alias("runs"))
    return counts.unionByName(runs.select(*_GROUP, F.lit(None).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("n"), "runs"))


def percentiles(counts: DataFrame, min_runs: int = 0) -> DataFrame:
    """Percentiles by nearest rank from value_counts(), whose rows may be of many batches. Ranks come from how often each value
    occurs, so no group's samples are gathered in one row."""
    per_value = counts.where("value is not null").groupBy(*_GROUP, "value").agg(F.sum("n").alias("c"))
    runs = counts.groupBy(*_GROUP).agg(F.sum("runs").alias("runs"), F.sum("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*_GROUP).orderBy("value"))
    low = F.col("signal") == "oscillation"
    ranked = per_value.withColumn("upto", upto).join(runs, _GROUP)
    pick = lambda p: F.min(F.when(F.col("upto") > F.round(p * (F.col("n") - 1)), F.col("value")))
    two = lambda a, b: F.when(low, F.lit(a)).otherwise(F.lit(b))
    g = ranked.groupBy(*_GROUP).agg(F.first("runs").alias("runs"), F.first("n").alias("n"), pick(F.lit(0.5)).alias("p50"), pick(two(0.1, 0.9)).alias("near_tail"), pick(two(0.01, 0.99)).alias("far_tail"))
    return g.where((F.col("model") == "(all)") | (F.col("runs") >= min_runs))


def calibrate(log: DataFrame, outcomes: DataFrame, min_runs: int = 0) -> DataFrame:
    """Percentiles by nearest rank of every signal by (model, outcome), and over all models as '(all)'. outcomes: session, model, outcome.
    runs counts sessions, n samples; the least number of runs applies to the rows of one model only."""
    return percentiles(value_counts(log, outcomes), min_runs)


def calibrate_on(path: str, log: DataFrame, outcomes: DataFrame, min_runs: int = 0) -> DataFrame:
    """As calibrate(), over a corpus that grows: the counts of sessions counted before are in the table at path, and only those of
    new sessions of the log are worked out, and added in one write together with the sessions' names. A write that is lost has
    added nothing. A session is counted once, so only ended sessions should be given."""
    spark, kind = log.sparkSession, log.schema["session"].dataType
    stored = f"signal string, model string, outcome string, value bigint, n bigint, runs bigint, session {kind.simpleString()}"
    try:
        known = spark.read.schema(stored).parquet(path).where("session is not null").select("session")
    except Exception as e:  # nothing is stored before the first time
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], f"session {kind.simpleString()}")
    new = outcomes.join(known, "session", "left_anti")
    own = log.join(new.select("session"), "session", "left_semi")
    names = new.select(*[F.lit(None).cast(t).alias(c) for c, t in (("signal", "string"), ("model", "string"), ("outcome", "string"), ("value", "bigint"), ("n", "bigint"), ("runs", "bigint"))], "session")
    value_counts(own, new).withColumn("session", F.lit(None).cast(kind)).unionByName(names).write.mode("append").parquet(path)
    return percentiles(spark.read.schema(stored).parquet(path).where("signal is not null").drop("session"), min_runs)


def live(log: DataFrame, *, terminate_on_novelty: bool = False, **limits: int) -> DataFrame:
    """session, seq, detector of every step at which a live detector fires; of several the one listed first. limits: as in
    DEFAULTS. A stall or a novelty window of 0 is off; low novelty fires only if it is to terminate."""
    x = DEFAULTS | limits
    if unknown := limits.keys() - DEFAULTS.keys():
        raise ValueError(f"no such limit: {sorted(unknown)}")
    w = ordered()
    n = F.row_number().over(w)
    since = lambda broken: F.col("__n") - F.coalesce(F.max(F.when(broken, F.col("__n"))).over(w), F.lit(0))
    full = lambda k: F.col("__n") >= k
    mutated = lambda k: F.coalesce(F.bool_or("mutating").over(_trailing(k)), F.lit(False))
    distinct = lambda c, k: F.size(F.collect_set(c).over(_trailing(k)))
    earlier = F.last("errors", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = log.select("session", "seq", "mutating", "output_bytes", "errors", "blank", "feedback", read_target().alias("__target"), call_key().alias("__key"), n.alias("__n"), F.count("errors").over(w).alias("__c"), earlier.alias("__before"), (~F.lag("feedback").over(w).eqNullSafe(F.col("feedback"))).alias("__new"))
    e, at = F.col("errors"), lambda when: F.coalesce(F.max(F.when(when, F.col("__c"))).over(w), F.lit(0))  # rows without a count are no break
    streak = F.col("__c") - F.greatest(at(e == 0), at(e < F.col("__before")) - 1)
    off = F.lit(False)
    novel = full(x["novelty_window"]) & (since(F.col("mutating")) >= x["novelty_window"]) & (distinct("__target", x["novelty_window"]) <= x["novelty_floor"]) if x["novelty_window"] and terminate_on_novelty else off
    hit = (
        F.when(full(x["identical"]) & (distinct("__key", x["identical"]) == 1) & mutated(x["identical"]), "identical")
        .when(e.isNotNull() & (streak >= x["persistence"]), "persistence")
        .when(F.col("output_bytes") > x["output"], "runaway")
        .when(full(x["window"]) & mutated(x["window"]) & distinct("__key", x["window"]).between(2, x["most"]) if x["window"] else off, "oscillation")
        .when(full(x["flood_window"]) & (F.sum("output_bytes").over(_trailing(x["flood_window"])) > x["flood_limit"]) if x["flood_window"] else off, "flood")
        .when(novel, "novelty")
        .when(since(F.col("mutating")) >= x["stall"] if x["stall"] else off, "stall")
        .when(since(~F.col("blank")) >= x["empty"], "empty")
        .when(F.col("feedback").isNotNull() & (F.col("__n") - F.max(F.when(F.col("__new"), F.col("__n"))).over(w) + 1 >= x["feedback"]), "feedback")
    )
    return d.select("session", "seq", hit.alias("detector")).where("detector is not null")


def first_hit(log: DataFrame, **limits) -> DataFrame:
    """Per session the first step at which a live detector fires, and which."""
    h = live(log, **limits)
    return h.groupBy("session").agg(F.min("seq").alias("seq"), F.min_by("detector", "seq").alias("detector"))


def backend_errors(log: DataFrame) -> DataFrame:
    """Per session the first failure of the backend after turn 0. log: session, seq, turn, failed."""
    return log.where("failed and turn > 0").groupBy("session").agg(F.min("seq").alias("seq"))
