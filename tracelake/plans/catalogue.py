"""Every query of the library with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import commands
from tracelake.functions import metrics as m
from tracelake.functions import present as pr
from tracelake.functions import text as t
from tracelake.operators import context, costs, detectors, diagnostics, documents, folds, harvest, names, privacy, scorecard, sessions, terms, toolcalls
from tracelake.plans import adapters as a

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = "", *tables: str):
    """Registers the function under its name, with SQL over the adapters' tables."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (a.duck(*tables) + (", " if sql.lstrip().startswith("&") else "\n") + sql.lstrip().lstrip("&") if tables else sql)
        return f

    return put


def rates(spark: SparkSession) -> DataFrame:
    """Of two of the three models; the third is unknown."""
    return spark.sql("select * from values ('A', 3D, 15D), ('N', 1D, 5D) as r(model, input_rate, output_rate)")


_R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
KEY = "coalesce('p' || phase_doc_path, 'i' || phase_id || '/' || coalesce(project_id, ''))"
FOLDED = f"""& rv as (select *, {KEY} as k from reviews), lr as (select k, arg_min(r, seq) as r from (select k, seq, rv as r, ts, max(ts) over (partition by k) as top from rv) where ts = top group by k),
ru as (select *, {KEY} as k, ts = max(ts) over (partition by {KEY}) as latest from runs),
f as (select ru.*, lr.r as r, case when latest and lr.k is not null then lr.r.verdict end as verdict, case when latest and lr.k is not null then lr.r.bounces end as bounces,
 case when latest and lr.k is not null then lr.r.bugs end as bugs, case when latest and lr.k is not null then lr.r.warnings end as warn from ru left join lr on ru.k = lr.k)
"""
SCORE = """select model, {key} as key, count(*) as n_runs, round(avg(case when coalesce(fmt, false) and coalesce(build, false) and coalesce(lint, false) and coalesce(test, false) then 1.0 else 0.0 end), 6) as gates_pass_rate,
 round(avg(parse_failure_rate), 6) as parse_failure_rate_mean, round(avg(length_finish_rate), 6) as length_finish_rate_mean, round(avg(repairs_per_call), 6) as repairs_per_call_mean, round(avg(tool_success_rate), 6) as tool_success_rate_mean,
 round(avg(verifier_retries), 6) as verifier_retries_mean, round(avg(turns), 6) as turns_mean, round(avg(wall_clock_s), 6) as wall_clock_s_mean, round(avg(case when escalated then 1.0 else 0.0 end), 6) as escalation_rate,
 count(verdict) as n_with_verdict, round(avg(case when verdict is null then null when verdict = 'approved_first_try' then 1.0 else 0.0 end), 6) as approved_first_try_rate, round(avg(bounces), 6) as bounces_to_approval_mean,
 round(avg(case when peak_context_pct > 0 then peak_context_pct end), 6) as peak_context_pct_mean, round(avg(case when peak_context_pct > 0 then reclaimed end), 6) as tokens_reclaimed_mean
 from {source} {where} group by 1, 2 {having}"""
LABEL = "coalesce(nullif(concat_ws(',', 'temp=' || regexp_replace(cast(temperature as varchar), '\\.0$', ''), 'seed=' || seed), ''), 'default')"


def _folded(spark, d) -> DataFrame:
    return folds.fold_reviews(a.runs(spark, d), a.reviews(spark, d))


def _score(df: DataFrame) -> DataFrame:
    return _R6(df, *[c for c in df.columns if c.endswith(("_rate", "_mean"))])


@query(FOLDED + SCORE.format(key="''", source="f", where="", having=""), "runs", "reviews")
def scorecard_by_model(spark, d):
    return _score(scorecard.scorecard(_folded(spark, d), "model"))


@query(FOLDED + SCORE.format(key="unnest([tag1, tag2])", source="f", where="", having=""), "runs", "reviews")
def scorecard_by_tag(spark, d):
    return _score(scorecard.scorecard(_folded(spark, d), "tag"))


@query(FOLDED + SCORE.format(key=LABEL, source="f", where="", having=""), "runs", "reviews")
def scorecard_by_settings(spark, d):
    return _score(scorecard.scorecard(_folded(spark, d), "settings"))


@query(FOLDED + SCORE.format(key=LABEL, source="f", where="where tag1 = 'O' and tag2 = 'BUILDING'", having="having count(*) >= 12"), "runs", "reviews")
def scorecard_filtered(spark, d):
    return _score(scorecard.scorecard(_folded(spark, d), "settings", tags=["O", "BUILDING"], min_runs=12))


@query(FOLDED + "select seq, verdict as architect_verdict, bounces as bounces_to_approval, bugs as bugs_filed, warn as warnings from f", "runs", "reviews")
def fold_reviews(spark, d):
    return _folded(spark, d).select("seq", *folds.SUPERVISION)


@query(FOLDED + ", h as (select model, unnest([tag1, tag2]) as tag, r from f where latest and r is not null), g as (select model, tag, unnest([r.class1, r.class2]) as failure_class from h) select model, tag, failure_class, count(*) as n, row_number() over (partition by model, tag order by count(*) desc, failure_class) as rank from g where failure_class <> 'none' group by 1, 2, 3", "runs", "reviews")
def failure_ranking(spark, d):
    return scorecard.failure_ranking(a.runs(spark, d), a.reviews(spark, d))


@query(FOLDED + """, g as (select k, count(*) as attempts, cast(least(sum(input_tokens), 4294967295) as bigint) as input_tokens, cast(least(sum(output_tokens), 4294967295) as bigint) as output_tokens, cast(least(sum(cache_read_tokens), 4294967295) as bigint) as cache_read_tokens, cast(least(sum(cache_write_tokens), 4294967295) as bigint) as cache_write_tokens from ru group by k),
 l as (select distinct on (k) k, phase_id, milestone_id, project_id from ru order by k, ts desc, seq) select phase_id, milestone_id, project_id, attempts, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, coalesce(starts_with(lr.r.verdict, 'approved') or lr.r.verdict = 'escalated', false) as shipped from g join l on g.k = l.k join lr on g.k = lr.k""", "runs", "reviews")
def cost_to_ship(spark, d):
    return scorecard.cost_to_ship(a.runs(spark, d), a.reviews(spark, d))


FOLD_L = "& fl as (select *, min(seq) over w as first_seq, max(seq) over w as last from ledger window w as (partition by project_id, session_id, model, skill)), lg as (select * from fl where seq = last), rt as (select * from (values ('A', 3.0::double, 15.0::double), ('N', 1.0::double, 5.0::double)) v(m, i, o)), pc as (select lg.*, coalesce(input / 1e6 * i + output / 1e6 * o + cache_read / 1e6 * i * 0.1 + c5m / 1e6 * i * 1.25 + c1h / 1e6 * i * 2, 0) as cost from lg left join rt on model = m)\n"


@query(FOLD_L + "select project_id, session_id, model, skill, input, output, last_ts, first_seq from lg", "ledger")
def fold_ledger(spark, d):
    f = folds.last_write_wins(a.ledger(spark, d), costs.LEDGER_KEY)
    return f.select("project_id", "session_id", "model", "skill", "tokens.input", "tokens.output", "last_ts", "first_seq")


@query(FOLD_L + "select project_id, session_id, model, skill, round(cost, 6) as cost from pc", "ledger")
def ledger_pricing(spark, d):
    return _R6(costs.priced(a.ledger(spark, d), rates(spark)).select("project_id", "session_id", "model", "skill", "cost"), "cost")


@query(FOLD_L + "select skill, count(*) as messages, cast(sum(input + c5m + c1h + cache_read + output) as bigint) as tokens, round(sum(cost), 6) as cost, round(sum(cost) / sum(sum(cost)) over () * 100, 4) as percent from pc where project_id = 'p1' group by skill", "ledger")
def skill_costs(spark, d):
    s = costs.skill_costs(a.ledger(spark, d), rates(spark), "p1")
    return _R6(s, "cost").withColumn("percent", F.round("percent", 4))


SCOPES = FOLD_L + """, m as (select session, coalesce(arg_max(input_tokens, seq), 0) as i, coalesce(arg_max(output_tokens, seq), 0) as o from log where event_type = 'metrics' group by 1),
s as (select 'project' as scope, sum(input_tokens) as i, sum(output_tokens) as o, sum(cache_read_tokens) as r, sum(cache_write_tokens) as w from runs where project_id = 'p1' union all select 'milestone:' || milestone_id, sum(input_tokens), sum(output_tokens), sum(cache_read_tokens), sum(cache_write_tokens) from runs where project_id = 'p1' and milestone_id is not null group by 1
 union all select distinct 'session:' || l.session, coalesce(m.i, 0), coalesce(m.o, 0), 0, 0 from log l left join m on l.session = m.session),
x as (select scope, cast(i as bigint) as input_tokens, cast(o as bigint) as output_tokens, i / 1e6 * 3 + o / 1e6 * 15 as saved, i / 1e6 * 0.1 + o / 1e6 * 0.2 + r / 1e6 * 0.01 + w / 1e6 * 0.05 as executor, cast(i + o + r + w as bigint) as executor_tokens, case when scope = 'project' then (select sum(cost) from pc where project_id = 'p1') end as architect from s)
"""
_SAVED, _EXECUTOR = (3.0, 15.0), {"input": 0.1, "output": 0.2, "cache_read": 0.01, "cache_creation": 0.05}


@query(SCOPES + "select scope, input_tokens, output_tokens, executor_tokens, round(saved, 6) as saved, round(executor, 6) as executor, round(architect, 4) as architect, round(saved - executor - architect, 4) as net from x", "ledger", "runs", "log")
def scope_costs(spark, d):
    s = costs.scope_costs(a.runs(spark, d), a.ledger(spark, d), rates(spark), "p1", _SAVED, _EXECUTOR, a.log(spark, d))
    return s.select("scope", "input_tokens", "output_tokens", "executor_tokens", F.round("saved", 6).alias("saved"), F.round("executor", 6).alias("executor"), F.round("architect", 4).alias("architect"), F.round("net", 4).alias("net"))


@query(SCOPES + "select scope, l.line, round(l.amount, 4) as amount from (select scope, unnest([{'line': 'executor', 'amount': saved - executor}, {'line': 'architect', 'amount': -architect}, {'line': 'net', 'amount': saved - executor - architect}]) as l from x where scope not like 'session:%')", "ledger", "runs", "log")
def spend_lines(spark, d):
    s = costs.scope_costs(a.runs(spark, d), a.ledger(spark, d), rates(spark), "p1", _SAVED, _EXECUTOR)
    return costs.ledger_lines(s).withColumn("amount", F.round("amount", 4))


@query("select arg_max(milestone_id, ts::hugeint * 10000000 + seq) as milestone_id from runs where project_id = 'p1' and milestone_id is not null", "runs")
def active_milestone(spark, d):
    return costs.active_milestone(a.runs(spark, d), "p1")


@query(FOLD_L + "select skill, round(sum(cost), 6) as cost from pc where project_id = 'p1' group by 1 order by 2 desc, 1 limit 1", "ledger")
def top_skill(spark, d):
    return costs.top_skill(a.ledger(spark, d), rates(spark), "p1").select("skill", F.round("cost", 6).alias("cost"))


@query("& f as (select *, row_number() over (partition by phase_id, activity, ts order by seq desc) as k from activities) select count(*) as assists from f where k = 1 and activity = 'assist' and project_id = 'p1'", "activities")
def assist_count(spark, d):
    return costs.assists(a.activities(spark, d), "p1")


_PRICED = "list_extract(['claude-opus-4-6', 'claude-haiku-4-5', 'A', 'none such'], cast(l_orderkey % 4 + 1 as int))"


@query(f"""with l as (select {_PRICED} as model, count(*) as n, sum(cast(l_quantity as bigint)) as q from lineitem group by 1),
v as (select * from (values ('claude-opus-4-6', 5.0, 25.0), ('claude-haiku-4-5', 9.0, 9.5), ('A', 3.0, 15.0)) v(model, i, o))
select l.model, n, round(i::double, 6) as input_rate, round(o::double, 6) as output_rate, round(q * i::double / 1000000, 6) as cost from l left join v on l.model = v.model""")
def rate_lookup(spark, d):
    """Order lines as calls of four models, one of them without a price. The caller's prices win over the built-in ones."""
    from tracelake.functions import rates as price

    own = price.rate_table(spark, {"A": (3.0, 15.0), "claude-haiku-4-5": (9.0, 9.5)})
    names = F.array(*map(F.lit, ("claude-opus-4-6", "claude-haiku-4-5", "A", "none such")))
    used = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.element_at(names, (F.col("l_orderkey") % 4 + 1).cast("int")).alias("model")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return used.join(own, "model", "left").select("model", "n", "input_rate", "output_rate", F.round(F.col("q") * F.col("input_rate") / 1_000_000, 6).alias("cost"))


@query("select session, seq, ts, tool from (select *, row_number() over (partition by arguments order by session, seq) as k from session) where k = 1", "session")
def harvest_dedup(spark, d):
    return folds.first_wins(a.session(spark, d), "arguments", ["session", "seq"]).select("session", "seq", "ts", "tool")


@query(FOLD_L + "select project_id, session_id, model, skill, input from lg where not (session_id in ('s1', 's2', 's3'))", "ledger")
def unchanged_anti(spark, d):
    fresh = folds.last_write_wins(a.ledger(spark, d), costs.LEDGER_KEY).select("project_id", "session_id", "model", "skill", "tokens.input")
    return folds.changed_only(fresh, fresh.where(F.col("session_id").isin("s1", "s2", "s3")))


@query("select seq, ts, model from runs order by ts desc, seq limit 25", "runs")
def runs_newest(spark, d):
    return sessions.newest(a.runs(spark, d), 25).select("seq", "ts", "model")


@query("select seq, lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(ts || '|' || model || '|' || phase_id, ''), lambda c: ascii(c)::ubigint)), lambda h, x: ((xor(h, x) * 16777619) & 4294967295)::ubigint)), 8, '0')) as run_id from runs", "runs")
def run_id(spark, d):
    return a.runs(spark, d).select("seq", m.run_id(F.col("ts"), F.col("model"), F.col("phase_id")).alias("run_id"))


@query(f"select seq, coalesce(fmt and build and lint and test, false) as gates_pass, reclaimed, round(case when gen_time_s > 0 then output_tokens / gen_time_s end, 6) as tps, {LABEL} as settings from runs", "runs")
def run_derived(spark, d):
    r = a.runs(spark, d).select("seq", m.gates_all_pass().alias("gates_pass"), m.reclaimed_total().alias("reclaimed"), m.tokens_per_second(F.col("tokens.output_tokens"), F.col("gen_time_s")).alias("tps"), m.settings_label().alias("settings"))
    return _R6(r, "tps")


STATUS = """& i as (select *, ts - lag(ts) over w as gap, last_value(case when event_type = 'metrics' then ts end ignore nulls) over b as mts, last_value(case when event_type = 'metrics' then output_tokens end ignore nulls) over b as mout, max(case when event_type = 'progress' then seq end) over (partition by session) as pat from log
 window w as (partition by session order by seq), b as (partition by session order by seq rows between unbounded preceding and 1 preceding)),
r as (select *, case when event_type = 'metrics' and ts > mts then greatest(output_tokens - mout, 0) / ((ts - mts) / 1000.0) end as rate from i),
k as (select session, task, arg_max(state, seq) as state from log where event_type = 'task_update' group by 1, 2),
t as (select session, count(*) as total, count(case when state = 'done' then 1 end) as done, count(case when state = 'active' then 1 end) as active from k group by 1),
s as (select session, arg_max(model, case when event_type = 'session_start' then seq end) as model, min(ts) as started_at, max(ts) as last_ts,
 cast(greatest(coalesce(arg_max(said_turn, case when event_type = 'progress' then seq end), 0), coalesce(max(case when event_type = 'session_end' and coalesce(seq > pat, true) then said_turn end), 0)) as bigint) as latest_turn, count(*) as events,
 arg_max(title, case when event_type = 'progress' then seq end) as stage, arg_max(status, case when event_type = 'session_end' then seq end) as ended, count(case when event_type = 'parse_failed' then 1 end) as parse_failures, arg_max(title, case when event_type = 'parse_failed' then seq end) as parse_feedback,
 arg_max(least(diagnostics, 3), case when event_type = 'verify' then seq end) as diagnostics, arg_max(word, case when event_type = 'tool_result' then seq end) as last_tool, arg_max(output_tokens, case when event_type = 'metrics' then seq end) as output_tokens,
 arg_max(context_pct, case when event_type = 'metrics' then seq end) as context_pct, cast(coalesce(sum(case when event_type = 'compaction' then v end), 0) as bigint) as compaction_before, cast(coalesce(sum(case when event_type = 'compaction' then less end), 0) as bigint) as compaction_after,
 cast(coalesce(sum(case when event_type = 'output_filtered' then greatest(v - less, 0) end), 0) as bigint) as filtered_tokens, cast(coalesce(sum(case when event_type = 'read_evicted' then v end), 0) as bigint) as evicted_tokens,
 case when count(case when gap > 0 then 1 end) >= 2 then min(case when gap > 0 then gap end) end as gap_min, case when count(case when gap > 0 then 1 end) >= 2 then cast(floor(sum(case when gap > 0 then gap end) / count(case when gap > 0 then 1 end)) as bigint) end as gap_avg, case when count(case when gap > 0 then 1 end) >= 2 then max(case when gap > 0 then gap end) end as gap_max,
 case when count(rate) >= 2 then round(min(rate), 9) end as rate_min, case when count(rate) >= 2 then round(avg(rate), 9) end as rate_avg, case when count(rate) >= 2 then round(max(rate), 9) end as rate_max from r group by session)
"""
_SHOWN = ["model", "started_at", "last_ts", "latest_turn", "events", "stage", "ended", "parse_failures", "parse_feedback", "diagnostics", "last_tool", "output_tokens", "context_pct", "compaction_before", "compaction_after", "filtered_tokens", "evicted_tokens", "gap_min", "gap_avg", "gap_max", "rate_min", "rate_avg", "rate_max"]


@query(STATUS + f"select s.session, {', '.join(_SHOWN)}, coalesce(total, 0) as tasks_total, coalesce(done, 0) as tasks_done, coalesce(active, 0) as tasks_active from s left join t on s.session = t.session", "log")
def status_fold(spark, d):
    s = sessions.status(a.log(spark, d))
    return s.withColumns({c: F.round(c, 9) for c in ("rate_min", "rate_avg", "rate_max")}).select("session", *_SHOWN, "tasks_total", "tasks_done", "tasks_active")


@query(STATUS + "select s.session, case when total > 0 then cast(round(100.0 * done / total) as bigint) else 0 end as percent, case when compaction_after > 0 then round(compaction_before / compaction_after, 6) end as ratio, case when context_pct is null or context_pct = 0 then null when round(context_pct * 100) >= 80 then 'high' when round(context_pct * 100) >= 50 then 'middle' else 'low' end as band, greatest(case when ended is null then 1800000000000 else last_ts end - started_at, 0) as duration from s left join t on s.session = t.session", "log")
def session_progress(spark, d):
    s = sessions.duration(sessions.progress(sessions.status(a.log(spark, d))), 1_800_000_000_000)
    return s.select("session", "percent", F.round("ratio", 6).alias("ratio"), "band", "duration")


@query("select session, round(coalesce(max(case when event_type = 'metrics' then context_pct end), 0), 6) as peak_context_pct, count(case when event_type = 'compaction' then 1 end) as compaction_count, cast(coalesce(sum(case when event_type = 'compaction' then greatest(v - less, 0) end), 0) as bigint) as compaction_tokens_reclaimed, cast(coalesce(sum(case when event_type = 'output_filtered' then greatest(v - less, 0) end), 0) as bigint) as output_filtered_tokens, cast(coalesce(sum(case when event_type = 'read_evicted' then v end), 0) as bigint) as read_evicted_tokens, cast(coalesce(sum(case when event_type = 'read_deduped' then v end), 0) as bigint) as read_deduped_tokens from log group by 1", "log")
def context_efficiency(spark, d):
    return _R6(sessions.context_efficiency(a.log(spark, d)), "peak_context_pct")


@query(STATUS + """, c as (select session, count(case when event_type = 'tool_result' and succeeded then 1 end) as ok, count(case when event_type = 'tool_result' then 1 end) as calls, count(case when event_type = 'parse_failed' then 1 end) as bad, count(case when event_type in ('parsed', 'parse_failed') then 1 end) as tries from log group by 1), n as (select cast(user_id as varchar) as session, count(*) as finishes, count(case when event_id % 7 = 0 then 1 end) as short, count(case when event_id % 5 = 0 then 1 end) as repairs, count(case when event_id % 11 = 0 then 1 end) as retries, count(case when event_id % 3 = 0 then 1 end) / 4.0::double as gen, max(event_id) % 2 = 0 as test from events where user_id % 4 > 0 group by 1)
select s.session, last_ts as ts, ended as status, latest_turn as turns, round((last_ts - started_at) / 1000.0, 3) as wall_clock_s, round(case when calls > 0 then ok / calls else 0 end, 6) as tool_success_rate, round(case when tries > 0 then bad / tries else 0 end, 6) as parse_failure_rate, coalesce(output_tokens, 0) as output_tokens, round(case when calls > 0 then coalesce(repairs, 0) / calls else 0 end, 6) as repairs_per_call, round(short / finishes, 6) as length_finish_rate, coalesce(retries, 0) as verifier_retries, coalesce(gen, 0) as gen_time_s, test as tested, coalesce('t' || cast(finishes % 3 as varchar), '') as tags from s join c on s.session = c.session left join n on s.session = n.session where ended is not null""", "log")
def run_records(spark, d):
    """Three of four sessions were counted by the one who ran them."""
    e, k = spark.read.parquet(f"{d}/events.parquet").where("user_id % 4 > 0"), lambda n: F.count_if(F.col("event_id") % n == 0)
    gates = F.struct(*[F.lit(True).alias(g) for g in ("fmt", "build", "lint")], (F.max("event_id") % 2 == 0).alias("test"))
    counted = e.groupBy(F.col("user_id").cast("string").alias("session")).agg(k(5).alias("repairs"), F.count("*").alias("finishes"), k(7).alias("length_finishes"), k(11).alias("verifier_retries"), (k(3) / 4).alias("gen_time_s"), gates.alias("gates"), F.array(F.concat(F.lit("t"), (F.count("*") % 3).cast("string"))).alias("tags"))
    r = _R6(sessions.run_record(a.log(spark, d), counted), "tool_success_rate", "parse_failure_rate", "repairs_per_call", "length_finish_rate")
    return r.select("session", "ts", "status", "turns", F.round("wall_clock_s", 3).alias("wall_clock_s"), "tool_success_rate", "parse_failure_rate", "output_tokens", "repairs_per_call", "length_finish_rate", "verifier_retries", "gen_time_s", F.col("gates.test").alias("tested"), F.array_join("tags", ",").alias("tags"))


@query("select session, seq, event_type from log where event_type in ('parsed', 'tool_result') and contains(word, 'c') and (case when event_type = 'parsed' then contains('\"z\":' || v, '7') else contains('\"output_bytes\":' || v, '7') end or contains(cast(ts as varchar), '7') or contains(cast(turn as varchar), '7') or (event_type = 'parsed' and contains(task, '7'))) order by session, seq limit 20", "log")
def log_search(spark, d):
    """Text is looked for in the whole record as it is written."""
    return sessions.search(a.log(spark, d), tool="c", text="7").select("session", "seq", F.col("event.event_type").alias("event_type"))


@query("select session, seq from log where event_type = 'verify' order by session, seq limit 50", "log")
def log_search_by_type(spark, d):
    return sessions.search(a.log(spark, d), event_type="verify", limit=99).select("session", "seq")


@query("select session, seq, tool from (select *, row_number() over (partition by session order by seq desc) as k from session) where k <= 10", "session")
def log_tail(spark, d):
    return sessions.tail(a.session(spark, d)).select("session", "seq", "tool")


@query("select session, seq, event_type from log where turn = 3", "log")
def get_turn(spark, d):
    return sessions.turn(a.log(spark, d), 3).select("session", "seq", F.col("event.event_type").alias("event_type"))


@query("& o as (select *, lead(event_type) over w as nt, lead(seq) over w as ns, lead(succeeded) over w as nok from log where event_type in ('parsed', 'tool_result') window w as (partition by session order by seq)) select session, seq, word as name, case when nt = 'tool_result' then ns end as result_seq, case when nt = 'tool_result' then nok end as succeeded from o where event_type = 'parsed'", "log")
def call_results(spark, d):
    return sessions.paired(a.log(spark, d))


@query("select event_type, count(*) as n, cast(sum(ts - first) as bigint) as elapsed from (select *, min(ts) over (partition by session) as first from log) where event_type not in ('progress', 'metrics', 'parsed', 'tool_result') group by 1", "log")
def visible_events(spark, d):
    shown = sessions.visible(sessions.elapsed(a.log(spark, d)), ["progress", "metrics", "tool_call"])
    return shown.groupBy("event.event_type").agg(F.count("*").alias("n"), F.sum("elapsed").alias("elapsed"))


@query("select session, coalesce(arg_max(model, case when event_type = 'session_start' then seq end), '(unknown)') as model, coalesce(arg_max(status, case when event_type = 'session_end' then seq end), 'unknown') as outcome from log group by 1", "log")
def replayed(spark, d):
    from tracelake.sources import session_log

    return session_log.replayed(a.log(spark, d))


@query("select session, task as id, arg_max(title, seq) as title, arg_max(state, seq) as state, min(seq) as place from log where event_type = 'task_update' group by 1, 2", "log")
def session_tasks(spark, d):
    return sessions.tasks(a.log(spark, d))


HARVEST = """& u as (select *, row_number() over (partition by message_id order by string_split(path, '/'), line) as k from transcripts where type = 'assistant' and has_usage),
b as (select session, coalesce(model, 'unknown') as model, coalesce(nullif(skill, ''), 'other') as skill, input, output, hour as cache_read, case when shape % 2 = 0 then five when shape > 1 then five else 0 end as c5, case when shape % 2 = 0 then hour else 0 end as c1, case when shape = 5 then 0 else ts end as ts from u where k = 1)
"""


@query(HARVEST + "select session as session_id, model, skill, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, cast(sum(cache_read) as bigint) as cache_read, cast(sum(c5 + c1) as bigint) as cache_creation, cast(sum(c5) as bigint) as cache_creation_5m, count(*) as messages, max(ts) as last_ts from b group by 1, 2, 3", "transcripts")
def harvest_buckets(spark, d):
    b = harvest.buckets(harvest.usage(a.transcripts(spark, d)))
    return b.select("session_id", "model", "skill", "tokens.input", "tokens.output", "tokens.cache_read", "tokens.cache_creation", "cache_creation_5m", "messages", "last_ts")


@query(HARVEST + ", g as (select session, model, skill, max(ts) as last_ts from b group by 1, 2, 3) select (select count(*) from b) as messages, (select count(*) from u where k > 1) as duplicates, (select count(distinct session) from b) as sessions, (select count(*) from g where last_ts % 2 = 0) as records, (select count(*) from g where last_ts % 2 = 1) as unchanged", "transcripts")
def harvest_outcome(spark, d):
    use = harvest.usage(a.transcripts(spark, d))
    fresh = harvest.buckets(use)
    return harvest.outcome(use, fresh, fresh.where("last_ts % 2 = 1"))


@query("select tool, count(*) as calls, round((count(case when errors = 0 then 1 end) + 1) / (count(*) + 2), 6) as score from session group by tool", "session")
def tool_scores(spark, d):
    return _R6(sessions.tool_scores(a.session(spark, d), "errors = 0"), "score")


SIG = {
    "identical_run": "select session, max(n) as value from (select session, i, count(*) as n from (select session, sum(case when same then 0 else 1 end) over (partition by session order by seq) as i from (select *, coalesce(tool = lag(tool) over w and arguments = lag(arguments) over w, false) as same from session window w as (partition by session order by seq))) group by 1, 2) group by 1",
    "read_only_run": "select session, max(n) as value from (select session, i, count(case when not mutating then 1 end) as n from (select *, sum(case when mutating then 1 else 0 end) over (partition by session order by seq) as i from session) group by 1, 2) group by 1",
    "empty_run": "select session, max(n) as value from (select session, i, count(case when blank then 1 end) as n from (select *, sum(case when blank then 0 else 1 end) over (partition by session order by seq) as i from session) group by 1, 2) group by 1",
    "persistence": "select session, max(n) as value from (select session, i, count(case when errors > 0 then 1 end) as n from (select session, errors, sum(case when errors = 0 or p is null or p = 0 or errors < p then 1 else 0 end) over (partition by session order by seq) as i from (select *, lag(errors) over (partition by session order by seq) as p from session)) group by 1, 2) group by 1",
    "oscillation": "select session, min(dd) as value from (select session, count(distinct tool || '|' || arguments) over w as dd, count(*) over w as k from session window w as (partition by session order by seq rows between 7 preceding and current row)) where k = 8 group by 1",
    "flood": "select session, cast(max(dd) as bigint) as value from (select session, sum(output_bytes) over w as dd, count(*) over w as k from session window w as (partition by session order by seq rows between 5 preceding and current row)) where k = 6 group by 1",
    "novelty": "select session, dd as value from (select session, count(distinct tool || '(' || arguments || ')') over w as dd, count(*) over w as k from (select * from (select *, sum(case when mutating then 1 else 0 end) over (partition by session order by seq) as i from session) where not mutating) window w as (partition by session, i order by seq rows between 5 preceding and current row)) where k = 6",
}


def _detector(name: str) -> None:
    def run(spark, d, f=detectors.SIGNALS[name]):
        return f(a.session(spark, d)).select("session", "value")

    QUERIES[f"detect_{name}"] = run
    ORACLE_SQL[f"detect_{name}"] = a.duck("session") + "\n" + SIG[name]


for _name in SIG:
    _detector(_name)

_RANK = "list_sort(list(value))[cast(round({p} * (count(*) - 1)) as int) + 1]"


@query("& s as (" + " union all ".join(f"select '{k}' as signal, session, value from ({v})" for k, v in SIG.items()) + """), o as (select signal, session, value, 'm' || (cast(session as bigint) % 3) as model, case when cast(session as bigint) % 2 = 0 then 'complete' else 'hard_fail' end as outcome from s), b as (select * from o union all select signal, session, value, '(all)', outcome from o)
select signal, model, outcome, count(distinct session) as runs, count(*) as n, """ + f"{_RANK.format(p=0.5)} as p50, case when signal = 'oscillation' then {_RANK.format(p=0.1)} else {_RANK.format(p=0.9)} end as near_tail, case when signal = 'oscillation' then {_RANK.format(p=0.01)} else {_RANK.format(p=0.99)} end as far_tail from b group by 1, 2, 3 having model = '(all)' or count(distinct session) >= 3", "session")
def calibrate(spark, d):
    log = a.session(spark, d)
    who = F.col("session").cast("bigint")
    outcomes = log.select("session").distinct().select("session", F.concat(F.lit("m"), who % 3).alias("model"), F.when(who % 2 == 0, "complete").otherwise("hard_fail").alias("outcome"))
    return detectors.calibrate(log, outcomes, min_runs=3)


@query("& s as (" + " union all ".join(f"select '{k}' as signal, session, value from ({v})" for k, v in SIG.items()) + """), o as (select signal, session, value, 'm' || (cast(session as bigint) % 3) as model, case when cast(session as bigint) % 2 = 0 then 'complete' else 'hard_fail' end as outcome from s), b as (select * from o union all select signal, session, value, '(all)', outcome from o)
select signal, model, outcome, count(distinct session) as runs, count(*) as n, """ + f"{_RANK.format(p=0.5)} as p50, case when signal = 'oscillation' then {_RANK.format(p=0.1)} else {_RANK.format(p=0.9)} end as near_tail, case when signal = 'oscillation' then {_RANK.format(p=0.01)} else {_RANK.format(p=0.99)} end as far_tail from b group by 1, 2, 3 having model = '(all)' or count(distinct session) >= 3", "session")
def calibrate_stored(spark, d):
    """The same in two steps: two thirds of the sessions are counted first, the rest is added to what was stored."""
    log = a.session(spark, d)
    who = F.col("session").cast("bigint")
    outcomes = log.select("session").distinct().select("session", F.concat(F.lit("m"), who % 3).alias("model"), F.when(who % 2 == 0, "complete").otherwise("hard_fail").alias("outcome"))
    at = _folder(spark, "calibration")
    detectors.calibrate_on(at, log, outcomes.where(who % 3 > 0))
    return detectors.calibrate_on(at, log, outcomes, min_runs=3)


LIVE = """& n as (select *, row_number() over p as n, lag(errors) over p as before, coalesce(feedback <> lag(feedback) over p, true) as fresh from steps window p as (partition by session order by seq)),
w as (select *, count(distinct tool || '|' || arguments) over w3 as d3, bool_or(mutating) over w3 as m3, count(distinct tool || '|' || arguments) over w8 as d8, bool_or(mutating) over w8 as m8, sum(output_bytes) over w6 as s6,
 n - coalesce(max(case when mutating then n end) over p, 0) as since, n - coalesce(max(case when not blank then n end) over p, 0) as blanks, n - max(case when fresh then n end) over p + 1 as repeats,
 n - greatest(coalesce(max(case when errors = 0 then n end) over p, 0), coalesce(max(case when errors < before then n end) over p, 1) - 1) as streak, count(distinct {target}) over w4 as d4 from n
 window p as (partition by session order by seq), w3 as (partition by session order by seq rows between 1 preceding and current row), w8 as (partition by session order by seq rows between 3 preceding and current row), w6 as (partition by session order by seq rows between 5 preceding and current row), w4 as (partition by session order by seq rows between 3 preceding and current row)),
h as (select session, seq, case when n >= 2 and d3 = 1 and m3 then 'identical' when streak >= 4 then 'persistence' when output_bytes > 33000 then 'runaway' when n >= 4 and m8 and d8 between 2 and 2 then 'oscillation' when n >= 6 and s6 > 60000 then 'flood' when n >= 4 and since >= 4 and d4 <= 1 then 'novelty' when since >= 20 then 'stall' when blanks >= 2 then 'empty' when repeats >= 3 then 'feedback' end as detector from w)
"""
LIVE = LIVE.format(target="case when tool in ('read_file', 'symbols') then coalesce(json_extract_string(arguments, '$.path'), json_extract_string(arguments, '$.name'), tool || '(' || arguments || ')') when tool = 'search' then coalesce(json_extract_string(arguments, '$.path'), '.') when tool = 'bash' then coalesce(regexp_replace(json_extract_string(arguments, '$.command'), '[0-9]', '', 'g'), tool || '(' || arguments || ')') else tool || '(' || arguments || ')' end")
_LIMITS = {"identical": 2, "persistence": 4, "output": 33_000, "window": 4, "flood_limit": 60_000, "novelty_window": 4, "novelty_floor": 1, "stall": 20, "empty": 2, "feedback": 3}


@query(LIVE + "select session, min(seq) as seq, arg_min(detector, seq) as detector from h where detector is not null group by session", "steps")
def first_hit(spark, d):
    return detectors.first_hit(a.steps(spark, d), terminate_on_novelty=True, **_LIMITS)


@query(LIVE + "select detector, count(*) as steps, count(distinct session) as sessions from h where detector is not null group by 1", "steps")
def live_hits(spark, d):
    """All nine detectors fire somewhere."""
    return detectors.live(a.steps(spark, d), terminate_on_novelty=True, **_LIMITS).groupBy("detector").agg(F.count("*").alias("steps"), F.count_distinct("session").alias("sessions"))


def _folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    from tracelake.sources import store

    return f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(LIVE + "select session, seq, detector from h where detector is not null", "steps")
def streamed_hits(spark, d):
    """The steps as a stream of three batches, with a restart before each."""
    from tracelake.streaming import live

    steps, at = a.steps(spark, d), _folder(spark, "steps")
    parts = steps.withColumn("part", F.when(F.col("seq") <= 40, 0).when(F.col("seq") <= 120, 1).otherwise(2))
    parts.write.partitionBy("part").parquet(f"{at}/all")  # once: numbering the steps sorts them all
    for part in range(3):
        spark.read.schema(parts.schema).parquet(f"{at}/all").where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{at}/in")
        live.live_detectors(spark.readStream.schema(steps.schema).parquet(f"{at}/in"), f"{at}/state", f"{at}/hits", terminate_on_novelty=True, **_LIMITS).awaitTermination()
    return spark.read.schema("session string, seq bigint, detector string").parquet(f"{at}/hits")


@query("select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as ks from events group by 1")
def tailed_lines(spark, d):
    """Events as JSON lines in a folder that grows between two runs of a stream over it."""
    from tracelake.sources import tail

    e, at = spark.read.parquet(f"{d}/events.parquet"), _folder(spark, "tail")
    for rest in (0, 1):
        e.where(F.col("event_id") % 2 == rest).select(F.to_json(F.struct("event_id", "event_type", "props"))).write.mode("append").text(f"{at}/logs")
        tail.growing(spark, f"{at}/logs", ".txt").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    r = spark.read.schema("value string").parquet(f"{at}/out").select(F.from_json("value", "event_id bigint, event_type string, props string").alias("r")).select("r.*")
    return r.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("ks"))


@query("select session, min(seq) as seq from steps where turn > 0 and errors = 4 group by session", "steps")
def backend_errors(spark, d):
    return detectors.backend_errors(a.steps(spark, d).withColumn("failed", F.col("errors") == 4))


@query("select tool, case when tool in ('read_file', 'symbols') then coalesce(json_extract_string(arguments, '$.path'), json_extract_string(arguments, '$.name'), tool || '(' || arguments || ')') when tool = 'search' then coalesce(json_extract_string(arguments, '$.path'), '.') when tool = 'bash' then coalesce(regexp_replace(json_extract_string(arguments, '$.command'), '[0-9]', '', 'g'), tool || '(' || arguments || ')') else tool || '(' || arguments || ')' end as target, count(*) as n from steps group by 1, 2", "steps")
def read_targets(spark, d):
    return a.steps(spark, d).groupBy("tool", detectors.read_target().alias("target")).agg(F.count("*").alias("n"))


def _docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _pii(kind: str) -> str:
    return t.PERSONAL[kind].replace("'", "''")


@query("select doc_id, " + ", ".join(f"cast(len(regexp_extract_all(text, '{_pii(k)}')) as bigint) as {k}" for k in ("email", "ssn", "phone", "ipv4", "mac")) + " from documents")
def pii_counts(spark, d):
    return _docs(spark, d).select("doc_id", *[F.size(t.found(F.col("text"), k, unicode=False)).cast("long").alias(k) for k in ("email", "ssn", "phone", "ipv4", "mac")])


@query(f"""with c as (select doc_id, unnest(regexp_extract_all(text, '{_pii("card")}')) as card from documents), n as (select doc_id, regexp_replace(card, '[^0-9]', '', 'g') as n from c),
v as (select doc_id, n from n where len(n) between 13 and 19 and list_sum(list_transform(range(len(n)), lambda i: case when i % 2 = 0 then cast(n[len(n) - i] as int) else (2 * cast(n[len(n) - i] as int)) // 10 + (2 * cast(n[len(n) - i] as int)) % 10 end)) % 10 = 0) select doc_id, count(*) as cards from v group by doc_id""")
def luhn_cards(spark, d):
    return _docs(spark, d).select("doc_id", F.size(t.cards(F.col("text"), unicode=False)).cast("long").alias("cards")).where("cards > 0")


def _secret_sql() -> str:
    out = "text"
    for pattern, kind in t.SECRETS:
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED:{kind}]', 'g')"
    return f"select doc_id, sha256({out}) as redacted_sha256, {out} <> text as changed from documents"


@query(_secret_sql())
def secret_redaction(spark, d):
    r = _docs(spark, d).select("doc_id", "text", t.redact_secrets(F.col("text"), unicode=False).alias("r"))
    return r.select("doc_id", F.sha2(F.col("r").cast("binary"), 256).alias("redacted_sha256"), (F.col("r") != F.col("text")).alias("changed"))


@query("select doc_id as key, sha256(text) as sha256 from documents where doc_id % 10 < 2")
def content_changed(spark, d):
    """Documents whose content the registry does not hold under their own key: every tenth is missing, the next is another's."""
    docs = _docs(spark, d).withColumnRenamed("doc_id", "key")
    registry = docs.where("key % 10 <> 0").select("key", F.when(F.col("key") % 10 == 1, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"))
    return privacy.changed(docs, registry).select("key", "sha256")


@query(r"select doc_id, cast(coalesce(list_sum(list_transform(regexp_extract_all(text, '[^\s!-/:-@\[-`{-~]+'), lambda w: ceil(length(w) / 4))), 0) as bigint) + cast(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) as bigint) as tokens from documents")
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query("""with l as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as line from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as x from documents where text <> '')), s as (select *, case when line = lag(line) over (partition by doc_id order by i) then 0 else 1 end as b from l), g as (select *, sum(b) over (partition by doc_id order by i) as k from s),
r as (select doc_id, k, any_value(line) as line, count(*) as n from g group by doc_id, k) select doc_id, sha256(string_agg(line || case when n > 1 then ' (x' || n || ')' else '' end || chr(10), '' order by k)) as folded_sha256 from r group by doc_id union all select doc_id, sha256('') from documents where text = ''""")
def line_rle(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(t.collapse_lines(F.col("text")).cast("binary"), 256).alias("folded_sha256"))


@query("select doc_id, cast(case when len(x) > 100 then 101 else len(x) end as bigint) as n_lines, sha256(array_to_string(case when len(x) > 100 then list_concat(x[1:20], ['[… ' || (len(x) - 100) || ' lines omitted; full output not retained …]'], x[-80:]) else x end, chr(10))) as shown_sha256 from (select doc_id, string_split(replace(text, ' ', chr(10)), chr(10)) as x from documents)")
def head_tail(spark, d):
    cut = _docs(spark, d).select("doc_id", t.head_tail(F.split(F.translate("text", " ", "\n"), "\n")).alias("x"))
    return cut.select("doc_id", F.size("x").cast("long").alias("n_lines"), F.sha2(F.array_join("x", "\n").cast("binary"), 256).alias("shown_sha256"))


@query("""with l as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as l, x from (select doc_id, string_split(text, chr(10)) as x from documents)), h as (select doc_id, i, l, x, regexp_extract_all(l, 'Licen[cs]e[d]?') as hits, string_split_regex(l, 'Licen[cs]e[d]?') as rest from l where regexp_matches(l, 'Licen[cs]e[d]?'))
select doc_id as key, i as line, cast(strlen(array_to_string(list_transform(range(1, k + 1), lambda j: rest[j] || case when j < k then hits[j] else '' end), '')) + 1 as bigint) as col, hits[k] as hit, len(x[greatest(i - 2, 1):i - 1]) as n_before, len(x[i + 1:i + 2]) as n_after from (select *, unnest(range(1, len(hits) + 1)) as k from h)""")
def regex_search(spark, d):
    """Every match: 1-based line and byte column, with the lines around it."""
    found = documents.searched(_docs(spark, d).withColumnRenamed("doc_id", "key"), "Licen[cs]e[d]?", context=2)
    return found.select("key", "line", "col", "hit", F.size("before").cast("long").alias("n_before"), F.size("after").cast("long").alias("n_after"))


@query("""with l as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as l, x from (select doc_id, string_split(text, chr(10)) as x from documents)), h as (select doc_id, i, l, x, regexp_extract_all(l, 'Licen[cs]e[d]?') as hits, string_split_regex(l, 'Licen[cs]e[d]?') as rest from l where regexp_matches(l, 'Licen[cs]e[d]?'))
select doc_id as key, i as line, cast(strlen(array_to_string(list_transform(range(1, k + 1), lambda j: rest[j] || case when j < k then hits[j] else '' end), '')) + 1 as bigint) as col, hits[k] as hit, len(x[greatest(i - 2, 1):i - 1]) as n_before, len(x[i + 1:i + 2]) as n_after from (select *, unnest(range(1, len(hits) + 1)) as k from h)""")
def indexed_search(spark, d):
    """The same through an index of trigrams that was written before."""
    docs, at = _docs(spark, d).withColumnRenamed("doc_id", "key"), _folder(spark, "trigrams")
    documents.write_trigrams(docs, at)
    found = documents.searched_by_index(docs, spark.read.parquet(at), "Licen[cs]e[d]?", context=2)
    return found.select("key", "line", "col", "hit", F.size("before").cast("long").alias("n_before"), F.size("after").cast("long").alias("n_after"))


_CALLS = "select doc_id, text || case doc_id % 9 when 0 then '<tool_call>' || chr(123) || chr(125) when 1 then '<function=x>' || chr(123) when 2 then '```json' when 3 then '```yaml' when 4 then chr(10) || 'name: x' || chr(10) || 'arguments:' when 5 then chr(123) || chr(125) when 6 then 'call(a=1)' when 7 then chr(125) || chr(123) else '' end as text from documents"


@query(rf"with d as ({_CALLS}), b as (select *, len(text) - len(replace(text, chr(123), '')) as o, len(text) - len(replace(text, chr(125), '')) as c, text like '%```yaml%' or regexp_matches(text, '(?m)(^|\n)name:\s+\S+\s*\n\s*arguments:') as y, regexp_matches(text, '\w+\(\w+\s*=') as t from d), f as (select *, concat_ws(',', case when contains(text, '<tool_call>') then 'hermes' end, case when contains(text, '<function=') then 'xml' end, case when contains(text, '```json') then 'fenced' end, case when y then 'yaml' end, case when o > 0 and o = c then 'loose_json' end) as f from b) select case when f = '' and t then 'text' else f end as formats, count(*) as n from f group by 1")
def format_detect(spark, d):
    docs = spark.sql(_CALLS.replace("documents", "{docs}"), docs=_docs(spark, d))
    return docs.groupBy(F.array_join(t.detected_formats(F.col("text")), ",").alias("formats")).agg(F.count("*").alias("n"))


def _store(spark, d) -> DataFrame:
    """A store of ledger lines, some blank, broken, of another version or kind."""
    e = a.ledger(spark, d)
    body = F.to_json(F.struct(F.lit("architect_ledger").alias("record"), "project_id", "session_id", "model", "skill", "last_ts", F.when(F.col("seq") % 11 == 0, 0).otherwise(1).alias("schema_version")))
    value = F.when(F.col("seq") % 13 == 0, "").when(F.col("seq") % 17 == 0, F.substring(body, 1, 20)).when(F.col("seq") % 19 == 0, F.lit('{"schema_version":1,"record":"odd"}')).when(F.col("seq") % 23 == 0, F.lit('{"ts":1}')).otherwise(body)
    return e.select("seq", value.alias("value"))


@query("""& s as (select *, case when seq % 13 = 0 then 'blank' when seq % 17 = 0 then 'malformed' when seq % 19 = 0 then 'other' when seq % 23 = 0 then 'legacy_run' when seq % 11 = 0 then 'other' else 'architect_ledger' end as c from ledger),
k as (select *, max(case when c = 'architect_ledger' then seq end) over (partition by project_id, session_id, model, skill) as last from s) select case when c = 'architect_ledger' and seq < last then 'superseded' else c end as class, count(*) as n, cast(sum(seq) as bigint) as seqs from k group by 1""", "ledger")
def compact_classes(spark, d):
    from tracelake.sources import store

    return store.class_counts(_store(spark, d)).drop("bytes")


def _written(spark, d, kind: str) -> DataFrame:
    """Records of one kind, read back from a store to which runs, reviews and, in two batches, ledger lines were appended."""
    from tracelake.sources import store

    path = f"{store.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    ledger = a.ledger(spark, d)
    if kind == "architect_ledger":
        store.append_ledger(ledger.where("seq % 2 = 0"), path)
        store.append_ledger(ledger.where("seq % 2 = 1"), path)
    elif kind == "review":
        store.append_review(a.reviews(spark, d), path)
    elif kind == "architect_activity":
        store.append_activity(a.activities(spark, d), path)
    store.append_run(a.runs(spark, d), path)
    return store.records(store.lines(spark, path), kind)


@query("select model, count(*) as n, sum(ts)::bigint as ts, round(sum(wall_clock_s), 3) as wall, count(case when test then 1 end) as tested, count(temperature) as with_temperature, cast(sum(output_tokens) as bigint) as output_tokens from runs group by 1", "runs")
def read_runs(spark, d):
    r = _written(spark, d, "run")
    return r.groupBy("model").agg(F.count("*").alias("n"), F.sum("ts").alias("ts"), F.round(F.sum("wall_clock_s"), 3).alias("wall"), F.count_if("gates.test").alias("tested"), F.count("generation_params.temperature").alias("with_temperature"), F.sum("tokens.output_tokens").alias("output_tokens"))


@query("select verdict as architect_verdict, count(*) as n, count(warnings) as warned, cast(sum(bounces) as bigint) as bounces, cast(sum(case when class1 = 'none' then 1 else 0 end) as bigint) as clean from reviews group by 1", "reviews")
def read_reviews(spark, d):
    r = _written(spark, d, "review")
    return r.groupBy("architect_verdict").agg(F.count("*").alias("n"), F.count("warnings").alias("warned"), F.sum("bounces_to_approval").alias("bounces"), F.count_if(F.get("failure_class", F.lit(0)) == "none").alias("clean"))


@query("& f as (select *, row_number() over (partition by phase_id, activity, ts order by seq desc) as k from activities) select activity, model, count(*) as n, cast(sum(input) as bigint) as input from f where k = 1 group by 1, 2", "activities")
def read_activities(spark, d):
    """The last record of each (phase, activity, ts)."""
    r = folds.last_write_wins(_written(spark, d, "architect_activity"), ["phase_id", "activity", "ts"])
    return r.groupBy("activity", "model").agg(F.count("*").alias("n"), F.sum("tokens.input").alias("input"))


@query("& o as (select *, row_number() over (partition by project_id, session_id, model, skill order by seq % 2 desc, seq desc) as k from ledger) select project_id, session_id, model, skill, input, last_ts from o where k = 1", "ledger")
def read_ledger(spark, d):
    """Two appends: the last line of a key is one of the second batch, if that has any."""
    return folds.last_write_wins(_written(spark, d, "architect_ledger"), costs.LEDGER_KEY).select("project_id", "session_id", "model", "skill", "tokens.input", "last_ts")


TOOLS = ["read_file", "bash", "patch", "search", "update_task", "symbols", "move_file", "odd_tool"]
_TOOL_SQL = "list_extract(['read_file', 'bash', 'patch', 'search', 'update_task', 'symbols', 'move_file', 'odd_tool'], cast(seq % 8 + 1 as int))"


def _calls(spark, d) -> DataFrame:
    return a.session(spark, d).withColumn("called", F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("seq") % 8 + 1).cast("int")))


@query(f"& c as (select *, {_TOOL_SQL} as t from session) select t as called, case when t in ('read_file', 'symbols') then 'read' when t in ('patch', 'move_file') then 'write' when t = 'search' then 'search' when t = 'bash' then 'run' when t = 'update_task' then 'meta' end as category, t in ('patch', 'move_file') as mutating, count(*) as n from c group by t", "session")
def tool_categories(spark, d):
    n = _calls(spark, d).groupBy("called").agg(F.count("*").alias("n"))
    return n.select("called", pr.tool_category(F.col("called")).alias("category"), pr.mutates(F.col("called")).alias("mutating"), "n")


@query(f"& c as (select session, seq, {_TOOL_SQL} as t, arguments from session), l as (select session, case when t = 'move_file' then 'to' || arguments else arguments end as path, max(seq) as last from c where t in ('patch', 'move_file') group by 1, 2), r as (select *, row_number() over (partition by session order by last desc, path) as k from l) select session, path, last, k as rank from r where k <= 5", "session")
def newest_mutated(spark, d):
    """Of every session, the five files changed last."""
    calls = _calls(spark, d).select("session", "seq", F.col("called").alias("tool"), F.col("arguments").alias("path"), F.concat(F.lit("to"), "arguments").alias("to"))
    return sessions.newest_changed(calls)


@query("& n as (select seq, (select max(ts) from runs) - ts as age from runs), s as (select seq, age // 1000 as s from n) select seq, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || lpad(cast(s % 60 as varchar), 2, '0') || 's' when s < 86400 then (s // 3600) || 'h' else (s // 86400) || 'd' end as age, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || lpad(cast(s % 60 as varchar), 2, '0') || 's' else (s // 3600) || 'h' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || 'm' end as span from s", "runs")
def age_labels(spark, d):
    r = a.runs(spark, d).select("seq", "ts")
    old = r.crossJoin(F.broadcast(r.agg(F.max("ts").alias("now")))).withColumn("old", F.col("now") - F.col("ts"))  # one row
    return old.select("seq", pr.age(F.col("old")).alias("age"), pr.age(F.col("old"), days=False).alias("span"))


@query("select p_partkey, case when p_partkey % 4 = 0 then p_name else 'M' || p_size || ' — ' || array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') end as label from part")
def milestone_labels(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    folder = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("M"), "p_size", F.lit("-"), F.translate("p_name", " ", "-")))
    return p.select("p_partkey", pr.milestone_label(folder).alias("label"))


@query(r"with e as (select doc_id, cast(coalesce(list_sum(list_transform(regexp_extract_all(text, '[^\s!-/:-@\[-`{-~]+'), lambda w: ceil(length(w) / 4))), 0) as bigint) + cast(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) as bigint) as tokens, n_chars * 27 // 100 as ceiling from documents) select doc_id, ceiling, tokens >= ceiling as overflows, case when ceiling = 0 then 0 else round(tokens / ceiling, 6) end as used from e")
def budget_use(spark, d):
    """Estimated tokens against 27 % of the characters as a context; equality overflows."""
    e = spark.read.parquet(f"{d}/documents.parquet")
    e = e.select("doc_id", t.token_estimate(F.col("text")).alias("tokens"), pr.budget_ceiling(F.col("n_chars"), 27).alias("ceiling"))
    return e.select("doc_id", "ceiling", (F.col("tokens") >= F.col("ceiling")).alias("overflows"), F.round(pr.budget_used(F.col("tokens"), F.col("ceiling")), 6).alias("used"))


@query("with x as (select doc_id, string_split(text, chr(10)) as x from documents) select doc_id, len(x) < 3 as past_end, case when len(x) >= 3 then sha256(array_to_string(x[3:502], chr(10))) end as range_sha256 from x")
def range_read(spark, d):
    """Lines from the third on, 500 at most; a start behind the last line is an error, not an empty range."""
    x = _docs(spark, d).select("doc_id", documents.line_range(F.col("text"), 3).alias("x"))
    return x.select("doc_id", F.col("x").isNull().alias("past_end"), F.sha2(F.col("x").cast("binary"), 256).alias("range_sha256"))


@query("& g as (select l_suppkey, l_returnflag as severity, case when l_linenumber > 1 then cast(l_linenumber as varchar) end as code, l_linestatus as message, l_orderkey from lineitem), b as (select distinct l_suppkey, severity, code, message from g where l_orderkey % 2 = 0) select severity, n is not null as known, count(*) as diagnostics from (select g.*, (select 1 from b where b.l_suppkey = g.l_suppkey and b.severity = g.severity and b.message = g.message and b.code is not distinct from g.code) as n from g where l_orderkey % 2 = 1) group by 1, 2".replace("& g as", "with g as", 1))
def diagnostics_partition(spark, d):
    """Findings against a baseline by path, severity, code (null equals null) and message."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    keys = [F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("severity"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")).alias("code"), F.col("l_linestatus").alias("message")]
    now, base = (li.where(f"l_orderkey % 2 = {k}").select(*keys) for k in (1, 0))
    return diagnostics.against(now, base).groupBy("severity", "known").agg(F.count("*").alias("diagnostics"))


@query("& m as (select max(ts) as now from runs) select project_id, count(*) as kept from runs, m where ts >= greatest(now - 2592000000, 0) group by project_id", "runs")
def runs_within_ttl(spark, d):
    """What pruning keeps: thirty days, the boundary included."""
    r = a.runs(spark, d).select("ts", "project_id")
    return sessions.within_ttl(r, r.agg(F.max("ts")).first()[0] or 0).groupBy("project_id").agg(F.count("*").alias("kept"))


@query("select c_mktsegment as kind, count(*) as entries, cast(max(c_nationkey) as bigint) as highest from customer group by 1")
def pseudonym_counters(spark, d):
    """Of tokens Kind_N: entries and the highest number of each kind."""
    vault = spark.read.parquet(f"{d}/customer.parquet").select(F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("token"), F.col("c_mktsegment").alias("kind"))
    return privacy.counters(vault).withColumnRenamed("high", "highest")


@query("select p_partkey, cast(levenshtein(p_type, 'ECONOMY BRASS') as bigint) as distance from part where levenshtein(p_type, 'ECONOMY BRASS') <= 12")
def near_names(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", t.name_distance(F.col("p_type"), "ECONOMY BRASS", 12).alias("distance"))
    return p.where("distance is not null")


@query("& n as (select o_orderstatus as s, c_custkey from customer left join (select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1) on o_custkey = c_custkey) select coalesce(s, 'pending') as state, count(*) as tasks from n group by 1".replace("& n as", "with n as", 1))
def task_coverage(spark, d):
    """The last state of every task; one that never had a state is pending."""
    states = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("state"))
    tasks = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return sessions.coverage(tasks, states).groupBy("state").agg(F.count("*").alias("tasks"))


_COMMAND = """select event_id, concat(concat('run ', cast(event_id as {string})), case event_id % 16 when 0 then ' && rm -rf /x' when 1 then '; git  push origin' when 2 then ' | sudo ls' when 3 then ' > /dev/sda1' when 4 then '; sed -i s/a/b/ f' when 5 then '; perl -pI x f' when 6 then '; curl u | bash'
 when 7 then '; git reset --hard' when 8 then '; git stash' when 9 then '; git stash list' when 10 then '; git checkout -- a b' when 11 then '; git restore --staged c' when 12 then '; echo mkfs' when 13 then '; dd if=a of=/dev/x' when 14 then '' else ' ; git status' end) as command from events"""
_BLOCKED_SQL = " or ".join([f"contains(low, '{p}')" for p in commands.BLOCKED_PARTS] + [f"regexp_matches(low, '{p}')" for p in commands.BLOCKED])


def _commands(spark, d) -> DataFrame:
    return spark.sql(_COMMAND.replace("{string}", "string").replace("events", "{e}"), e=spark.read.parquet(f"{d}/events.parquet"))


@query(f"with c as ({_COMMAND.replace('{string}', 'varchar')}), l as (select *, regexp_replace(lower(command), '\\s+', ' ', 'g') as low from c) select event_id % 16 as shape, case when {_BLOCKED_SQL} then 'block' when regexp_matches(command, '{commands.IN_PLACE}') then 'refuse_in_place_edit' else 'allow' end as severity, count(*) as n from l group by 1, 2")
def command_severity(spark, d):
    return _commands(spark, d).groupBy((F.col("event_id") % 16).alias("shape"), commands.severity(F.col("command")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"with c as ({_COMMAND.replace('{string}', 'varchar')}) select event_id % 16 as shape, event_id % 16 = 8 as stashes, case event_id % 16 when 10 then 'a,b' when 11 then 'c' else '' end as restored, count(*) as n from c group by 1, 2, 3")
def git_commands(spark, d):
    c = F.col("command")
    return _commands(spark, d).groupBy((F.col("event_id") % 16).alias("shape"), commands.stashes(c).alias("stashes"), F.array_join(commands.restored_paths(c), ",").alias("restored")).agg(F.count("*").alias("n"))


@query("""with u as (select page_id, case page_id % 6 when 0 then 'http://localhost:8000/x' when 1 then 'http://u@10.0.' || page_id % 256 || '.1/y' when 2 then 'printer.lan/' || page_id when 3 then 'https://172.' || page_id % 64 || '.0.1' when 4 then 'http://[::1]:9/' else url end as url from pages)
select page_id, case page_id % 6 when 0 then 'localhost' when 1 then '10.0.' || page_id % 256 || '.1' when 2 then 'printer.lan' when 3 then '172.' || page_id % 64 || '.0.1' when 4 then '::1' else regexp_extract(url, '^[a-z]+://([^/:]+)', 1) end as host,
 case page_id % 6 when 3 then page_id % 64 between 16 and 31 when 5 then false else true end as local, case page_id % 6 when 3 then page_id % 64 not between 16 and 31 when 5 then true else false end as redacts from u""")
def egress_hosts(spark, d):
    """Hosts of this machine, of private networks and their neighbours, names of a local network, and the pages' own."""
    p, n = spark.read.parquet(f"{d}/pages.parquet"), F.col("page_id")
    local = [F.lit("http://localhost:8000/x"), F.concat(F.lit("http://u@10.0."), n % 256, F.lit(".1/y")), F.concat(F.lit("printer.lan/"), n), F.concat(F.lit("https://172."), n % 64, F.lit(".0.1")), F.lit("http://[::1]:9/"), F.col("url")]
    p = p.select(n, F.element_at(F.array(*local), (n % 6 + 1).cast("int")).alias("url"))
    return p.select("page_id", commands.host(F.col("url")).alias("host"), commands.is_local(F.col("url")).alias("local"), commands.redacts_egress(F.lit(True), F.lit(None).cast("boolean"), F.col("url")).alias("redacts"))


_LONG = "with d as (select doc_id, repeat(text || 'é漢', cast(doc_id % 3 * 20 + 1 as int)) as text from documents where text <> ''), b as (select *, encode(text) as b from d), n as (select *, 50000 + coalesce(list_min(list_filter([0, 1, 2, 3], lambda k: strlen(text) <= 50000 + k or hex(b[50001 + k:50001 + k]) not between '80' and 'BF')), 0) as cut from b)\n"


@query(_LONG + "select doc_id, sha256(case when strlen(text) <= 50000 then text else decode(b[1:cut]) || chr(10) || chr(10) || '[truncated: ' || (strlen(text) - 50000) || ' bytes elided]' end) as capped_sha256, left(text, 500) as preview, case when length(text) > 100 then left(replace(replace(text, chr(10), ' '), chr(9), ' '), 100) || '…' else replace(replace(text, chr(10), ' '), chr(9), ' ') end as line from n")
def capped_fields(spark, d):
    """All documents, two of three of them repeated to be long, with characters of two and three bytes where the cut may fall."""
    text = F.repeat(F.concat("text", F.lit("é漢")), (F.col("doc_id") % 3 * 20 + 1).cast("int"))
    docs = _docs(spark, d).where("text <> ''").select("doc_id", text.alias("text"))
    return docs.select("doc_id", F.sha2(commands.capped(F.col("text")).cast("binary"), 256).alias("capped_sha256"), commands.preview(F.col("text")).alias("preview"), commands.line_preview(F.col("text")).alias("line"))


@query("select doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') or regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}') or regexp_matches(text, '(\\+?1[-. ])?(\\([0-9]{3}\\)|[0-9]{3})[-. ][0-9]{3}[-. ][0-9]{4}') or regexp_matches(text, '[0-9]{4}([ -]?[0-9]{4}){3}') as held from documents")
def prompt_guard(spark, d):
    return _docs(spark, d).select("doc_id", commands.prompt_guarded(F.col("text")).alias("held"))


@query("with e as (select event_id, unnest(list_distinct(string_split(props, ''))) as c, string_split(props, '') as x from events) select event_id, round(-sum(len(list_filter(x, lambda y: y = c)) / len(x) * log2(len(list_filter(x, lambda y: y = c)) / len(x))), 6) as bits from e group by 1")
def byte_entropy(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(t.entropy(F.col("props")), 6).alias("bits"))


_MESSAGES = """select conv_id as conv, turn * 2 + 1 as idx, turn as turn, case when turn = 0 then 'system' else 'assistant' end as role, 'read_file' as tool, concat('p', cast((conv_id + turn) % 2 as {string})) as path, turn % 5 = 4 as ranged, cast(10 as bigint) as tokens from conversations
 union all select conv_id, turn * 2 + 2, turn, 'tool', 'read_file', null, null, cast(length(text) as bigint) from conversations"""
_EDITS = "select distinct conv_id as conv, turn * 2 + 3 as idx, turn as turn, concat('p', cast(turn % 2 as {string})) as path from conversations where turn % 3 = 2"


def _messages(spark, d) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{d}/conversations.parquet").dropDuplicates(["conv_id", "turn"])
    return tuple(spark.sql(x.replace("{string}", "string").replace("conversations", "{c}"), c=c) for x in (_MESSAGES, _EDITS))


_TALK = f"with m as ({_MESSAGES.replace('{string}', 'varchar')}), e as ({_EDITS.replace('{string}', 'varchar')}), r as (select a.conv, b.idx, a.turn, a.path, a.ranged, b.tokens from m a join m b on a.conv = b.conv and b.idx = a.idx + 1 where a.role = 'assistant')\n"


@query(_TALK + "select r.conv, r.idx, r.path, arg_min(e.turn, e.idx) as turn, greatest(r.tokens - 24, 0) as reclaimed from r join e on r.conv = e.conv and r.path = e.path and e.idx > r.idx group by r.conv, r.idx, r.path, r.tokens")
def superseded_reads(spark, d):
    return context.superseded(*_messages(spark, d))


@query(_TALK + ", u as (select conv, path, idx, turn, tokens, true as rd from r where not ranged union all select conv, path, idx, turn, 0, false from e), l as (select *, lag(rd) over w as br, lag(turn) over w as bt, lag(tokens) over w as bk from u window w as (partition by conv, path order by idx)) select conv, idx, path, bt as prior_turn, greatest(bk - 36, 0) as saved from l where rd and br")
def repeated_reads(spark, d):
    return context.repeated(*_messages(spark, d))


def _est(x: str) -> str:
    return rf"(cast(coalesce(list_sum(list_transform(regexp_extract_all({x}, '[^\s!-/:-@\[-`{{-~]+'), lambda w: ceil(length(w) / 4))), 0) as bigint) + cast(len(regexp_extract_all({x}, '[!-/:-@\[-`{{-~]')) as bigint))"


def _noted(x: str, what: str) -> str:
    return f"('[compacted: ' || strlen({x}) || ' bytes / ' || {_est(x)} || ' tokens — {what} compacted for budget]')"


_WRAPPED = "'<tool_result>' || text || '</tool_result>'"


@query(f"""with c as (select conv_id as conv, turn as idx, turn // 2 as turn, role as said, text, conv_id % 3 = 0 as other from conversations),
m as (select *, case when said = 'assistant' and idx % 4 = 1 then 'tool' else said end as role, case when said = 'user' and idx % 4 = 2 then {_WRAPPED} else text end as shown from c),
t as (select *, {_est("shown")} as t, case when said = 'user' and idx % 4 = 2 then {_est("'<tool_result>' || " + _noted("text", "original content") + " || '</tool_result>'")} - {_est("shown")} end as d1, case when role = 'tool' then {_est(_noted("text", "tool result"))} - {_est("text")} end as d2, case when role = 'tool' then case when other then 0 else 1 end end as rank from m),
a as (select *, sum(t) over (partition by conv) + 3 as bef, max(turn) over (partition by conv) as newest from t),
b as (select *, bef + coalesce(sum(d1) over (partition by conv order by idx rows between unbounded preceding and 1 preceding), 0) as run from a),
d as (select *, d1 is not null and min(run) over (partition by conv order by idx) > 225 as did1 from b),
e as (select *, bef + coalesce(sum(case when did1 then d1 end) over (partition by conv), 0) as left1, case when rank is not null and newest - turn >= 3 then greatest(-d2, 0) end as gain from d),
f as (select *, gain is not null and left1 - coalesce(sum(gain) over (partition by conv order by case when gain is not null then rank end nulls first, turn, idx rows between unbounded preceding and 1 preceding), 0) > 225 as did2 from e),
g as (select *, left1 - coalesce(sum(case when did2 then gain end) over (partition by conv), 0) as left2, t + case when did1 then d1 when did2 then d2 else 0 end as now from f),
h as (select *, role <> 'system' and left2 - coalesce(sum(case when role <> 'system' then now end) over (partition by conv order by idx rows between unbounded preceding and 1 preceding), 0) > 225 as gone from g)
select conv, idx, case when gone then 'evict' when did1 or did2 then 'shorten' else 'keep' end as action, cast(case when gone then 0 else now end as bigint) as tokens, cast(bef as bigint) as before from h""")
def context_compaction(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").dropDuplicates(["conv_id", "turn"])
    tool, wrapped = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1), (F.col("role") == "user") & (F.col("turn") % 4 == 2)
    result = F.array(F.struct(F.when(F.col("conv_id") % 3 == 0, "bash").otherwise("read_file").alias("tool"), F.col("text").alias("content")))
    messages = c.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("idx"), F.when(tool, "tool").otherwise(F.col("role")).alias("role"), F.floor(F.col("turn") / 2).alias("turn"),
        F.when(tool, "").when(wrapped, F.concat(F.lit("<tool_result>"), "text", F.lit("</tool_result>"))).otherwise(F.col("text")).alias("content"), F.lit(None).cast("array<string>").alias("calls"), F.when(tool, result).alias("results"),
    )
    return context.compacted(messages, 300, "be brief").select("conv", "idx", "action", "tokens", "before")


@query("select p_partkey, 'phase-' || lpad(cast(p_size as varchar), 2, '0') || case when p_size % 3 = 0 then '-b' else '' end as id, case when p_size % 2 = 0 then 'M' || p_size || '-x' end as milestone from part")
def phase_paths(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.lit("docs/"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("M"), "p_size", F.lit("-x"))).otherwise("notes"), F.lit("/phase-"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.when(F.col("p_size") % 3 == 0, "-b").otherwise(""), F.lit("-"), F.lower(F.element_at(F.split("p_name", " "), 1)), F.lit("-words.md"))
    return p.select("p_partkey", documents.phase_id(path).alias("id"), documents.milestone_id(path).alias("milestone"))


@query("select replace(p_name, ' ', '/') || '.txt' as path from part where regexp_matches(replace(p_name, ' ', '/') || '.txt', '^([^/]*/)*[^/]*e[^/]*\\.txt$') order by 1 limit 100")
def found_files(spark, d):
    files = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.translate("p_name", " ", "/"), F.lit(".txt")).alias("path"))
    return documents.found_files(files, "**/*e*.txt")


@query("with s as (select doc_id, cast(row_number() over (order by doc_id) as bigint) as r from (select distinct doc_id, text from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) select count(*) as documents from s")
def pii_documents(spark, d):
    """Documents in which spans of e-mail addresses remain after spans that overlap are merged."""
    s = privacy.spans(_docs(spark, d).distinct()).where(F.exists("spans", lambda x: x["kind"] == "email"))
    return s.agg(F.count("*").alias("documents"))


@query("""with t as (select distinct w as term from (select unnest(string_split(text, ' ')) as w from benchmark) where length(w) >= 6),
o as (select term, (length(text) - length(replace(text, term, ''))) // length(term) as n from documents, t where contains(text, term))
select term, count(*) as documents, cast(sum(n) as bigint) as occurrences from o group by 1""")
def term_occurrences(spark, d):
    """Every longer word of the benchmark as a term, anywhere in the documents."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split("text", " ")).alias("text")).where("length(text) >= 6")
    own = terms.build(words.select("text", F.lit("term").alias("kind")))
    each = terms.occurrences(_docs(spark, d), own).select("doc_id", F.explode("terms").alias("t"))
    return each.groupBy(F.col("t.text").alias("term"), "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


@query("""with each as (select l_orderkey as doc, l_linenumber as place, case when l_suppkey % 2 = 0 then 'person_name' else 'org' end as kind, 's' || l_suppkey || '/' || l_returnflag as original from lineitem),
f as (select original, arg_min(kind, (doc, -place, kind)) as kind, min((doc, -place)) as o from each group by original)
select case kind when 'org' then 'Org_' else 'Person_' end || row_number() over (partition by kind order by o, original) as token, original, kind from f where original not in (select 's' || s_suppkey || '/R' from supplier where s_suppkey % 3 = 0)
union all select case when s_suppkey % 2 = 0 then 'Person_' else 'Org_' end || -s_suppkey, 's' || s_suppkey || '/R', case when s_suppkey % 2 = 0 then 'person_name' else 'org' end from supplier where s_suppkey % 3 = 0""")
def pseudonym_numbers(spark, d):
    """Suppliers named in order lines as spans, numbered where they first occur; a third of them are in the vault already."""
    kind = lambda k: F.when(k % 2 == 0, "person_name").otherwise("org")
    each = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), F.struct(F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), kind(F.col("l_suppkey")).alias("kind"), F.concat(F.lit("s"), "l_suppkey", F.lit("/"), "l_returnflag").alias("text")).alias("s"))
    found = each.groupBy("doc").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    s = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 3 = 0")
    vault = s.select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Person_").otherwise("Org_"), (-F.col("s_suppkey")).cast("string")).alias("token"), F.concat(F.lit("s"), "s_suppkey", F.lit("/R")).alias("original"), kind(F.col("s_suppkey")).alias("kind"))
    return privacy.numbered(found, vault)


@query("""with a as (select distinct unnest(string_split(lower(p_name), ' ')) as name from part), b as (select distinct unnest(string_split(lower(text), ' ')) as name from benchmark)
select a.name, min(b.name) as nearest, cast(min(d) as bigint) as distance from a join (select a.name as own, b.name, levenshtein(a.name, b.name) as d, min(levenshtein(a.name, b.name)) over (partition by a.name) as least from a, b) b on own = a.name and d = least and d <= 2 group by a.name""")
def nearest_names(spark, d):
    """Words of the parts' names and the nearest words of the benchmark."""
    words = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.explode(F.split(F.lower(c), " ")).alias("name"))
    return names.closest(words("part", "p_name"), words("benchmark", "text"))


@query()
def pseudonyms(spark, d):
    """Texts with personal data, their pseudonymised form and whether it reads back as it was."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("doc"), "text").distinct()
    at = _folder(spark, "spans")
    privacy.spans(docs).where("size(spans) > 0").write.parquet(at)  # used five times, found once
    found = spark.read.parquet(at)
    vault = privacy.numbered(found)
    masked = privacy.pseudonymised(found, vault)
    back = privacy.reconstituted(masked, vault).select("doc", F.col("text").alias("back"))
    return found.select("doc", "text").join(masked.select("doc", F.col("text").alias("masked")), "doc").join(back, "doc").select("doc", F.sha2(F.col("masked").cast("binary"), 256).alias("masked_sha256"), (F.col("back") == F.col("text")).alias("same"))


REGISTRY = {
    "read_file": {"properties": {"path": {"type": "string"}, "start_line": {"type": "integer"}, "force": {"type": "boolean", "default": False}}, "required": ["path"]},
    "bash": {"properties": {"command": {"type": "string"}, "timeout": {"type": "integer"}}, "required": ["command"]},
    "search": {"properties": {"pattern": {"type": "string"}, "path": {"type": "string"}}, "required": ["pattern"]},
}
_REPLY = """select event_id, concat(concat('I will. ', case event_id % 7 when 0 then concat('<tool_call>', concat(chr(123), '"name":"read_file","arguments":')) when 1 then concat('<function=bash>', chr(123)) when 2 then concat('```json ', concat(chr(123), '"name":"serch","arguments":')) when 3 then 'bash(command=ls)' when 4 then 'no call' when 5 then concat(chr(123), '"name":"read_file","arguments":') else concat('<tool_call>', concat(chr(123), 'name: "bash", "arguments":')) end),
 case event_id % 7 when 0 then concat(chr(123), concat('"file_path":"p","start_line":"7"', concat(chr(125), chr(125)))) when 1 then concat('"cmd":"ls",', chr(125)) when 2 then concat(chr(123), concat('"query":"x"', concat(chr(125), chr(125)))) when 5 then concat(chr(123), concat('"odd":1', concat(chr(125), chr(125)))) when 6 then concat(chr(123), concat('"command":"a",', concat(chr(125), chr(125)))) else '' end) as text from events"""


@query("with r as (select event_id % 7 as shape, count(*) as n from events group by 1) select shape, case when shape = 4 then 'none' when shape in (1, 5) then 'failed' else 'found' end as status, case shape when 0 then 'read_file' when 1 then 'bash' when 2 then 'search' when 3 then 'bash' when 5 then 'read_file' when 6 then 'bash' end as name, case shape when 0 then '{\"force\":false,\"path\":\"p\",\"start_line\":7}' when 1 then '{\"cmd\":\"ls\"}' when 2 then '{\"pattern\":\"x\"}' when 3 then '{\"command\":\"ls\"}' when 5 then '{\"force\":false,\"odd\":1}' when 6 then '{\"command\":\"a\"}' end as arguments, case shape when 0 then 'alias,coerce,default' when 1 then 'json' when 2 then 'name,alias' when 5 then 'default' when 6 then 'json' else '' end as repairs, n from r")
def tool_calls(spark, d):
    """Calls in replies of seven shapes."""
    replies = spark.sql(_REPLY.replace("events", "{e}"), e=spark.read.parquet(f"{d}/events.parquet"))
    p = toolcalls.parsed(replies, REGISTRY)
    return p.groupBy((F.col("event_id") % 7).alias("shape"), "call.status", "call.name", "call.arguments", F.array_join("call.repairs", ",").alias("repairs")).agg(F.count("*").alias("n"))


@query(FOLDED + """, s as (select model, unnest([tag1, tag2]) as tag, f.* exclude (model) from f), g as (select model, tag, count(*) as n_runs, round(avg(case when coalesce(fmt, false) and coalesce(build, false) and coalesce(lint, false) and coalesce(test, false) then 1.0 else 0.0 end), 6) as gates_pass_rate, round(avg(tool_success_rate), 6) as tool_success_rate_mean, round(avg(parse_failure_rate), 6) as parse_failure_rate_mean, round(avg(case when escalated then 1.0 else 0.0 end), 6) as escalation_rate,
 count(verdict) as n_with_verdict, round(avg(case when verdict is null then null when verdict = 'approved_first_try' then 1.0 else 0.0 end), 6) as approved_first_try_rate, round(avg(bounces), 6) as bounces_to_approval_mean, count(case when latest and r is not null then 1 end) as n_reviews from s group by 1, 2),
 h as (select model, unnest([tag1, tag2]) as tag, r from f where latest and r is not null), c as (select model, tag, unnest([r.class1, r.class2]) as k from h), k as (select model, tag, k, count(*) as n from c where k <> 'none' group by 1, 2, 3), l as (select model, tag, string_agg(k || '=' || n, ',' order by n desc, k) as classes from k group by 1, 2)
 select g.*, coalesce(classes, '') as classes from g left join l on g.model = l.model and g.tag = l.tag""", "runs", "reviews")
def capability_profile(spark, d):
    p = scorecard.profile(a.runs(spark, d), a.reviews(spark, d))
    shown = F.array_join(F.transform(F.coalesce("failure_classes", F.array().cast("array<struct<failure_class:string,n:bigint>>")), lambda c: F.concat(c["failure_class"], F.lit("="), c["n"].cast("string"))), ",")
    return _score(p.withColumn("classes", shown).drop("failure_classes"))


_COUNT = "case when {0} = 0 then '—' when {0} < 1000 then cast({0} as varchar) when {0} < 1000000 then printf('%.1f', {0} / 1000.0::double) || 'k' else printf('%.1f', {0} / 1000000.0::double) || 'M' end"
_RUN_ID = "lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(ts || '|' || model || '|' || phase_id, ''), lambda c: ascii(c)::ubigint)), lambda h, x: ((xor(h, x) * 16777619) & 4294967295)::ubigint)), 8, '0'))"


@query("& n as (select *, greatest(1000000000000 - ts, 0) // 1000 as s, case when gen_time_s > 0 then output_tokens / gen_time_s end as tps from runs) select seq, " + _RUN_ID + " as run_id, case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' || lpad(cast(s % 60 as varchar), 2, '0') || 's' when s < 86400 then s // 3600 || 'h' else s // 86400 || 'd' end as age, model, phase_id as phase, 'complete' as status, (case when fmt then '✓' else '✗' end) || (case when build then '✓' else '✗' end) || (case when lint then '✓' else '✗' end) || (case when test then '✓' else '✗' end) as gates, " + _COUNT.format("input_tokens") + " as input, " + _COUNT.format("output_tokens") + " as output, coalesce(printf('%.0f', tps), '—') as speed, " + _COUNT.format("reclaimed") + " as reclaimed, " + LABEL + " as settings from n", "runs")
def run_table(spark, d):
    return scorecard.run_table(a.runs(spark, d), 1_000_000_000_000)


@query("select seq, strftime(epoch_ms(ts), '%Y-%m-%d') as date, strftime(epoch_ms(ts + seq * 1000), '%H:%M:%S') as time from runs", "runs")
def run_dates(spark, d):
    r = a.runs(spark, d)
    return r.select("seq", pr.utc_date(F.col("ts")).alias("date"), pr.utc_time(F.col("ts") + F.col("seq") * 1000).alias("time"))


@query("select event_id, greatest(greatest(cast(round(value * 100) as bigint) - event_id % 500, 0) - event_id % 70, 0) as input_tokens, event_id % 900 as output_tokens, event_id % 500 as cache_read_tokens, event_id % 70 as cache_write_tokens from events")
def usage_classes(spark, d):
    from tracelake.sources import backends

    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", backends.usage_classes(F.round(F.col("value") * 100), F.col("event_id") % 900, F.col("event_id") % 500, F.col("event_id") % 70).alias("u")).select("event_id", "u.*")


@query("select p_partkey as line, 'src/' || p_brand || '.ts' as path, p_size as \"column\", 'TS' || p_size as code, p_name as message from part where p_partkey % 3 = 0")
def type_checker_errors(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    line = F.concat(F.col("p_brand"), F.lit(".ts("), F.col("p_partkey").cast("string"), F.lit(","), F.col("p_size").cast("string"), F.lit("): "), F.when(F.col("p_partkey") % 3 == 0, "error TS").otherwise("warning TS"), F.col("p_size").cast("string"), F.lit(": "), "p_name")
    return diagnostics.from_type_checker(p.select(F.col("p_partkey").alias("seq"), line.alias("value")), "src").select("line", "path", "column", "code", "message")
