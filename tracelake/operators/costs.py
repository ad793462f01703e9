"""Cost accounting over the usage ledger. Rates are a small table (model, input_rate, output_rate; dollars per million tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.metrics import ledger_cost
from tracelake.functions.rates import token_cost
from tracelake.operators.folds import last_write_wins

LEDGER_KEY = ["project_id", "session_id", "model", "skill"]
#: The run's token counts by class of price.
RUN_CLASSES = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_creation": "cache_write_tokens"}


def priced(ledger: DataFrame, rates: DataFrame) -> DataFrame:
    """Folded ledger rows with cost; unknown models cost 0, their tokens still count."""
    r = rates.select(F.col("model").alias("r_model"), "input_rate", "output_rate")
    folded = last_write_wins(ledger, LEDGER_KEY)
    j = folded.join(r, folded["model"] == r["r_model"], "left")
    return j.withColumn("cost", F.coalesce(ledger_cost(F.col("input_rate"), F.col("output_rate")), F.lit(0.0))).drop("r_model", "input_rate", "output_rate")


def skill_costs(ledger: DataFrame, rates: DataFrame, project: str) -> DataFrame:
    """Per display skill of a project: messages, tokens, cost and percent of the total; the dearest first."""
    p = priced(ledger, rates).where(F.col("project_id") == project).withColumn("skill", F.when(F.col("skill") == "other", "architect chat").otherwise(F.col("skill")))
    g = p.groupBy("skill").agg(F.sum("messages").alias("messages"), F.sum(F.col("tokens.input") + F.col("tokens.cache_creation") + F.col("tokens.cache_read") + F.col("tokens.output")).alias("tokens"), F.sum("cost").alias("cost"))
    total = F.sum("cost").over(Window.partitionBy())  # as many rows as skills
    return g.withColumn("percent", F.when(total > 0, F.col("cost") / total * 100).otherwise(0.0)).orderBy(F.col("cost").desc(), "skill")


def top_skill(ledger: DataFrame, rates: DataFrame, project: str) -> DataFrame:
    """The dearest skill; of equal ones the first by name. No row if there is none."""
    return skill_costs(ledger, rates, project).limit(1)


def active_milestone(runs: DataFrame, project: str) -> DataFrame:
    """The milestone of the project's latest run that has one; of runs at one time the last in the store. One row or none."""
    r = runs.where((F.col("project_id") == project) & F.col("milestone_id").isNotNull())
    return r.agg(F.max_by("milestone_id", F.struct("ts", "seq")).alias("milestone_id")).where("milestone_id is not null")


def session_tokens(log: DataFrame) -> DataFrame:
    """session, input_tokens, output_tokens: counts of the session's last metrics, which are cumulative; 0 without any."""
    last = lambda c: F.coalesce(F.max_by(F.col(f"event.{c}"), F.when(F.col("event.event_type") == "metrics", F.col("seq"))), F.lit(0).cast("bigint"))
    return log.groupBy("session").agg(last("input_tokens").alias("input_tokens"), last("output_tokens").alias("output_tokens"))


def report(scopes: DataFrame, saved: tuple[float, float], executor: dict[str, float]) -> DataFrame:
    """Adds to scopes (token counts by class, architect: its cost or null) executor (its cost, all four classes), saved (what
    input and output would have cost at the saved rates; null if these are 0), net (null if a part is) and executor_tokens."""
    c = {k: F.col(v) for k, v in RUN_CLASSES.items()}
    price = token_cost({k: c[k] for k in ("input", "output")}, {"input": saved[0], "output": saved[1]})
    out = scopes.withColumns({"saved": price if any(saved) else F.lit(None).cast("double"), "executor": token_cost(c, executor), "executor_tokens": sum(c.values(), F.lit(0)).cast("bigint")})
    return out.withColumn("net", F.col("saved") - F.col("executor") - F.col("architect"))


def scope_costs(runs: DataFrame, ledger: DataFrame, rates: DataFrame, project: str, saved: tuple[float, float], executor: dict[str, float], log: DataFrame | None = None) -> DataFrame:
    """report() of the project, of each of its milestones and, of a log, each session. The architect's cost, and so the net, is
    the project's alone."""
    r = runs.where(F.col("project_id") == project)
    sums = [F.coalesce(F.sum(f"tokens.{c}"), F.lit(0)).cast("bigint").alias(c) for c in RUN_CLASSES.values()]
    whole = r.agg(*sums).select(F.lit("project").alias("scope"), "*")
    stones = r.where("milestone_id is not null").groupBy("milestone_id").agg(*sums).select(F.concat(F.lit("milestone:"), "milestone_id").alias("scope"), *RUN_CLASSES.values())
    both = whole.unionByName(stones)
    if log is not None:
        zero = F.lit(0).cast("bigint")
        both = both.unionByName(session_tokens(log).select(F.concat(F.lit("session:"), "session").alias("scope"), "input_tokens", "output_tokens", zero.alias("cache_read_tokens"), zero.alias("cache_write_tokens")))
    arch = priced(ledger, rates).where(F.col("project_id") == project).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("architect")).select("architect", F.lit("project").alias("s"))
    out = both.join(F.broadcast(arch), both["scope"] == arch["s"], "left").drop("s")  # one row
    return report(out, saved, executor)


def ledger_lines(report: DataFrame) -> DataFrame:
    """scope, line, amount of the spend table: the executor's saving (credit), the architect's cost (debit) and the net."""
    lines = F.array(
        F.struct(F.lit("executor").alias("line"), (F.col("saved") - F.col("executor")).alias("amount")),
        F.struct(F.lit("architect").alias("line"), (-F.col("architect")).alias("amount")),
        F.struct(F.lit("net").alias("line"), F.col("net").alias("amount")),
    )
    return report.select("scope", F.explode(lines).alias("x")).select("scope", "x.line", "x.amount")


def assists(activities: DataFrame, project: str) -> DataFrame:
    """How many assists the project's folded activities hold. One row."""
    f = last_write_wins(activities, ["phase_id", "activity", "ts"])
    return f.where((F.col("project_id") == project) & (F.col("activity") == "assist")).agg(F.count("*").alias("assists"))
