"""Labels, categories and budgets as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The built-in tools of each category.
CATEGORIES = {
    "read": ["read_file", "symbols"],
    "write": ["write_file", "patch", "patch_lines", "delete_file", "move_file"],
    "search": ["search", "find_files"],
    "run": ["bash"],
    "meta": ["update_task"],
}

# Event types that share a switch with others; any other type has its own.
SHARED_SWITCH = {"session": ["session_start", "session_end"], "tool_call": ["parsed", "tool_result"], "metrics": ["metrics", "novelty_sample"]}


def tool_category(tool: Column) -> Column:
    """Null for an unknown tool."""
    return F.coalesce(*[F.when(tool.isin(names), F.lit(kind)) for kind, names in CATEGORIES.items()])


def mutates(tool: Column) -> Column:
    return F.coalesce(tool_category(tool) == "write", F.lit(False))


def activity_switch(event_type: Column) -> Column:
    return F.coalesce(*[F.when(event_type.isin(names), F.lit(kind)) for kind, names in SHARED_SWITCH.items()], event_type)


def age(millis: Column, days: bool = True) -> Column:
    """5s, 3m12s, then 1h and 2d; without days: 1h04m, 49h00m."""
    s = F.floor(millis / 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda unit: F.floor(s / unit).cast("string")
    short = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(whole(60), F.lit("m"), two(s % 60), F.lit("s")))
    if days:
        return short.when(s < 86400, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))
    return short.otherwise(F.concat(whole(3600), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("m")))


def milestone_label(folder: Column) -> Column:
    """M15-dashboard-polish-2 as `M15 — Dashboard Polish 2`; only first characters change; other shapes stay as they are."""
    words = F.transform(F.split(F.regexp_extract(folder, "^[^-]*-([\\s\\S]*)$", 1), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(folder.rlike("^M[0-9]+[^-]*-"), F.concat(F.substring_index(folder, "-", 1), F.lit(" — "), F.array_join(words, " "))).otherwise(folder)


def budget_ceiling(context: Column, percent: int) -> Column:
    return F.floor(context * percent / 100).cast("long")


def budget_used(tokens: Column, ceiling: Column) -> Column:
    return F.when(ceiling == 0, 0.0).otherwise(tokens / ceiling)


def utc_date(millis: Column) -> Column:
    """YYYY-MM-DD of epoch milliseconds in UTC."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int")).cast("string")


def utc_time(millis: Column) -> Column:
    """HH:MM:SS of epoch milliseconds in UTC."""
    s = F.pmod(F.floor(millis / 1000), F.lit(86_400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two(s % 3600 / 60), two(s % 60))


def cost_cell(cost: Column) -> Column:
    return F.when(cost == 0, "—").otherwise(F.concat(F.lit("$"), F.replace(F.format_number(cost, 4), F.lit(","), F.lit(""))))


def speed_cell(rate: Column) -> Column:
    """Whole tokens a second."""
    return F.when(rate.isNull(), "—").otherwise(F.replace(F.format_number(rate, 0), F.lit(","), F.lit("")))


def gate_cell(passed: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), "✓").otherwise("✗")


def phase_label(path: Column, phase: Column) -> Column:
    """The stem of the document's path, else the id."""
    return F.coalesce(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""), phase)
