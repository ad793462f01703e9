"""Derived measures of runs and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295


def gates_all_pass(gates: str = "gates") -> Column:
    """A null gate has not passed."""
    ok = F.lit(True)
    for g in ("fmt", "build", "lint", "test"):
        ok = ok & F.coalesce(F.col(f"{gates}.{g}"), F.lit(False))
    return ok


def has_tags(tags: list[str]) -> Column:
    """All of the tags; true for none."""
    ok = F.lit(True)
    for t in tags:
        ok = ok & F.array_contains("tags", t)
    return ok


def shipped(verdict: Column) -> Column:
    return verdict.startswith("approved") | (verdict == "escalated")


def attributable(failure: Column) -> Column:
    return ~failure.isin("none", "spec_bug", "infra_blip")


def reclaimed_total(e: str = "context_efficiency") -> Column:
    return F.col(f"{e}.compaction_tokens_reclaimed") + F.col(f"{e}.output_filtered_tokens") + F.col(f"{e}.read_evicted_tokens") + F.col(f"{e}.read_deduped_tokens")


def number_text(x: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def settings_label(p: str = "generation_params") -> Column:
    t, s = F.col(f"{p}.temperature"), F.col(f"{p}.seed")
    label = F.concat_ws(",", F.concat(F.lit("temp="), number_text(t)), F.concat(F.lit("seed="), s.cast("string")))
    return F.when(label == "", "default").otherwise(label)


def tokens_per_second(output: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, output / seconds)


def run_id(ts: Column, model: Column, phase: Column) -> Column:
    """FNV-1a, 32 bits, of ts|model|phase in UTF-8, as eight hex digits."""
    text = F.concat_ws("|", ts.cast("string"), model, phase)
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    h = F.aggregate(pairs, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(U32)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def ledger_cost(input_rate: Column, output_rate: Column) -> Column:
    """Of a ledger row with tokens and split cache writes; cache reads at 0.1, five-minute writes at 1.25, one-hour writes at 2 times the input rate."""
    per = lambda c, r: F.col(c) / F.lit(1e6) * r
    return per("tokens.input", input_rate) + per("tokens.output", output_rate) + per("tokens.cache_read", input_rate * 0.1) + per("cache_creation_5m", input_rate * 1.25) + per("cache_creation_1h", input_rate * 2)


def nearest_rank(values: Column, p: float) -> Column:
    """Of an array: the element at round(p * (n - 1)), half away from zero; 0 for none."""
    v = F.array_sort(values)
    return F.when(F.size(v) == 0, 0).otherwise(F.get(v, F.round(F.lit(p) * (F.size(v) - 1)).cast("int")))


def compact_count(n: Column) -> Column:
    scaled = lambda d, u: F.concat(F.replace(F.format_number(n / F.lit(float(d)), 1), F.lit(","), F.lit("")), F.lit(u))
    return F.when(n == 0, "—").when(n < 1000, n.cast("string")).when(n < 1_000_000, scaled(1000, "k")).otherwise(scaled(1_000_000, "M"))


def zulu_millis(text: Column) -> Column:
    """Epoch milliseconds of ISO text; only month and day are checked, so a 31st of February rolls over; 0 on failure or before 1970."""
    pat = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?Z?$"
    g = lambda i: F.expr("0") if i == 0 else F.regexp_extract(text, pat, i).try_cast("long")
    y, m, d = g(1), g(2), g(3)
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    days = era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468
    frac = F.coalesce(F.rpad(F.left(F.regexp_extract(text, pat, 7), F.lit(3)), 3, "0").try_cast("long"), F.lit(0))
    ms = ((days * 86400 + g(4) * 3600 + g(5) * 60 + g(6)) * 1000 + frac).cast("long")
    return F.when(text.rlike(pat) & m.between(1, 12) & d.between(1, 31) & (ms >= 0), ms).otherwise(F.lit(0).cast("long"))
