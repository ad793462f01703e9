"""Findings of verifiers: three output formats, findings against a baseline, test failures, changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["path", "line", "column", "severity", "message", "code"]


def from_compiler(lines: DataFrame, root: str) -> DataFrame:
    """Errors among JSON lines (seq, value) of a compiler: those with a primary span, at its place; the replacements it is sure
    of are added to the message."""
    span = "struct<file_name:string,line_start:bigint,column_start:bigint,is_primary:boolean,suggested_replacement:string,suggestion_applicability:string>"
    schema = f"reason string, message struct<level:string,message:string,code:struct<code:string>,spans:array<{span}>,children:array<struct<message:string,spans:array<{span}>>>>"
    d = lines.select("seq", F.inline(F.array(F.struct(F.from_json("value", schema).alias("j")))))
    m = F.col("j.message")
    primary = F.get(F.filter("j.message.spans", lambda s: s["is_primary"]), F.lit(0))
    d = d.where((F.col("j.reason") == "compiler-message") & (m["level"] == "error") & m["message"].isNotNull()).withColumn("p", primary).where("p.file_name is not null and p.line_start is not null")
    sure = F.filter(F.flatten(F.transform(F.coalesce("j.message.children", F.array().cast(f"array<struct<message:string,spans:array<{span}>>>")), lambda c: F.transform(F.filter(c["spans"], lambda s: (s["suggestion_applicability"] == "MachineApplicable") & s["suggested_replacement"].isNotNull()), lambda s: F.concat(F.lit("\n  "), c["message"], F.lit(": "), s["suggested_replacement"])))), lambda x: x.isNotNull())
    text = F.concat(F.col("j.message.message"), F.array_join(sure, ""))
    return d.select("seq", F.concat(F.lit(root.rstrip("/") + "/"), "p.file_name").alias("path"), F.col("p.line_start").alias("line"), F.col("p.column_start").alias("column"), F.lit("error").alias("severity"), text.alias("message"), F.col("j.message.code.code").alias("code"))


def from_type_checker(lines: DataFrame, root: str) -> DataFrame:
    """Errors among lines `file(line,column): error CODE: message`."""
    pattern = r"^([^(]*)\(([0-9]+)(?:,([0-9]+))?[^)]*\):\s*error ([^:]*):([\s\S]*)$"
    g = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select("seq", F.concat(F.lit(root.rstrip("/") + "/"), F.trim(g(1))).alias("path"), g(2).try_cast("bigint").alias("line"), g(3).try_cast("bigint").alias("column"), F.lit("error").alias("severity"), F.trim(g(5)).alias("message"), g(4).alias("code")).where("line is not null")


def from_linter(outputs: DataFrame) -> DataFrame:
    """Findings of a linter's JSON array (seq, value); fields it does not give are empty, lines 0."""
    schema = "array<struct<code:string,message:string,filename:string,location:struct<row:bigint,column:bigint>>>"
    each = outputs.select("seq", F.explode(F.from_json("value", schema)).alias("e"))
    return each.select("seq", F.coalesce("e.filename", F.lit("")).alias("path"), F.coalesce("e.location.row", F.lit(0).cast("bigint")).alias("line"), F.col("e.location.column").alias("column"), F.lit("error").alias("severity"), F.coalesce("e.message", F.lit("")).alias("message"), F.col("e.code").alias("code"))


def against(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """now with known: whether the baseline has a finding of equal path, severity, code (null equals null) and message; lines and
    columns may differ."""
    same = ["path", "severity", "code", "message"]
    b = baseline.select(*[F.col(c).alias(f"__{c}") for c in same]).distinct().withColumn("__known", F.lit(True))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    return now.join(b, on, "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known", *[f"__{c}" for c in same])


def test_failures(lines: DataFrame) -> DataFrame:
    """run, place, name, location, detail of every failed test in lines (run, i, line) of test output: blocks that begin with
    `---- name stdout ----` and end with the next, `failures:` or `test result:`."""
    w = Window.partitionBy("run").orderBy("i")
    t = F.ltrim("line")
    head = F.regexp_extract(t, r"^---- ([\s\S]*) stdout ----$", 1)
    is_head, is_end = t.rlike(r"^---- [\s\S]* stdout ----$"), (t == "failures:") | t.startswith("test result:")
    d = lines.select("run", "i", t.alias("t"), is_head.alias("head"), (is_head | is_end).alias("edge"), head.alias("name"))
    d = d.withColumns({"place": F.max(F.when(F.col("edge"), F.col("i"))).over(w)})
    block = Window.partitionBy("run", "place").orderBy("i")
    d = d.withColumn("inside", F.first("head").over(block)).where("inside")
    at = F.min(F.when(F.contains("t", F.lit("panicked at ")), F.col("i"))).over(Window.partitionBy("run", "place"))
    d = d.withColumn("at", at)
    says = (F.col("i") > F.col("at")) & ~F.col("t").startswith("note:") & (F.col("t") != "") & ~F.col("t").startswith("(x")
    g = d.groupBy("run", "place").agg(F.max(F.when(F.col("head"), F.col("name"))).alias("name"), F.max(F.when(F.col("i") == F.col("at"), F.regexp_replace(F.regexp_extract("t", r"panicked at ([\s\S]*)$", 1), ":$", ""))).alias("location"), F.sort_array(F.collect_list(F.when(says, F.struct("i", "t")))).alias("x"))
    return g.select("run", "place", "name", "location", F.array_join("x.t", ", ").alias("detail"))


def changed_lines(files: DataFrame) -> DataFrame:
    """files (path, before, after) with added and removed, of those that changed: lines beyond the longest common run of both, kept
    in order."""
    from tracelake.operators.privacy import _by_text

    def counted(a: str | None, b: str | None) -> dict:
        import difflib

        x, y = (a or "").splitlines(), (b or "").splitlines()
        same = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        return {"added": len(y) - same, "removed": len(x) - same}

    out = _by_text(files.select("path", "before", "after"), counted, "before", "after", out="n", kind="struct<added:bigint,removed:bigint>")
    return out.select("path", "n.added", "n.removed").where("added > 0 or removed > 0")


def progress_line(changes: DataFrame, turn: int, stage: str, top: int = 5) -> DataFrame:
    """One row: sums over all files, then the first `top` files by path."""
    total = changes.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("a"), F.coalesce(F.sum("removed"), F.lit(0)).alias("r"), F.count("*").alias("n"))
    some = changes.orderBy("path").limit(top).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit(" "), "path", F.lit(":+"), F.col("added").cast("string"), F.lit("/-"), F.col("removed").cast("string")))), "").alias("files"))
    more = F.when(F.col("n") > top, F.concat(F.lit("  …+"), (F.col("n") - top).cast("string"))).otherwise("")
    line = F.concat(F.lit(f"turn={turn} stage={stage} +"), F.col("a").cast("string"), F.lit("/-"), F.col("r").cast("string"), F.lit(" files="), F.col("n").cast("string"), "files", more)
    return total.join(F.broadcast(some)).select(line.alias("line"))  # a row each
