"""Ignore files of a repository: which paths their rules leave out.

A rule is a line of an ignore file: a pattern, whether it takes back what others leave out (`!`), whether it is for folders only
(`/` at its end), and the folder whose paths it is about. For a path, and for every folder on the way to it, the rules of all folders above are asked; of
those that match, one of `.ignore` counts before one of `.gitignore`, then the one of the deeper folder, then the later line. What
lies in a folder that is left out is left out, whatever other rules say. Hidden names are left out unless a rule takes them back.

All of it is joins: folders and files are asked once each, however many paths share a folder, and meet rules by the rule's folder.

Defined cases: blank lines and comments are no rules; `\\` takes a character as it is; blanks at a line's end do not count unless
escaped; a pattern that is no pattern (an open bracket) matches nothing; null paths are left out of the result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.privacy import _by_text

#: Names of ignore files, the one that counts least first.
NAMES = (".gitignore", ".ignore")
_RULES = "array<struct<line:int,negated:boolean,folder_only:boolean,regex:string>>"


def _bracket(pattern: str, i: int) -> tuple[str, int] | None:
    """The class that opens at i as a regular expression, and where it ends."""
    j = i + 1
    negated = pattern[j : j + 1] in ("!", "^")
    j += negated
    out, first = "", True
    while j < len(pattern) and (pattern[j] != "]" or first):
        if pattern[j] == "\\" and j + 1 < len(pattern):
            j += 1
        c = pattern[j]
        ranged = c == "-" and not first and pattern[j + 1 : j + 2] not in ("]", "")
        out += "-" if ranged else re.sub(r"([\\\]\[^&~|-])", r"\\\1", c)
        first, j = False, j + 1
    return None if j >= len(pattern) else ((f"[^/{out}]" if negated else f"[{out}]"), j + 1)


def rule(line: str) -> dict | None:
    """Of a line: negated, folder_only, regex (of a path below the rule's folder); None if it is no rule."""
    line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t]+$", r"\1", line.removesuffix("\r"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folder_only = line.endswith("/")
    line = line[: len(line) - folder_only]
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i) and i in (0, *[m.end() for m in re.finditer("/", line)]):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line == "**":
            out, i = ".+", 2
        elif line[i] == "[":
            found = _bracket(line, i)
            if found is None:
                return None
            out, i = out + found[0], found[1]
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(line[i]) or re.escape(line[i])
            i += 1
    return {"negated": negated, "folder_only": folder_only, "regex": f"^{out}$" if anchored else f"^(?:.*/)?{out}$"}


def rules(files: DataFrame) -> DataFrame:
    """files: path (of an ignore file, relative to the root), text. Gives folder, rank (which counts more), negated, folder_only,
    regex of every rule."""

    def of(text: str | None) -> list[dict]:
        found = [(i, rule(line)) for i, line in enumerate((text or "").split("\n"))]
        return [{"line": i} | r for i, r in found if r is not None]

    each = _by_text(files.select("path", "text"), of, "text", out="rules", kind=_RULES).select("path", F.explode("rules").alias("r"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    rank = F.struct((F.element_at(F.split("path", "/"), -1) == NAMES[1]).cast("int").alias("kind"), depth.alias("depth"), F.col("r.line").alias("line"))
    return each.select(folder.alias("folder"), rank.alias("rank"), "r.negated", "r.folder_only", "r.regex")


def decided(subjects: DataFrame, of: DataFrame) -> DataFrame:
    """subjects: subject (a path), is_folder. Gives them with left_out, by the rules and names of their own alone."""
    parts = F.split("subject", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = subjects.withColumn("folder", F.explode(above))
    below = F.when(F.col("folder") == "", F.col("subject")).otherwise(F.expr("substring(subject, length(folder) + 2)"))
    met = each.join(of, "folder").where((F.col("is_folder") | ~F.col("folder_only")) & F.regexp_like(below, F.col("regex")))
    last = met.groupBy("subject", "is_folder").agg(F.max_by("negated", "rank").alias("negated"))
    hidden = F.element_at(parts, -1).startswith(".")
    return subjects.join(last, ["subject", "is_folder"], "left").select("subject", "is_folder", F.coalesce(~F.col("negated"), hidden).alias("left_out"))


def kept(paths: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of paths (path, relative to the root, ...) that no rule leaves out."""
    d = paths.where("path is not null").withColumn("__parts", F.split("path", "/"))
    n = F.size("__parts")
    way = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice("__parts", 1, k), "/").alias("subject"), (k < n).alias("is_folder")))
    each = d.select("path", way.alias("way")).distinct().select("path", F.explode("way").alias("s")).select("path", "s.*")
    out = each.join(decided(each.select("subject", "is_folder").distinct(), of), ["subject", "is_folder"]).where("left_out").select("path").distinct()
    return paths.where("path is not null").join(out, "path", "left_anti")
