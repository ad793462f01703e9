"""Phase documents, found files, ranges and searched lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import bound


def section(markdown: Column, title: str) -> Column:
    """The text under `## title` up to the next section, trimmed; null without one."""
    m = F.regexp_extract(markdown, rf"(?:^|\n)##[ \t]+{re.escape(title)}[ \t]*(?:\n|$)((?:(?!\n?##[ \t])[\s\S])*)", 1)
    return F.nullif(F.trim(F.regexp_replace(m, r"^\s+|\s+$", "")), F.lit(""))


def phase_id(path: Column) -> Column:
    """Of a file's stem `phase-<id>-<words>` the id: parts with a digit, single letters and small Roman numerals, up to the first
    other word; another stem is its own id."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    kept = F.regexp_extract(stem, r"^(phase(?:-(?:[^-]*[0-9][^-]*|[a-z]|[ivx]+)(?=-|$))+)", 1)
    return F.when(kept != "", kept).otherwise(stem)


def milestone_id(path: Column) -> Column:
    """The folder of the file, if it is named M and a digit; else null."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.when(F.size(F.split(path, "/")) > 1, F.when(folder.rlike("^M[0-9]"), folder))


def seeded_tasks(docs: DataFrame) -> DataFrame:
    """doc, place, id, title of the tasks that the `## Spec` section lists: `1. **Title** ...`, `### 1. Title`, `### Task 1: Title`
    or `### §1 — Title`. A task whose id or title an earlier one that stays has is left out."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("place")
    t = F.trim("line")
    at = F.min(F.when(t == "## Spec", F.col("place"))).over(Window.partitionBy("doc"))
    inside = lines.withColumn("at", at).where("place > at")
    ended = F.coalesce(F.max(F.when(F.trim("line").startswith("## "), F.lit(True))).over(w), F.lit(False))
    own = inside.withColumn("ended", ended).where("not ended")
    shapes = [(r"^([0-9]+)\.[ \t]\s*\*\*([\s\S]*?)\*\*", F.col("line")), (r"^### §\s*([0-9]+)\s*[—:.]\s*([\s\S]+)$", t), (r"^### Task \s*([0-9]+)\s*[—:.]\s*([\s\S]+)$", t), (r"^### ([0-9]+)\.[ \t]\s*([\s\S]+)$", t)]
    pick = lambda i: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, p, i)), F.lit("")) for p, c in shapes])
    found = own.select("doc", "place", pick(1).alias("id"), pick(2).alias("title")).where("id is not null and title is not null")
    lists = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("place", "id", "title"))).alias("t"))
    none = F.slice(F.col("t"), 1, 0)
    kept = F.aggregate("t", none, lambda a, x: F.when(F.exists(a, lambda y: (y["id"] == x["id"]) | (y["title"] == x["title"])), a).otherwise(F.concat(a, F.array(x))))
    return lists.select("doc", F.explode(kept).alias("x")).select("doc", "x.place", "x.id", "x.title")


def line_range(text: Column, start: int, end: int | None = None, most: int = 500) -> Column:
    """Lines start to end of a text, `most` at most; null if it has fewer lines than start."""
    lines = F.split(text, "\n")
    n = most if end is None else max(0, min(most, end - start + 1))
    return F.when(F.size(lines) >= start, F.array_join(F.slice(lines, start, n), "\n"))


def glob_pattern(glob: str) -> str:
    """A regular expression of a glob: * and ? within a name, ** over folders, [...] and {a,b}."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        if c == "[" and (close := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + glob[i + 1 : close].replace("!", "^", 1 if glob[i + 1] == "!" else 0).replace("\\", "\\\\") + "]", close + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:"}.get(c) or (")" if c == "}" else "|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out}$"


def found_files(files: DataFrame, glob: str, *, most: int = 100, depth: int | None = None) -> DataFrame:
    """path of the first `most` files, by path, that match a glob; depth: folders below the root at most. A glob without a folder
    is looked for by name everywhere."""
    target = F.col("path") if "/" in glob else F.element_at(F.split("path", "/"), -1)
    out = files.where(target.rlike(glob_pattern(glob)))
    if depth is not None:
        out = out.where(F.size(F.split("path", "/")) <= depth)
    return out.select("path").orderBy("path").limit(most)


def _places(line: Column, p: str) -> Column:
    """Start bytes of the matches: what lies before each, split off."""
    hits, rest = F.regexp_extract_all(line, F.lit(f"({p})"), F.lit(1)), F.split(line, p)
    step = lambda a, x: F.struct((a["at"] + F.octet_length(x["r"]) + F.octet_length(x["h"])).cast("bigint").alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.octet_length(x["r"]) + 1).cast("bigint").alias("col"), x["h"].alias("hit")))).alias("out"))
    pairs = F.zip_with(F.slice(rest, 1, F.size(hits)), hits, lambda r, h: F.struct(r.alias("r"), h.alias("h")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<col:bigint,hit:string>>").alias("out"))
    return F.aggregate(pairs, zero, step)["out"]


def searched(docs: DataFrame, pattern: str, *, context: int = 0, most: int | None = None, ignore_case: bool = False) -> DataFrame:
    """key, line, col (1-based, col in bytes), hit, before and after (up to five lines) of every match, in order of key, line and
    col; the first `most` of them. Lines without a match, and their neighbours, never leave the array of a text's lines."""
    k = min(context, 5)
    p = f"(?U{'i' if ignore_case else ''}){pattern}"

    def hits(lines: Column) -> Column:
        numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x["line"].rlike(p))
        around = lambda i: (F.slice(lines, F.greatest(i + 1 - k, F.lit(1)), F.least(i, F.lit(k))).alias("before"), F.slice(lines, i + 2, k).alias("after"))
        return F.transform(numbered, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), *around(x["i"])))

    each = docs.select("key", F.explode(bound(F.split("text", "\n"), hits)).alias("x")).select("key", "x.*")
    out = each.select("key", (F.col("i") + 1).cast("bigint").alias("line"), "before", "after", F.explode(bound(F.col("line"), lambda x: _places(x, p))).alias("m")).select("key", "line", "m.col", "m.hit", "before", "after")
    return out if most is None else out.orderBy("key", "line", "col").limit(most)


def truncated(found: DataFrame, most: int) -> bool:
    """Whether a search or a list of files that was cut at `most` reached it."""
    return found.limit(most).count() >= most


def needed_trigrams(pattern: str, ignore_case: bool = False) -> set[int]:
    """Three ASCII characters each, lower-cased, that every text with a match holds. None are known of a pattern with
    alternatives at its top, or that is read in another way elsewhere."""
    import re._constants as c
    import re._parser as parser

    if re.search(r"\\[0-9QEhHzZGRXkpPxuN]", pattern):  # not the same in both dialects
        return set()
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return set()
    if tree.state.flags & re.VERBOSE:
        return set()
    ignore_case = ignore_case or bool(tree.state.flags & re.IGNORECASE)
    texts: list[str] = []

    def walk(items) -> None:
        run = ""
        for kind, value in items:
            if kind is c.LITERAL:
                run += chr(value)
                continue
            texts.append(run)
            run = ""
            if kind is c.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
                walk(value[2])
            elif kind is c.ATOMIC_GROUP:
                walk(value)
        texts.append(run)

    walk(tree)
    # letters that are a case of one outside ASCII
    odd = set("iksIKS") if ignore_case else set()
    return {_trigram(t[i : i + 3].lower().encode()) for t in texts for i in range(len(t) - 2) if t[i : i + 3].isascii() and not odd & set(t[i : i + 3])}


def _trigram(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def trigrams(docs: DataFrame) -> DataFrame:
    """trigram, key of every three ASCII characters, lower-cased, that a text (key, text) holds. To be written in ranges of
    trigram, so that a search reads few of them: see write_trigrams()."""

    def of(text: str | None) -> list[int]:
        import numpy as np

        b = np.frombuffer((text or "").encode().lower(), np.uint8).astype(np.int32)
        if len(b) < 3:
            return []
        ascii_ = b < 128
        return np.unique((b[:-2] << 16 | b[1:-1] << 8 | b[2:])[ascii_[:-2] & ascii_[1:-1] & ascii_[2:]]).tolist()

    from tracelake.operators.privacy import _by_text

    return _by_text(docs.select("key", "text"), of, "text", out="trigrams", kind="array<int>").select(F.explode("trigrams").alias("trigram"), "key")


def write_trigrams(docs: DataFrame, path: str) -> None:
    """A trigram that most texts hold is spread over several ranges by key."""
    trigrams(docs).repartitionByRange("trigram", "key").sortWithinPartitions("trigram", "key").write.parquet(path)


def candidates(index: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame | None:
    """key of the texts that hold all trigrams that a match needs; None if none are known, and all texts must be read. index:
    trigram, key, each pair once."""
    needed = sorted(needed_trigrams(pattern, ignore_case))
    if not needed:
        return None
    return index.where(F.col("trigram").isin(needed)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(needed)).select("key")


def searched_by_index(docs: DataFrame, index: DataFrame, pattern: str, *, context: int = 0, most: int | None = None, ignore_case: bool = False) -> DataFrame:
    """As searched(), of the texts alone that the index does not rule out. Each key must be one text."""
    some = candidates(index, pattern, ignore_case)
    return searched(docs if some is None else docs.join(some, "key", "left_semi"), pattern, context=context, most=most, ignore_case=ignore_case)


def search_repository(spark, root: str, index: DataFrame, pattern: str, *, context: int = 0, ignore_case: bool = False, most_files: int = 100_000) -> DataFrame:
    """As searched(), over the files (key: path below root) of an index. Files that the index rules out are not opened, as long as
    the others are `most_files` at most (else all are)."""
    some = candidates(index, pattern, ignore_case)
    names = None if some is None else [r["key"] for r in some.limit(most_files + 1).collect()]
    if names is None or len(names) > most_files:
        texts = repository_texts(spark, root).select(F.col("path").alias("key"), "text")
        return searched(texts if some is None else texts.join(some, "key", "left_semi"), pattern, context=context, ignore_case=ignore_case)
    if not names:
        return searched(spark.createDataFrame([], "key string, text string"), pattern, context=context, ignore_case=ignore_case)
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").load([f"{base}/{n}" for n in names])
    path = F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/+', '/'), {len(re.sub('^[a-z0-9]+:/+', '/', base)) + 2})")
    return searched(f.select(path.alias("key"), F.col("content").cast("string").alias("text")), pattern, context=context, ignore_case=ignore_case)


def _contents(files: DataFrame, root: str) -> DataFrame:
    """files (path below root) with text; null if it is not UTF-8. Spark's file sources read no hidden files."""
    source = files.select("path")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text], pa.string())], names=["path", "text"])

    return source.mapInArrow(run, "path string, text string")


def repository_texts(spark, root: str, globs: tuple[str, ...] = (), most: int = 1 << 20) -> DataFrame:
    """path, text of the files under root of `most` bytes at most that are UTF-8, without hidden ones and without what ignore
    files leave out (`.gitignore` only where root is a repository); with globs only those that match one. Names are listed by
    the driver, as Spark's sources do; only files that stay are opened, by tasks."""
    from pyarrow import fs

    from tracelake.operators import ignore

    root = (root if ":/" in root else f"file://{root}").rstrip("/")
    system, base = fs.FileSystem.from_uri(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    own = [(f.path[len(base) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File]
    names = ignore.NAMES if system.get_file_info(f"{base}/.git").type != fs.FileType.NotFound else ignore.NAMES[1:]
    files = spark.createDataFrame([f for f in own if "/.git/" not in f"/{f[0]}"], "path string, length bigint")
    rules = ignore.rules(_contents(files.where(F.element_at(F.split("path", "/"), -1).isin(*names)), root))
    kept = ignore.kept(files.where(F.col("length") <= most), rules)
    out = _contents(kept.repartition("path"), root).where("text is not null").where(~F.contains("text", F.lit("\x00")))
    for i, g in enumerate(globs):
        match = F.col("path").rlike(glob_pattern(g)) if "/" in g else F.element_at(F.split("path", "/"), -1).rlike(glob_pattern(g))
        keep = match if i == 0 else keep | match
    return out.where(keep) if globs else out


SYMBOLS = "array<struct<name:string,kind:string,line:bigint,definition:boolean>>"


def symbols(docs: DataFrame) -> DataFrame:
    """docs (text of Python modules) with symbols: where functions, methods, classes and module variables are defined, and where
    names are used. A text that is no Python has none."""
    from tracelake.operators.privacy import _by_text

    def found(text: str | None) -> list[dict]:
        import ast

        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last two: nested too deeply
            return []
        out, todo = [], [(tree, "module")]
        kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.Lambda: "function"}
        while todo:  # a stack of its own: trees may be deeper than calls may be
            node, inside = todo.pop()
            for child in ast.iter_child_nodes(node):
                line = getattr(child, "lineno", 0)
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.append((line, child.name, "method" if inside == "class" else "function", True))
                elif isinstance(child, ast.ClassDef):
                    out.append((line, child.name, "class", True))
                elif isinstance(child, ast.Name):
                    own = isinstance(child.ctx, ast.Store) and inside == "module"
                    out.append((line, child.id, "variable" if own else "reference", own))
                elif isinstance(child, ast.Attribute):
                    out.append((line, child.attr, "reference", False))
                todo.append((child, kinds.get(type(child), inside)))
        return [{"name": n, "kind": k, "line": at, "definition": d} for at, n, k, d in sorted(out)]

    return _by_text(docs, found, "text", out="symbols", kind=SYMBOLS)
