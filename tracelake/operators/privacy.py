"""Personal data in texts: spans, stable pseudonyms and their reversal, irreversible redaction, an incremental index.

Spans need offsets, which no built-in function gives, so they are found in Arrow batches; offsets are code points. All that
joins, numbers or counts them is declared as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import PERSONAL

# Kinds of personal data with the prefix of their pseudonyms and the tag of their markers.
KINDS = {
    "person_name": ("Person", "name"),
    "email": ("Email", "email"),
    "phone": ("Phone", "phone"),
    "ssn": ("Ssn", "ssn"),
    "card": ("Card", "card"),
    "ipv4": ("Ip", "ip"),
    "mac": ("Mac", "mac"),
    "street_address": ("Address", "address"),
    "org": ("Org", "org"),
}
#: The order in which detectors run; it decides between equal spans.
ORDER = ["email", "ssn", "phone", "ipv4", "mac", "card"]
SPANS = "array<struct<start:int,end:int,kind:string,text:string>>"
_PATTERNS = {k: re.compile(PERSONAL[k]) for k in ORDER}
_FOUR, _DOTTED = re.compile(r"\d{4}"), re.compile(r"\.\d")


def _possible(text: str) -> list[str]:
    """The detectors, in order, that may find something: those of whose matches the text holds some plain part."""
    four = _FOUR.search(text) is not None
    yes = {
        "email": "@" in text, "ssn": four and "-" in text, "phone": four, "card": four, "ipv4": _DOTTED.search(text) is not None,
        "mac": text.count(":") + text.count("-") >= 5,
    }
    return [k for k in ORDER if yes[k]]


def _card(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"]
    twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0


def merged(spans: list[dict]) -> list[dict]:
    """In order of their start; of spans that overlap, the first to start stays, of those the longest, of equals the first given."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["start"] - s["end"])):
        if not kept or s["start"] >= kept[-1]["end"]:
            kept.append(s)
    return kept


def detected(text: str) -> list[dict]:
    found = [{"start": m.start(), "end": m.end(), "kind": k, "text": m[0]} for k in _possible(text) for m in _PATTERNS[k].finditer(text) if k != "card" or _card(m[0])]
    return merged(found)


def occurrences(text: str, term: str, kind: str) -> list[dict]:
    """All places of a term, without overlap."""
    out, at = [], text.find(term) if term else -1
    while at >= 0:
        out.append({"start": at, "end": at + len(term), "kind": kind, "text": term})
        at = text.find(term, at + len(term))
    return out


def kind_of_label(label: Column) -> Column:
    """Of a model's label; what is not known is taken for a person's name."""
    low = F.lower(label)
    return F.when(low.contains("email"), "email").when(low.contains("phone"), "phone").when(low.contains("address"), "street_address").when(low.contains("org"), "org").otherwise("person_name")


def _by_text(df: DataFrame, f, *columns: str, out: str = "spans", kind: str = SPANS) -> DataFrame:
    """df with out = f(values of columns), in Arrow batches. Where f takes one column, a value that a batch repeats is computed once."""
    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.types import _parse_datatype_string as datatype

    schema = StructType([*df.schema.fields, StructField(out, datatype(kind))])
    at = [df.columns.index(c) for c in columns]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        t = to_arrow_type(schema[out].dataType)
        for b in batches:
            if len(at) == 1:
                own = b.column(at[0]).dictionary_encode("encode")
                made = pa.array([f(v) for v in own.dictionary.to_pylist()], t)
                new = made if len(made) == b.num_rows else made.take(own.indices)
            else:
                new = pa.array([f(*r) for r in zip(*[b.column(i).to_pylist() for i in at])], t)
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=schema.names)

    return df.mapInArrow(run, schema)


def spans(texts: DataFrame) -> DataFrame:
    """texts with their spans: by the detectors, in order, without overlap. A null text has none."""
    return _by_text(texts, lambda t: detected(t or ""), "text")


def with_named(texts: DataFrame) -> DataFrame:
    """texts with spans of the detectors and of items (array of text, kind) that a model named. Named spans that overlap a
    detected one give way; the rest is merged."""

    def both(text, items):
        own = detected(text or "")
        named = [s for i in items or [] for s in occurrences(text or "", i["text"] or "", i["kind"])]
        return merged(own + [s for s in named if not any(o["start"] < s["end"] and s["start"] < o["end"] for o in own)])

    return _by_text(texts, both, "text", "items")


def redacted(texts: DataFrame, terms: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """texts with redacted: what the detectors find and every occurrence of a term (text, kind) as [REDACTED:tag], the longest
    where they overlap. The terms are a repository's dictionary, of any size."""
    from tracelake.operators import terms as dictionary

    if isinstance(terms, list):
        terms = texts.sparkSession.createDataFrame(terms, "text string, kind string")
    return dictionary.redacted(texts, dictionary.build(terms))


def numbered(found: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """token, original, kind of all originals in found (doc, spans): those of the vault as they are, new ones numbered on per
    kind, by document and, within one, from the last span to the first, as they would be replaced. An original has one token,
    of the kind it was first seen with.

    Numbers come from prefix sums: the originals are dealt out by ranges of (kind, place), so that a kind lies in many tasks; each
    task counts its own, and a kind's earlier tasks tell where it goes on. No task holds a kind."""
    each = found.select("doc", F.explode("spans").alias("s")).select(F.col("s.text").alias("original"), F.struct("doc", (-F.col("s.start")).alias("back")).alias("o"), F.col("s.kind").alias("kind"))
    first = each.groupBy("original").agg(F.min(F.struct("o", "kind")).alias("f")).select("original", "f.kind", "f.o")
    new = first if vault is None else first.join(vault.select("original"), "original", "left_anti")
    ranked = ranks(new, "kind", ["o", "original"])
    if vault is not None:
        high = counters(vault).select(F.col("kind").alias("k"), "high")
        ranked = ranked.join(F.broadcast(high), F.col("kind") == F.col("k"), "left").withColumn("n", F.col("n") + F.coalesce("high", F.lit(0)))  # a row per kind
    prefix = F.coalesce(*[F.when(F.col("kind") == k, p) for k, (p, _) in KINDS.items()])
    made = ranked.select(F.concat(prefix, F.lit("_"), F.col("n").cast("string")).alias("token"), "original", "kind")
    return made if vault is None else vault.select("token", "original", "kind").unionByName(made)


def ranks(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with n: 1, 2, ... within each value of group, in the order of the columns in order. The rows are written in ranges,
    then numbered by the counts of the ranges before; only those counts (a row a range and group) are ever in one task."""
    import uuid

    from pyspark.sql import Window

    from tracelake.sources.store import shared_folder

    spark, at = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/ranks-{uuid.uuid4().hex}"
    keys = [F.asc(group), *[F.asc(c) for c in order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.withColumn("__at", F.monotonically_increasing_id()).write.parquet(at)  # written, as a second run could deal it out anew
    rows = spark.read.parquet(at).withColumn("__task", F.shiftright("__at", 33))
    counts = rows.groupBy(group, "__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("__g"), F.col("__task").alias("__t"), (before - F.col("__first") + 1).alias("__add"))
    out = rows.join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__task") == F.col("__t")))
    return out.withColumn("n", F.col("__at") + F.col("__add")).drop("__at", "__task", "__g", "__t", "__add")


def counters(vault: DataFrame) -> DataFrame:
    """kind, entries, high: of a vault's tokens Prefix_N the greatest N of each kind, from which numbering goes on."""
    n = F.regexp_extract("token", "_([0-9]+)$", 1).try_cast("bigint")
    return vault.groupBy("kind").agg(F.count("*").alias("entries"), F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("high"))


def pseudonymised(found: DataFrame, vault: DataFrame) -> DataFrame:
    """doc, text with every span replaced by its token of the vault."""
    each = found.select("doc", F.posexplode("spans").alias("i", "s")).join(vault.select(F.col("original").alias("__o"), "token"), F.col("s.text") == F.col("__o"))
    parts = each.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "token"))).alias("parts"))

    def spliced(text, parts):
        for s in reversed(parts or []):
            text = text[: s["start"]] + s["token"] + text[s["end"] :]
        return text

    return _by_text(found.select("doc", "text").join(parts, "doc", "left"), spliced, "text", "parts", out="out", kind="string").select("doc", F.col("out").alias("text"))


def reconstituted(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """doc, text with every token of the vault, as a whole word, replaced by its original."""
    token = rf"\b(?:{'|'.join(p for p, _ in KINDS.values())})_[0-9]+\b"
    words = texts.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(token), F.lit(0)))).alias("token")).join(vault.select("token", "original"), "token")
    known = words.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("known"))
    pattern = re.compile(token)

    def back(text, known):
        own = dict(known or [])
        return None if text is None else pattern.sub(lambda m: own.get(m[0], m[0]), text)

    return _by_text(texts.select("doc", "text").join(known, "doc", "left"), back, "text", "known", out="out", kind="string").select("doc", F.col("out").alias("text"))


def changed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (key, text) whose content the registry (key, sha256) does not hold under their key, with sha256."""
    now = files.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    return now.join(registry.select("key", "sha256"), ["key", "sha256"], "left_anti")


def index(files: DataFrame, registry: DataFrame, prior: DataFrame) -> DataFrame:
    """path, pii (array of text, kind) of every file (key, text): reused where the content is unchanged and the prior index has
    the file, else found anew."""
    now = files.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    same = now.join(registry.select("key", "sha256"), ["key", "sha256"], "left_semi").select("key").join(prior.select(F.col("path").alias("key"), "pii"), "key")
    fresh = spans(now.join(same.select("key"), "key", "left_anti").select("key", "text"))
    made = fresh.select(F.col("key").alias("path"), F.transform("spans", lambda s: F.struct(s["text"].alias("text"), s["kind"].alias("kind"))).alias("pii"))
    return same.select(F.col("key").alias("path"), "pii").unionByName(made)


def redaction_terms(index: DataFrame) -> DataFrame:
    """Distinct texts of an index with the kind of their first place (by path), the longest in bytes first, then by text."""
    each = index.select("path", F.posexplode("pii").alias("i", "p"))
    t = each.groupBy(F.col("p.text").alias("text")).agg(F.min_by("p.kind", F.struct("path", "i")).alias("kind"))
    return t.orderBy(F.octet_length("text").desc(), "text")


def files_with_data(index: DataFrame) -> DataFrame:
    return index.where("size(pii) > 0").select("path")


def refused(edits: DataFrame, index: DataFrame) -> DataFrame:
    """Edits (path) that a guard refuses, as their file holds personal data."""
    return edits.join(files_with_data(index), "path", "left_semi")


def save(table: DataFrame, folder: str, key: str) -> str:
    """Writes a table as the next version in folder, its rows as JSON encrypted with a key of 16, 24 or 32 characters, and returns
    its path. A version appears whole or not at all; older ones stay until the caller removes them."""
    from tracelake.sources.store import _batches

    row = F.hex(F.aes_encrypt(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])).cast("binary"), F.lit(key), F.lit("GCM")))
    last = max((int(re.findall(r"/version=(\d+)/", f)[-1]) for f in _batches(table.sparkSession, folder) if "/version=" in f), default=0)
    path = f"{folder.rstrip('/')}/version={last + 1:09d}"
    table.select(row.alias("value")).write.text(path)
    return path


def load(spark, folder: str, key: str, schema: str) -> DataFrame:
    """The newest version of a table in folder; an empty one if there is none."""
    from tracelake.sources.store import _batches

    paths = sorted({f.rsplit("/", 1)[0] for f in _batches(spark, folder) if "/version=" in f})
    if not paths:
        return spark.createDataFrame([], schema)
    plain = F.aes_decrypt(F.unhex("value"), F.lit(key), F.lit("GCM")).cast("string")
    return spark.read.text(paths[-1]).select(F.from_json(plain, schema).alias("r")).select("r.*")
