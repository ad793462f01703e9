"""Benchmark decontamination with a distributed positional inverted index.

Index: build() reads the training texts once and stores, in the folder all executors share, one row per shard of documents:
its terms in order, the ordered list of each term's positions (postings), the start and number of words of each document,
and the columns to keep. The index is partitioned by document, so a term's postings lie in every shard that has it; two
documents are at least GAP positions apart, so that no match crosses documents. It holds all terms, whatever the test set.

Lookup: the corpus's frequencies of the test terms are summed over the shards. A window of test terms is looked up shard by
shard by intersecting its terms' lists, each shifted by the term's offset, from the corpus's rarest term on, and ends as
soon as nothing is left. Proximity looks for all terms, in order, within `slop` positions more than an exact phrase takes.

No text and no posting is shuffled. Test items travel in blocks of at most BLOCK_WORDS words; a larger test set is looked up
block by block in the same index, and the hits are united by document.

Defined cases: null or wordless texts have no words and no hits; an item of fewer words than a window is one window; items
with a null or wordless text have none; rows of one item_id are one item; rows of a null item_id are looked up, and their
hits count as hit words, but they are no item that could be named; repeated documents keep a row each; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tracelake.llm.common import remove, shared_path, table, unused

WINDOW, BLOCK_WORDS, GAP = 13, 200_000, 1 << 10
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Of the text with A-Z lower-cased: runs of digits, letters a-z and characters beyond ASCII, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


class Queries:
    """The windows of a block of test items, as term numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.terms: dict[bytes, int] = {}
        self.window, self.item_ids = window, []
        known: dict[tuple[int, ...], int] = {}
        numbers: dict[str | None, int] = {}
        self.owners: list[list[int]] = []
        for item_id, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            if not ids:
                continue
            n = numbers.setdefault(item_id, len(self.item_ids))
            if n == len(self.item_ids):
                self.item_ids.append(item_id)
            for i in range(max(1, len(ids) - window + 1)):
                q = tuple(ids[i : i + window])
                k = known.setdefault(q, len(known))
                if k == len(self.owners):
                    self.owners.append([])
                if n not in self.owners[k]:
                    self.owners[k].append(n)
        self.windows = list(known)
        self.padded = np.array([q + q[-1:] * (window - len(q)) for q in self.windows], np.int32).reshape(-1, window)
        self.frequency = np.zeros(len(self.terms), np.int64)

    def weighed(self, frequency: dict[bytes, int]) -> Queries:
        """With the terms' frequencies in the corpus; lists are intersected in their order."""
        self.frequency = np.array([frequency.get(t, 0) for t in self.terms], np.int64)
        return self


class Shard:
    """Postings of some documents: terms, and of term i the positions[bounds[i] : bounds[i + 1]]."""

    def __init__(self, texts: list[str | None]):
        found = [words(t) for t in texts]
        self.n_words = np.array([len(w) for w in found], np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words[:-1] + GAP)]).astype(np.int32)[: len(found)]
        flat = [x for w in found for x in w]
        self.terms = sorted(set(flat))
        number = dict(zip(self.terms, range(len(self.terms))))
        ids = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
        at = np.arange(len(flat), dtype=np.int32) + np.repeat(np.arange(len(found), dtype=np.int32) * GAP, self.n_words)
        self.positions = at[np.argsort(ids, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(self.terms)))]).astype(np.int32)

    def row(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        return b" ".join(self.terms), self.bounds.tobytes(), self.positions.tobytes(), self.starts.tobytes(), self.n_words.tobytes()

    @staticmethod
    def of(terms, bounds, positions, starts, n_words) -> Shard:
        s = object.__new__(Shard)
        s.terms = bytes(terms).split()
        s.bounds, s.positions, s.starts, s.n_words = (np.frombuffer(x, np.int32) for x in (bounds, positions, starts, n_words))
        return s


class Lookup:
    """The postings of a shard by the numbers of the test terms."""

    def __init__(self, shard: Shard, queries: Queries):
        here = {t: i for i, t in enumerate(shard.terms) if t in queries.terms}
        none = np.array([], np.int32)
        self.lists = [shard.positions[shard.bounds[i] : shard.bounds[i + 1]] if (i := here.get(t)) is not None else none for t in queries.terms]
        self.has = np.array([len(x) > 0 for x in self.lists], bool)
        self.rank = queries.frequency

    def phrase(self, query: tuple[int, ...]) -> np.ndarray:
        """Start positions of exact occurrences."""
        order = sorted(range(len(query)), key=lambda i: (self.rank[query[i]], i))
        found = self.lists[query[order[0]]] - order[0]
        found = found[found >= 0]
        for i in order[1:]:
            if not len(found):
                break
            own = self.lists[query[i]]  # the candidates are probed in the longer list
            found = found[own[np.minimum(np.searchsorted(own, found + i), len(own) - 1)] == found + i]
        return found

    def near(self, query: tuple[int, ...], slop: int) -> list[tuple[int, int]]:
        """(first, last) positions of ordered occurrences of all terms that are at most `slop` words longer than the phrase."""
        rare = min(range(len(query)), key=lambda i: self.rank[query[i]])
        out, limit = set(), len(query) + slop
        for p in self.lists[query[rare]].tolist():
            first, at = p, p
            for i in range(rare - 1, -1, -1):  # leftwards: the last posting before
                own = self.lists[query[i]]
                k = int(np.searchsorted(own, first)) - 1
                if k < 0:
                    break
                first = int(own[k])
            else:
                for i in range(rare + 1, len(query)):
                    own = self.lists[query[i]]
                    k = int(np.searchsorted(own, at, "right"))
                    if k == len(own):
                        break
                    at = int(own[k])
                else:
                    if at - first < limit:
                        out.add((first, at))
        return sorted(out)


def _hits(shard: Shard, queries: Queries, slop: int | None) -> tuple[list[list[list[int]]], list[list[int]], list[list[int]]]:
    """Of every document: spans of hit words, items with exact and with near occurrences."""
    look, size = Lookup(shard, queries), len(shard.n_words)
    exact, close = [set() for _ in range(size)], [set() for _ in range(size)]
    begun, ended = [], []
    if len(queries.windows):
        for k in np.flatnonzero(look.has[queries.padded].all(axis=1)).tolist():
            q = queries.windows[k]
            found = look.phrase(q)
            if len(found):
                begun.append(found)
                ended.append(found + len(q))
                for d in set(np.searchsorted(shard.starts, found, "right").tolist()):
                    exact[d - 1].update(queries.owners[k])
            if slop is not None:
                for first, _ in look.near(q, slop):
                    close[int(np.searchsorted(shard.starts, first, "right")) - 1].update(queries.owners[k])
    spans: list[list[list[int]]] = [[] for _ in range(size)]
    if begun:
        a, b = np.concatenate(begun), np.concatenate(ended)
        o = np.argsort(a, kind="stable")
        a, b = a[o], np.maximum.accumulate(b[o])
        new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
        last = np.r_[new[1:], len(a)] - 1
        doc = np.searchsorted(shard.starts, a[new], "right") - 1
        for d, x, y in zip(doc.tolist(), (a[new] - shard.starts[doc]).tolist(), (b[last] - shard.starts[doc]).tolist()):
            spans[d].append([x, y])
    return spans, [sorted(x) for x in exact], [sorted(x) for x in close]


#: A row holds megabytes, and Parquet looks at the size of a group of rows only once it has 100 of them, which a reader then holds
#: whole: here it looks after each row, so that a group is a row or two, however many shards a task writes.
_NARROW = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_INDEX = "terms binary, bounds binary, positions binary, starts binary, n_words binary"


def build(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), most_chars: int = 4_000_000) -> None:
    """Write the index of docs to path: a row per shard of some most_chars characters of whole texts of one task, with the
    columns in keep of its documents in `kept`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(None).cast("int").alias("c0"))
    source = docs.select(F.col("text").cast("string").alias("t"), kept.alias("kept"))
    schema = StructType([*StructType.fromDDL(_INDEX).fields, StructField("kept", ArrayType(source.schema["kept"].dataType))])

    def run(batches):
        import pyarrow as pa

        types = to_arrow_schema(schema)

        def made(parts):
            texts, rows = (pa.chunked_array([p.column(i) for p in parts]) for i in (0, 1))
            held = rows.combine_chunks()
            held = held if isinstance(held, pa.Array) else held.chunk(0)
            held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            columns = [pa.array([x], pa.binary()) for x in Shard(texts.to_pylist()).row()]
            return pa.RecordBatch.from_arrays([*columns, held.cast(types.field("kept").type)], names=types.names)

        parts, size = [], 0
        for b in batches:
            start = 0
            for at in range(b.num_rows):
                size += b.column(0)[at].as_buffer().size if b.column(0)[at].is_valid else 0
                if size >= most_chars:
                    yield made([*parts, b.slice(start, at + 1 - start)])
                    parts, size, start = [], 0, at + 1
            if start < b.num_rows:
                parts.append(b.slice(start))
        if parts:
            yield made(parts)

    source.mapInArrow(run, schema).write.options(**_NARROW).parquet(path)


def frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How often each of the terms (bounded by a block of test items) occurs in the corpus."""

    def run(batches):
        import pyarrow as pa

        wanted, total = set(terms), {}
        for b in batches:
            for t, x in zip(b.column(0), b.column(1)):
                n = np.diff(np.frombuffer(x.as_buffer(), np.int32))
                for i, term in enumerate(t.as_py().split()):
                    if term in wanted:
                        total[term] = total.get(term, 0) + int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.binary()), pa.array([*total.values()], pa.int64())], names=["term", "n"])

    got = index.select("terms", "bounds").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["term"]): r["n"] for r in got}


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list]:
    """Test items in blocks whose size is bounded; one block is on the driver at a time. Rows of an item come together."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(words(r["text"]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    yield block


def find(index: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document of the index: kept (struct of the kept columns), n_words, spans (hit word ranges, end exclusive),
    items (with exact occurrences) and near_items (with occurrences within slop; empty without slop); null ids are left out."""
    if window + (slop or 0) > GAP:
        raise ValueError("a match could cross documents")
    spark, df, todo = index.sparkSession, index, _blocks(benchmark, block_words)
    columns, block = index.columns, next(todo)
    hits = "spans array<array<array<int>>>, items array<array<string>>, near array<array<string>>"
    kinds = _schema(index, hits)
    each = StructType([StructField("kept", index.schema["kept"].dataType.elementType), *StructType.fromDDL("n_words long, spans array<array<int>>, items array<string>, near_items array<string>").fields])
    first = True
    while block is not None:
        after = next(todo, None)
        queries = Queries(block, window)
        shared = spark.sparkContext.broadcast(queries.weighed(frequencies(index, [*queries.terms])))

        def run(batches, shared=shared, first=first, last=after is None):
            import pyarrow as pa

            ints, texts, q = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), shared.value
            names = lambda found: [[q.item_ids[x] for x in d if q.item_ids[x] is not None] for d in found]
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard.of(*[b.column(k)[i].as_buffer() for k in range(5)])
                    spans, exact, close = _hits(shard, q, slop)
                    new = [spans, names(exact), names(close)]
                    if not first:
                        new = [[x + y for x, y in zip(b.column(6 + k)[i].as_py(), v)] for k, v in enumerate(new)]
                    if last:  # a row per document
                        new[1:] = [[sorted(set(d)) for d in v] for v in new[1:]]
                        yield pa.RecordBatch.from_arrays([b.column(5)[i].values, pa.array(shard.n_words, pa.int64()), *[pa.array(x, t) for x, t in zip(new, (ints, texts, texts))]], names=each.names)
                    else:
                        yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, 1) for k in range(6)], *[pa.array([x], pa.list_(t)) for x, t in zip(new, (ints, texts, texts))]], names=kinds.names)

        df = df.select(*(columns if first else kinds.names)).mapInArrow(run, each if after is None else kinds)
        block, first = after, False
    return df


def _schema(index: DataFrame, added: str) -> StructType:
    return StructType([*index.schema.fields, *StructType.fromDDL(added).fields])


def search(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """find() in an index of docs that is built for it and removed: the columns in keep and find()'s, a row per row of docs."""
    spark = docs.sparkSession
    path = shared_path(spark, "postings")
    build(docs, path, keep=keep)
    found = find(spark.read.parquet(path), benchmark, window=window, slop=slop, block_words=block_words)
    out = found.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", "items", "near_items").checkpoint()
    remove(spark, path)
    return out


def n_hit(spans: Column) -> Column:
    """Words in the union of the spans, which may overlap when they come from several blocks."""
    step = lambda a, s: F.struct((a["n"] + F.greatest(s[1] - F.greatest(s[0], a["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], s[1]).alias("end"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]


def digest(found: DataFrame) -> DataFrame:
    out = found.select("doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def contaminated(hit: Column, n_words: Column) -> Column:
    return (hit > 0) & (20 * hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    row = unused(docs, "row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "text")
    found = search(whole, benchmark, keep=(row,), window=window)
    return found.where(~contaminated(n_hit(F.col("spans")), F.col("n_words"))).select(f"{row}.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
