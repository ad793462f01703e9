"""Token ids in binary files of Simple-8b words, written and read as a Spark data source.

A 64-bit word holds a selector in its top four bits and as many ids as fit into the other sixty at the selector's width. The
greedy choice is vectorised: a maximum over windows tells at every place which selectors fit, then all blocks are walked in
step. Ids of more than sixty bits leave an escape word that numbers them; they stand whole at their block's end. Blocks hold
BLOCK ids, the last one fewer; the footer has the words of each block, so that any of them can be found and decoded alone,
again one selector at a time for all words together.

A file, little-endian: MAGIC, then block after block (words, then escaped ids), then the footer (doc ids, which of them are
null, ids a document, words and escaped ids a block), then its sizes and MAGIC. Each task writes one file under a name of
its own; the driver then lists those of the tasks that won, in order, with their documents and ids. What is not listed is not
read, so repeated or lost attempts do no harm.

`write_tokens` sorts by doc_id (nulls first; equal ids by a hash of the text) in ranges that split even a single hot id.
Reading gives doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
numbers) and, with option ids=true, the ids.

Defined cases: null and empty texts have no ids but the end id, if one is set; null ids count as no ids; repeated rows are
kept; other columns are ignored; an empty table makes no documents; ids are 0 to 2^64 - 1 in the codec and 0 to 2^32 - 1 in the
files. A document's ids are decoded whole in one task.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tracelake.llm.common import shared_path, table

VOCABULARY, END_ID = "word_bpe_49k.json", 1
MAGIC = b"TOKENS8B"
BLOCK = 4096
# Ids a word and bits an id of selectors 1 to 14. Selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: The first selector whose ids are wide enough for a number of bits; 15: none is.
_FITS = np.array([1 + int(np.searchsorted(WIDTHS[1:], bits)) for bits in range(65)], np.uint8)
_FITS_16 = _FITS[[i.bit_length() for i in range(1 << 16)]]
READ_IDS, WRITE_IDS, BATCH_IDS = 8 << 20, 1 << 20, 1 << 20


# --- codec ---------------------------------------------------------------------------------------------------------------


def _fits(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or ids.max() < 1 << 16:
        return _FITS_16[ids]
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return _FITS[np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low)]


def _selectors(ids: np.ndarray) -> np.ndarray:
    """At every place the selector of the most ids from there on that are narrow enough."""
    n, widest = len(ids), int(COUNTS.max())
    top = {1: np.concatenate((_fits(ids), np.zeros(widest, np.uint8)))}
    while 2 * max(top) <= widest:
        half = max(top)
        top[2 * half] = np.maximum(top[half], np.append(top[half][half:], np.zeros(half, np.uint8)))
    best = np.zeros(n, np.uint8)
    for s in range(14, 0, -1):
        count = int(COUNTS[s])
        part = 1 << (count.bit_length() - 1)
        most = np.maximum(top[part][:n], top[part][count - part : count - part + n])
        np.copyto(best, np.uint8(s), where=most <= s)
    return best


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids: unsigned 64-bit. Result: all blocks' words with their escaped ids, and the number of both a block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    best = _selectors(ids)
    at = np.arange(0, n, block)
    limit, steps = np.minimum(at + block, n), []
    while len(at):
        steps.append(at)
        at = at + COUNTS[best[at]]
        more = at < limit
        at, limit = at[more], limit[more]
    begin = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
    selector, of = best[begin], begin // block
    end = np.minimum((of + 1) * block, n)
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.append(ids, np.zeros(int(COUNTS.max()), np.uint64))
    for s in np.unique(selector[selector > 0]).tolist():
        k = np.flatnonzero(selector == s)
        where = begin[k, None] + np.arange(COUNTS[s])
        part = padded[where]
        part[where >= end[k, None]] = 0
        words[k] |= np.bitwise_or.reduce(part << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])), axis=1)
    blocks = -(-n // block)
    n_words = np.bincount(of, minlength=blocks)
    escaped = np.flatnonzero(selector == 0)
    n_escaped = np.bincount(of[escaped], minlength=blocks)
    if len(escaped):
        words[escaped] |= (np.arange(len(escaped)) - (np.cumsum(n_escaped) - n_escaped)[of[escaped]]).astype(np.uint64)
        words = np.insert(words, np.cumsum(n_words)[of[escaped]], ids[begin[escaped]])
    return words, n_words, n_escaped


def unpack(stored: np.ndarray, n_words: np.ndarray, n_escaped: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; n_ids: of each block."""
    sizes = n_words + n_escaped
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    words = stored[first[of] + place] if n_escaped.any() else stored
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    before = np.cumsum(count) - count
    word_first = np.cumsum(n_words) - n_words
    inside = before - np.repeat(before[np.minimum(word_first, max(len(before) - 1, 0))], n_words)
    base = np.cumsum(n_ids) - n_ids
    kept = np.minimum(count, n_ids[of] - inside)  # the last word of a block may have room left
    at = base[of] + inside
    out = np.empty(int(n_ids.sum()), np.uint64)
    low = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector).tolist():
        k = np.flatnonzero(selector == s)
        if s == 0:
            out[at[k]] = stored[first[of[k]] + n_words[of[k]] + low[k].astype(np.int64)]
            continue
        c, w = int(COUNTS[s]), np.uint64(WIDTHS[s])
        part = (low[k, None] >> (np.arange(c, dtype=np.uint64) * w)) & np.uint64((1 << int(w)) - 1)
        where, valid = at[k, None] + np.arange(c), np.arange(c) < kept[k, None]
        out[where[valid]] = part[valid]
    return out


# --- tokenizer -----------------------------------------------------------------------------------------------------------

# The only settings with which words between ASCII blanks are encoded independently of each other and of their case.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
MOST_WORDS = 1_500_000
JOINED = 1000


class _Words(dict):
    """Numbers of words; a new word gets the next number and waits for its ids."""

    def __init__(self):
        self.waiting: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.waiting.append(word)
        return number


class Encoder:
    """The library's ids of texts. Where the settings allow it, each different word is encoded once and remembered."""

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        settings = json.loads(data)
        self.between, self.apart = next(((t["content"].encode(), t["id"]) for t in settings["added_tokens"]), (b"", None))
        self.by_words = settings["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS} and (settings["pre_tokenizer"].get("pretokenizers") or [None])[0] == _SPLIT and settings["post_processor"] is None and self.apart is not None and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in settings["added_tokens"])
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.pool, self.first, self.count, self.used = np.empty(1 << 16, np.uint32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def _learn(self) -> None:
        new, self.words.waiting = self.words.waiting, []
        if not new:
            return
        # One call for many words: a special token between two words keeps them apart, and tells where each one's ids end.
        joined = [self.between.join(new[i : i + JOINED]).decode() for i in range(0, len(new), JOINED)]
        got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([x for g in got for x in (g, [self.apart])])
        ends = np.flatnonzero(ids == self.apart)
        count = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.apart]
        known = len(self.words) - len(new)
        while known + len(new) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[known : known + len(new)], self.count[known : known + len(new)] = self.used + np.cumsum(count) - count, count
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        whole = [i for i, t in enumerate(texts) if not self.by_words or "<|" in t]  # could hold a special token
        split = [t.encode().lower().split() if self.by_words and "<|" not in t else [] for t in texts]
        if len(self.words) > MOST_WORDS:
            self.forget()
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.concatenate([np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in split] or [np.zeros(0, np.int64)])
        self._learn()
        count = self.count[numbers]
        ends = np.cumsum(count)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[numbers] - (ends - count), count)]
        n = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_words)))])
        if whole:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                parts[i], n[i] = np.array(e.ids, np.uint32), len(e.ids)
            ids = np.concatenate(parts)
        return ids, n


_encoders: dict[int, Encoder] = {}


def encoder(data: str) -> Encoder:
    """One a process, with what it remembers."""
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def ended(ids: np.ndarray, n: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each document's."""
    return (ids, n) if end_id is None else (np.insert(ids, np.cumsum(n), end_id), n + 1)


# --- files ---------------------------------------------------------------------------------------------------------------


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class File:
    """A file being written: documents are added in order, whole blocks leave memory."""

    def __init__(self, sink):
        self.sink, self.held, self.n_held = sink, [], 0
        self.doc_ids, self.lengths, self.n_words, self.n_escaped = [], [], [], []
        sink.write(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= WRITE_IDS:
            self._pack(self.n_held // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.concatenate(self.held or [np.zeros(0, np.uint64)])
        words, n_words, n_escaped = pack(ids[:n])
        self.sink.write(words.astype("<u8", copy=False).tobytes())
        self.n_words.append(n_words)
        self.n_escaped.append(n_escaped)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """Documents and ids in all."""
        self._pack(self.n_held)
        lengths = np.concatenate(self.lengths or [np.zeros(0, np.int64)])
        n_words, n_escaped = np.concatenate(self.n_words), np.concatenate(self.n_escaped)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        footer = b"".join((np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), null.tobytes(), lengths.astype("<i8").tobytes(), n_words.astype("<i8").tobytes(), n_escaped.astype("<i8").tobytes()))
        self.sink.write(footer + struct.pack("<4q", len(self.doc_ids), int(lengths.sum()), len(n_words), len(footer)) + MAGIC)
        self.sink.close()
        return len(self.doc_ids), int(lengths.sum())


class Footer:
    def __init__(self, source):
        size, tail = source.size(), 32 + len(MAGIC)
        end = source.read_at(tail, size - tail)
        if end[32:] != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_ids, blocks, length = struct.unpack("<4q", end[:32])
        raw = source.read_at(length, size - tail - length)
        ids, n = np.frombuffer(raw, "<i8", self.n_docs), self.n_docs
        null = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
        self.lengths, self.n_words, self.n_escaped = (np.frombuffer(raw, "<i8", k, at) for k, at in ((n, 9 * n), (blocks, 17 * n), (blocks, 17 * n + 8 * blocks)))

    def ids(self, source, begin: int, end: int) -> np.ndarray:
        """The ids at places begin to end, from their blocks alone."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        a, b = begin // BLOCK, -(-end // BLOCK)
        sizes = 8 * (self.n_words + self.n_escaped)
        stored = np.frombuffer(source.read_at(int(sizes[a:b].sum()), len(MAGIC) + int(sizes[:a].sum())), "<u8")
        n_ids = np.minimum(BLOCK, self.n_ids - BLOCK * np.arange(a, b))
        return unpack(stored, self.n_words[a:b], self.n_escaped[a:b], n_ids)[begin - a * BLOCK : end - a * BLOCK]


class Written(WriterCommitMessage):
    def __init__(self, partition: int, name: str, docs: int, ids: int):
        self.partition, self.name, self.docs, self.ids = partition, name, docs, ids


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], tokenizer: str | None, end_id: int | None):
        self.path, self.columns, self.end_id, self.data = path, columns, end_id, None
        if tokenizer is not None:
            with open(tokenizer, encoding="utf-8") as f:
                self.data = f.read()
            if len(self.data) > 16 << 20:
                raise ValueError("the tokenizer is too large to be sent with every task")
        fs, at = _filesystem(path)
        fs.create_dir(at, recursive=True)

    def _documents(self, batch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        doc_ids, column = batch.column(self.columns.index("doc_id")).to_pylist(), batch.column(self.columns.index("ids" if self.data is None else "text"))
        if self.data is None:
            lengths = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            yield doc_ids, column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), lengths
            return
        start = size = 0
        for at, text in enumerate(column):
            size += len(text.as_buffer() or b"") if text.is_valid else 0
            if size >= 4_000_000 or at + 1 == len(column):
                texts = [t or "" for t in column.slice(start, at + 1 - start).to_pylist()]
                yield doc_ids[start : at + 1], *encoder(self.data).encode(texts)
                start, size = at + 1, 0

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        fs, at = _filesystem(self.path)
        partition = TaskContext.get().partitionId()
        name = f"part-{partition:06d}-{uuid.uuid4().hex}.ids"
        out = File(fs.open_output_stream(f"{at}/{name}"))
        for batch in iterator:
            for doc_ids, ids, n in self._documents(batch):
                out.add(doc_ids, *ended(ids, n, self.end_id))
        return Written(partition, name, *out.close())

    def commit(self, messages) -> None:
        files = [{"name": m.name, "docs": m.docs, "ids": m.ids} for m in sorted(filter(None, messages), key=lambda m: m.partition)]
        fs, at = _filesystem(self.path)
        with fs.open_output_stream(f"{at}/_files.tmp") as f:
            f.write(json.dumps(files).encode())
        fs.move(f"{at}/_files.tmp", f"{at}/_files.json")

    def abort(self, messages) -> None:
        fs, at = _filesystem(self.path)
        for m in filter(None, messages):
            fs.delete_file(f"{at}/{m.name}")


class Slice(InputPartition):
    """Documents first to last of a file; base: ids in all files before."""

    def __init__(self, name: str, first: int, last: int, base: int):
        self.name, self.first, self.last, self.base = name, first, last, base


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def partitions(self) -> list[Slice]:
        fs, at = _filesystem(self.path)
        with fs.open_input_stream(f"{at}/_files.json") as f:
            files = json.loads(f.read())
        out, base = [], 0
        for f in files:
            parts = max(1, min(f["docs"], -(-f["ids"] // READ_IDS)))
            out += [Slice(f["name"], f["docs"] * i // parts, f["docs"] * (i + 1) // parts, base) for i in range(parts)]
            base += f["ids"]
        return out or [Slice("", 0, 0, 0)]

    def read(self, partition: Slice):
        import pyarrow as pa

        if partition.first == partition.last:
            return
        fs, at = _filesystem(self.path)
        with fs.open_input_file(f"{at}/{partition.name}") as source:
            footer = Footer(source)
            ends = np.cumsum(footer.lengths)
            i = partition.first
            while i < partition.last:
                begin = int(ends[i] - footer.lengths[i])
                j = min(partition.last, max(i + 1, int(np.searchsorted(ends, begin + BATCH_IDS, "right"))))
                ids = footer.ids(source, begin, int(ends[j - 1])).astype("<u4")
                cut = [0, *(ends[i:j] - begin).tolist()]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])]
                columns = [pa.array(footer.doc_ids[i:j], pa.int64()), pa.array(ends[i:j] - footer.lengths[i:j] + partition.base), pa.array(footer.lengths[i:j]), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if self.with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                i = j


class TokenFiles(DataSource):
    """format("token_files"). Writing: columns doc_id long and ids array<long>, or with option tokenizer (a file of the
    tokenizers library, on the driver) doc_id long and text string; option end_id ends every document. The order of the
    rows is kept. Reading: option ids=true adds the ids."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * (self.options.get("ids") == "true")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("ids") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        end = self.options.get("end_id")
        return _Writer(self.options["path"], schema.names, self.options.get("tokenizer"), None if end is None else int(end))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Token ids of docs (doc_id, text) in ascending order of doc_id."""
    docs.sparkSession.dataSource.register(TokenFiles)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("m")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {"tokenizer": tokenizer} | ({} if end_id is None else {"end_id": end_id})
    sorted_rows.write.format("token_files").options(**options).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("ids", str(ids).lower()).load(path)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, p.path(VOCABULARY), END_ID)
    return read_tokens(spark, path)
