"""A dictionary of terms found in texts in one pass: Aho-Corasick automata in arrays.

The terms are dealt out in shards of bounded size; a task builds the automaton of each and writes it to a shared folder. Texts are
never shuffled or replicated: a task holds some megabytes of them and takes the shards one after the other. Trie and failure links
are built a level at a time, all nodes of a depth together. Texts are scanned in step: each is cut in lanes, and every lane takes
its next byte in the same few array operations. A lane begins as many bytes early as the longest term has, so that no occurrence
is lost at its edge.

Occurrences of one term do not overlap (the leftmost counts); those of different terms may, until privacy.merged() decides.
Offsets are code points.

Defined cases: null and empty terms are none; a term given with several kinds has the least of them; null texts hold nothing;
an empty dictionary finds nothing. A dictionary stays in its folder until remove() is called.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of terms in a shard, of texts in a scan, and in a lane at least.
SHARD_BYTES, SCAN_BYTES, LANE = 8 << 20, 4 << 20, 512


class Automaton:
    """States are nodes of the trie, 0 the root, numbered by depth and then by edge: the child at edge i is i + 1."""

    def __init__(self, edges: np.ndarray, fail: np.ndarray, term: np.ndarray, more: np.ndarray, longest: int):
        self.edges, self.fail, self.term, self.more, self.longest = edges, fail, term, more, longest
        self.root = np.zeros(256, np.int64)
        first = edges[edges < 256]
        self.root[first] = np.arange(1, len(first) + 1)

    @classmethod
    def of(cls, terms: list[bytes]) -> Automaton:
        """terms: different and not empty."""
        data = np.frombuffer(b"".join(terms), np.uint8)
        size = np.array([len(t) for t in terms], np.int64)
        begin = np.cumsum(size) - size
        at, own, edges, firsts, n = np.zeros(len(terms), np.int64), np.arange(len(terms)), [], [1], 1
        term = [np.full(1, -1)]
        depth = 0
        while len(own):
            key = at[own] * 256 + data[begin[own] + depth]
            level, inverse = np.unique(key, return_inverse=True)
            edges.append(level)
            at[own] = n + inverse
            depth += 1
            ends = own[size[own] == depth]
            named = np.full(len(level), -1)
            named[at[ends] - n] = ends
            term.append(named)
            own = own[size[own] > depth]
            n += len(level)
            firsts.append(n)
        edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        made = cls(edges, np.zeros(n, np.int64), np.concatenate(term), np.zeros(n, np.int64), depth)
        for a, b in zip(firsts, firsts[1:]):  # level by level, as links lead to shorter nodes
            made._link(np.arange(a, b))
        return made

    def _link(self, nodes: np.ndarray) -> None:
        parent, byte = self.edges[nodes - 1] // 256, self.edges[nodes - 1] % 256
        link, todo, from_ = np.zeros(len(nodes), np.int64), np.flatnonzero(parent > 0), self.fail[parent]
        while len(todo):
            to = self._child(from_[todo], byte[todo])
            link[todo] = np.maximum(to, 0)
            todo = todo[(to < 0) & (from_[todo] > 0)]
            from_[todo] = self.fail[from_[todo]]
        self.fail[nodes] = link
        self.more[nodes] = np.where(self.term[link] >= 0, link, self.more[link])

    def _child(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the byte leads, -1 if nowhere."""
        key = state * 256 + byte
        i = np.searchsorted(self.edges, key)
        i[i == len(self.edges)] = 0
        return np.where(self.edges[i] == key, i + 1, -1) if len(self.edges) else np.full(len(key), -1)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.root[byte]
        todo = np.flatnonzero(state)
        while len(todo):
            to = self._child(state[todo], byte[todo])
            found = to >= 0
            out[todo[found]] = to[found]
            todo = todo[~found]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        return out

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of all texts, offsets: where each begins, and the end. Gives the end of every occurrence and its term."""
        length = max(LANE, 4 * self.longest)
        sizes = np.diff(offsets)
        lanes = -(-sizes // length)
        text = np.repeat(np.arange(len(sizes)), lanes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = offsets[text] + place * length
        end = np.minimum(begin + length, offsets[text + 1])
        early = np.maximum(begin - (self.longest - 1), offsets[text])
        order = np.argsort(early - end, kind="stable")  # the longest first: those at work stay in front
        begin, end, early = begin[order], end[order], early[order]
        state, ends, states = np.zeros(len(order), np.int64), [], []
        steps = end - early
        for k in range(int(steps.max(initial=0))):
            n = int(np.searchsorted(-steps, -k, "left"))
            at = early[:n] + k
            state[:n] = self._step(state[:n], data[at])
            hit = np.flatnonzero((state[:n] > 0) & ((self.term[state[:n]] >= 0) | (self.more[state[:n]] > 0)) & (at >= begin[:n]))
            if len(hit):
                ends.append(at[hit] + 1)
                states.append(state[hit])
        ends, states, out = np.concatenate(ends or [np.zeros(0, np.int64)]), np.concatenate(states or [np.zeros(0, np.int64)]), []
        while len(states):  # the terms that end here, from the longest to the shortest
            out.append((ends[self.term[states] >= 0], self.term[states[self.term[states] >= 0]]))
            ends, states = ends[self.more[states] > 0], self.more[states[self.more[states] > 0]]
        return tuple(np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in (0, 1))

    def save(self, sink, texts: list[bytes], kinds: list[str]) -> None:
        size = np.array([len(t) for t in texts], np.int64)
        np.savez(sink, edges=self.edges, fail=self.fail, term=self.term, more=self.more, longest=self.longest, texts=np.frombuffer(b"".join(texts), np.uint8), size=size, kinds=np.array(kinds, str))

    @classmethod
    def load(cls, source) -> tuple[Automaton, np.ndarray, list[bytes], list[str]]:
        """The automaton, and of each term its size, bytes and kind."""
        x = np.load(source)
        whole, ends = x["texts"].tobytes(), np.cumsum(x["size"]).tolist()
        return cls(x["edges"], x["fail"], x["term"], x["more"], int(x["longest"])), x["size"], [whole[a:b] for a, b in zip([0, *ends], ends)], x["kinds"].tolist()


def apart(begin: np.ndarray, end: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Which occurrences stay when those of one term must not overlap, the leftmost first. Ordered by (term, begin)."""
    keep, last, free = np.ones(len(begin), bool), -1, 0
    # Few: only terms that overlap themselves. An occurrence that does not touch the one before always stays.
    for i in (np.flatnonzero((term[1:] == term[:-1]) & (begin[1:] < end[:-1])) + 1).tolist():
        free = free if last == i - 1 else end[i - 1]
        keep[i] = begin[i] >= free
        free = end[i] if keep[i] else free
        last = i
    return keep


class Dictionary:
    """Where a dictionary's automata are. Sent with tasks, unlike the automata."""

    def __init__(self, path: str, shards: list[str]):
        self.path, self.shards = path, shards

    def automata(self) -> Iterator[tuple[Automaton, np.ndarray, list[bytes], list[str]]]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        for name in self.shards:
            key = f"{self.path}/{name}"
            if len(self.shards) > 1:  # one at a time
                _kept.clear()
            if key not in _kept:
                _kept.clear()
                with system.open_input_stream(f"{root}/{name}") as f:
                    _kept[key] = Automaton.load(io.BytesIO(f.read()))
            yield _kept[key]

    def remove(self, spark: SparkSession) -> None:
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


_kept: dict[str, tuple] = {}


def build(terms: DataFrame) -> Dictionary:
    """terms: text, kind. Writes the automata to a new folder that all executors share."""
    from tracelake.sources.store import shared_folder

    spark = terms.sparkSession
    path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    path = path if ":/" in path else f"file://{path}"
    own = terms.where("length(text) > 0").groupBy("text").agg(F.min("kind").alias("kind"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        texts, kinds = [], []
        for b in batches:
            texts += [t.encode() for t in b.column(0).to_pylist()]
            kinds += [k or "" for k in b.column(1).to_pylist()]
        if texts:
            system, root = fs.FileSystem.from_uri(path)
            system.create_dir(root, recursive=True)
            name, made = f"shard-{uuid.uuid4().hex}.npz", io.BytesIO()
            Automaton.of(texts).save(made, texts, kinds)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(made.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    if not shards:
        return Dictionary(path, [])
    dealt = own.repartition(int(shards), F.xxhash64("text"))
    return Dictionary(path, sorted(r["name"] for r in dealt.mapInArrow(run, "name string").collect()))


def found(texts: list[str | None], dictionary: Dictionary) -> list[list[dict]]:
    """For each text the places of all terms: start, end (code points), kind, text; by start, the longest first."""
    raw = [(t or "").encode() for t in texts]
    out: list[list[dict]] = [[] for _ in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    for automaton, size, words, kinds in dictionary.automata():
        end, term = automaton.find(data, offsets)
        begin = end - size[term]
        order = np.lexsort((begin, term))
        begin, end, term = begin[order], end[order], term[order]
        kept = apart(begin, end, term)
        begin, end, term = begin[kept], end[kept], term[kept]
        row = np.searchsorted(offsets, begin, "right") - 1
        base = chars[offsets[row]]
        for r, a, b, t in zip(row.tolist(), (chars[begin] - base).tolist(), (chars[end] - base).tolist(), term.tolist()):
            out[r].append({"start": a, "end": b, "kind": kinds[t], "text": words[t].decode()})
    for own in out:
        own.sort(key=lambda s: (s["start"], -s["end"], s["kind"], s["text"]))
    return out


def _scanned(df: DataFrame, column: str, dictionary: Dictionary, added: str, make) -> DataFrame:
    """df with the column `added` (DDL of one) = make(text, its occurrences), some megabytes of whole texts at a time."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    field = StructType.fromDDL(added).fields[0]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    schema = StructType([*source.schema.fields, StructField("new", field.dataType)])
    at = df.columns.index(column)

    def run(batches):
        import pyarrow as pa

        kind = to_arrow_type(field.dataType)
        for batch in batches:
            texts = batch.column(at)
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t.as_buffer() or b"") if t.is_valid else 0
                if size >= SCAN_BYTES or i + 1 == len(texts):
                    part = batch.slice(start, i + 1 - start)
                    own = part.column(at).to_pylist()
                    new = [make(t, o) for t, o in zip(own, found(own, dictionary))]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, kind)], names=schema.names)
                    start, size = i + 1, 0

    return source.mapInArrow(run, schema).toDF(*df.columns, field.name)


def occurrences(texts: DataFrame, dictionary: Dictionary, column: str = "text") -> DataFrame:
    """texts with terms: array of start, end, kind, text of every occurrence."""
    return _scanned(texts, column, dictionary, "terms array<struct<start:int,end:int,kind:string,text:string>>", lambda _, own: own)


def redacted(texts: DataFrame, dictionary: Dictionary, column: str = "text") -> DataFrame:
    """texts with redacted: what the detectors find and every occurrence of a term as [REDACTED:tag], the longest where they
    overlap."""
    from tracelake.operators.privacy import KINDS, detected, merged

    def done(text: str | None, own: list[dict]) -> str | None:
        if text is None:
            return None
        parts, at = [], 0
        for s in merged(detected(text) + own):
            parts += [text[at : s["start"]], f"[REDACTED:{KINDS[s['kind']][1] if s['kind'] in KINDS else s['kind']}]"]
            at = s["end"]
        return "".join([*parts, text[at:]])

    return _scanned(texts, column, dictionary, "redacted string", done)
