"""Lines of files that grow, as a data source: format("growing_lines").

Spark's file source takes a file once, so what is appended later is lost. Here an offset is the number of bytes of each file
that end with a line feed: a line counts when it is finished, wherever it was cut while it was written, and a restart goes on
where the checkpoint stands. Without a change no file is opened and there is no batch.

Rows: file, offset (the byte at which the line begins), value (without line feed or carriage return; bytes that are not UTF-8
as replacement characters). Options: path (a folder with all below it, or a file) and suffix. Files and folders that begin with
`.` or `_` are left out. A file shorter than what was read of it was replaced, and is read from its beginning; one that is gone is
forgotten. An offset has an entry a file. A long stretch is read in parts of PART bytes, each with the lines that begin in it.
The batch form reads all finished lines, or with options known and upto (JSON of files and bytes) those between, of the files
that upto names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PART, BLOCK = 64 << 20, 1 << 16


class Stretch(InputPartition):
    """Lines of a file that begin at begin <= byte < end; there are finished lines up to limit."""

    def __init__(self, file: str, begin: int, end: int, limit: int, first: int):
        self.file, self.begin, self.end, self.limit, self.first = file, begin, end, limit, first


def _finished(source, size: int, known: int) -> int:
    """Bytes up to and with the last line feed before size, known if there is none after that."""
    at = size
    while at > known:
        begin = max(known, at - BLOCK)
        cut = source.read_at(at - begin, begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return known


class Files:
    """The files under a path, by what Arrow's file systems know."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def sizes(self) -> dict[str, tuple[int, int]]:
        """Size and time of change of each file."""
        from pyarrow import fs

        system, root = self.open()
        top = system.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            return {}
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
        return {f.path: (f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not hidden(f.path)}

    def finished(self, known: dict[str, int], seen: dict[str, tuple[int, int]]) -> dict[str, int]:
        """Bytes of finished lines of each file, given those known before. seen: sizes and times as of the last call, and
        then of this one."""
        system, now, out = self.open()[0], self.sizes(), {}
        for file, (size, changed) in sorted(now.items()):
            had = known.get(file, 0)
            if file in known and seen.get(file) == (size, changed):
                out[file] = had
                continue
            with system.open_input_file(file) as source:
                out[file] = _finished(source, size, had if had <= size else 0)
        seen.clear()
        seen.update(now)
        return out

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        out = []
        for file, limit in sorted(end.items()):
            first = start.get(file, 0)
            first = first if first <= limit else 0
            out += [Stretch(file, at, min(at + PART, limit), limit, first) for at in range(first, limit, PART)]
        return out

    def read(self, p: Stretch) -> Iterator:
        import pyarrow as pa

        with self.open()[0].open_input_file(p.file) as source:
            at, rest = p.begin, b""
            if p.begin > p.first:  # the line that goes on here began in the part before
                at = self._next_line(source, p.begin - 1, p.limit)
            begin = at
            while begin < p.end:
                data = source.read_at(min(BLOCK * 16, p.limit - at), at) if at < p.limit else b""
                if not data:
                    return
                at += len(data)
                lines = (rest + data).split(b"\n")
                rest = lines.pop()
                offsets, values = [], []
                for line in lines:
                    if begin >= p.end:
                        break
                    offsets.append(begin)
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    begin += len(line) + 1
                if offsets:
                    yield pa.RecordBatch.from_arrays([pa.array([p.file] * len(offsets)), pa.array(offsets, pa.int64()), pa.array(values)], names=["file", "offset", "value"])

    @staticmethod
    def _next_line(source, at: int, limit: int) -> int:
        while at < limit:
            data = source.read_at(min(BLOCK, limit - at), at)
            cut = data.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(data)
        return limit


class _Batch(DataSourceReader):
    def __init__(self, files: Files, known: dict[str, int], upto: dict[str, int] | None):
        self.files, self.known, self.upto = files, known, upto

    def partitions(self) -> list[Stretch]:
        upto = self.files.finished(self.known, {}) if self.upto is None else self.upto
        return self.files.stretches(self.known, upto) or [Stretch("", 0, 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator:
        return self.files.read(partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, files: Files):
        self.files, self.known, self.seen = files, {}, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = self.files.finished(self.known, self.seen)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.files.stretches(start, end)

    def read(self, partition: Stretch) -> Iterator:
        return self.files.read(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, offset bigint, value string"

    def _files(self) -> Files:
        return Files(self.options["path"], self.options.get("suffix", ""))

    def reader(self, schema) -> DataSourceReader:
        upto = self.options.get("upto")
        return _Batch(self._files(), json.loads(self.options.get("known", "{}")), None if upto is None else json.loads(upto))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._files())


def growing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """A stream of the finished lines under path."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).load(path)


def finished(spark: SparkSession, path: str, suffix: str = "", known: dict[str, int] | None = None, upto: dict[str, int] | None = None) -> DataFrame:
    """All finished lines under path, or those between known and upto."""
    spark.dataSource.register(GrowingLines)
    reader = spark.read.format("growing_lines").option("suffix", suffix).option("known", json.dumps(known or {}))
    return (reader if upto is None else reader.option("upto", json.dumps(upto))).load(path)
