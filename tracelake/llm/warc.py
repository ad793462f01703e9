"""WARC: archives written and read back, transactions assembled into one nested row per capture.

Writing: each capture gives a request, a response (or a revisit, for a payload that an earlier page already has) and a
metadata record, the last two naming the request or response by WARC-Concurrent-To. Spark's text sink writes them, with
CRLF CRLF as the line separator that ends a WARC record, gzipped, to the folder all executors share; files hold at most
RECORDS records or so. Reading: each archive is unzipped as a stream and cut by Content-Length, not by separators.
Assembly: request, response or revisit, and metadata are joined through the concurrent-to identifiers.

Revisits: of equal payloads of at least LEAST bytes (equal SHA-256), the smallest page_id is the response. Who revisits whom is
decided on narrow rows; only pages whose digest or page_id occurs more than once are shuffled with their payload.

Defined cases: a null html is the empty payload; null urls are written as `urn:none`; a repeated page_id keeps a capture a row: the
capture's identifier has a running number of its equal page_ids, of which the first is the response; a null page_id is
written as `null` and read back as null; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import ensure_shared, remove, shared_path, table

LEAST, RECORDS, PROBES = 100, 6000, 3
CRLF = "\r\n"


def _measured(pages: DataFrame, columns: str, rows) -> DataFrame:
    """rows(page ids, urls, payload buffers, their digests) of every batch, as a table with those columns (DDL)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("urn:none")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))

    def run(batches):
        for b in batches:
            payloads = [x.as_buffer() for x in b.column(2)]
            yield rows(b, payloads, [hashlib.sha256(x).digest() for x in payloads])

    return p.mapInArrow(run, columns)


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """PROBES bits of a set of `bits` for every key."""
    h = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=8 * PROBES).digest() for k in keys), "<u8").reshape(-1, PROBES)
    return h % np.uint64(bits)


def _id_key(page_id: int | None) -> bytes:
    return b"null" if page_id is None else page_id.to_bytes(8, "little", signed=True)


def _repeated(narrow: DataFrame, least: int, bits: int) -> np.ndarray:
    """A Bloom filter (`bits` bits, whatever the table) of the page_ids and of the digests that more than one row has."""
    digests = narrow.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(None).cast("long").alias("page_id"))
    ids = narrow.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(None).cast("binary").alias("digest"), "page_id")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = [d if d is not None else _id_key(p) for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            at = _places(keys, bits).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64))], names=["word", "bit"])

    words = digests.union(ids).mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def captures(pages: DataFrame, least: int = LEAST, *, bits: int = 1 << 24) -> DataFrame:
    """page_id, n (running number among equal page_ids), url, payload, bytes, digest, revisit, original and original_n (page_id
    and number of the response, null if own). A revisit may have a null payload.

    Most payloads are not shuffled: a Bloom filter of `bits` bits (2 MB, broadcast) holds the page_ids and digests that
    occur more than once, and rows it does not know are responses with number 0 as they stand. The others, with what the
    filter takes for one of them, are numbered and joined."""
    import pyarrow as pa

    spark = pages.sparkSession
    ensure_shared(spark)

    def narrow_rows(b, payloads, digests):
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.size for x in payloads], pa.int64()), pa.array(digests, pa.binary())], names=["page_id", "url", "bytes", "digest"])

    narrow = _measured(pages, "page_id long, url string, bytes long, digest binary", narrow_rows).checkpoint()
    known = spark.sparkContext.broadcast(_repeated(narrow.select("page_id", "bytes", "digest"), least, bits))

    def parted(again: bool):
        def rows(b, payloads, digests):
            ids = b.column(0).to_pylist()
            hit = lambda keys: ((known.value[(at := _places(keys, bits)) >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1)).all(1) if keys else np.zeros(0, bool)
            same = hit(digests) & np.array([x.size >= least for x in payloads], bool)
            take = np.flatnonzero((same | hit([_id_key(i) for i in ids])) == again)
            first: dict[bytes, tuple] = {}
            for i in take.tolist() if again else ():  # of equal payloads here only the least page_id can be the response
                first[digests[i]] = min(first.get(digests[i], (True, 0, 0)), (ids[i] is None, ids[i] or 0, i))
            left = {i for i in take.tolist() if again and payloads[i].size >= least and first[digests[i]][:2] != (ids[i] is None, ids[i] or 0)}
            payload = b.column(2).take(pa.array(take))
            if left:
                payload = pa.array([None if i in left else x for i, x in zip(take.tolist(), payload.to_pylist())], pa.string())
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), payload, pa.array([payloads[i].size for i in take], pa.int64()), pa.array([digests[i] for i in take], pa.binary())], names=["page_id", "url", "payload", "bytes", "digest"])

        return _measured(pages, "page_id long, url string, payload string, bytes long, digest binary", rows)

    number = F.row_number().over(Window.partitionBy("page_id").orderBy("digest", "url")) - 1
    more = parted(True).withColumn("n", number)
    # the same numbers from narrow rows alone decide who revisits whom
    ids = narrow.groupBy("page_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("page_id").alias("i"))
    twice = narrow.join(ids, F.col("page_id").eqNullSafe(F.col("i"))).select("page_id", "url", "bytes", "digest").withColumn("n", number)
    numbered = twice.union(narrow.join(ids, F.col("page_id").eqNullSafe(F.col("i")), "left_anti").select("page_id", "url", "bytes", "digest", F.lit(0).alias("n")))
    same = numbered.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("d")).agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("d", "first").checkpoint()
    j = more.join(same, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    own = F.coalesce(F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first.n") == F.col("n")), F.lit(True)) | F.col("d").isNull()
    more = j.select("page_id", "n", "url", "payload", "bytes", "digest", (~own).alias("revisit"), F.when(~own, F.col("first.page_id")).alias("original"), F.when(~own, F.col("first.n")).alias("original_n"))
    once = parted(False).select("page_id", F.lit(0).alias("n"), "url", "payload", "bytes", "digest", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("original"), F.lit(None).cast("int").alias("original_n"))
    return once.union(more).withColumn("digest", F.lower(F.hex("digest")))


def _identifier(kind: str, page: str, n: str):
    return F.concat(F.lit(f"<urn:capture:{kind}:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(n).cast("string"), F.lit(">"))


def _record(kind, identifier, url, block, headers: list, content_type: str):
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), identifier), F.concat(F.lit("WARC-Target-URI: "), url), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), *headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write(caps: DataFrame, path: str) -> None:
    req, res = _identifier("request", "page_id", "n"), _identifier("response", "page_id", "n")
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    request = _record(F.lit("request"), req, url, F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + CRLF + CRLF)), [], "application/http; msgtype=request")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    refers = F.concat(F.lit("WARC-Refers-To: "), F.when(F.col("revisit"), _identifier("response", "original", "original_n")))
    profile = F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), req)
    response = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), res, url, F.when(F.col("revisit"), head).otherwise(F.concat(head, F.coalesce("payload", F.lit("")))), [concurrent, digest, refers, profile], "application/http; msgtype=response")
    about = F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _identifier("metadata", "page_id", "n"), url, about, [F.concat(F.lit("WARC-Concurrent-To: "), req)], "application/warc-fields")
    rows = caps.select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an unzipped archive."""
    buffer, at = bytearray(), 0
    chunks = iter(chunks)

    def need(n: int) -> bool:
        nonlocal at
        while len(buffer) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            if at > 1 << 20:
                del buffer[:at]
                at = 0
            buffer.extend(more)
        return True

    while need(1):
        while buffer[at : at + 2] == b"\r\n":
            at += 2
            if not need(2):
                return
        looked = at
        while (end := buffer.find(b"\r\n\r\n", looked)) < 0:
            before = len(buffer) - at
            if not need(before + 1):
                return
            looked = max(at, at + before - 3)
        lines = buffer[at:end].decode("utf-8").split(CRLF)
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = int(headers["Content-Length"])
        at = end + 4
        if not need(size):
            raise ValueError("the archive ends inside a record")
        yield headers, bytes(buffer[at : at + size])
        at += size


def read(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """A row per record: type, record_id, concurrent_to, refers_to, url, digest (header), own_digest (of the payload read), bytes, html.

    An archive is unzipped and read as a stream, in pieces that end in CRLF CRLF wherever that stands; the stream is put
    together again and cut by Content-Length, so no task holds more than a record."""
    files = spark.read.option("lineSep", CRLF + CRLF).text(path)

    def run(batches):
        import pyarrow as pa

        names = ["type", "record_id", "concurrent_to", "refers_to", "url", "digest", "own_digest", "bytes", *["html"] * payload]
        types = [pa.string()] * 7 + [pa.int64()] + [pa.string()] * payload

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def chunks():
            for b in batches:
                for x in b.column(0):
                    yield x.as_buffer()
                    yield b"\r\n\r\n"

        rows, size = [], 0
        for h, block in parse(chunks()):
            kind, html, own, n = h["WARC-Type"], None, None, None
            if kind == "response":
                body = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                own, n = hashlib.sha256(body).hexdigest(), len(body)
                html = bytes(body).decode("utf-8") if payload else None
            elif kind == "metadata":
                fields = dict(x.split(": ", 1) for x in block.decode("utf-8").split(CRLF) if ": " in x)
                n = int(fields["payload-bytes"])
            rows.append((kind, h["WARC-Record-ID"], h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), h["WARC-Target-URI"], h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, own, n, *[html] * payload))
            size += len(block) if payload else 200
            if size > 4 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    schema = "type string, record_id string, concurrent_to string, refers_to string, url string, digest string, own_digest string, bytes long" + ", html string" * payload
    return files.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, n, request, response (a response or revisit), metadata (null if none).

    All records of a transaction meet under the identifier of its request, which the others name as concurrent to them:
    one shuffle, and the records are read once. Responses without a request are left out."""
    part = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    of = lambda *kinds: F.when(F.col("type").isin(*kinds), part)
    met = records.groupBy(F.when(F.col("type") == "request", F.col("record_id")).otherwise(F.col("concurrent_to")).alias("k"))
    met = met.agg(F.min(of("request")).alias("request"), F.collect_list(of("response", "revisit")).alias("responses"), F.min(of("metadata")).alias("metadata"))
    joined = met.where("k is not null and request is not null").select("request", F.explode("responses").alias("response"), "metadata")
    return joined.select(_page("request.record_id").alias("page_id"), F.regexp_extract("request.record_id", r":(\d+)>$", 1).cast("int").alias("n"), "request", "response", "metadata")


def _page(column: str):
    return F.expr(f"try_cast(regexp_extract({column}, ':([^:]*):[0-9]+>$', 1) as bigint)")


def round_trip(pages: DataFrame, *, least: int = LEAST, payload: bool = True) -> DataFrame:
    """The captures of pages, written and read back. The archives stay until the caller removes them."""
    path = shared_path(pages.sparkSession, "warc")
    write(captures(pages, least), path)
    return assemble(read(pages.sparkSession, path, payload=payload))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write(captures(table(spark, sf_dir, "pages")), path)
    c = assemble(read(spark, path, payload=False))
    out = c.select(
        "page_id", F.coalesce("response.bytes", "metadata.bytes").alias("payload_bytes"), F.coalesce("response.own_digest", "response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.type") == "revisit", _page("response.refers_to")).alias("refers_to"),
    ).checkpoint()
    remove(spark, path)
    return out
