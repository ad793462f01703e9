"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import pickle
import re
import tempfile
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_shared(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable: the cluster's spark.checkpoint.dir wins. Where it is unset, a folder of this
    machine serves a local master; any other master's executors could not read it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tracelake-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the folder all executors share."""
    import uuid

    ensure_shared(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that shared_path() named, once nothing reads it any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def stored(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """rows as a new table in the folder all executors share, and its path. A checkpoint keeps the planner's estimate of its size,
    and that of a join is the product of its sides': over the rounds of a loop the number's digits multiply, until they fill
    the driver's memory. A table has the size of its files."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


@contextlib.contextmanager
def nothing_broadcast(spark: SparkSession):
    """Joins planned inside are between shuffled sides: for tables that all grow with the documents, so that the driver
    neither collects nor serves any of them. Constraints are not inferred either: a checkpointed table carries them on,
    and over the rounds of a loop they multiply in the driver. What the session had is put back."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.constraintPropagation.enabled": "false"}
    had = {n: spark.conf.get(n, None) for n in off}
    for n, v in off.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in had.items():
            if v is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """A column name like name that docs does not have."""
    taken, out = {c.lower() for c in docs.columns}, f"__{name}"
    while out in taken:
        out += "_"
    return out


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True for the rows no label is learned from: crc32 of doc_id as text, modulo. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int) -> DataFrame:
    """(doc_id, text, y) of the rows a model may learn from. Documents with contradictory or null labels are left out."""
    y = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).where("y is not null")
    y = y.groupBy("l_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    d = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"), mod, rest))
    return d.join(y, d["doc_id"] == y["l_id"]).select("doc_id", "text", "y")


def least_ids(rows: DataFrame, by: str | None, each: int) -> tuple[dict, dict]:
    """For every value of `by` (all rows count as one value if None): how many rows it has, and the `each` doc_ids whose
    hashes are least. The driver gets a count per value and, as a share of the hash range is read, little more ids than
    are chosen, however many partitions there are."""
    own = F.lit(0) if by is None else F.col(f"`{by}`")
    ids = rows.select(own.alias("v"), "doc_id").where("v is not null and doc_id is not null")
    counts = {r["v"]: r["count"] for r in ids.groupBy("v").count().collect()}
    if not counts:
        return {}, {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    cut = {v: min(1 << 40, -(-(1 << 40) * (3 * each // 2 + 200) // n)) for v, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]), F.col("v"))
    chosen: dict = {v: [] for v in counts}
    for r in ids.where(place < limit).select("v", "doc_id", place.alias("p")).distinct().collect():
        chosen[r["v"]].append((r["p"], r["doc_id"]))
    return counts, {v: [d for _, d in sorted(x)[:each]] for v, x in sorted(chosen.items())}


def _sampled(rows: DataFrame, by: str, each: int, cols: tuple[str, ...]):
    """The rows of at most `each` ids for every value of `by`, and a function that orders them and holds the bound."""
    counts, chosen = least_ids(rows, by, each)
    rank = {d: i for v in chosen.values() for i, d in enumerate(v)}

    def ordered(got: list) -> list:
        count, out = dict.fromkeys(counts, 0), []
        for r in sorted(got, key=lambda r: (rank[r["doc_id"]], zlib.crc32(repr(r).encode("utf-8", "replace")))):  # repeated ids stay within the bound
            count[r["__by"]] += 1
            if count[r["__by"]] <= each:
                out.append(r)
        return out

    if not rank:
        return None, ordered, counts
    return rows.where(F.col("doc_id").isin([*rank]) & F.col(by).isNotNull()).select("doc_id", F.col(by).alias("__by"), *cols), ordered, counts


def spread_sample(rows: DataFrame, by: str, each: int, *cols: str) -> list:
    """At most `each` rows for every value of `by`, chosen by a hash of doc_id, so that the choice does not depend on
    partitioning. The bound of a classifier's training sample. Only ids are ranked; the other columns are then fetched for
    the chosen ids alone."""
    got, ordered, _ = _sampled(rows, by, each, cols)
    return [] if got is None else ordered(got.collect())


def fit_on_sample(rows: DataFrame, by: str, each: int, cols: tuple[str, ...], fit: Callable[[list, dict], object]):
    """fit() of the rows (by column name) that spread_sample() would choose and of how many rows each value has in all, run
    in one task of an executor: the driver holds the chosen ids and the model, neither texts nor what the training needs."""
    got, ordered, counts = _sampled(rows, by, each, cols)
    if got is None:
        return fit([], counts)

    def run(batches):
        import pyarrow as pa

        model = pickle.dumps(fit(ordered([r for b in batches for r in b.to_pylist()]), counts))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = got.repartition(1).mapInArrow(run, "model binary").first()
    return fit([], counts) if made is None else pickle.loads(bytes(made["model"]))


def give_back() -> None:
    """Frees what a task has left behind to the operating system: Python workers live on for the next task, and beside idle
    ones the executor would have less."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def with_text_columns(docs: DataFrame, keep: list[str], make, added: str, *, text: str = "text", most_chars: int = 4_000_000) -> DataFrame:
    """docs' columns in keep, untouched, and those in added (DDL), which make() computes from the texts.

    make() is called once a task and gives a function from a list of texts (null: None) to one list per added column. It
    gets about most_chars characters at a time, but always whole texts.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    extra = StructType.fromDDL(added)
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    added_fields = [StructField(f"n{i}", f.dataType) for i, f in enumerate(extra.fields)]  # names of our own: mapInArrow takes none with dots
    schema = StructType([*source.schema.fields[:-1], *added_fields])
    names, n_keep = [f.name for f in schema.fields], len(keep)

    def run(batches):
        import pyarrow as pa

        compute = make()
        types = [to_arrow_type(f.dataType) for f in extra.fields]
        for batch in batches:
            column = batch.column(n_keep)
            start, size = 0, 0
            for at in range(batch.num_rows):
                size += len(column[at].as_buffer() or b"") if column[at].is_valid else 0
                if size >= most_chars or at == batch.num_rows - 1:
                    part = batch.slice(start, at + 1 - start)
                    new = compute(part.column(n_keep).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *[pa.array(v, t) for v, t in zip(new, types)]], names=names)
                    start, size = at + 1, 0
                    del part, new
            del batch, column
        del compute
        give_back()

    return source.mapInArrow(run, schema).toDF(*keep, *extra.names)
