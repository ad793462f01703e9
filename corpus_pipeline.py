"""From documents to token counts: quality, toxicity, near-duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows of docs it keeps, with the columns of documents; the last
returns a row per document with its token ids. Classifiers learn from the stage's own rows and the labels table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, quality, simhash, toxicity
from tracelake.llm.common import ensure_shared, remove, shared_path, table, unused

#: Near-duplicates here: five-word shingles, as no contract fixes the stage's shingles.
SHINGLE = 5


def _accepted(scored, docs: DataFrame, model, label: int) -> DataFrame:
    """docs' rows that scored() predicts to have the label."""
    names = unused(docs, "score"), unused(docs, "predicted")
    return scored(docs, model, keep=tuple(docs.columns), names=names).where(F.col(names[1]) == label).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _accepted(quality.scored, docs, quality.learn(docs, table(spark, sf_dir, "labels")), 1)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _accepted(toxicity.scored, docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), 0)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, shingle=SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The classifiers' and the fingerprints' decisions have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last writes what it keeps to the shared folder; what the stage before wrote is
    removed then. The table that the last one reads stays, as its result is lazy."""
    ensure_shared(spark)
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        written.append(shared_path(spark, f"pipeline-{name}"))
        stage(spark, docs, sf_dir).write.parquet(written[-1])
        if len(written) > 1:
            remove(spark, written[-2])
        docs = spark.read.parquet(written[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
