"""The training corpus from raw documents: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of ``documents``. What it returns is
written as Parquet and read again as the next one's docs. All but the last return those columns. An empty
table passes every stage and gives no sequences; further columns are carried on and never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parleylake.llm import decontam, nbsvm, packing, secrets, simhash
from parleylake.llm._shared import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts are judged as empty ones, repeated rows alike, null ids are never learnt from; without labels,
    or with labels of one class only, all texts score alike.
    """
    return nbsvm.keep_good(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays.

    Repeated rows are copies of each other, texts without words are one group, rows without an id all stay.
    """
    return simhash.deduplicate(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, wherever the same text stands; null and empty texts and all else stay as they are."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials are masked in the texts; ``n_chars`` follows.

    No row goes; null texts stay null, a null source is an owner of its own, repeated rows are masked alike.
    """
    return secrets.redact(docs, length_col="n_chars").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents: one row per piece; null texts are empty, that is their end mark, and repeated rows each have their pieces."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("best-fit packing", pack)]
#: SQL can't express the classifier, the fingerprints or the tokeniser: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
