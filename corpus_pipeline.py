"""A training corpus from raw documents: quality rules, near duplicates, decontamination, personal data, packing.

Each stage works on all that the one before it kept; the result of each is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontamination, near_duplicates, packing, personal, quality
from attesta.llm.common import documents, importable
from attesta.scratch import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the learned decision list rejects go."""
    importable(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays."""
    importable(spark)
    return near_duplicates.one_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its error budget, go."""
    importable(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked."""
    importable(spark)
    return personal.masked(docs, personal.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    importable(spark)
    return packing.pieces(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_one_each),
    ("decontamination", drop_leaks),
    ("personal data", mask_personal),
    ("packing", pack),
]

#: SQL can't express the sketches, matches and tokens of the stages; ``tests/llm`` holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
