"""From raw documents to packed training sequences, one stage after another.

Each stage works on what the stage before has kept. `labels` of the given
folder are read by the first stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vernissage.llm import exact, mixing, packing, quality, simhash
from vernissage.llm.text import table
from vernissage.session import fresh_path, landing_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest of each group of equal texts."""
    return exact.without_duplicates(spark, docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of linked fingerprints, with op6's shingle length and bit distance."""
    return simhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the training sequence each belongs to."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

# A trained model and streaming state have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what the stages have written on the way is removed."""
    docs = table(spark, sf_dir, "documents")
    result = fresh_path(spark, "pipeline")
    with landing_scope(spark):
        for name, stage in STAGES:
            path = result if name == STAGES[-1][0] else fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
            with landing_scope(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
