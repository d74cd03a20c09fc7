"""From raw documents to shards: language, near duplicates, benchmark passages, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps. A stage's result is written as Parquet
and read again before the next one starts, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe.llm import decontaminate, langid, mixing, sharding, simhash
from airframe.llm.common import stored, table
from airframe.session import prepare


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from the labelled ones of this input."""
    return langid.keep_identified(docs, langid.train(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more in shingles of five words."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of a mixture that weighs sources by the root of their size."""
    return mixing.in_order(mixing.mix(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard: contiguous in the order of the files read, by the id where there are none."""
    try:
        order = {"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")}
        docs.select(*order.values())
    except AnalysisException:
        order = {"id": F.col("doc_id"), "row": F.xxhash64("text")}
    return sharding.with_shard(docs, order)


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixture", mixed),
    ("shards", sharded),
]

#: Trained models, SimHash and XXH64 have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(prepare(spark), sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, name)
    return docs
