"""The corpus pipeline: five of the corpus operators, one after the other.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame, which
is written as Parquet and read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import contamination, language, mixing, near_dedup, sharding
from weftline.llm.staging import scoped, stage, sweep

N_SHARDS = 40
#: Least similarity of near copies, in hundredths.
SIMILARITY = 80
#: Part of the tokens that the mix keeps on average.
SAMPLE_SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, in no known language, or with a score of it under 0.5, go."""
    return language.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of copies of a similarity of 0.8 or more stays."""
    return near_dedup.keep_one(docs, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target shares."""
    return mixing.sample(docs, SAMPLE_SHARE)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard and the slot of each."""
    return sharding.shard(docs, [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))], N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shards),
]

#: Learned models and sketches are beyond SQL; the tests hold the pipeline against its operators on small tables.
ORACLE_SQL = None


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged in the shared folder until the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
            sweep(docs)
    return docs
