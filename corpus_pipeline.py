"""From raw documents to shards: reject, de-duplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame; ``run``
applies them to ``documents`` in order, each one's result written as Parquet to
the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, mixing, neardup, queries, sharding, toxicity
from cohortry.session import stored


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator gives to a column of its own, and those names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cut."""
    plain, names = _renamed(docs)
    scored = toxicity.score(plain, queries.toxicity_model(spark, sf_dir), text=names["text"])
    return scored.where(F.col("score") < queries.CUT).drop("score").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id."""
    return neardup.distinct(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    plain, names = _renamed(docs)
    found = decontaminate.report(plain, queries.table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"], window=queries.WINDOW)
    return found.where(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights; a document taken more than once stands more than once."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.assign(docs, queries.SHARD_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained network, which SQL cannot express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
