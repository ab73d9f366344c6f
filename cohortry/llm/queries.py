"""The operators of this subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import stored

from . import clusters, decontaminate, importance, language, linededup, mixing, mtree, neardup, packing, quality, sharding, toxicity, warc

#: Bytes of text that a shard holds.
SHARD_BYTES = 1 << 20
#: Words of a benchmark window.
WINDOW = 10
#: Scores from here on count as label 1.
CUT = 0.3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_fold(key: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _labelled(spark: SparkSession, folder: str, label: str, folds: int, held_out: int) -> DataFrame:
    """Texts of the training folds with their label, as a written table that the steps of a fit read again.

    Labels grow with the documents, so no size of them is broadcast: the texts are shuffled once, at every size.
    """
    labels = table(spark, folder, "labels").select("doc_id", F.col(label).alias("label")).where("label is not null")
    docs = table(spark, folder, "documents").select("doc_id", "text").where(~in_fold(F.col("doc_id"), folds, held_out))
    return stored(docs.join(labels.hint("merge"), "doc_id"))


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    return toxicity.fit(_labelled(spark, folder, "toxic", 4, 2))


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"), SHARD_BYTES, keep=["doc_id"])


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_records(table(spark, folder, "pages"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


def neardup_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """As op4_neardup with every shingle weighing as often as it occurs."""
    return neardup.classes(table(spark, folder, "documents"), settings=neardup.Settings(weighted=True))


def op5_linededup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = linededup.clean(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=WINDOW, keep=["doc_id"])
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~in_fold(F.col("doc_id"), 4, 2)))
    found = language.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score(table(spark, folder, "documents"), toxicity_model(spark, folder), keep=["doc_id"])
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    model = quality.fit(_labelled(spark, folder, "quality", 5, 0))
    found = quality.score(table(spark, folder, "documents"), model, keep=["doc_id"])
    return found.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pieces(table(spark, folder, "documents"))
    return packing.placed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clustered(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_neardup": op4_neardup,
    "neardup_weighted": neardup_weighted,
    "op5_linededup": op5_linededup,
    "op6_decontaminate": op6_decontaminate,
    "op7_language": op7_language,
    "op8_topk": op8_topk,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_resampling": op12_resampling,
    "op13_clustering": op13_clustering,
}
