"""A training corpus from ``documents``: quality, exact dedup, near dedup, mixing, packing; each stage reads what the one before wrote."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm import exactdup, mixing, neardup, packing, quality
from kindred.llm.tokens import public_path
from kindred.shared import materialize

TOKENIZER = "word_bpe_49k.json"
#: Names of at most so many dropped rows are sent to all executors (16 MB); more are joined by a shuffle.
SEND = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't among ``dropped`` (doc_id, version: the text's xxhash64), so another text of a doc_id stays; rows without doc_id stay."""
    names = materialize(dropped.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).where("_d is not null").distinct(), "dropped")
    gone = (docs["doc_id"] == names["_d"]) & (F.xxhash64(docs["text"]) == names["_v"])
    return docs.join(F.broadcast(names) if names.count() <= SEND else names, gone, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by ``labels``, predicts to be good; null texts count as empty, repeated rows are judged each, an empty table stays empty."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id.

    Null texts equal empty ones; rows that repeat both doc_id and text stay or go alike; a doc_id's
    other texts and rows without doc_id stay; an empty table stays empty.
    """
    return _without(docs, exactdup.exact_duplicates(docs).where("not kept and keep_id is not null"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest doc_id.

    Texts without words and rows without doc_id are near nothing and stay; rows that repeat both
    doc_id and text stay or go alike; an empty table stays empty.
    """
    return _without(docs, neardup.near_duplicates(docs).where("not kept and component_id is not null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to once more, by the temperature mixture's weights.

    A null source is a source of its own, repeated rows are read each, texts without words once a
    whole reading; an empty table stays empty.
    """
    return mixing.mix(docs).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of mixed sources; null texts have the end id alone, repeated rows are packed each, an empty table gives no pieces."""
    return packing.pack(docs, public_path(TOKENIZER))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table; every stage's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
