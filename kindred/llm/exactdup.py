"""Exact dedup by content-defined chunk recipes, in DataFrame expressions only."""

from pyspark.sql import Column, DataFrame, functions as F

from kindred.operators.hot import join_groups
from kindred.shared import materialize

#: A chunk has LEAST characters and then ends after the first of these: a mark and a space; a full stop or comma of CJK, or an
#: ideograph of three blocks; a rare letter or digit and a space; a digit of 0-7 and a letter of A-F or a-c without a space (as in
#: encoded data). All depend on content alone, so equal passages are cut alike, wherever they stand, from the first cut that they
#: share. Only runs without any of these are cut at MOST characters.
LEAST, MOST = 512, 4096
ENDS = r"(?<=[.!?:;,kxyzKXYZ0-9] |[0-7][A-Fa-c]|[\u3001\u3002\uFF0C\uFF0E\u4E00-\u4E7F\u6200-\u627F\u8000-\u807F])"
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:{ENDS}|\z)|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed and return as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text_sha256, recipe): the chunks of each normalised text in order, as (id, v1, v2).

    ``id`` is a 64-bit hash of the chunk; ``v1`` and ``v2`` are 120 bits of its SHA-256, by which
    the identifiers are verified. No text leaves the task that reads it.
    """
    def chunk(c: Column) -> Column:
        sha = F.sha2(c, 256)
        bits = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("long")
        return F.struct(F.xxhash64(c).alias("id"), bits(1).alias("v1"), bits(16).alias("v2"))

    norm = docs.select("doc_id", F.xxhash64("text").alias("version"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "version", F.sha2("norm", 256).alias("text_sha256"), F.transform(F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)), chunk).alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks, version) of every row of ``docs`` (doc_id, text, any more columns).

    Texts are equal when their white space is normalised alike (see ``normalised``). Chunks are
    deduplicated into a dictionary of identifiers; an identifier is verified when all its chunks
    have one SHA-256. While all are, texts are equal if and only if their ordered identifier lists
    are; if any clashes, the lists carry the SHA-256 bits as well. Only lists and hashes move.

    ``version`` is the xxhash64 of the row's text. Null texts count as empty, and all empty texts are one group. Rows that repeat a doc_id are
    counted each; a null doc_id never stays unless no row of its group has one (keep_id is then
    null and kept false). An empty table gives no rows.
    """
    made = materialize(recipes(docs), "recipes")
    entry = made.select(F.explode("recipe").alias("c")).groupBy("c.id").agg(*[f(f"c.{v}").alias(f"{f.__name__}_{v}") for v in ("v1", "v2") for f in (F.min, F.max)], F.count("*").alias("uses"))
    clashes = entry.where("min_v1 <> max_v1 or min_v2 <> max_v2").limit(1).count()
    ordered = F.col("recipe") if clashes else F.transform("recipe", lambda c: c["id"])
    lists = made.select("doc_id", "version", "text_sha256", F.size("recipe").alias("n_chunks"), ordered.alias("ids")).withColumn("h", F.xxhash64("ids"))
    groups = lists.groupBy("h", "text_sha256", "ids").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1 or keep_id is null")
    # Rows meet what became of their group by the list's hash and the text's digest, which are short however long the list.
    out = join_groups(lists.drop("ids"), materialize(groups.drop("ids"), "groups"), ["h", "text_sha256"], "group_size", made.count())
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(keep == F.col("doc_id"), F.lit(False)).alias("kept"), "text_sha256", "n_chunks", "version")
