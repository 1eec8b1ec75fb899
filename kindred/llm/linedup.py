"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position."""

from pyspark.sql import Column, DataFrame, functions as F

from kindred.operators.hot import join_groups
from kindred.shared import materialize

WHITE = " \t\n\x0b\x0c\r"
#: The letters that a key has in lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Positions of at most so many dropped lines, and names of their rows, are sent to all executors (about 100 MB); more are joined by a shuffle.
SEND = 2_000_000


def lines_of(text: Column) -> Column:
    """The text cut at line feeds; null or empty has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, least: int) -> Column:
    """For each line in order the first 128 bits of its key's SHA-256, in hexadecimal; null for keys of fewer than ``least`` code points."""
    # lower() is the quick way where a line is ASCII alone; elsewhere it would change more letters than A-Z.
    lower = lambda k: F.when(F.octet_length(k) == F.char_length(k), F.lower(k)).otherwise(F.translate(k, UPPER, LOWER))
    trimmed = F.transform(lines_of(text), lambda line: F.btrim(line, F.lit(WHITE)))
    return F.transform(trimmed, lambda k: F.when(F.char_length(k) >= least, F.substring(F.sha2(lower(k), 256), 1, 32)))


def without_lines(text: Column, drop: Column) -> Column:
    """The text without its lines at the places ``drop`` (from 0); null drops none."""
    # The outer transform holds the lines, so that they are cut once and not once a place.
    kept = F.transform(F.array(lines_of(text)), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda p: F.get(lines, p)), "\n"))
    return F.when(drop.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.get(kept, F.lit(0)))


def line_dedup(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text) of every row of ``docs`` (doc_id, text, any more columns).

    A text is cut at line feeds (null or empty: one empty line). A line's key is the line without
    white space at both ends, A-Z lower-cased. A key of at least ``least`` code points that at
    least ``documents`` documents hold loses all its lines but those in the largest doc_id holding
    it; the rest are joined again by line feeds. Keys are told apart by 128 bits of their SHA-256.

    Each row is a document, so rows that repeat a doc_id count each, and keep or lose their lines
    alike; rows with a null doc_id are counted and, where the key is frequent, never the one that
    keeps it, unless all holders are such. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    hashed = materialize(docs.select("doc_id", "version", line_hashes(F.col("text"), least).alias("keys")), "lines")
    lines = hashed.select("doc_id", "version", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    # Each document counts a key once.
    held = hashed.select("doc_id", "version", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    frequent = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= documents)
    gone = join_groups(lines, materialize(frequent, "frequent"), ["key"], "n", hashed.count(), "inner").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    drops = materialize(gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("drop")), "drops")
    total = drops.agg(F.sum(F.size("drop") + 4)).first()[0] or 0
    sent = F.broadcast(drops) if total <= SEND else drops
    sent = sent.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "drop")
    joined = docs.join(sent, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    kept = joined.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), without_lines(F.col("text"), F.col("drop")).alias("kept_text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")
