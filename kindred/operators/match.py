"""Fuzzy matching of names, fields and timestamps."""

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.text import compare
from kindred.operators.hot import join_groups
from kindred.shared import materialize

#: Words in so many objects or more are common; most comparisons and matches of a run, beyond which it fails rather than answer in part.
COMMON, MOST_COMPARISONS, MOST_TIMESTAMPS = 50, 2_000_000, 50_000_000
#: Words that are merged by one task, whose work grows with their square.
MOST_WORDS = 200_000


class MatchLimit(ValueError):
    """The input is beyond a guard; nothing was matched."""


def postings(objects: DataFrame) -> DataFrame:
    """(word, id) of each distinct word."""
    return objects.select("id", F.explode(F.array_distinct("words")).alias("word"))


def uncommon_postings(objects: DataFrame, common: int = COMMON) -> DataFrame:
    """Postings without common words, but with all words of objects that have no other.

    Counts come from an aggregate and a join, not from a window over a word's postings, so a word
    that every object has is counted map-side.
    """
    p = postings(objects)
    counted = p.join(p.groupBy("word").agg(F.count("*").alias("n")), "word")
    rare = counted.where(F.col("n") < common)
    only_common = counted.join(rare.select("id").distinct(), "id", "left_anti")
    return rare.unionByName(only_common).select("word", "id")


def similar_words(vocabulary: DataFrame) -> DataFrame:
    """(word, canonical): shortest words first take up to 100 close matches (0.8) among what is left.

    Sequential by nature: one task over a vocabulary; more than MOST_WORDS different words are an
    error before it.
    """
    if vocabulary.select("word").distinct().limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise MatchLimit(f"more than {MOST_WORDS} words to merge")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        left = sorted(sorted(pdf["word"]), key=len)
        out = {}
        while left:
            key = left.pop(0)
            out[key] = key
            for w in difflib.get_close_matches(key, left, 100, 0.8):
                out[w] = key
                left.remove(w)
        return pd.DataFrame({"word": list(out), "canonical": list(out.values())})

    return vocabulary.select("word").distinct().withColumn("one", F.lit(0)).groupBy("one").applyInPandas(merge, "word string, canonical string")


def word_pairs(objects: DataFrame, common: int = COMMON, similar: DataFrame | None = None, guard: bool = True) -> DataFrame:
    """Distinct pairs (first_id, second_id) that share a posting; an error before the join if there are too many."""
    p = uncommon_postings(objects, common)
    if similar is not None:
        p = p.join(similar, "word", "left").select(F.coalesce("canonical", "word").alias("word"), "id").distinct()
    if guard:
        n = p.groupBy("word").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0
        if n > MOST_COMPARISONS:
            raise MatchLimit(f"{n:.0f} comparisons; at most {MOST_COMPARISONS}")
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.col("a.word") == F.col("b.word")).where("a.id < b.id").select(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id")).distinct()


def matches(objects: DataFrame, least: int = 80, score=compare, common: int = COMMON, similar: DataFrame | None = None, column: str = "words", guard: bool = True) -> DataFrame:
    """(first_id, second_id, percentage) of pairs sharing a word that reach ``least``; ``score`` compares two columns."""
    pairs = word_pairs(objects, common, similar, guard)
    side = lambda k: objects.select(F.col("id").alias(f"{k}_id"), F.col(column).alias(f"_{k}"))
    scored = pairs.join(side("first"), "first_id").join(side("second"), "second_id")
    return scored.select("first_id", "second_id", score(F.col("_first"), F.col("_second")).alias("percentage")).where(F.col("percentage") >= least)


def timestamp_matches(pictures: DataFrame, scaled: bool = True, most: int | None = MOST_TIMESTAMPS) -> DataFrame:
    """Pairs (id, ts, dimensions) of one known timestamp at 100; equal dimensions unless ``scaled``. More than ``most`` are an error before the join; timestamp_groups() says the same in rows."""
    p = pictures.where("ts is not null and ts <> '' and ts <> '0000:00:00 00:00:00'")
    keys = ["ts"] if scaled else ["ts", "dimensions"]
    n = p.groupBy(*keys).agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0
    if most is not None and n > most:
        raise MatchLimit(f"{n:.0f} matches; at most {most}")
    a, b = p.alias("a"), p.alias("b")
    same: Column = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"), F.lit(100).alias("percentage"))


def timestamp_groups(pictures: DataFrame) -> DataFrame:
    """D8 without pairs: members of each timestamp that several pictures share."""
    p = pictures.where("ts is not null and ts <> '' and ts <> '0000:00:00 00:00:00'")
    many = materialize(p.groupBy("ts").agg(F.count("*").alias("members")).where("members > 1"), "timestamps", small=True)
    return join_groups(p, many, ["ts"], "members", many.agg(F.sum("members")).first()[0] or 0, "inner")


def discarded(matched: DataFrame, grouped: DataFrame) -> DataFrame:
    """Files that matched but are in no group."""
    ids = matched.select(F.explode(F.array("first_id", "second_id")).alias("member_id")).distinct()
    return ids.join(grouped.select("member_id"), "member_id", "left_anti").agg(F.count("*").alias("discarded_file_count"))
