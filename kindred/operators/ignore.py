"""Ignored pairs, symmetric and canonical."""

from pyspark.sql import DataFrame, functions as F


def canonical(pairs: DataFrame, a: str = "first_path", b: str = "second_path") -> DataFrame:
    """Each unordered pair once, as (lo, hi); a path isn't paired with itself. A list that is canonical already will do as well."""
    if {"lo", "hi"} <= set(pairs.columns):
        a, b = "lo", "hi"
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def without_ignored(matches: DataFrame, ignored: DataFrame, a: str = "first_path", b: str = "second_path") -> DataFrame:
    """B7."""
    keyed = matches.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    return keyed.join(canonical(ignored), ["lo", "hi"], "left_anti").drop("lo", "hi")


def neighbours(ignored: DataFrame, path: str) -> DataFrame:
    c = canonical(ignored)
    return c.where(F.col("lo") == path).select(F.col("hi").alias("path")).union(c.where(F.col("hi") == path).select("lo"))


def add(ignored: DataFrame, more: DataFrame) -> DataFrame:
    return canonical(ignored).union(canonical(more)).distinct()


def remove(ignored: DataFrame, less: DataFrame) -> DataFrame:
    return canonical(ignored).join(canonical(less), ["lo", "hi"], "left_anti")


def purge(ignored: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs of which both files exist."""
    e = existing.select("path")
    return canonical(ignored).join(e.withColumnRenamed("path", "lo"), "lo", "left_semi").join(e.withColumnRenamed("path", "hi"), "hi", "left_semi").select("lo", "hi")


def pairs_of_selected(members: DataFrame, selected: DataFrame) -> DataFrame:
    """Each selected member with every other of its group."""
    s = members.join(selected, "file_id", "left_semi").select("group_id", F.col("path").alias("first_path"))
    return canonical(s.join(members.select("group_id", F.col("path").alias("second_path")), "group_id"))
