"""Exact duplicates by content."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kindred.functions.digests import content_digest, partial_digest, sample_digest
from kindred.operators.hot import join_groups, ranked
from kindred.shared import materialize

GROUP = ["size", "digest"]
#: Rows of at most so many nominated files are sent to all executors (under 100 MB); more are joined by a shuffle.
SEND = 500_000
#: Pairs that pairs() lists unless told otherwise.
MOST_PAIRS = 50_000_000
#: Members of a group that one task compares with its first.
AT_A_FIRST = 1024


def _several(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once; the counts are made map-side, so a hot key is one row of the join's small side."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), keys, "left_semi")


def exact_candidates(files: DataFrame, staged: bool = False, big: int = 0) -> DataFrame:
    """Files (file_id, content, ...) whose size and SHA-256 occur more than once, with both as columns.

    ``staged`` narrows by size, partial digest and, above ``big`` bytes, sampled digest first: worth
    it only where content is read anew for each stage. Files without content are no candidates.
    """
    df = files.where("content is not null").withColumn("size", F.octet_length("content").cast("long"))
    if staged:
        df = _several(df, ["size"])
        df = _several(df.withColumn("_p", partial_digest(F.col("content"))), ["size", "_p"])
        sampled = F.when(F.col("size") > big, sample_digest(F.col("content"))) if big else F.lit(None).cast("string")
        df = df.withColumn("_s", F.coalesce(sampled, F.col("_p")))
        df = _several(df, ["size", "_p", "_s"]).drop("_p", "_s")
    return df.withColumn("digest", content_digest(F.col("content")))


def exact_groups(files: DataFrame, verify: bool = True, staged: bool = False, big: int = 0) -> DataFrame:
    """(group_id, file_id, size, digest, members, first_id) of files with equal content, one row a member.

    The digest nominates; ``verify`` then compares every member's bytes with the first one's, and a
    bucket with any difference is withheld whole. No pairs are made. Digests are made once, where
    the content is read; only the content of nominated files moves.
    """
    digests = materialize(exact_candidates(files, staged, big).select("file_id", "size", "digest"), "digests")
    keyed = digests.groupBy(*GROUP).agg(F.count("*").alias("members"), F.min("file_id").alias("first_id")).where("members > 1")
    rows = join_groups(digests, materialize(keyed, "keyed", small=True), GROUP, "members", digests.count(), "inner")
    if verify:
        rows = materialize(rows, "nominated")
        held = files.select("file_id", "content").join(F.broadcast(rows) if rows.count() <= SEND else rows, "file_id")
        # A group's first content goes to as many tasks as its members need.
        places = F.ceil(F.col("members") / AT_A_FIRST).cast("int")
        first = held.where(F.col("file_id") == F.col("first_id")).select(*GROUP, F.col("content").alias("_first"), F.explode(F.sequence(F.lit(0), places - 1)).alias("_place"))
        rest = held.withColumn("_place", F.pmod(F.xxhash64("file_id"), places).cast("int"))
        bad = rest.join(first, [*GROUP, "_place"]).where(F.col("content") != F.col("_first")).select(*GROUP).distinct()
        rows = rows.join(bad, GROUP, "left_anti")
    return rows.select(F.concat(F.lit("sha256:"), "digest").alias("group_id"), "file_id", "size", "digest", "members", "first_id")


def require_equal(files: DataFrame) -> DataFrame:
    """The group of files that are known to be equal; an error if they aren't, or if there is but one."""
    n, kinds = files.agg(F.count_distinct("file_id"), F.count_distinct(F.struct(F.octet_length("content"), content_digest(F.col("content"))))).first()
    if n < 2 or kinds != 1:
        raise ValueError(f"{n} files with {kinds} contents are no exact group")
    return exact_groups(files)


def pairs(groups: DataFrame, most: int | None = MOST_PAIRS) -> DataFrame:
    """All pairs at 100; only where asked for, as their number grows with the square of a group: more than ``most`` are an error before the join."""
    n = pair_count(groups).agg(F.sum("pairs")).first()[0] or 0
    if most is not None and n > most:
        raise ValueError(f"{n} pairs; at most {most}: groups say the same")
    a, b = groups.alias("a"), groups.alias("b")
    return a.join(b, F.col("a.group_id") == F.col("b.group_id")).where("a.file_id < b.file_id").select(F.col("a.file_id").alias("first_id"), F.col("b.file_id").alias("second_id"), F.lit(100).alias("percentage"))


def pair_count(groups: DataFrame) -> DataFrame:
    """H2: the number of pairs, without making them."""
    return groups.groupBy("group_id").agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs"))


def manifest_groups(folders: DataFrame) -> DataFrame:
    """Folders (folder, size, digest, is_ref) of one manifest, unless all are references."""
    k = folders.groupBy("size", "digest").agg(F.count("*").alias("members"), F.bool_or(~F.col("is_ref")).alias("_any")).where("members > 1 and _any").drop("_any")
    return folders.join(k, ["size", "digest"])


def colour(members: DataFrame, ignored: DataFrame, mixed: bool = True) -> DataFrame:
    """Splits groups (group_id, file_id, path, extension) so that no part holds an ignored pair; members take the first colour that no ignored neighbour before them has.

    Groups that no ignored pair touches, which are nearly all, need no Python.
    """
    kind = F.lit("") if mixed else F.col("extension")
    keyed = members.withColumn("kind", kind)
    m = keyed.select("group_id", "kind", "file_id", "path")
    edges = ignored.select(F.col("lo").alias("path"), F.col("hi").alias("other")).union(ignored.select("hi", "lo"))
    near = m.join(edges, "path").join(m.select("group_id", "kind", F.col("path").alias("other"), F.col("file_id").alias("other_id")), ["group_id", "kind", "other"])
    near = near.where("other_id < file_id").groupBy("group_id", "kind", "file_id").agg(F.collect_set("other_id").alias("before"))
    touched = near.select("group_id").distinct()

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        got: dict = {}
        for i, before in zip(pdf.file_id, pdf.before, strict=True):
            taken = {got[b] for b in (before if before is not None else ())}
            got[i] = next(c for c in range(len(taken) + 1) if c not in taken)
        return pd.DataFrame({"file_id": list(got), "colour": list(got.values())})

    hard = m.join(touched, "group_id", "left_semi").join(near, ["group_id", "kind", "file_id"], "left").orderBy("file_id")
    coloured = hard.groupBy("group_id", "kind").applyInPandas(lambda p: greedy(p.sort_values("file_id")), "file_id long, colour int")
    return keyed.join(coloured, "file_id", "left").withColumn("colour", F.coalesce("colour", F.lit(0)))


def finish(members: DataFrame, cross_pool: bool = False) -> DataFrame:
    """Of parts (group_id, kind, colour) those with two members, two pools where asked, and one that isn't a reference."""
    key = ["group_id", "kind", "colour"]
    pools = F.size(F.collect_set(F.coalesce(F.col("comparison_pool"), F.lit("incoming"))))
    good = members.groupBy(*key).agg(F.count("*").alias("n"), pools.alias("pools"), F.bool_or(~F.col("is_ref")).alias("any")).where("n > 1 and any" + (" and pools > 1" if cross_pool else ""))
    return members.join(good.select(*key), key, "left_semi")


def reclaimable(groups: DataFrame) -> DataFrame:
    """H6, H7: groups, members beyond the first of each, and their bytes."""
    g = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return g.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("size")).alias("bytes"))


def clusters_equal(members: DataFrame) -> DataFrame:
    """Whether all of a cluster's primaries, and its sidecars slot by slot, are byte-equal (cluster_id, slot, content)."""
    return members.groupBy("cluster_id", "slot").agg((F.count_distinct(content_digest(F.col("content"))) == 1).alias("same")).groupBy("cluster_id").agg(F.bool_and("same").alias("proven"))


def stats(members: DataFrame, marked: str = "marked") -> DataFrame:
    """H6: marked and all rows that can be marked, and their bytes."""
    return members.agg(F.count_if(marked).alias("marked"), F.sum(F.when(F.col(marked), F.col("size")).otherwise(0)).alias("marked_size"), F.count("*").alias("total"), F.sum("size").alias("total_size"))


def ranked_first(members: DataFrame, order: list) -> DataFrame:
    """Each group's members in order, references first; rank 0 is the reference."""
    return ranked(members, "group_id", [F.col("is_ref").desc(), *order])
