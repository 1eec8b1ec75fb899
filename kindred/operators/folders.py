"""Folders as manifests of their children."""

from pyspark.sql import DataFrame, functions as F

from kindred.functions.text import folder_of
from kindred.shared import materialize


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, size, digest) of every folder above files (path, size, digest): sizes summed, digest over the children's digests by path.

    Bottom-up, one round for each depth; a folder's children are gathered by one task, files of one
    folder being what a listing holds.
    """
    level = files.select("path", F.col("size").cast("long").alias("size"), "digest", (F.size(F.split("path", "/")) - 1).alias("depth"))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    pending, out = materialize(level, "level"), None
    for depth in range(deepest, 1, -1):
        here = pending.where(F.col("depth") == depth)
        made = here.groupBy(folder_of(F.col("path")).alias("path")).agg(F.sum("size").alias("size"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda c: c["digest"]), "").cast("binary"), 256).alias("digest")).withColumn("depth", F.lit(depth - 1))
        made = materialize(made, "folders")
        out = made if out is None else out.unionByName(made)
        pending = pending.where(F.col("depth") < depth).unionByName(made)
    if out is None:
        out = level.where("false")
    return out.select(F.col("path").alias("folder"), "size", "digest", "depth")


def suppress_nested(groups: DataFrame) -> DataFrame:
    """Folder groups (group_id, folder) without those whose members all lie below other matched folders."""
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = groups.select("group_id", "folder", F.explode(up).alias("at"))
    nested = above.join(groups.select(F.col("folder").alias("at")).distinct(), "at", "left_semi").select("folder").distinct().withColumn("_n", F.lit(True))
    flagged = groups.join(nested, "folder", "left")
    open_ = flagged.groupBy("group_id").agg(F.bool_and(F.coalesce("_n", F.lit(False))).alias("all")).where("not all")
    return groups.join(open_.select("group_id"), "group_id", "left_semi")
