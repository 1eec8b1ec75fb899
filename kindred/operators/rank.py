"""Ranking within groups: keepers, priorities, deltas, marks, filters."""

from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.text import extension, without_extension
from kindred.operators.hot import join_groups, ranked
from kindred.shared import materialize

# File kinds, name patterns, folders and points of the keeper score.
RAW_EXTENSIONS = (
    "3fr", "arw", "cr2", "cr3", "dng", "erf", "fff", "iiq", "kdc", "mef", "mos",
    "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "sr2", "srf", "x3f",
)
LOSSLESS_EXTENSIONS = ("bmp", "flac", "gif", "png", "tif", "tiff", "wav")
COPY_NAME = r"(?i)(?:^|[\s._-])(?:copy|backup|duplicate|resized|small|thumb|thumbnail)(?:$|[\s._-])"
NUMBERED_COPY = r"(?i)(?:[\s._-]\d+|\(\d+\)|\[\d+\]|\{\d+\}|(?:copy|duplicate)[\s_-]*\d*)$"
TEMPORARY_FOLDERS = ("download", "downloads", "temp", "tmp", "cache", "thumbnails", "recycle.bin")
POINTS = {"reference": 100.0, "resolution": 30.0, "bit_depth": 20.0, "metadata": 15.0, "bitrate": 20.0, "lossless": 10.0, "file_size": 5.0, "copy_name": -20.0, "temporary_path": -50.0, "jpeg_artifacts": -30.0}
#: What a member's points are called, for and against it, and what it lacks beside the keeper.
MESSAGES = {"resolution": "more pixels", "bit_depth": "deeper colour", "metadata": "richer metadata", "bitrate": "denser encoding", "file_size": "most bytes", "copy_name": "named like a copy", "temporary_path": "lies in a folder for passing files", "jpeg_artifacts": "shows JPEG block edges"}
WEAKER = {"resolution": "fewer pixels", "bit_depth": "shallower colour", "metadata": "poorer metadata", "bitrate": "thinner encoding", "lossless": "weaker file format", "file_size": "fewer bytes"}

_COLUMNS = {"pixels": "double", "bit_depth": "double", "metadata_count": "double", "bitrate": "double", "size": "double", "jpeg_artifact_score": "double", "is_ref": "boolean", "comparison_pool": "string", "name": "string", "path": "string"}


def keeper_points(members: DataFrame) -> DataFrame:
    """The points of every member (group_id, file_id and what it has of the other columns), in ``points``, and their sum ``score``."""
    df = members
    for c, kind in _COLUMNS.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    maxima = df.groupBy("group_id").agg(F.count("*").alias("_n"), *[F.max(c).alias(f"_m_{c}") for c in ("pixels", "bit_depth", "metadata_count", "bitrate", "size")])
    maxima = materialize(maxima, "maxima", small=True)
    df = join_groups(df, maxima, ["group_id"], "_n", maxima.agg(F.sum("_n")).first()[0] or 0, "inner").drop("_n")
    ratio = lambda c, k: F.when((F.col(c) > 0) & (F.col(f"_m_{c}") > 0), POINTS[k] * F.least(F.col(c) / F.col(f"_m_{c}"), F.lit(1.0)))
    ext, stem = extension(F.col("name")), without_extension(F.coalesce("name", F.lit("")))
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda p: p != "")
    depth = F.size(parts) + F.when(F.startswith(F.col("path"), F.lit("/")), 1).otherwise(0)
    points = {
        "reference": F.when(F.col("is_ref"), POINTS["reference"]),
        "resolution": ratio("pixels", "resolution"),
        "bit_depth": ratio("bit_depth", "bit_depth"),
        "metadata": ratio("metadata_count", "metadata"),
        "bitrate": ratio("bitrate", "bitrate"),
        "lossless": F.when(ext.isin(*LOSSLESS_EXTENSIONS, *RAW_EXTENSIONS), POINTS["lossless"]),
        "file_size": ratio("size", "file_size"),
        "copy_name": F.when(stem.rlike(COPY_NAME) | stem.rlike(NUMBERED_COPY), POINTS["copy_name"]),
        "temporary_path": F.when(F.exists(parts, lambda p: F.lower(p).isin(*TEMPORARY_FOLDERS)), POINTS["temporary_path"]),
        "jpeg_artifacts": F.when(F.col("jpeg_artifact_score") > 0, POINTS["jpeg_artifacts"] * F.least("jpeg_artifact_score", F.lit(1.0))),
        "path_context": depth / 1000.0,
    }
    packed = F.struct(*[F.coalesce(v, F.lit(0.0)).cast("double").alias(k) for k, v in points.items()])
    out = df.withColumn("points", packed)
    total = sum((F.col(f"points.{k}") for k in points), F.lit(0.0))
    return out.withColumn("score", F.round(total, 9)).drop(*[f"_m_{c}" for c in ("pixels", "bit_depth", "metadata_count", "bitrate", "size")])


def choose_keepers(members: DataFrame) -> DataFrame:
    """Members with score and rank; rank 0 is the keeper: references first, then score, then path."""
    return ranked(keeper_points(members), "group_id", [F.col("is_ref").desc_nulls_last(), F.col("score").desc(), F.lower(F.coalesce("path", F.lit(""))), F.col("file_id")])


def explanations(ranked: DataFrame) -> DataFrame:
    """Why the keeper stays, and what speaks against each other member."""
    k = ranked.where("rank = 0").select("group_id", F.col("points").alias("_k"), F.col("score").alias("_ks"))
    df = ranked.join(k, "group_id")
    reference = F.when(F.col("comparison_pool") == "protected", "in a protected folder").when(F.col("comparison_pool") == "compare_only", "in a folder for comparison alone").otherwise("a reference")
    raw = F.when(extension(F.col("name")).isin(*RAW_EXTENSIONS), "raw camera data").otherwise("format without loss")
    label = lambda c: reference if c == "reference" else raw if c == "lossless" else F.lit("deeper path") if c == "path_context" else F.lit(MESSAGES[c])
    order = [*POINTS, "path_context"]
    some = lambda test, text: F.filter(F.array(*[F.when(test(c), text(c)) for c in order if text(c) is not None]), lambda x: x.isNotNull())
    good = some(lambda c: F.col(f"points.{c}") > 0, label)
    bad = some(lambda c: F.col(f"points.{c}") < 0, label)
    weaker = F.filter(F.array(*[F.when(F.col(f"_k.{c}") > F.col(f"points.{c}") + 1e-9, F.lit(t)) for c, t in WEAKER.items()]), lambda x: x.isNotNull())
    against = F.concat(bad, weaker)
    lower = F.array(F.format_string("fewer points in all (%.3f of %.3f)", "score", "_ks"))
    text = F.when(F.col("rank") == 0, F.concat(F.lit("keep: "), F.array_join(F.when(F.size(good) > 0, good).otherwise(F.array(F.lit("first in order"))), ", "))).otherwise(F.concat(F.lit("review: "), F.array_join(F.when(F.size(against) > 0, against).otherwise(lower), ", ")))
    return df.withColumn("explanation", text).drop("_k", "_ks")


def prioritize(members: DataFrame, keys: list[Column], tie: str = "file_id") -> DataFrame:
    """Ranks members anew, references first, then by the keys."""
    return ranked(members.drop("rank"), "group_id", [F.col("is_ref").desc(), *keys, F.col(tie)])


def legacy_keys() -> list[Column]:
    """I3 as a total order: larger, no "copy" in the name, no digits behind it, deeper folder."""
    return [F.col("size").desc(), F.lower("name").contains("copy").asc(), F.regexp_replace("name", r"\.[^.]*$", "").rlike(r"\d$").asc(), F.size(F.split("path", "/")).desc()]


# Sort keys by category.
CATEGORIES = {
    "kind": lambda v: (extension(F.col("name")) == v).desc(),
    "folder": lambda v: F.startswith(F.col("path"), F.lit(v.rstrip("/") + "/")).desc(),
    "filename_ends_with_digit": lambda v: without_extension(F.col("name")).rlike(r"\d$").desc(),
    "filename_no_digit": lambda v: without_extension(F.col("name")).rlike(r"\d$").asc(),
    "longest_name": lambda v: F.length("name").desc(),
    "shortest_name": lambda v: F.length("name").asc(),
    "longest_path": lambda v: F.length("path").desc(),
    "shortest_path": lambda v: F.length("path").asc(),
    "highest": lambda v: F.col(v).desc_nulls_last(),
    "lowest": lambda v: F.col(v).asc_nulls_last(),
    "largest_dimensions": lambda v: (F.col("dimensions.w") * F.col("dimensions.h")).desc_nulls_last(),
}


def criteria(names: list[tuple[str, str | None]]) -> list[Column]:
    """Sort columns of (category, value) pairs, in their order."""
    return [CATEGORIES[n](v) for n, v in names]


def criterion_values(members: DataFrame, column: str) -> DataFrame:
    """H13."""
    return members.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def _with_reference(members: DataFrame, columns: list[str]) -> DataFrame:
    ref = members.where("rank = 0").select("group_id", *[F.col(c).alias(f"_ref_{c}") for c in columns])
    return members.join(ref, "group_id")


def deltas(members: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Each number less the reference's, and whether each text differs from the reference's."""
    df = _with_reference(members, [*numeric, *text])
    for c in numeric:
        df = df.withColumn(f"delta_{c}", F.when(F.col("rank") == 0, F.col(c)).otherwise(F.col(c) - F.col(f"_ref_{c}")))
    for c in text:
        df = df.withColumn(f"differs_{c}", ~F.col(c).eqNullSafe(F.col(f"_ref_{c}")) & (F.col("rank") > 0))
    return df.drop(*[f"_ref_{c}" for c in [*numeric, *text]])


def sort_groups(members: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Groups by ``size``, ``marked``, or a column of their reference, members by rank."""
    if key == "size":
        v = members.groupBy("group_id").agg(F.count("*").alias("_v"))
    elif key == "marked":
        v = members.groupBy("group_id").agg(F.count_if("marked").alias("_v"))
    else:
        v = members.where("rank = 0").select("group_id", F.col(key).alias("_v"))
    order = F.col("_v").asc() if ascending else F.col("_v").desc()
    return members.join(v, "group_id").orderBy(order, "group_id", "rank").drop("_v")


def sort_members(members: DataFrame, key: str, ascending: bool = True, delta: bool = False) -> DataFrame:
    """All members but references by a column, or by its delta."""
    df = _with_reference(members, [key]) if delta else members
    value = F.col(key) - F.col(f"_ref_{key}") if delta else F.col(key)
    return df.where("rank > 0").orderBy(value.asc() if ascending else value.desc(), "file_id").drop(f"_ref_{key}")


def filtered(members: DataFrame, *patterns: str) -> DataFrame:
    """Groups in which, for all patterns, a member's path is found; ``shown`` marks members that match all."""
    hit = F.lit(True)
    for p in patterns:
        hit = hit & F.col("path").rlike(f"(?i){p}")
    df = members.withColumn("shown", hit)
    return df.join(df.where("shown").select("group_id").distinct(), "group_id", "left_semi")


def marked(members: DataFrame, marks: DataFrame, inverted: bool = False) -> DataFrame:
    """``marked`` of rows that can be marked, from a set of marks that may be inverted."""
    m = marks.select("file_id").distinct().withColumn("_m", F.lit(True))
    can = ~F.col("is_ref") & (F.col("rank") > 0)
    flag = F.coalesce("_m", F.lit(False))
    return members.join(m, "file_id", "left").withColumn("marked", F.coalesce(can & (~flag if inverted else flag), F.lit(False))).drop("_m")


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Groups without the members that go; a group of one or of references alone dissolves."""
    left = members.join(gone.select("file_id"), "file_id", "left_anti")
    ok = left.groupBy("group_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("is_ref")).alias("any")).where("n > 1 and any")
    return left.join(ok.select("group_id"), "group_id", "left_semi")


def switch_reference(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted members become references of their groups, unless the present one is protected."""
    held = members.where("rank = 0 and is_ref").select("group_id")
    want = wanted.select("file_id").distinct().withColumn("_w", F.lit(True))
    df = members.join(want, "file_id", "left").join(held.withColumn("_h", F.lit(True)), "group_id", "left")
    first = F.coalesce(F.col("_w") & F.col("_h").isNull(), F.lit(False))
    df = df.withColumn("_first", first).withColumnRenamed("rank", "_rank")
    return ranked(df, "group_id", [F.col("_first").desc(), F.col("_rank")]).drop("_w", "_h", "_first", "_rank")
