"""Files: scope, folder states, exclusion, identity."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions.text import file_name

# Folder states and the names that are excluded unless a policy says otherwise.
NORMAL, REFERENCE, EXCLUDED, COMPARE_ONLY = 0, 1, 2, 3
DEFAULT_EXCLUSIONS = (
    r"^thumbs\.db$",
    r"^desktop\.ini$",
    r"^\.DS_Store$",
    r"^\.Trash\-.*",
    r"^\$Recycle\.Bin$",
    r"^\..*",
)
#: Names of folders that the engine keeps for itself.
RESERVED = (".kindred-quarantine", ".kindred-executor")
WINDOWS_DEVICES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def walk_coverage(events: DataFrame) -> DataFrame:
    """A2, H9 over (root, kind): counts of each kind; complete without skips or errors that reduce coverage (pruned folders don't)."""
    bad = F.col("kind").startswith("skipped") | (F.col("kind") == "error")
    return events.groupBy("root").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "pruned").alias("pruned"), F.count_if(bad).alias("reduced"), (F.count_if(bad) == 0).alias("complete"))


def scan_receipt(coverage: DataFrame) -> DataFrame:
    """H9: one row over all roots; any incomplete root makes the scan incomplete."""
    return coverage.agg(F.sum("files").alias("files"), F.sum("reduced").alias("reduced"), (F.sum("files") + F.sum("reduced")).alias("discovered"), F.bool_and("complete").alias("complete"))


def folders_of(files: DataFrame) -> DataFrame:
    """A4: every folder above a file, deepest first in ``depth``."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(up).alias("folder")).where("folder <> ''").distinct().withColumn("depth", F.size(F.split("folder", "/")) - 1)


def one_level(files: DataFrame, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """A5."""
    out = files.where(F.regexp_replace("path", r"/[^/]*$", "") == folder)
    return out.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions)) if extensions else out


def within_budget(files: DataFrame, most: int) -> DataFrame:
    """The input whole, or an error; never a part of it."""
    if files.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files: nothing was matched")
    return files


def size_between(files: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """0 lifts a bound."""
    out = files.where(F.col("size") >= least) if least else files
    return out.where(F.col("size") <= most) if most else out


def pair_in_scope(first_pool: Column, second_pool: Column, scope: str = "all") -> Column:
    """B5."""
    pool = lambda c: F.coalesce(c, F.lit("incoming"))
    return F.lit(True) if scope == "all" else pool(first_pool) != pool(second_pool)


def excluded(path: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUSIONS) -> Column:
    """The whole name matches a pattern without a separator, or the whole path one with."""
    name = file_name(path)
    tests = [(path if "/" in p else name).rlike(f"^(?:{p})$") for p in patterns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def reserved(path: Column) -> Column:
    """B12."""
    return F.exists(F.split(F.lower(path), "/"), lambda part: part.isin(*RESERVED))


def unsafe_component(name: Column) -> Column:
    stem = F.lower(F.substring_index(name, ".", 1))
    return F.coalesce((name == "") | name.isin(".", "..") | name.rlike(r"[\x00/\\<>:\"|?*\x01-\x1f]") | name.rlike(r"[. ]$") | stem.isin(*WINDOWS_DEVICES), F.lit(True))


def directory_states(files: DataFrame, states: DataFrame) -> DataFrame:
    """Each file's state is that of its nearest folder with one (path, state), else excluded below hidden or reserved folders, else normal.

    States are joined to the folders above files, not the other way round, so any number of them will do.
    """
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")))
    up = files.select("file_id", F.explode(chain).alias("c")).select("file_id", "c.depth", "c.at")
    own = F.when(reserved(F.col("at")) | file_name(F.col("at")).rlike(r"^\..+"), EXCLUDED)
    found = up.join(states.select(F.col("path").alias("at"), "state"), "at", "left").withColumn("s", F.coalesce("state", own)).where("s is not null")
    near = found.groupBy("file_id").agg(F.max_by("s", "depth").alias("state"))
    out = files.join(near, "file_id", "left").withColumn("state", F.coalesce("state", F.lit(NORMAL)))
    return out.withColumn("comparison_pool", pool_of_state(F.col("state"))).withColumn("is_ref", F.col("state").isin(REFERENCE, COMPARE_ONLY))


def pool_of_state(state: Column) -> Column:
    """B10."""
    return F.when(state == REFERENCE, "protected").when(state == COMPARE_ONLY, "compare_only").otherwise("incoming")


def prunable(folders: DataFrame, states: DataFrame) -> DataFrame:
    """Excluded folders below which no folder has another state."""
    keep = states.where(F.col("state") != EXCLUDED).select("path")
    above = folders_of(keep.withColumn("path", F.concat("path", F.lit("/x")))).select("folder")
    return folders.join(states.where(F.col("state") == EXCLUDED).select(F.col("path").alias("folder")), "folder", "left_semi").join(above, "folder", "left_anti")


def first_of(files: DataFrame, key: Column, order: Column | str = "file_id") -> DataFrame:
    """Of rows with one key the first in order, which is a total one; picked map-side first."""
    return files.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*files.columns), order).alias("_row")).select("_row.*")


def without_hardlinks(files: DataFrame) -> DataFrame:
    """Of files with one (device, inode) the first; null or 0 is no identity."""
    known = (F.coalesce(F.col("device"), F.lit(0)) != 0) & (F.coalesce(F.col("inode"), F.lit(0)) != 0)
    return first_of(files.where(known), F.struct("device", "inode")).unionByName(files.where(~known))


def scan_candidates(files: DataFrame, least_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """M2: files of at least ``least_size`` bytes, each physical file once, and the issues (path, issue) of files whose size or identity couldn't be read."""
    known = F.col("size").isNotNull() & F.col("device").isNotNull() & F.col("inode").isNotNull()
    issues = files.where(~known).select("path", F.when(F.col("size").isNull(), "unreadable").otherwise("no identity").alias("issue"))
    return without_hardlinks(size_between(files.where(known), least_size)), issues


def eligible(members: DataFrame) -> DataFrame:
    """Rows that may be marked: verified in a complete scan, incoming, not the reference, and pool unchanged for it and its keeper; ``batch_ok`` if all may."""
    ok = F.col("scan_complete") & (F.col("verification_kind") == "verified_exact") & ~F.col("is_ref") & (F.col("comparison_pool") == "incoming") & (F.col("comparison_pool") == F.col("current_pool")) & F.col("keeper_pool_unchanged")
    return members.withColumn("eligible", F.coalesce(ok, F.lit(False))).withColumn("batch_ok", F.bool_and("eligible").over(Window.partitionBy("group_id")))


def markable(is_ref: Column, rank: Column, shown: Column) -> Column:
    """Neither reference nor first of its group nor hidden by a filter nor without group."""
    return F.coalesce(~is_ref & (rank > 0) & shown, F.lit(False))
