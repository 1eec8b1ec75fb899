"""The catalog: snapshots of scans as tables, their differences, projections and pages."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions.digests import content_digest
from kindred.shared import discard, materialize

# Domains of state columns.
SCAN_STATUS = ("running", "cancelled", "complete", "completed_with_errors", "failed")
PATH_STATES = ("active", "missing", "unreadable")
CONTENT_STATES = ("stable", "unstable", "unreadable", "missing")
WORK_STATUS = ("pending", "claimed", "complete", "failed")
KEY = ["root_id", "path_key"]
MOST_ATTEMPTS = 3


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows of the table whose key isn't in ``rows``, and ``rows``."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """only rows whose key is new."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").dropDuplicates(key))


def in_domain(table: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """The rows that break a column's domain, to be asserted empty."""
    return table.where(~F.col(column).isin(*domain) | F.col(column).isNull())


def start_scan(scans: DataFrame, scan_id: int, roots: list[str], now: float, resume_of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """the scans (scan_id, status, started_at, finished_at, resume_of) with a running one more, and its roots (scan_id, root)."""
    spark = scans.sparkSession
    row = spark.createDataFrame([(scan_id, "running", now, None, resume_of)], "scan_id long, status string, started_at double, finished_at double, resume_of long")
    return insert_missing(scans, row, ["scan_id"]), spark.createDataFrame([(scan_id, r) for r in sorted(set(roots))], "scan_id long, root string")


def end_scan(scans: DataFrame, scan_id: int, status: str, now: float) -> DataFrame:
    """a running scan ends with a status; one that has ended stays as it is."""
    mine = (F.col("scan_id") == scan_id) & (F.col("status") == "running")
    return scans.withColumn("finished_at", F.when(mine, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(mine, status).otherwise(F.col("status")))


def finalize_scan(scans: DataFrame, scan_id: int, folders: DataFrame, errors: DataFrame, now: float) -> DataFrame:
    """complete if every folder (scan_id, status) of the scan is and no error (scan_id) was recorded, failed if a folder failed for good, else complete with errors."""
    mine = folders.where(F.col("scan_id") == scan_id)
    left, lost = mine.where("status <> 'complete'").limit(1).count(), mine.where("status = 'failed'").limit(1).count()
    bad = errors.where(F.col("scan_id") == scan_id).limit(1).count()
    return end_scan(scans, scan_id, "failed" if lost else "completed_with_errors" if left or bad else "complete", now)


def run_batch(items: DataFrame, contents: DataFrame, owner: str, now: float, lease: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """one batch of a worker: claims items (item_id, content_version_id, ...), digests their contents (content_version_id, content) and finishes them.

    Returns the items and the new artifacts (content_version_id, algorithm, value). An item whose
    content can't be read goes back to the queue until its attempts are used up.
    """
    held = claim(items, owner, now, lease, limit, ["item_id"])
    mine = held.where((F.col("status") == "claimed") & (F.col("owner") == owner))
    read = mine.join(contents, "content_version_id", "left").select("item_id", "content_version_id", "content")
    done, lost = read.where("content is not null"), read.where("content is null")
    made = done.select("content_version_id", F.lit("sha256").alias("algorithm"), content_digest(F.col("content")).alias("value")).distinct()
    return fail(complete(held, done, owner), lost, owner, MOST_ATTEMPTS), made


def run_batches(items: DataFrame, contents: DataFrame, owner: str, now: float, lease: float, limit: int, most: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """batches of ``limit`` items as long as any is pending, or at most ``most``; each batch's tables are written, so its lineage ends.

    Every batch finishes its items or uses up one of their attempts, so there is a last one.
    """
    if limit < 1:
        raise ValueError("a batch has one item at least")
    made = []
    while (most is None or len(made) < most) and items.where("status = 'pending'").limit(1).count():
        before = items
        items, more = run_batch(before, contents, owner, now, lease, limit)
        items = materialize(items, "items")
        made.append(materialize(more, "artifacts"))
        discard(before)
    return items, made


def journal(actions: DataFrame, more: DataFrame) -> DataFrame:
    """Rows are only ever added; each name once."""
    return insert_missing(actions, more, [actions.columns[0]])


def integrity(paths: DataFrame, versions: DataFrame, artifacts: DataFrame, scans: DataFrame) -> DataFrame:
    """what is wrong with a catalog's tables, as (problem, id): states beyond their domain, repeated keys, references to nothing; empty for a sound one."""
    told = lambda problem, df, c: df.select(F.lit(problem).alias("problem"), F.col(c).cast("string").alias("id"))
    repeated = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    out = told("scan status", in_domain(scans, "status", SCAN_STATUS), "scan_id").union(told("path state", in_domain(paths, "state", PATH_STATES), "path_id")).union(told("content state", in_domain(versions, "state", CONTENT_STATES), "content_version_id"))
    out = out.union(told("repeated path", repeated(paths, "path_id"), "path_id")).union(told("repeated version", repeated(versions, "content_version_id"), "content_version_id"))
    v = versions.select("content_version_id").distinct()
    return out.union(told("path without content", paths.join(v, "content_version_id", "left_anti"), "path_id")).union(told("artifact without content", artifacts.join(v, "content_version_id", "left_anti"), "content_version_id"))


def latest_complete(scans: DataFrame) -> DataFrame:
    """F3."""
    return scans.where("status = 'complete'").orderBy(F.col("finished_at").desc(), F.col("scan_id").desc()).limit(1).select("scan_id")


def projectable(roots: DataFrame, scans: DataFrame) -> DataFrame:
    """each root (root_id, last_complete_scan_id) and whether its latest scan (root_id, scan_id, status) is that, and complete."""
    last = scans.groupBy("root_id").agg(F.max_by("status", "scan_id").alias("status"), F.max("scan_id").alias("scan_id"))
    return roots.join(last, "root_id", "left").select("root_id", F.coalesce((F.col("status") == "complete") & (F.col("scan_id") == F.col("last_complete_scan_id")), F.lit(False)).alias("projectable"))


def claim(items: DataFrame, owner: str, now: float, lease: float, limit: int, order: list) -> DataFrame:
    """expired leases fall back to pending; then the first ``limit`` pending items get the owner and a lease."""
    freed = items.withColumn("status", F.when((F.col("status") == "claimed") & (F.col("lease_until") < now), "pending").otherwise(F.col("status")))
    won = freed.where("status = 'pending'").orderBy(*order).limit(limit).select("item_id", F.lit(True).alias("_w"))
    df = freed.join(won, "item_id", "left")
    mine = F.col("_w").isNotNull()
    return df.withColumn("status", F.when(mine, "claimed").otherwise(F.col("status"))).withColumn("owner", F.when(mine, owner).otherwise(F.col("owner"))).withColumn("lease_until", F.when(mine, now + lease).otherwise(F.col("lease_until"))).drop("_w")


def complete(items: DataFrame, done: DataFrame, owner: str, status: str = "complete") -> DataFrame:
    """finishes items that the owner holds; others stay as they are."""
    d = done.select("item_id").withColumn("_d", F.lit(True))
    mine = F.col("_d").isNotNull() & (F.col("owner") == owner) & (F.col("status") == "claimed")
    return items.join(d, "item_id", "left").withColumn("status", F.when(mine, status).otherwise(F.col("status"))).drop("_d")


def fail(items: DataFrame, failed: DataFrame, owner: str, most_attempts: int) -> DataFrame:
    """back to pending until the attempts are used up."""
    f = failed.select("item_id").withColumn("_f", F.lit(True))
    df = items.join(f, "item_id", "left").withColumn("_f", F.coalesce(F.col("_f") & (F.col("owner") == owner) & (F.col("status") == "claimed"), F.lit(False)))
    again = F.when(F.col("attempts") + 1 < most_attempts, "pending").otherwise("failed")
    return df.withColumn("status", F.when(F.col("_f"), again).otherwise(F.col("status"))).withColumn("attempts", F.when(F.col("_f"), F.col("attempts") + 1).otherwise(F.col("attempts"))).drop("_f")


def observe(known: DataFrame, seen: DataFrame) -> DataFrame:
    """what a listing does to known paths: ``new``, ``unchanged`` or ``changed`` generation, by native id, else by path.

    A native id that returns without a change token is a new generation, as ids are reused.
    """
    by_id = known.where("native_file_id is not null").select("native_file_id", F.struct("size", "mtime_ns", "change_token", "state").alias("_i"))
    by_path = known.select("path_key", F.struct("size", "mtime_ns", "change_token", "state").alias("_p"), F.col("native_file_id").alias("_pid"))
    df = seen.join(by_id, "native_file_id", "left").join(by_path, "path_key", "left")
    old = F.coalesce("_i", F.when(F.col("native_file_id").isNull() | F.col("_pid").isNull(), F.col("_p")))
    now = F.struct("size", "mtime_ns", "change_token", "state")
    reused = F.col("_i").isNotNull() & F.col("change_token").isNull() & ~F.col("_pid").eqNullSafe(F.col("native_file_id"))
    kind = F.when(old.isNull(), "new").when(reused | ~old.eqNullSafe(now), "changed").otherwise("unchanged")
    return df.withColumn("generation", kind).drop("_i", "_p", "_pid")


def finish_scan(paths: DataFrame, observed: DataFrame, clean_folders: DataFrame, errors: int) -> DataFrame:
    """F16: active paths that weren't seen under folders that were read without error become missing; not at all after a global error."""
    if errors:
        return paths
    gone = paths.where("state = 'active'").join(observed.select(*KEY), KEY, "left_anti").join(clean_folders.select("root_id", F.col("folder_key").alias("parent_key")), ["root_id", "parent_key"], "left_semi").select(*KEY, F.lit(True).alias("_g"))
    return paths.join(gone, KEY, "left").withColumn("state", F.when(F.col("_g"), "missing").otherwise(F.col("state"))).drop("_g")


def scan_changes(before: DataFrame, after: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """The differences of two snapshots (root_id, path_key, display_path, volume_id, native_file_id, physical_file_id, content_version_id, path_state, content_state).

    A path in both that differs is modified. Of the rest, an old and a new path of one native id,
    if no other path has it, both stable, are a relocation where the content is the same version or
    has one full SHA-256 (``artifacts``: content_version_id, sha256, size); all others are missing
    or added.
    """
    cols = ["display_path", "physical_file_id", "content_version_id", "path_state", "content_state"]
    extra = ["volume_id", "native_file_id"]
    b = before.select(*KEY, *[F.col(c).alias(f"b_{c}") for c in [*cols, *extra]])
    a = after.select(*KEY, *[F.col(c).alias(f"a_{c}") for c in [*cols, *extra]])
    both = b.join(a, KEY)
    differs = F.lit(False)
    for c in cols:
        differs = differs | (F.col(f"b_{c}") != F.col(f"a_{c}"))
    modified = both.where(differs).select(*KEY, F.lit("modified").alias("change_type"), (F.col("b_content_version_id") != F.col("a_content_version_id")).alias("content_changed"), F.lit(None).cast("string").alias("old_path_key"), F.lit(None).cast("string").alias("relation_evidence"))
    old, new = b.join(a.select(*KEY), KEY, "left_anti"), a.join(b.select(*KEY), KEY, "left_anti")
    identity = lambda df, s: df.where(F.col(f"{s}_native_file_id").isNotNull()).groupBy(F.col(f"{s}_volume_id").alias("v"), F.col(f"{s}_native_file_id").alias("i")).agg(F.count("*").alias("n"), F.max(F.struct(*[F.col(k).alias(f"{s}_{k}") for k in KEY], f"{s}_content_version_id", f"{s}_content_state")).alias(s)).where("n = 1").select("v", "i", f"{s}.*")
    pair = identity(old, "b").join(identity(new, "a"), ["v", "i"]).where("b_content_state = 'stable' and a_content_state = 'stable'")
    same = F.col("b_content_version_id") == F.col("a_content_version_id")
    if artifacts is not None:
        side = lambda s: artifacts.select(F.col("content_version_id").alias(f"{s}_content_version_id"), F.struct("sha256", "size").alias(f"{s}_d"))
        pair = pair.join(side("b"), "b_content_version_id", "left").join(side("a"), "a_content_version_id", "left")
        equal = same | F.coalesce(F.col("b_d") == F.col("a_d"), F.lit(False))
    else:
        equal = same
    moved = pair.where(equal).select(F.col("a_root_id").alias("root_id"), F.col("a_path_key").alias("path_key"), F.lit("relocation_candidate").alias("change_type"), (~same).alias("content_changed"), F.col("b_path_key").alias("old_path_key"), F.when(same, "same_catalog_generation").otherwise("matching_full_sha256").alias("relation_evidence"), "b_root_id")
    none = lambda t: (F.lit(t).alias("change_type"), F.lit(False).alias("content_changed"), F.lit(None).cast("string").alias("old_path_key"), F.lit(None).cast("string").alias("relation_evidence"))
    missing = old.join(moved.select(F.col("b_root_id").alias("root_id"), F.col("old_path_key").alias("path_key")), KEY, "left_anti").select(*KEY, *none("missing"))
    added = new.join(moved.select(*KEY), KEY, "left_anti").select(*KEY, *none("added"))
    return modified.unionByName(moved.drop("b_root_id")).unionByName(missing).unionByName(added)


def change_summary(changes: DataFrame) -> DataFrame:
    """H5."""
    kinds = ("modified", "relocation_candidate", "missing", "added")
    return changes.agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in kinds])


def require_snapshots(scans: DataFrame, before: int, after: int) -> None:
    """both scans must be complete."""
    n = scans.where(F.col("scan_id").isin(before, after) & (F.col("status") == "complete")).count()
    if n != len({before, after}):
        raise ValueError("both scans must be complete")


def digest_groups(paths: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(size, digest, physical_file_id, content_version_id, path_id): one active path, the lowest, of each file whose (size, digest) several files share."""
    v = versions.where("state = 'stable'").select("content_version_id", "size", "physical_file_id")
    d = artifacts.where("algorithm = 'sha256'").select("content_version_id", F.col("value").alias("digest"))
    p = paths.where("state = 'active'").groupBy("physical_file_id").agg(F.min("path_id").alias("path_id"))
    rows = v.join(d, "content_version_id").join(p, "physical_file_id")
    many = rows.groupBy("size", "digest").agg(F.count_distinct("physical_file_id").alias("members")).where("members > 1")
    return rows.join(many, ["size", "digest"])


def projection_counts(groups: DataFrame) -> DataFrame:
    """F12, H3."""
    g = groups.groupBy("size", "digest").agg(F.count_distinct("physical_file_id").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def digest_page(groups: DataFrame, after_size: int = -1, after_digest: str = "", limit: int = 100, max_rows: int | None = None, max_members: int | None = None) -> DataFrame:
    """Whole groups behind the cursor in order of size and digest, as many as fit the limits.

    The page of groups is cut first (a top-k), so the running total covers ``limit`` rows at most.
    """
    g = groups.groupBy("size", "digest").agg(F.count("*").alias("members")).where(F.struct("size", "digest") > F.struct(F.lit(after_size).cast("long"), F.lit(after_digest)))
    if max_members:
        g = g.where(F.col("members") <= max_members)
    page = g.orderBy("size", "digest").limit(limit).withColumn("running", F.sum("members").over(Window.orderBy("size", "digest").rowsBetween(Window.unboundedPreceding, 0)))
    if max_rows:
        page = page.where(F.col("running") <= max_rows)
    return groups.drop("members").join(F.broadcast(page), ["size", "digest"])


def keyset_page(table: DataFrame, key: list[str], after: tuple | None, limit: int) -> DataFrame:
    """J4, J5."""
    df = table if after is None else table.where(F.struct(*key) > F.struct(*[F.lit(v).cast(table.schema[k].dataType) for k, v in zip(key, after, strict=True)]))
    return df.orderBy(*key).limit(limit)


def scan_coverage(items: DataFrame, by: list[str], statuses: tuple[str, ...] = WORK_STATUS) -> DataFrame:
    """H4: counts of every status, zero where there is none."""
    return items.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))


def retire(versions: DataFrame, artifacts: DataFrame, verifications: DataFrame, work: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """all tables without the evidence of given versions (content_version_id)."""
    g = gone.select("content_version_id").distinct()
    hit = lambda c: g.withColumnRenamed("content_version_id", c).withColumn(f"_{c}", F.lit(True))
    v = verifications.join(hit("first_content_version_id"), "first_content_version_id", "left").join(hit("second_content_version_id"), "second_content_version_id", "left")
    touched: Column = F.col("_first_content_version_id").isNotNull() | F.col("_second_content_version_id").isNotNull()
    return {
        "versions": versions.join(g.withColumn("_g", F.lit(True)), "content_version_id", "left").withColumn("state", F.when(F.col("_g"), "unstable").otherwise(F.col("state"))).drop("_g"),
        "artifacts": artifacts.join(g, "content_version_id", "left_anti"),
        "verifications": v.withColumn("state", F.when(touched, "invalidated").otherwise(F.col("state"))).drop("_first_content_version_id", "_second_content_version_id"),
        "work": work.join(g.withColumn("_g", F.lit(True)), "content_version_id", "left").withColumn("status", F.when(F.col("_g"), "failed").otherwise(F.col("status"))).drop("_g"),
    }


def verification_pairs(groups: DataFrame) -> DataFrame:
    """each member's pair with its group's first, in canonical order."""
    first = groups.groupBy("size", "digest").agg(F.min("content_version_id").alias("first_content_version_id"))
    return groups.join(first, ["size", "digest"]).where("content_version_id > first_content_version_id").select("first_content_version_id", F.col("content_version_id").alias("second_content_version_id"), F.col("digest").alias("full_digest"), F.lit("verified").alias("state"))


def stale(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Known paths whose size, mtime or token a fresh listing doesn't confirm."""
    now = listing.select("path_key", F.struct("size", "mtime_ns", "change_token").alias("_now"))
    return paths.join(now, "path_key", "left").where(~F.coalesce(F.struct("size", "mtime_ns", "change_token").eqNullSafe(F.col("_now")), F.lit(False))).drop("_now")
