"""Dataset preparation: bundles, selection, splits, actions."""

import hashlib
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions.digests import UNIT, action_id, split_of, unit_id
from kindred.functions.text import extension, file_name, without_extension
from kindred.operators.groups import dataset_clusters
from kindred.shared import discard, materialize, tidy

#: Assets, and distances between them, up to which one task makes a whole selection with diversity; beyond, each step is a job of its own.
MOST_DIVERSE, MOST_DISTANCES = 50_000, 5_000_000


def bundles(primaries: DataFrame, sidecars: DataFrame, extensions: tuple[str, ...], required: tuple[str, ...] = (), naming: str = "both") -> tuple[DataFrame, DataFrame]:
    """(asset_id, sidecar_path, slot) of sidecars with one owner, and issues (kind, asset_id, path, slot).

    A sidecar belongs to an asset whose path without its extension (``naming`` stem), whole path
    (full_name), or either (both) it continues.
    """
    stems = {"stem": [without_extension(F.col("primary_path"))], "full_name": [F.col("primary_path")]}
    stems["both"] = stems["stem"] + stems["full_name"]
    ext = F.explode(F.array(*map(F.lit, extensions)))
    keyed = primaries.select("asset_id", "primary_path", ext.alias("slot"))
    keys = keyed.select("asset_id", "slot", F.explode(F.array(*[F.concat(x, F.lit("."), "slot") for x in stems[naming]])).alias("sidecar_path")).distinct()
    s = sidecars.select("sidecar_path").distinct()
    owned = s.join(keys, "sidecar_path", "left").groupBy("sidecar_path").agg(F.collect_set("asset_id").alias("owners"))
    slot = extension(file_name(F.col("sidecar_path")))
    attached = owned.where(F.size("owners") == 1).select(F.col("owners")[0].alias("asset_id"), "sidecar_path", slot.alias("slot"))
    issue = lambda kind, df, asset, path, slot_: df.select(F.lit(kind).alias("kind"), asset.alias("asset_id"), path.alias("path"), slot_.alias("slot"))
    none = F.lit(None).cast("string")
    issues = issue("orphan", owned.where(F.size("owners") == 0), none, F.col("sidecar_path"), slot)
    issues = issues.union(issue("ambiguous_owner", owned.where(F.size("owners") > 1), F.array_join(F.array_sort("owners"), ","), F.col("sidecar_path"), slot))
    many = attached.groupBy("asset_id", "slot").agg(F.count("*").alias("n"), F.min("sidecar_path").alias("sidecar_path")).where("n > 1")
    issues = issues.union(issue("multiple_for_slot", many, F.col("asset_id").cast("string"), F.col("sidecar_path"), F.col("slot")))
    for r in required:
        lack = primaries.join(attached.where(F.col("slot") == r).select("asset_id"), "asset_id", "left_anti")
        issues = issues.union(issue("missing_required", lack, F.col("asset_id").cast("string"), F.col("primary_path"), F.lit(r)))
    return attached, issues


def sidecar_conflicts(members: DataFrame) -> DataFrame:
    """G15 on (group_id, asset_id, slot, digest), slot null for an asset without: slots that some members lack, or of several contents."""
    n = members.groupBy("group_id").agg(F.count_distinct("asset_id").alias("members"))
    s = members.where("slot is not null").groupBy("group_id", "slot").agg(F.count_distinct("asset_id").alias("have"), F.count_distinct("digest").alias("contents"))
    kind = F.when(F.col("contents") > 1, "content_mismatch").when(F.col("have") < F.col("members"), "presence_mismatch")
    return s.join(n, "group_id").select("group_id", "slot", kind.alias("kind"), "have", "members", "contents").where("kind is not null")


def _unit_ids(batches):
    """(cluster_id, unit_id) of rows (cluster_id, asset_id) in their order, each once: unit_id() with members hashed as they come, so a cluster is never held as a whole."""
    at, first, sha, open_ = None, None, None, False

    def told():
        return hashlib.sha256(f"{UNIT}\0{first}".encode()).hexdigest() if sha is None else f"{UNIT}:{sha.hexdigest()}"

    for batch in batches:
        out = []
        for cluster, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lambda r: r[0]):
            members = [m for _, m in rows]
            if not open_ or cluster != at:
                if open_:
                    out.append((at, told()))
                at, first, sha, open_ = cluster, members.pop(0), None, True
            if members:
                if sha is None:
                    sha = hashlib.sha256(f"{UNIT}\0\0{first}".encode())
                sha.update(("\0" + "\0".join(members)).encode())
        yield _told(out, batch.schema)
    if open_:
        yield _told([(at, told())], batch.schema)


def _told(ids: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in ids], schema.field(0).type), pa.array([u for _, u in ids], pa.string())], names=["cluster_id", "unit_id"])


def units(assets: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit_id, asset_id) of clusters and single assets, and issues: unknown members, overlaps, clusters of one.

    A cluster's id is made once, by one task that reads its sorted members, and joined with them.
    """
    known = clusters.join(assets.select("asset_id"), "asset_id", "left_semi").select("cluster_id", "asset_id")
    members = known.repartition("cluster_id").distinct()
    types = dict(clusters.dtypes)
    ids = members.sortWithinPartitions("cluster_id", "asset_id").select("cluster_id", F.col("asset_id").cast("string")).mapInArrow(tidy(_unit_ids), f"cluster_id {types['cluster_id']}, unit_id string").withColumnRenamed("cluster_id", "_c")
    single = assets.join(known.select("asset_id"), "asset_id", "left_anti").select(unit_id(F.array("asset_id")).alias("unit_id"), "asset_id")
    made = members.join(ids, F.col("cluster_id").eqNullSafe(F.col("_c"))).select("unit_id", "asset_id").union(single)
    issue = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("x").cast("string").alias("id"))
    issues = issue("unknown_member", clusters.join(assets.select("asset_id"), "asset_id", "left_anti").select(F.col("asset_id").alias("x")))
    issues = issues.union(issue("overlap", clusters.groupBy("asset_id").agg(F.count_distinct("cluster_id").alias("n")).where("n > 1").select(F.col("asset_id").alias("x"))))
    return made, issues.union(issue("incomplete", clusters.groupBy("cluster_id").agg(F.count_distinct("asset_id").alias("n")).where("n < 2").select(F.col("cluster_id").alias("x"))))


def quality(assets: DataFrame, rules: list[tuple[str, float, bool]]) -> DataFrame:
    """``quality``: the weighted sum of metrics (column, weight, lower is better) scaled to 0 .. 1; a half where all are equal, 0 where missing."""
    low_high = assets.agg(*[f(m).alias(f"{f.__name__}_{m}") for m, _, _ in rules for f in (F.min, F.max)])
    df = assets.join(F.broadcast(low_high))
    total = F.lit(0.0)
    for m, weight, lower in rules:
        lo, hi = F.col(f"min_{m}"), F.col(f"max_{m}")
        part = F.when(lo == hi, 0.5).otherwise((F.col(m) - lo) / (hi - lo))
        total = total + F.coalesce((1 - part if lower else part) * weight, F.lit(0.0))
    return df.withColumn("quality", total).drop(*low_high.columns)


def select_top(assets: DataFrame, rules: list[tuple[str, float, bool]], most: int, eligible: Column | None = None, forced: Column | None = None) -> DataFrame:
    """G12 without diversity: forced assets, then the best eligible ones up to ``most`` in all; a status for each asset."""
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    keep = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    df = quality(assets, rules).withColumn("forced", keep).withColumn("eligible", ok & ~keep)
    slots = max(0, most - df.where("forced").count())
    top = df.where("eligible").orderBy(F.col("quality").desc(), "asset_id").limit(slots).select("asset_id", F.lit(True).alias("_t"))
    status = F.when(F.col("forced") | F.col("_t"), "selected").when(~F.col("eligible"), "ineligible").otherwise("not_selected")
    return df.join(top, "asset_id", "left").withColumn("status", status).drop("_t", "eligible")


def greedy_diverse(ids: list, score: list[float], near: dict, weight: float, slots: int, chosen: list) -> list[tuple]:
    """(id, diversity, marginal) in the order of selection: the best of quality and weighted distance to what is selected; a pair without distance has none."""
    left = {i: s for i, s in zip(ids, score, strict=True)}
    first = not chosen
    far = {i: (min((near.get((min(i, c), max(i, c)), 0.0) for c in chosen), default=0.0)) for i in left}
    out = []
    while left and len(out) < slots:
        best = min(left, key=lambda i: (-(left[i] + weight * far[i]), -left[i], i))
        out.append((best, far[best], left.pop(best) + weight * far[best]))
        for i in left:
            d = near.get((min(i, best), max(i, best)), 0.0)
            far[i] = d if first else min(far[i], d)
        first = False
    return out


def _diverse_steps(df: DataFrame, distances: DataFrame, weight: float, slots: int) -> DataFrame:
    """greedy_diverse() of assets (asset_id, quality) in a job for each step; of the distances, only those to the asset just chosen are read out, and nothing but the chosen assets goes to the driver."""
    left = materialize(df.withColumn("far", F.lit(0.0)), "left", small=True)
    marginal = F.col("quality") + F.lit(weight) * F.col("far")
    out = []
    while len(out) < slots:
        best = left.agg(F.min(F.struct((-marginal).alias("m"), (-F.col("quality")).alias("q"), "asset_id", "quality", "far")).alias("b")).first()["b"]
        if best is None:
            break
        out.append((best.asset_id, len(out), best.quality, best.far, -best.m))
        if len(out) == slots:
            break
        ends = [distances.where(F.col(x) == best.asset_id).select(F.col(y).alias("asset_id"), "distance") for x, y in (("first_id", "second_id"), ("second_id", "first_id"))]
        near = ends[0].union(ends[1]).groupBy("asset_id").agg(F.coalesce(F.min("distance"), F.lit(0.0)).alias("_d"))
        d = F.coalesce("_d", F.lit(0.0))
        rest = left.where(F.col("asset_id") != best.asset_id).join(near, "asset_id", "left").select("asset_id", "quality", (d if len(out) == 1 else F.least("far", d)).alias("far"))
        after = materialize(rest, "left", small=True)
        discard(left)
        left = after
    discard(left)
    return df.sparkSession.createDataFrame(out, "asset_id long, step int, quality double, diversity double, marginal double")


def select_diverse(assets: DataFrame, distances: DataFrame, rules: list[tuple[str, float, bool]], most: int, weight: float) -> DataFrame:
    """G12 with diversity: (asset_id, step, quality, diversity, marginal) of the selected assets.

    Each step depends on all before it: up to MOST_DIVERSE assets and MOST_DISTANCES distances are
    one task's work, more are selected step by step over all tasks.
    """
    df = quality(assets, rules).select("asset_id", "quality")
    if df.limit(MOST_DIVERSE + 1).count() > MOST_DIVERSE or distances.limit(MOST_DISTANCES + 1).count() > MOST_DISTANCES:
        return _diverse_steps(df, distances, weight, most)
    rows = df.select("asset_id", "quality", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("distance"), F.lit(0).alias("one"))
    edges = distances.select(F.least("first_id", "second_id").alias("asset_id"), F.lit(None).cast("double").alias("quality"), F.greatest("first_id", "second_id").alias("other"), "distance", F.lit(0).alias("one"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, e = pdf[pdf.other.isna()].sort_values("asset_id"), pdf[pdf.other.notna()]
        near = dict(zip(zip(e.asset_id.astype(int), e.other.astype(int), strict=True), e.distance, strict=True))
        got = greedy_diverse(a.asset_id.tolist(), a.quality.tolist(), near, weight, most, [])
        q = dict(zip(a.asset_id, a.quality, strict=True))
        return pd.DataFrame([(i, k, q[i], d, m) for k, (i, d, m) in enumerate(got)], columns=["asset_id", "step", "quality", "diversity", "marginal"])

    return rows.unionByName(edges).groupBy("one").applyInPandas(run, "asset_id long, step int, quality double, diversity double, marginal double")


def stable_split(clusters: DataFrame, weights: dict[str, float], seed: str = "", previous: DataFrame | None = None) -> DataFrame:
    """(cluster_id, split, reason) of clusters (cluster_id, member_id): the cluster's earlier split, else its members' (all or most), else by hash.

    ``previous`` has (cluster_id, member_id, split).
    """
    ids = clusters.select("cluster_id").distinct()
    hashed = split_of(F.col("cluster_id").cast("string"), seed, weights)
    if previous is None:
        return ids.select("cluster_id", hashed.alias("split"), F.lit("hash").alias("reason"))
    own = previous.groupBy("cluster_id").agg(F.min("split").alias("_own"))
    votes = clusters.join(previous.select("member_id", "split").distinct(), "member_id").groupBy("cluster_id", "split").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "split")
    most = votes.withColumn("_r", F.row_number().over(w)).withColumn("_k", F.count("*").over(Window.partitionBy("cluster_id"))).where("_r = 1").select("cluster_id", F.col("split").alias("_most"), "_k")
    df = ids.join(own, "cluster_id", "left").join(most, "cluster_id", "left")
    reason = F.when(F.col("_own").isNotNull(), "previous_cluster").when(F.col("_k") == 1, "previous_members").when(F.col("_k") > 1, "majority").otherwise("hash")
    return df.select("cluster_id", F.coalesce("_own", "_most", hashed).alias("split"), reason.alias("reason"))


def split_maps(assignments: DataFrame) -> DataFrame:
    """H12."""
    return assignments.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster_id", "split")))).alias("cluster_splits"))


def build_actions(members: DataFrame, destination: str) -> DataFrame:
    """An action for each member (cluster_id, asset_id, path, relation, keeper_id, split, immutable): the exact duplicate of a keeper goes to quarantine, any other moves to its split's folder."""
    target = F.concat(F.lit(destination.rstrip("/") + "/"), "split", F.lit("/"), file_name(F.col("path")))
    operation = F.when(F.col("immutable"), "skip").when((F.col("relation") == "verified_exact") & (F.col("asset_id") != F.col("keeper_id")), "quarantine").otherwise("move")
    df = members.withColumn("operation", operation).withColumn("destination", F.when(operation == "move", target))
    clash = df.where("destination is not null").groupBy("destination").agg(F.count("*").alias("n")).where("n > 1").select("destination", F.lit(True).alias("collision"))
    df = df.join(clash, "destination", "left").withColumn("collision", F.coalesce("collision", F.lit(False)))
    return df.withColumn("action_id", action_id(F.col("cluster_id").cast("string"), F.col("path"), F.col("operation")))


def prepare(assets: DataFrame, exact: DataFrame, visual: DataFrame, weights: dict[str, float], destination: str, seed: str = "", previous: DataFrame | None = None) -> DataFrame:
    """The actions of a dataset: assets (asset_id, path, quality, immutable) in clusters of exact and visual edges (first_id, second_id, relation), each cluster in one split.

    An asset without edges is a cluster of its own. A cluster's best asset, of equal ones the first
    by path, is its keeper; exact duplicates of it go to quarantine, all others to their split.
    """
    found = dataset_clusters(exact, visual).withColumnRenamed("member_id", "asset_id")
    clusters = assets.select("asset_id").join(found, "asset_id", "left").select("asset_id", F.coalesce("cluster_id", "asset_id").alias("cluster_id"), F.coalesce("relation", F.lit("single")).alias("relation"))
    members = materialize(assets.join(clusters, "asset_id"), "members")
    keepers = members.groupBy("cluster_id").agg(F.min_by("asset_id", F.struct(-F.col("quality"), "path", "asset_id")).alias("keeper_id"))
    splits = stable_split(members.select("cluster_id", F.col("asset_id").alias("member_id")), weights, seed, previous).select("cluster_id", "split")
    return build_actions(members.join(keepers, "cluster_id").join(splits, "cluster_id"), destination)
