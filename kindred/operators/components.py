"""Connected components by alternating large-star and small-star steps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from kindred.shared import discard, materialize

#: Edges of at most so many are one task's work (under 100 MB); more are joined in rounds.
ONE_TASK = 500_000


def _roots(batches):
    """The whole of a few edges: every id with its component's smallest, by hooking and pointer jumping."""
    batches = list(batches)
    u, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) if batches else np.zeros(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], names=["member_id", "component_id"])


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges in the shared folder, and a signature that equal edge sets share, taken while they are written."""
    seen = Observation()
    out = materialize(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges", small=True)
    got = seen.get
    return out, (got["n"], got["h"])


def connected_components(edges: DataFrame, a: str = "first_id", b: str = "second_id", max_rounds: int = 60) -> DataFrame:
    """(member_id, component_id) for every id that an edge names; component_id is the component's smallest id.

    Edges never go to the driver. Up to ONE_TASK distinct ones are one task's work; more stay
    distributed, and each round writes its edges to the shared folder and ends the lineage; their
    number never grows. Self-loops and repeated edges are allowed, edges with a null end are
    dropped; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    pairs = edges.where(x.isNotNull() & y.isNotNull())
    loops = pairs.where(x == y).select(x.alias("member_id"), y.alias("component_id"))
    e, was = _written(pairs.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    if was[0] <= ONE_TASK:
        few = e.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_roots, "member_id long, component_id long")
        return few.union(loops).groupBy("member_id").agg(F.min("component_id").alias("component_id"))
    for _ in range(max_rounds):
        if not was[0]:
            break
        after, now = _written(_stars(e))
        discard(e)
        e = after
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("member_id"), F.col("v").alias("component_id"))
    return e.select(F.col("u").alias("member_id"), F.col("v").alias("component_id")).union(roots).union(loops).groupBy("member_id").agg(F.min("component_id").alias("component_id"))
