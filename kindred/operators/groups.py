"""Groups of matches: greedy cliques, components, clusters."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kindred.operators.components import connected_components
from kindred.shared import materialize

#: Matches of one component, beyond which grouping fails: a component is one task's work.
MOST_IN_COMPONENT = 1_000_000


def greedy_cliques(edges: list[tuple[int, int, int]]) -> list[list[int]]:
    """G1 on (first, second, percentage): groups of members that all match each other, best matches first.

    A file is claimed by the first group that sees it, and becomes a member once it has matches
    with all members; matches between claimed files of two groups are void. Matches of which
    neither file became a member anywhere are grouped again.
    """
    groups: list[list[int]] = []
    left = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    while left:
        claimed: dict[int, int] = {}
        made: list[list[int]] = []
        seen: list[dict[int, set]] = []
        for a, b, _ in left:
            ga, gb = claimed.get(a), claimed.get(b)
            if ga is None and gb is None:
                ga = gb = len(made)
                made.append([])
                seen.append({})
            elif ga is None or gb is None:
                ga = gb = ga if gb is None else gb
            elif ga != gb:
                continue
            claimed[a] = claimed[b] = ga
            members, near = made[ga], seen[ga]
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            for x in (a, b):
                if x not in members and near[x].issuperset(members):
                    members.append(x)
        made = [m for m in made if len(m) > 1]
        groups += made
        taken = {x for m in made for x in m}
        rest = [e for e in left if e[0] not in taken and e[1] not in taken]
        if not made or len(rest) == len(left):
            break
        left = rest
    return groups


def clique_groups(matches: DataFrame, most: int = MOST_IN_COMPONENT) -> DataFrame:
    """G1: (group_id, member_id, rank) of matches (first_id, second_id, percentage), ties by ids.

    Exact per connected component, as no group spans two; a component of more than ``most`` matches
    raises before any work, as the greedy order is sequential.
    """
    edges = materialize(matches.select(F.least("first_id", "second_id").alias("first_id"), F.greatest("first_id", "second_id").alias("second_id"), "percentage").groupBy("first_id", "second_id").agg(F.max("percentage").alias("percentage")), "matches")
    parts = edges.join(connected_components(edges).withColumnRenamed("member_id", "first_id"), "first_id")
    parts = materialize(parts, "parts")
    largest = parts.groupBy("component_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a component has {largest} matches; at most {most}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for members in greedy_cliques(list(zip(pdf.first_id.tolist(), pdf.second_id.tolist(), pdf.percentage.tolist(), strict=True))):
            rows += [(min(members), m, k) for k, m in enumerate(members)]
        return pd.DataFrame(rows, columns=["group_id", "member_id", "rank"])

    return parts.groupBy("component_id").applyInPandas(run, "group_id long, member_id long, rank int")


def group_percentage(groups: DataFrame, matches: DataFrame) -> DataFrame:
    """Whole mean of the matches between each group's reference (rank 0) and its other members."""
    ref = groups.where("rank = 0").select("group_id", F.col("member_id").alias("ref_id"))
    other = groups.where("rank > 0").join(ref, "group_id")
    m = matches.select(F.least("first_id", "second_id").alias("lo"), F.greatest("first_id", "second_id").alias("hi"), "percentage")
    return other.withColumn("lo", F.least("member_id", "ref_id")).withColumn("hi", F.greatest("member_id", "ref_id")).join(m, ["lo", "hi"]).groupBy("group_id").agg(F.floor(F.sum("percentage") / F.count("*")).cast("int").alias("percentage"))


def match_of(groups: DataFrame, matches: DataFrame) -> DataFrame:
    """Each member's match with its group's reference."""
    ref = groups.where("rank = 0").select("group_id", F.col("member_id").alias("ref_id"))
    rows = groups.where("rank > 0").join(ref, "group_id").withColumn("first_id", F.least("member_id", "ref_id")).withColumn("second_id", F.greatest("member_id", "ref_id"))
    return rows.join(matches, ["first_id", "second_id"], "left").select("group_id", "member_id", "percentage")


def component_groups(relations: DataFrame) -> DataFrame:
    """(group_id, component_id, members) of relations (first_id, second_id); the id is a digest of the members."""
    c = connected_components(relations)
    members = c.groupBy("component_id").agg(F.array_sort(F.collect_list("member_id")).alias("members"))
    return members.select(F.sha2(F.to_json(F.struct("members")).cast("binary"), 256).alias("group_id"), "component_id", "members")


def dataset_clusters(exact: DataFrame, visual: DataFrame) -> DataFrame:
    """(cluster_id, member_id, relation): components over exact and visual edges.

    Exact where one exact class is the whole cluster and no visual edge crosses classes; else the
    weakest relation of crossing edges: related, transformed, near.
    """
    classes = connected_components(exact).withColumnRenamed("component_id", "class_id")
    both = exact.select("first_id", "second_id").union(visual.select("first_id", "second_id"))
    c = materialize(connected_components(both), "clusters").withColumnRenamed("component_id", "cluster_id")
    side = lambda k: c.join(classes, "member_id", "left").select(F.col("member_id").alias(f"{k}_id"), "cluster_id" if k == "first" else F.col("cluster_id").alias("_c"), F.coalesce("class_id", F.col("member_id")).alias(f"_{k}"))
    crossing = visual.join(side("first"), "first_id").join(side("second"), "second_id").where("_first <> _second")
    kinds = crossing.groupBy("cluster_id").agg(F.max(F.when(F.col("relation") == "related", 3).when(F.col("relation") == "transformed_variant", 2).otherwise(1)).alias("k"))
    n = c.join(classes, "member_id", "left").groupBy("cluster_id").agg(F.count_distinct(F.coalesce("class_id", F.col("member_id"))).alias("classes"))
    relation = F.when(F.col("k").isNull() & (F.col("classes") == 1), "verified_exact").when(F.col("k") == 3, "related").when(F.col("k") == 2, "transformed_variant").otherwise("near_duplicate")
    return c.join(n, "cluster_id").join(kinds, "cluster_id", "left").select("cluster_id", "member_id", relation.alias("relation"))


def invariants(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each group (group_id, member_id): members, edges within it, and whether it is connected, a clique, a star."""
    m = groups.select("group_id", "member_id")
    inside = edges.select("first_id", "second_id").distinct().join(m.withColumnRenamed("member_id", "first_id"), "first_id").join(m.select(F.col("group_id").alias("_g"), F.col("member_id").alias("second_id")), "second_id").where("group_id = _g").select("group_id", "first_id", "second_id")
    inside = materialize(inside, "inside")
    n = m.groupBy("group_id").agg(F.count_distinct("member_id").alias("members"))
    e = inside.groupBy("group_id").agg(F.count("*").alias("edges"))
    ends = inside.select("group_id", F.explode(F.array("first_id", "second_id")).alias("member_id"))
    hub = ends.groupBy("group_id", "member_id").agg(F.count("*").alias("d")).groupBy("group_id").agg(F.max("d").alias("hub"), F.count("*").alias("touched"))
    # Ids made of group and member keep components apart where groups share members.
    ids = ends.distinct().withColumn("x", F.xxhash64("group_id", "member_id"))
    pairs = inside.select(F.xxhash64("group_id", "first_id").alias("first_id"), F.xxhash64("group_id", "second_id").alias("second_id"))
    parts = ids.join(connected_components(pairs).withColumnRenamed("member_id", "x"), "x").groupBy("group_id").agg(F.count_distinct("component_id").alias("parts"))
    out = n.join(e, "group_id", "left").join(hub, "group_id", "left").join(parts, "group_id", "left").na.fill(0)
    return out.select("group_id", "members", "edges", ((F.col("parts") == 1) & (F.col("touched") == F.col("members"))).alias("connected"), (F.col("edges") == F.col("members") * (F.col("members") - 1) / 2).alias("clique"), ((F.col("hub") == F.col("members") - 1) & (F.col("edges") == F.col("hub"))).alias("star"))


