"""Candidates, matches and evidence of pictures by their features."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions.bits import block_percentage, block_similarity, dimensions_compatible, hamming, histogram_distance
from kindred.operators.hamming import limited, near
from kindred.shared import materialize

#: Limits of a distance where both must be passed to rule a pair out.
DHASH_LIMIT, HISTOGRAM_LIMIT = 12, 0.25


def entries(pictures: DataFrame, turned: bool = False, crops: bool = False) -> DataFrame:
    """(id, kind, orientation, phash, dhash): the whole picture, in all orientations where ``turned``, and its crops."""
    sides = F.arrays_zip(F.col("phashes").alias("phash"), F.col("dhashes").alias("dhash"))
    whole = pictures.select("id", F.lit("whole").alias("kind"), F.posexplode(sides if turned else F.slice(sides, 1, 1)).alias("orientation", "e")).select("id", "kind", "orientation", "e.phash", "e.dhash")
    if not crops:
        return whole
    return whole.union(pictures.select("id", F.explode("tiles").alias("t")).select("id", "t.kind", F.lit(0), "t.phash", "t.dhash"))


def candidates(pictures: DataFrame, targets: DataFrame | None = None, radius: int = 8, dhash_limit: int = DHASH_LIMIT, histogram_limit: float = HISTOGRAM_LIMIT, scaled: bool = False, rotated: bool = False, crops: bool = False, references: bool = True) -> DataFrame:
    """Pairs (first_id, second_id) and how they came near: distances, orientation, kinds and rank.

    Of pictures (id, phashes, dhashes, histogram, dimensions, is_ref, tiles) any orientation of the
    first is held against the plain second, or, with ``targets``, each picture against all targets
    but itself. Incompatible dimensions rule a pair out unless a crop is part of it; dHash and
    histogram do where both are beyond their limits; two references do unless ``references``. A
    pair is told by its nearest entries: least sum of distances, whole pictures before crops.
    """
    other = pictures if targets is None else targets
    l = entries(pictures, rotated, crops).select(F.col("id").alias("first_id"), F.col("kind").alias("first_kind"), "orientation", F.col("phash").alias("lbits"), F.col("dhash").alias("ldhash"))
    r = entries(other, False, crops).select(F.col("id").alias("second_id"), F.col("kind").alias("second_kind"), F.col("phash").alias("rbits"), F.col("dhash").alias("rdhash"))
    within = F.col("first_id") < F.col("second_id") if targets is None else F.col("first_id") != F.col("second_id")
    found = near(l, r, 64, radius, within)
    side = lambda df, k: df.select(F.col("id").alias(f"{k}_id"), F.col("histogram").alias(f"{k}_h"), F.col("dimensions").alias(f"{k}_d"), F.col("is_ref").alias(f"{k}_ref"))
    found = found.join(side(pictures, "first"), "first_id").join(side(other, "second"), "second_id")
    crop = (F.col("first_kind") != "whole") | (F.col("second_kind") != "whole")
    found = found.where(crop | dimensions_compatible(F.col("first_d"), F.col("second_d"), scaled, rotated))
    if not references:
        found = found.where(~(F.col("first_ref") & F.col("second_ref")))
    found = found.withColumn("dhash_distance", hamming(F.col("ldhash"), F.col("rdhash"))).withColumn("histogram_distance", histogram_distance(F.col("first_h"), F.col("second_h")))
    found = found.where((F.col("dhash_distance") <= dhash_limit) | (F.col("histogram_distance") <= histogram_limit))
    rank = F.col("distance") / 64 + F.col("dhash_distance") / 64 + F.col("histogram_distance")
    best = F.min(F.struct(rank.alias("rank"), crop.alias("crop"), F.col("distance").alias("phash_distance"), "dhash_distance", "histogram_distance", "orientation", "first_kind", "second_kind")).alias("b")
    return found.groupBy("first_id", "second_id").agg(best).select("first_id", "second_id", "b.*")


def candidate_order() -> list[Column]:
    """A query's candidates, nearest first, whole pictures before crops."""
    return [F.col(c) for c in ("rank", "crop", "phash_distance", "dhash_distance", "histogram_distance", "second_id")]


def evidence_order() -> list[Column]:
    """Pairs in order of ids, relation and score."""
    return [F.col("first_id"), F.col("second_id"), F.col("relation"), F.col("score")]


def _with_blocks(pairs: DataFrame, pictures: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    side = lambda df, k: df.select(F.col("id").alias(f"{k}_id"), F.col("blocks").alias(f"{k}_blocks"), F.col("dimensions").alias(f"{k}_dimensions"))
    return pairs.join(side(pictures, "first"), "first_id").join(side(pictures if targets is None else targets, "second"), "second_id")


def matches(pictures: DataFrame, threshold: int, scaled: bool = False, rotated: bool = False, radius: int = 8, most_candidates: int | None = None, most_matches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(first_id, second_id, percentage) of pictures that share enough of their blocks, and a receipt of what limits left out.

    Candidates are D14's; the blocks of the first, in any orientation where ``rotated``, are held
    against the plain second's. Without limits, which are the caller's, all is kept; with them the
    first in order of ids, and the receipt (stage, candidates, kept, limit_reached, complete) says so.
    """
    found = materialize(candidates(pictures, None, radius, scaled=scaled, rotated=rotated, references=False), "candidates")
    n = found.count()
    kept, first = limited(found, n if most_candidates is None else most_candidates, ["first_id", *candidate_order()])
    turned = F.col("first_blocks") if rotated else F.slice("first_blocks", 1, 1)
    rated = _with_blocks(kept.select("first_id", "second_id"), pictures).select("first_id", "second_id", block_percentage(turned, F.get("second_blocks", F.lit(0)), threshold).alias("percentage")).where("percentage is not null")
    rated = materialize(rated, "matches")
    n = rated.count()
    out, second = limited(rated, n if most_matches is None else most_matches, ["first_id", "second_id"])
    receipt = first.select(F.lit("candidates").alias("stage"), "*").union(second.select(F.lit("matches"), "*"))
    return out, receipt


def relation(first_kind: Column, second_kind: Column, orientation: Column, block_orientation: Column, same_dimensions: Column, block: Column, phash: Column, dhash: Column, histogram: Column, threshold: int = 95) -> Column:
    """(relation, score): crop, transformed, similar or related; the score is the better of blocks and fingerprints."""
    crop = (first_kind != "whole") | (second_kind != "whole")
    transformed = (orientation != 0) | (block_orientation != 0) | ~same_dimensions
    prints = F.greatest(F.lit(0.0), 1 - (phash / 64 * 0.5 + dhash / 64 * 0.35 + histogram * 0.15))
    kind = F.when(crop, "crop_candidate").when(transformed, "transformed").when(block >= threshold, "similar").otherwise("related")
    return F.struct(kind.alias("relation"), F.bround(F.greatest(block / 100, prints), 6).alias("score"))


def evidence(pictures: DataFrame, targets: DataFrame | None = None, threshold: int = 95, related: bool = False, **how) -> DataFrame:
    """The evidence of every candidate pair: relation, score, similarity of blocks, distances and kinds; mere relations only where asked for."""
    pairs = _with_blocks(candidates(pictures, targets, **how), pictures, targets)
    turned = F.col("first_blocks") if how.get("rotated") else F.slice("first_blocks", 1, 1)
    pairs = pairs.withColumn("b", block_similarity(turned, F.get("second_blocks", F.lit(0))))
    same = (F.col("first_dimensions.w") == F.col("second_dimensions.w")) & (F.col("first_dimensions.h") == F.col("second_dimensions.h"))
    found = relation(F.col("first_kind"), F.col("second_kind"), F.col("orientation"), F.col("b.orientation"), same, F.col("b.similarity"), F.col("phash_distance"), F.col("dhash_distance"), F.col("histogram_distance"), threshold)
    out = pairs.withColumn("r", found).select("first_id", "second_id", "r.relation", "r.score", F.col("b.similarity").alias("block_similarity"), "phash_distance", "dhash_distance", "histogram_distance", "first_kind", "second_kind", "orientation", F.col("b.orientation").alias("block_orientation"))
    return out if related else out.where("relation <> 'related'")


def best_per_target(found: DataFrame) -> DataFrame:
    """The best evidence of each target (target_id, score, block_similarity, path), in order of score, blocks and path."""
    order = [F.col("score").desc(), F.col("block_similarity").desc(), F.lower("path")]
    first = F.row_number().over(Window.partitionBy("target_id").orderBy(*order))
    return found.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(*order)
