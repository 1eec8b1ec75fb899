"""Similarity joins of fingerprints within a Hamming radius."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions.bits import hamming


def segments(bits: int, count: int) -> list[tuple[int, int]]:
    """(offset, width) of contiguous segments, the wider ones first."""
    wide, extra = divmod(bits, count)
    out, at = [], 0
    for k in range(count):
        width = wide + (k < extra)
        out.append((at, width))
        at += width
    return out


def keys(fingerprint: Column, bits: int, radius: int) -> Column:
    """One (segment, value) for each of radius + 1 segments: two fingerprints within the radius agree in one."""
    parts = [F.struct(F.lit(k).alias("seg"), F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1).cast("long")).alias("value")) for k, (at, w) in enumerate(segments(bits, radius + 1))]
    return F.array(*parts)


def near(left: DataFrame, right: DataFrame, bits: int, radius: int, within: Column) -> DataFrame:
    """Pairs of entries (lid, lbits) and (rid, rbits) within the radius, each once: by its first common segment.

    Radii must be below the number of bits: beyond it every pair passes, which is no search. The
    index is selective while segments are wide, as at the usual 8 of 64 bits.
    """
    if not 0 <= radius < bits:
        raise ValueError(f"a radius of {radius} in {bits} bits")
    l = left.withColumn("_k", F.explode(keys(F.col("lbits"), bits, radius))).select("*", "_k.seg", "_k.value").drop("_k")
    r = right.withColumn("_k", F.explode(keys(F.col("rbits"), bits, radius))).select("*", "_k.seg", "_k.value").drop("_k")
    both = l.join(r, ["seg", "value"]).where(within)
    earlier = F.lit(False)
    for k, (at, w) in enumerate(segments(bits, radius + 1)[:-1]):
        mask = F.lit((1 << w) - 1).cast("long")
        same = F.shiftrightunsigned(F.col("lbits").bitwiseXOR(F.col("rbits")), at).bitwiseAND(mask) == 0
        earlier = earlier | ((F.col("seg") > k) & same)
    return both.where(~earlier).drop("seg", "value").withColumn("distance", hamming(F.col("lbits"), F.col("rbits"))).where(F.col("distance") <= radius)


def hamming_pairs(entries: DataFrame, radius: int = 8, bits: int = 64) -> DataFrame:
    """(first_id, second_id, distance) of all pairs of (id, fingerprint) within the radius, exactly.

    Equal fingerprints are joined once as a class and classes expanded at the end, so a hot value
    costs its pairs alone, not the pairs of every segment.
    """
    e = entries.select(F.col("id"), F.col("fingerprint")).where("fingerprint is not null")
    classes = e.groupBy("fingerprint").agg(F.count("*").alias("n"))
    side = lambda k: classes.select(F.col("fingerprint").alias(f"{k}bits"))
    pairs = near(side("l"), side("r"), bits, radius, F.col("lbits") < F.col("rbits")).union(classes.where("n > 1").select("fingerprint", "fingerprint", F.lit(0)))
    a = e.select(F.col("id").alias("_a"), F.col("fingerprint").alias("lbits"))
    b = e.select(F.col("id").alias("_b"), F.col("fingerprint").alias("rbits"))
    out = pairs.join(a, "lbits").join(b, "rbits").where((F.col("lbits") != F.col("rbits")) | (F.col("_a") < F.col("_b")))
    return out.select(F.least("_a", "_b").alias("first_id"), F.greatest("_a", "_b").alias("second_id"), F.col("distance").cast("int").alias("distance"))


def guarded(pairs: DataFrame, most: int) -> DataFrame:
    """All pairs, or an error where there are more than ``most``."""
    if pairs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} pairs")
    return pairs


def limited(pairs: DataFrame, most: int, order: list) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` in order, and a receipt that says whether that was all."""
    n = pairs.count()
    receipt = pairs.sparkSession.createDataFrame([(n, min(n, most), n > most, n <= most)], "candidates long, kept long, limit_reached boolean, complete boolean")
    return pairs.orderBy(*order).limit(most), receipt


def query(entries: DataFrame, probes: DataFrame, radius: int = 8, bits: int = 64) -> DataFrame:
    """(probe_id, id, distance) within the radius of each probe (probe_id, fingerprint), itself excluded."""
    l = probes.select("probe_id", F.col("fingerprint").alias("lbits"))
    r = entries.select("id", F.col("fingerprint").alias("rbits"))
    return near(l, r, bits, radius, F.col("probe_id") != F.col("id")).select("probe_id", "id", F.col("distance").cast("int").alias("distance"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """Each entry's k nearest others."""
    both = pairs.select(F.col("first_id").alias("id"), F.col("second_id").alias("other_id"), "distance").union(pairs.select("second_id", "first_id", "distance"))
    w = Window.partitionBy("id").orderBy("distance", "other_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def add(index: DataFrame, more: DataFrame) -> DataFrame:
    """Later entries take the place of earlier ones with their id."""
    return index.join(more.select("id"), "id", "left_anti").unionByName(more)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids, "id", "left_anti")


def reduction(pairs: DataFrame, indexed: int) -> DataFrame:
    """H8: candidates against all possible pairs."""
    possible = indexed * (indexed - 1) // 2
    return pairs.agg(F.lit(indexed).alias("indexed"), F.lit(possible).alias("possible"), F.count("*").alias("candidates"), F.round(1 - F.count("*") / F.lit(max(possible, 1)), 6).alias("reduction_ratio"))
