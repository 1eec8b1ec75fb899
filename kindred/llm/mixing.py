"""Temperature mixing of sources, realised as budgeted block permutations."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from kindred.operators.hot import join_groups, running_sums
from kindred.shared import discard, materialize

#: Documents of a block, about.
BLOCK_DOCS = 256
#: Decisions about at most so many blocks are sent to all executors (under 40 MB); about more, joined by a shuffle.
SEND = 500_000
#: The plan of at most so many sources is sent to all executors (under 40 MB); of more, that of the largest ones only.
SEND_SOURCES = 200_000
#: A word, of which tokens are counted.
WORD = r"[^\x20\x09-\x0D]+"


def weights(tokens: dict, exponent: float, times: dict | None = None) -> dict:
    """Normalised powers of the sources' token shares; sources without tokens weigh nothing. A key stands for ``times`` equal sources."""
    top = max(tokens.values(), default=0)
    raw = {s: (n / top) ** exponent if n else 0.0 for s, n in tokens.items()}
    total = math.fsum(x * (times[s] if times else 1) for s, x in raw.items()) or 1.0
    return {s: x / total for s, x in raw.items()}


def epochs(tokens: dict, w: dict, budget: float | None) -> dict:
    """How often each source is read for a budget of tokens; without one, the least often read source is read once."""
    rate = {s: w[s] / n for s, n in tokens.items() if n}
    budget = budget if budget is not None else 1.0 / min(rate.values(), default=1.0)
    return {s: rate.get(s, 0.0) * budget if n else 1.0 for s, n in tokens.items()}


def entropy(w: dict, times: dict | None = None) -> float:
    return -math.fsum(x * math.log(x) * (times[s] if times else 1) for s, x in w.items() if x > 0)


def bisect_exponent(tokens: dict, repetition_limit: float | None, target_entropy: float | None, budget: float | None, steps: int = 60, times: dict | None = None) -> float:
    """The exponent in 0 .. 1 whose weights reach the target entropy, or else the smallest that reads no source more often than the limit.

    Entropy falls and the largest repetition falls as the exponent grows, so bisection finds both.
    Where even the end of the range misses the target, that end is returned.
    """
    if target_entropy is not None:
        fine = lambda a: entropy(weights(tokens, a, times), times) <= target_entropy
    else:
        fine = lambda a: max(epochs(tokens, weights(tokens, a, times), budget).values(), default=0.0) <= (repetition_limit or 1.0)
    low, high = 0.0, 1.0
    if fine(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fine(mid) else (mid, high)
    return high


def mix(docs: DataFrame, repetition_limit: float | None = 1.25, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """(row, source, n_tokens, block, weight, epoch, block_order, place): each row of ``docs`` (doc_id, text, source, any more columns) as often as the mixture reads it.

    Tokens are words. Source shares are raised to the bisected exponent and normalised to weights;
    a source's budget is its weight times ``budget_tokens``, by default so many that every document
    is read at least once. A source is read whole as often as its budget allows; the rest of the
    budget goes to a permutation of its blocks (hash groups of about BLOCK_DOCS documents) up to
    the block that no longer fits, of which documents follow in a permutation while they fit. So a
    source misses its budget by less than its longest document.

    ``epoch`` counts a row's readings from 0, ``block_order`` and ``place`` permute blocks and rows
    in them: rows sorted by these three are the mixture. Null texts and texts without words have
    no tokens and are kept once a whole reading; a null source is "". Rows that repeat a doc_id are
    read each; those that repeat its text as well stand at one place. An empty table gives no rows.

    Only the different numbers of tokens that sources have go to the driver: at most about the
    square root of twice all tokens, however many sources there are.
    """
    spark = docs.sparkSession
    tag = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64("doc_id", "text").alias("key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
    counted = materialize(tag.select("source", "key", "n_tokens"), "counts")
    totals = materialize(counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "sources", small=True)
    times = {r.n: r.times for r in totals.groupBy("n").agg(F.count("*").alias("times")).collect()}
    tokens = {n: n for n in times}
    w = weights(tokens, bisect_exponent(tokens, repetition_limit, target_entropy, budget_tokens, times=times), times)
    often = epochs(tokens, w, budget_tokens)
    whole = {n: math.floor(often[n] + 1e-9) for n in tokens}
    rates = spark.createDataFrame([(n, w[n], whole[n], max(0.0, often[n] - whole[n]) * n) for n in tokens], "n long, weight double, whole int, rest double")
    plan = totals.join(F.broadcast(rates) if len(tokens) <= SEND else rates, "n").select("source", "docs", "weight", "whole", "rest", F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"))
    plan = materialize(plan, "plan", small=True)
    n_sources, n_docs = plan.count(), counted.count()

    def planned(df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(plan), "source") if n_sources <= SEND_SOURCES else join_groups(df, plan, ["source"], "docs", n_docs, "inner")
        return out.drop("docs").withColumn("block", F.pmod("key", "blocks"))

    blocked = planned(counted)
    order = F.xxhash64("source", "block", F.lit(seed))
    each = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")).withColumn("order", order)
    # Sums over a source's blocks run in 1024 spans of their order.
    summed = running_sums(each, {"ahead": "n"}, ["order", "block"], F.shiftright("order", 54), ("source",))
    chosen = summed.where(F.col("ahead") < F.col("rest"))
    chosen = materialize(chosen.select("source", "block", (F.col("ahead") + F.col("n") <= F.col("rest")).alias("full"), (F.col("rest") - F.col("ahead")).alias("room")), "blocks")
    # One last block for each source, cut within.
    last = chosen.where("not full").select("source", "block", "room")
    last = F.broadcast(last) if n_sources <= SEND_SOURCES else last
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("key", F.lit(seed)), "key").rowsBetween(Window.unboundedPreceding, 0)
    some = blocked.join(last, ["source", "block"]).groupBy("source", "block", "key", "room").agg(F.sum("n_tokens").alias("n"))
    some = some.withColumn("upto", F.sum("n").over(inside)).where("upto <= room").select("source", "block", F.col("key").alias("only"))
    picks = materialize(chosen.where("full").select("source", "block", F.lit(None).cast("long").alias("only")).union(some), "picks")
    n_picks = picks.count()
    discard(counted, chosen)
    picks = picks.groupBy("source", "block").agg(F.max(F.col("only").isNull()).alias("all"), F.collect_set("only").alias("some"))
    picks = F.broadcast(picks) if n_picks <= SEND else picks
    out = planned(tag).join(picks, ["source", "block"], "left")
    again = F.coalesce(F.col("all") | F.array_contains("some", F.col("key")), F.lit(False))
    out = out.withColumn("times", F.col("whole") + again.cast("int")).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return out.select("row", "source", "n_tokens", "block", "weight", "epoch", F.xxhash64("source", "block", "epoch", F.lit(seed)).alias("block_order"), F.xxhash64("key", "epoch", F.lit(seed)).alias("place"))
