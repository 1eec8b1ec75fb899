"""Joins of rows with what is known of their groups, and running sums, however large a group is."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.shared import materialize

#: Rows of a group that one window task ranks; larger groups are ranked by a sort of all their rows.
MOST_IN_WINDOW = 1_000_000
#: Groups of at least a thousandth of all rows are hot: there can be no more than so many of them.
PARTS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``groups`` on ``keys``, of which ``groups`` has one row each, with the number of its rows in ``size``.

    Hot groups are at most PARTS by their sizes, so they are broadcast and their rows stay where
    they are; the rest is shuffled, and no key of it has more than a PARTS-th of all rows. Null
    keys meet nothing. Where there are hot groups, ``rows`` is read twice; ``groups`` is read
    several times, so it should be a written table.
    """
    hot = groups.where(F.col(size) * PARTS >= total)
    if not hot.limit(1).count():
        return rows.join(groups, keys, how)
    cold = groups.where(F.col(size) * PARTS < total)
    return rows.join(F.broadcast(hot), keys, "inner").unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def running_sums(df: DataFrame, sums: dict[str, str], order: list[str], span: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each (name, column) of ``sums``, the sum of the column over the rows ahead in ``order``, apart for each ``by``.

    ``span`` ascends with the order: sums run within a span and over spans, so no window holds more
    rows than a span has or than there are spans.
    """
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_span", span)
    spans = rows.groupBy(*by, "_span").agg(*[F.sum(c).alias(f"_of_{k}") for k, c in sums.items()])
    over = ahead(Window.partitionBy(*by).orderBy("_span"))
    spans = spans.select(*by, "_span", *[F.coalesce(F.sum(f"_of_{k}").over(over), F.lit(0)).alias(f"_to_{k}") for k in sums])
    within = ahead(Window.partitionBy(*by, "_span").orderBy(*order))
    rows = rows.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()}).join(spans, [*by, "_span"])
    return rows.withColumns({k: F.col(k) + F.col(f"_to_{k}") for k in sums}).drop("_span", *[f"_to_{k}" for k in sums])


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of a sorted ``ordered`` with their places from 0: the rows of the partitions before, and of the partition's rows before.

    No window holds more rows than there are partitions.
    """
    rows = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    # The lower 33 bits of these ids count the rows of a partition.
    return rows.join(F.broadcast(parts), "_part").withColumn(name, F.col("_ahead") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_ahead")


def ranked(rows: DataFrame, by: str, order: list, name: str = "rank") -> DataFrame:
    """``rows`` with their places from 0 in the group ``by``, in an ``order`` that is a total one.

    Groups of up to MOST_IN_WINDOW rows are one window's work each; the rows of larger ones are
    sorted over all tasks, and places count from the group's first row.
    """
    window = (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).alias(name)
    hot = materialize(rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_IN_WINDOW).select(by), "hot", small=True)
    if not hot.limit(1).count():
        return rows.select("*", window)
    keys = F.broadcast(hot)  # at most a MOST_IN_WINDOW-th of all rows
    sorted_ = rows.join(keys, by, "left_semi").repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    placed = numbered(sorted_, "_at")
    first = placed.groupBy(by).agg(F.min("_at").alias("_first"))
    placed = placed.join(F.broadcast(first), by).withColumn(name, (F.col("_at") - F.col("_first")).cast("int")).drop("_at", "_first")
    return rows.join(keys, by, "left_anti").select("*", window).unionByName(placed)
