"""Reports, plans and their records."""

from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.digests import action_id
from kindred.functions.text import scalar_text
from kindred.operators.exact import exact_groups
from kindred.operators.hot import numbered
from kindred.operators.rank import choose_keepers

MOST_ACTIONS = 250_000
CHUNK = 40_000


def exact_report(files: DataFrame, least_size: int = 1) -> DataFrame:
    """M1: verified groups of files with keeper scores and ranks, one row a member."""
    sized = files.where(F.octet_length("content") >= least_size)
    members = exact_groups(sized).join(files.drop("content", "size", "digest"), "file_id")
    return choose_keepers(members)


def summary(report: DataFrame) -> DataFrame:
    """H7."""
    return report.agg(F.count_distinct("group_id").alias("groups"), F.count_if(F.col("rank") > 0).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("rank") > 0, F.col("size"))), F.lit(0)).alias("reclaimable"))


def plan_actions(report: DataFrame, complete: bool = True, operation: str = "quarantine") -> DataFrame:
    """M3, M9: an action for each member but the reference, in order of group, path and id; none from an incomplete scan."""
    if not complete:
        raise ValueError("an incomplete scan makes no plan")
    ref = report.where("rank = 0").select("group_id", F.col("path").alias("reference"))
    acts = report.where("rank > 0").join(ref, "group_id").select(action_id(F.col("group_id"), F.col("path"), F.lit(operation)).alias("action_id"), "group_id", F.lit(operation).alias("operation"), F.col("path").alias("target"), "reference", "digest")
    return acts


def checked_plan(actions: DataFrame, most: int = MOST_ACTIONS) -> DataFrame:
    if actions.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} actions")
    return actions.orderBy("group_id", "target", "action_id")


def query_report(report: DataFrame, group_id: str | None = None, path: str | None = None, digest: str | None = None) -> DataFrame:
    """Whole groups of an id, with a member of a path and a member of a digest."""
    df = report
    for column, value in (("group_id", group_id), ("path", path), ("digest", digest)):
        if value is not None:
            df = df.join(report.where(F.col(column) == value).select("group_id").distinct(), "group_id", "left_semi")
    return df


def doctor(spark) -> DataFrame:
    """M6: what this installation has."""
    import importlib.util

    rows = [(m, importlib.util.find_spec(m) is not None) for m in ("numpy", "pandas", "pyarrow", "PIL", "xxhash")]
    return spark.createDataFrame(rows, "capability string, available boolean")


def csv_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    text = scalar_text(c.cast("string"))
    return F.when(text.rlike(r"^[ \t\r\n]*[=+\-@]|^[\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(members: DataFrame, columns: list[str]) -> DataFrame:
    """The cells of an export, groups numbered in order."""
    order = numbered(members.select("group_id").distinct().orderBy("group_id"), "Group ID").withColumn("Group ID", F.col("Group ID").cast("int"))
    return members.join(order, "group_id").select("Group ID", *[csv_cell(F.col(c)).alias(c) for c in columns])


def html_rows(members: DataFrame, columns: list[str]) -> DataFrame:
    """A table row for each member, indented but for the first of each group."""
    escape = lambda c: F.replace(F.replace(F.replace(scalar_text(F.col(c).cast("string")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*[F.concat(F.lit("<td>"), escape(c), F.lit("</td>")) for c in columns])
    row = F.when(F.col("rank") == 0, F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))).otherwise(F.concat(F.lit('<tr class="indented">'), cells, F.lit("</tr>")))
    return members.select("group_id", "rank", row.alias("html"))


def _record(kind: str, group: Column, part: Column, body: Column, order: int) -> list[Column]:
    return [F.lit(order).alias("_o"), group.alias("_g"), part.alias("_p"), F.to_json(F.struct(F.lit(kind).alias("record"), body.alias("value"))).alias("value")]


def jsonl(report: DataFrame, scan_id: str) -> DataFrame:
    """Lines in order of (_o, _g, _p): header, for each group its head, chunks of at most CHUNK members and end, summary.

    Members are cut into chunks by their rank, so no line grows with its group.
    """
    spark = report.sparkSession
    none = F.lit("")
    head = spark.range(1).select(*_record("header", none, F.lit(-1), F.struct(F.lit(scan_id).alias("scan_id")), 0))
    sizes = report.groupBy("group_id").agg(F.count("*").alias("members"), F.first("digest").alias("digest"), F.first("size").alias("size"))
    starts = sizes.select(*_record("group_header", F.col("group_id"), F.lit(-1), F.struct("group_id", "members", "digest", "size"), 1))
    chunked = report.withColumn("chunk", F.floor(F.col("rank") / CHUNK).cast("int")).groupBy("group_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("rank", "file_id", "path"))).alias("files"))
    chunks = chunked.select(*_record("member_chunk", F.col("group_id"), F.col("chunk"), F.struct("group_id", "chunk", "files"), 1))
    ends = sizes.select(*_record("group_end", F.col("group_id"), F.lit(2**31 - 1), F.struct("group_id", "members"), 1))
    last = summary(report).select(*_record("summary", none, F.lit(0), F.struct("groups", "duplicates", "reclaimable"), 2))
    return head.union(starts).union(chunks).union(ends).union(last)


def check_jsonl(lines: DataFrame) -> DataFrame:
    """What breaks the stream's rules; empty for a good one."""
    kind = F.get_json_object("value", "$.record")
    df = lines.select(kind.alias("record"), F.get_json_object("value", "$.value.group_id").alias("group_id"), F.get_json_object("value", "$.value.members").cast("long").alias("members"), F.size(F.from_json(F.get_json_object("value", "$.value.files"), "array<struct<rank:int>>")).alias("files"))
    one = df.groupBy().agg(F.count_if(F.col("record") == "header").alias("h"), F.count_if(F.col("record") == "summary").alias("s")).where("h <> 1 or s <> 1").select(F.lit("header or summary isn't single").alias("problem"))
    g = df.where("group_id is not null").groupBy("group_id").agg(F.count_if(F.col("record") == "group_header").alias("h"), F.count_if(F.col("record") == "group_end").alias("e"), F.max("members").alias("m"), F.coalesce(F.sum(F.when(F.col("record") == "member_chunk", F.col("files"))), F.lit(0)).alias("f"))
    return one.union(g.where("h <> 1 or e <> 1 or m <> f").select(F.concat(F.lit("group "), "group_id").alias("problem")))


def change_records(changes: DataFrame, before: int, after: int) -> DataFrame:
    """Each change as a record with an id over its fields in order of name."""
    body = F.struct(F.lit(after).alias("after_scan"), F.lit(before).alias("before_scan"), "change_type", "content_changed", "old_path_key", "path_key", "root_id")
    return changes.select(F.sha2(F.to_json(body).cast("binary"), 256).alias("change_id"), "*")
