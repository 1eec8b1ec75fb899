"""Commands: python -m kindred scan | plan | query | groups | changes | status | backup | doctor."""

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from kindred.functions.text import extension, file_name
from kindred.operators import catalog, rank, report
from kindred.shared import job
from kindred.sources import documents, listing


def scan(spark: SparkSession, roots: list[str], out: str, least: int) -> None:
    """Exact groups of all files below the roots, as a table and as lines."""
    files = listing.read_files(spark, *roots)
    files = files.select(F.xxhash64("path").alias("file_id"), "path", file_name(F.col("path")).alias("name"), "content", F.lit(False).alias("is_ref"), F.lit("incoming").alias("comparison_pool")).withColumn("extension", extension(F.col("name")))
    found = report.exact_report(files, least).select("group_id", "file_id", "path", "name", "size", "digest", "is_ref", "comparison_pool", "rank", "score")
    found.write.parquet(f"{out}/groups")
    documents.write_lines(report.jsonl(spark.read.parquet(f"{out}/groups"), out), f"{out}/lines")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """One command; tables are folders of Parquet."""
    parser = argparse.ArgumentParser(prog="kindred", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("scan")
    p.add_argument("roots", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--min-size", type=int, default=1)
    p = sub.add_parser("plan")
    p.add_argument("groups")
    p.add_argument("--out", required=True)
    p = sub.add_parser("query")
    p.add_argument("groups")
    for k in ("group-id", "path", "digest"):
        p.add_argument(f"--{k}")
    p = sub.add_parser("groups")
    p.add_argument("groups")
    p.add_argument("--after-size", type=int, default=-1)
    p.add_argument("--after-digest", default="")
    p.add_argument("--limit", type=int, default=100)
    sub.add_parser("status").add_argument("items")
    p = sub.add_parser("backup")
    p.add_argument("table")
    p.add_argument("out")
    p = sub.add_parser("changes")
    p.add_argument("before")
    p.add_argument("after")
    sub.add_parser("doctor")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("kindred").getOrCreate()
    with job(spark, a.command):
        if a.command == "scan":
            scan(spark, a.roots, a.out, a.min_size)
        elif a.command == "plan":
            report.checked_plan(report.plan_actions(spark.read.parquet(a.groups))).write.json(a.out)
        elif a.command == "query":
            rank.sort_groups(report.query_report(spark.read.parquet(a.groups), a.group_id, a.path, a.digest), "size", False).show(100, False)
        elif a.command == "groups":
            g = documents.open_catalog(spark, a.groups, ["group_id", "file_id", "size", "digest"])
            catalog.digest_page(g.withColumn("members", F.lit(0)), a.after_size, a.after_digest, a.limit).orderBy("size", "digest", "file_id").show(1000, False)
        elif a.command == "status":
            catalog.scan_coverage(spark.read.parquet(a.items), []).show()
        elif a.command == "backup":
            documents.backup(spark.read.parquet(a.table), a.out)
        elif a.command == "changes":
            catalog.change_summary(catalog.scan_changes(spark.read.parquet(a.before), spark.read.parquet(a.after))).show()
        else:
            report.doctor(spark).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
