"""Reports, plans and policies as files."""

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

RECORDS = "record string, value string"
#: Schemas of records, by name.
SCHEMAS = {
    "file": "file_id long, path string, size long, mtime_ns long, digest string, is_ref boolean, comparison_pool string",
    "group": "group_id string, file_id long, rank int, path string, size long, digest string, is_ref boolean",
    "action": "action_id string, group_id string, operation string, target string, reference string, digest string",
    "results": "_percentage long, file array<struct<_path:string,_words:string,_is_ref:string,_marked:string>>, match array<struct<_first:long,_second:long,_percentage:long>>",
}
#: Bounds of policy files in XML.
MOST_XML_BYTES, MOST_XML_ITEMS, MOST_XML_DEPTH = 2 * 1024 * 1024, 4096, 64


def schema(name: str) -> StructType:
    """M23."""
    return StructType.fromDDL(SCHEMAS[name])


def read_records(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Records of a JSON-lines file of one kind; a line that isn't one fails the job."""
    return spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").json(path)


def unknown_fields(lines: DataFrame, name: str) -> DataFrame:
    """Lines (value) with a field that the schema doesn't have."""
    known = [f.name for f in schema(name).fields]
    return lines.where(F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known)))) > 0)


def write_lines(records: DataFrame, path: str) -> None:
    """Lines (value) in order of what else they have; an existing path is an error, a failed job leaves none."""
    records.orderBy(*[c for c in records.columns if c != "value"]).select("value").write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved groups of an XML file, one row a member; exact groups come back as reported, not as verified."""
    df = spark.read.format("xml").option("rowTag", "group").option("attributePrefix", "_").schema(SCHEMAS["results"]).load(path)
    g = df.select(F.sha2(F.to_json("file"), 256).alias("group_id"), "_percentage", F.posexplode("file").alias("rank", "f"))
    return g.select("group_id", F.col("_percentage").alias("percentage"), "rank", F.col("f._path").alias("path"), (F.col("f._is_ref") == "y").alias("is_ref"), (F.col("f._marked") == "y").alias("marked"), F.lit("reported").alias("verification_kind"))


def write_results(members: DataFrame, path: str) -> None:
    """Z3: groups with their files, in order of rank, as XML."""
    yes = lambda c: F.when(F.col(c), "y").otherwise("n")
    files = F.array_sort(F.collect_list(F.struct("rank", F.col("path").alias("_path"), yes("is_ref").alias("_is_ref"), yes("marked").alias("_marked"))))
    g = members.groupBy("group_id").agg(F.first("percentage").alias("_percentage"), files.alias("f"))
    g = g.select("_percentage", F.transform("f", lambda x: F.struct(x["_path"].alias("_path"), x["_is_ref"].alias("_is_ref"), x["_marked"].alias("_marked"))).alias("file"))
    g.write.format("xml").option("rowTag", "group").option("rootTag", "results").option("attributePrefix", "_").save(path)


def policy_rows(text: str, tag: str) -> list[dict]:
    """The attributes of all elements of a small XML document without DTD, within bounds of size, items and depth."""
    if len(text.encode()) > MOST_XML_BYTES:
        raise ValueError("policy file too large")
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("policy files have no DTD")
    root = ET.fromstring(text)
    todo, out, n = [(root, 1)], [], 0
    while todo:
        e, depth = todo.pop()
        n += 1
        if n > MOST_XML_ITEMS or depth > MOST_XML_DEPTH:
            raise ValueError("policy file has too many elements or is too deep")
        if e.tag == tag:
            out.append(dict(e.attrib))
        todo += [(c, depth + 1) for c in reversed(e)]
    return out


def ignore_list(spark: SparkSession, text: str) -> DataFrame:
    """Pairs of <file path="..."><file path="..."/></file>."""
    pairs = [(f.attrib["path"], g.attrib["path"]) for f in ET.fromstring(text) if policy_rows(text, "file") for g in f]
    return spark.createDataFrame(pairs, "first_path string, second_path string")


def directory_policy(spark: SparkSession, text: str) -> DataFrame:
    """States of <state path="..." value="..."/>."""
    return spark.createDataFrame([(r["path"], int(r["value"])) for r in policy_rows(text, "state")], "path string, state int")


def exclusion_patterns(text: str) -> tuple[str, ...]:
    """Marked patterns of <exclude regex="..." marked="y"/>."""
    return tuple(r["regex"] for r in policy_rows(text, "exclude") if r.get("marked") == "y")


def backup(table: DataFrame, path: str) -> None:
    """A copy under a new path; never over another."""
    table.write.mode("errorifexists").parquet(path)


def open_catalog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of a catalog for reading; an error unless it has the columns."""
    df = spark.read.parquet(path)
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*columns)


def cached(files: DataFrame, cache: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files with values that a cache holds for their whole generation key, and files that must be computed."""
    same = files.join(cache.select(*keys, *values), keys, "left")
    return same.where(F.col(values[0]).isNotNull()), same.where(F.col(values[0]).isNull()).drop(*values)


def refreshed(cache: DataFrame, computed: DataFrame, path_key: list[str]) -> DataFrame:
    """A cache in which new values replace those of older generations."""
    return cache.join(computed.select(*path_key), path_key, "left_anti").unionByName(computed.select(*cache.columns))
