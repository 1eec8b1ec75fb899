import datetime

import pytest
from pyspark.sql import functions as F

from kindred.sources import documents, listing
from kindred.streaming import arrivals


def test_walk_and_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.txt").write_text("1")
    (tmp_path / "a" / "b" / "y.txt").write_text("22")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    events = {(r.kind, r.path.removeprefix(str(tmp_path))) for r in listing.walk(spark, str(tmp_path)).collect()}
    assert events == {("file", "/x.txt"), ("file", "/a/b/y.txt"), ("skipped_symlink", "/link")}
    pruned = {r.kind for r in listing.walk(spark, str(tmp_path), prune=("b",)).collect()}
    assert "pruned" in pruned
    assert listing.walk(spark, str(tmp_path / "none")).first().kind == "error"
    got = {(r.path.rsplit("/", 1)[1], r.size) for r in listing.read_files(spark, str(tmp_path), extensions=("txt",)).collect()}
    assert ("x.txt", 1) in got and ("y.txt", 2) in got


def test_results_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("g", 90, 0, "/a", True, False), ("g", 90, 1, "/b", False, True)], "group_id string, percentage long, rank int, path string, is_ref boolean, marked boolean")
    documents.write_results(m, str(tmp_path / "r"))
    got = documents.read_results(spark, str(tmp_path / "r")).orderBy("rank").select("rank", "path", "is_ref", "marked", "verification_kind").collect()
    assert [tuple(r) for r in got] == [(0, "/a", True, False, "reported"), (1, "/b", False, True, "reported")]


def test_records_are_strict(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text('{"group_id":"g","file_id":1}\n')
    bad.write_text('{"group_id":"g","file_id":"x"}\n')
    assert documents.read_records(spark, str(good), "group").first().file_id == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        documents.read_records(spark, str(bad), "group").collect()
    odd = spark.createDataFrame([('{"group_id":"g","oops":1}',), ('{"group_id":"g"}',)], "value string")
    assert documents.unknown_fields(odd, "group").count() == 1


def test_policies(spark):
    assert documents.exclusion_patterns('<l><exclude regex="a" marked="y"/><exclude regex="b" marked="n"/></l>') == ("a",)
    assert documents.directory_policy(spark, '<l><state path="/a" value="1"/></l>').first().state == 1
    assert documents.ignore_list(spark, '<l><file path="/a"><file path="/b"/></file></l>').first().second_path == "/b"
    with pytest.raises(ValueError):
        documents.policy_rows("<!DOCTYPE x><l/>", "l")


def test_caches(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    c = spark.createDataFrame([("a", 1, "d"), ("b", 9, "e")], "path string, size long, digest string")
    have, lack = documents.cached(f, c, ["path", "size"], ["digest"])
    assert have.first().digest == "d" and lack.first().path == "b"
    new = documents.refreshed(c, lack.withColumn("digest", F.lit("n")), ["path"])
    assert sorted(tuple(r) for r in new.collect()) == [("a", 1, "d"), ("b", 2, "n")]


def test_stream_of_arrivals(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    t = datetime.datetime(2024, 1, 1)
    rows = [(t, "a"), (t, "a"), (t, "b")]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(src))
    q = arrivals.first_arrivals(stream, ["k"], "ts").writeStream.foreachBatch(arrivals.merge_batches(str(out), ["k"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(out)).count() == 2
