"""Queries of files, rankings, the catalog, datasets, sources and sinks."""

import uuid

from pyspark.sql import functions as F

from kindred.functions.bits import dimensions_compatible
from kindred.operators import catalog, dataset, exact, files as fs, folders, groups, ignore, rank, report
from kindred.operators.hot import numbered
from kindred.plans import views as v
from kindred.plans.queries import query
from kindred.shared import shared_folder
from kindred.sources import documents

_W = "WITH "

# -- files -------------------------------------------------------------------------------------


@query(_W + v.FILES + " SELECT file_id, path FROM files WHERE path LIKE '/lib/src1/en/%' AND extension = 'en'")
def one_level(spark, sf_dir):
    """A5, A6."""
    f = v.files(spark, sf_dir)
    return fs.within_budget(fs.one_level(f, "/lib/src1/en", ("en",)), 1_000_000_000).select("file_id", "path")


@query("SELECT a.file_id AS first_id, b.file_id AS second_id, a.pool IS DISTINCT FROM b.pool AS differ, true AS every FROM (SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'protected' ELSE 'incoming' END AS pool FROM documents) a JOIN (SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'protected' ELSE 'incoming' END AS pool FROM documents) b ON a.file_id + 1 = b.file_id")
def pair_scope(spark, sf_dir):
    """A pool that isn't given is incoming."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "protected").when(F.col("doc_id") % 3 == 1, "incoming").alias("pool"))
    a, b = d.alias("a"), d.alias("b")
    x = a.join(b, F.col("a.doc_id") + 1 == F.col("b.doc_id"))
    return x.select(F.col("a.doc_id").alias("first_id"), F.col("b.doc_id").alias("second_id"), fs.pair_in_scope(F.col("a.pool"), F.col("b.pool"), "cross").alias("differ"), fs.pair_in_scope(F.col("a.pool"), F.col("b.pool")).alias("every"))


_ORDER_PAIRS = "p AS (SELECT '/o/' || a.o_orderkey AS x, '/o/' || b.o_orderkey AS y, a.o_orderkey AS k FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)"


def _order_pairs(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    a, b = o.alias("a"), o.alias("b")
    x = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")))
    path = lambda c: F.concat(F.lit("/o/"), F.col(c).cast("string"))
    return x.select(path("a.o_orderkey").alias("first_path"), path("b.o_orderkey").alias("second_path"), F.col("a.o_orderkey").alias("k"))


@query(_W + _ORDER_PAIRS + " SELECT x AS first_path, y AS second_path FROM p WHERE k % 3 <> 0")
def not_ignored(spark, sf_dir):
    """Ignored the other way round, and twice."""
    p = _order_pairs(spark, sf_dir)
    ignored = p.where("k % 3 = 0").select(F.col("second_path").alias("first_path"), F.col("first_path").alias("second_path"))
    return ignore.without_ignored(p.drop("k"), ignored.union(ignored))


@query(_W + _ORDER_PAIRS + ", e AS (SELECT '/o/' || o_orderkey AS path FROM orders WHERE o_orderstatus <> 'F'), i AS (SELECT least(x, y) AS lo, greatest(x, y) AS hi FROM p WHERE k % 2 = 0 OR k % 5 = 0) SELECT DISTINCT lo, hi FROM i WHERE lo IN (SELECT path FROM e) AND hi IN (SELECT path FROM e)")
def ignore_list(spark, sf_dir):
    """Pairs are added, taken away and purged of files that are gone."""
    p = _order_pairs(spark, sf_dir)
    some = lambda k: p.where(f"k % {k} = 0").drop("k")
    kept = ignore.remove(ignore.add(ignore.add(some(2), some(5)), some(7)), p.where("k % 7 = 0 and k % 2 <> 0 and k % 5 <> 0").drop("k"))
    existing = v.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("path"))
    return ignore.purge(kept, existing)


@query("WITH s AS (SELECT DISTINCT '/r/' || n_regionkey AS path, CASE WHEN n_regionkey % 2 = 0 THEN 2 ELSE 1 END AS state FROM nation UNION SELECT '/r/' || n_regionkey || '/' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 2 END FROM nation), keep AS (SELECT path FROM s WHERE state <> 2) SELECT path AS folder FROM s WHERE state = 2 AND NOT EXISTS (SELECT 1 FROM keep WHERE keep.path LIKE s.path || '/%')")
def prunable_folders(spark, sf_dir):
    """B11."""
    n = v.table(spark, sf_dir, "nation")
    region = F.concat(F.lit("/r/"), F.col("n_regionkey").cast("string"))
    states = n.select(region.alias("path"), F.when(F.col("n_regionkey") % 2 == 0, 2).otherwise(1).alias("state")).distinct().union(n.select(F.concat(region, F.lit("/"), F.col("n_nationkey").cast("string")), F.when(F.col("n_nationkey") % 3 == 0, 0).otherwise(2)))
    return fs.prunable(states.select(F.col("path").alias("folder")), states)


@query("SELECT l_orderkey, l_linenumber, (w = h2 AND h = w2) OR (w = w2 AND h = h2) AS turned, w = w2 AND h = h2 AS same, true AS scaled FROM (SELECT *, l_quantity::INT % 3 AS w, l_linenumber % 3 AS h, l_suppkey % 3 AS w2, l_partkey % 3 AS h2 FROM lineitem)")
def dimension_rules(spark, sf_dir):
    """B15."""
    size = lambda a, b: F.struct((a % 3).alias("w"), (b % 3).alias("h"))
    a, b = size(F.col("l_quantity").cast("int"), F.col("l_linenumber")), size(F.col("l_suppkey"), F.col("l_partkey"))
    rule = lambda *how: dimensions_compatible(a, b, *how)
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rule(False, True).alias("turned"), rule(False, False).alias("same"), rule(True, False).alias("scaled"))


@query("SELECT min(l_orderkey * 10 + l_linenumber) AS file_id FROM lineitem WHERE l_suppkey % 10 <> 0 AND l_partkey % 10 <> 0 GROUP BY l_suppkey, l_partkey UNION ALL SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_suppkey % 10 = 0 OR l_partkey % 10 = 0")
def hardlinks(spark, sf_dir):
    """Device and inode of 0 or null are no identity."""
    l = v.table(spark, sf_dir, "lineitem")
    f = l.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").agg(F.count("*").alias("n")).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    known = lambda c: F.when(F.col(c) % 10 != 0, F.col(c)).when(F.col(c) % 20 == 0, 0)
    return fs.without_hardlinks(f.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), known("l_suppkey").alias("device"), known("l_partkey").alias("inode"))).select("file_id")


@query("WITH m AS (SELECT o_custkey AS group_id, o_orderkey AS file_id, o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS eligible FROM orders) SELECT *, bool_and(eligible) OVER (PARTITION BY group_id) AS batch_ok, eligible AND file_id % 2 = 0 AS markable FROM m")
def eligible_rows(spark, sf_dir):
    """B17, B18."""
    k = F.col("o_orderkey")
    o = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group_id"), k.alias("file_id"), (F.col("o_orderstatus") != "P").alias("scan_complete"), F.lit("verified_exact").alias("verification_kind"), (k % 3 == 0).alias("is_ref"),
        F.when(k % 7 == 0, "protected").otherwise("incoming").alias("comparison_pool"), F.lit("incoming").alias("current_pool"), (k % 11 != 0).alias("keeper_pool_unchanged"),
    )
    return fs.eligible(o).select("group_id", "file_id", "eligible", "batch_ok", fs.markable(~F.col("eligible"), F.when(F.col("file_id") % 2 == 0, 1).otherwise(0), F.lit(True)).alias("markable"))


@query(_W + v.FILES + ", d AS (SELECT file_id, path FROM files), e AS (SELECT '/lib/' || source AS folder, 1 AS g FROM documents GROUP BY source UNION SELECT '/lib/' || source || '/' || lang, 2 FROM documents WHERE source <> (SELECT max(source) FROM documents) GROUP BY source, lang UNION SELECT '/other/' || lang, 3 FROM documents GROUP BY lang) SELECT g AS group_id, folder FROM e WHERE g <> 2")
def nested_folders(spark, sf_dir):
    """A group whose folders all lie below matched ones goes."""
    d = v.table(spark, sf_dir, "documents")
    last = d.agg(F.max("source")).first()[0]
    src = F.concat(F.lit("/lib/"), "source")
    g = d.select(F.lit(1).alias("group_id"), src.alias("folder")).union(d.where(F.col("source") != last).select(F.lit(2), F.concat(src, F.lit("/"), "lang"))).union(d.select(F.lit(3), F.concat(F.lit("/other/"), "lang"))).distinct()
    return folders.suppress_nested(g)


@query("SELECT min(l_orderkey * 10 + l_linenumber) AS file_id FROM lineitem WHERE l_quantity >= 5 AND l_suppkey % 7 <> 0 GROUP BY l_suppkey, l_partkey HAVING l_partkey % 11 <> 0 UNION ALL SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_quantity >= 5 AND l_suppkey % 7 <> 0 AND l_partkey % 11 = 0")
def scan_candidates(spark, sf_dir):
    """M2, B4, D24."""
    return _scanned(spark, sf_dir)[0].select("file_id")


@query("SELECT '/l/' || (l_orderkey * 10 + l_linenumber) AS path, 'no identity' AS issue FROM lineitem WHERE l_suppkey % 7 = 0")
def scan_issues(spark, sf_dir):
    """M2."""
    return _scanned(spark, sf_dir)[1]


def _scanned(spark, sf_dir):
    l = v.table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    f = l.select(key.alias("file_id"), F.concat(F.lit("/l/"), key.cast("string")).alias("path"), F.col("l_quantity").cast("long").alias("size"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") + 1).alias("device"), F.when(F.col("l_partkey") % 11 == 0, 0).otherwise(F.col("l_partkey") + 1).alias("inode"))
    return fs.scan_candidates(f, 5)


# -- rankings ----------------------------------------------------------------------------------

_ORDERS = "m AS (SELECT o_custkey AS group_id, o_orderkey AS file_id, 'f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN ' copy' ELSE '' END || '.txt' AS name, '/' || o_orderstatus || CASE o_orderkey % 2 WHEN 0 THEN '/deep' ELSE '' END || '/f' || o_orderkey AS path, CAST(floor(o_totalprice / 10000) AS BIGINT) AS size, o_orderkey % 10 = 0 AS is_ref FROM orders), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY is_ref DESC, size DESC, file_id) - 1 AS INT) AS rank FROM m)"


def _orders(spark, sf_dir):
    o, k = v.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, " copy").otherwise(""), F.lit(".txt"))
    path = F.concat(F.lit("/"), "o_orderstatus", F.when(k % 2 == 0, "/deep").otherwise(""), F.lit("/f"), k.cast("string"))
    m = o.select(F.col("o_custkey").alias("group_id"), k.alias("file_id"), name.alias("name"), path.alias("path"), F.floor(F.col("o_totalprice") / 10_000).cast("long").alias("size"), (k % 10 == 0).alias("is_ref"))
    return exact.ranked_first(m, [F.col("size").desc(), "file_id"])


@query(_W + _ORDERS + " SELECT group_id, file_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY is_ref DESC, size DESC, contains(lower(name), 'copy'), regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), '[0-9]$'), len(string_split(path, '/')) DESC, file_id) - 1 AS INT) AS rank FROM m")
def legacy_ranking(spark, sf_dir):
    """I2, I3."""
    return rank.prioritize(_orders(spark, sf_dir), rank.legacy_keys()).select("group_id", "file_id", "rank")


def _placed(ordered, name: str):
    return numbered(ordered, name).withColumn(name, F.col(name) + 1)


@query(_W + _ORDERS + ", o AS (SELECT group_id, count(*) AS n, max(size) FILTER (rank = 0) AS top FROM r GROUP BY group_id) SELECT r.group_id, file_id, rank, CAST(row_number() OVER (ORDER BY n DESC, r.group_id, rank) AS BIGINT) AS by_size, CAST(row_number() OVER (ORDER BY top, r.group_id, rank) AS BIGINT) AS by_reference FROM r JOIN o ON o.group_id = r.group_id")
def sorted_groups(spark, sf_dir):
    """Places in either order, taken from the sorted rows themselves."""
    m = _orders(spark, sf_dir)
    by_size = _placed(rank.sort_groups(m, "size", False), "by_size")
    return by_size.join(_placed(rank.sort_groups(m.withColumn("top", F.col("size")), "top"), "by_reference").select("file_id", "by_reference"), "file_id").select("group_id", "file_id", "rank", "by_size", "by_reference")


@query(_W + _ORDERS + ", f AS (SELECT group_id, size AS own FROM r WHERE rank = 0) SELECT file_id, CAST(row_number() OVER (ORDER BY size, file_id) AS BIGINT) AS place, CAST(row_number() OVER (ORDER BY size - own DESC, file_id) AS BIGINT) AS delta_place FROM r JOIN f USING (group_id) WHERE rank > 0")
def sorted_members(spark, sf_dir):
    """Members by a column and by its difference from the reference's."""
    m = _orders(spark, sf_dir)
    return _placed(rank.sort_members(m, "size"), "place").select("file_id", "place").join(_placed(rank.sort_members(m, "size", False, True), "delta_place").select("file_id", "delta_place"), "file_id")


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def criterion_values(spark, sf_dir):
    """H13."""
    return rank.criterion_values(v.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "value"), "value")


@query(_W + _ORDERS + " SELECT group_id, file_id, NOT is_ref AND rank > 0 AND file_id % 4 = 0 AS marked, NOT is_ref AND rank > 0 AND file_id % 4 <> 0 AS inverted FROM r")
def marks(spark, sf_dir):
    """M19."""
    m = _orders(spark, sf_dir)
    some = m.where("file_id % 4 = 0").select("file_id")
    return rank.marked(m, some).join(rank.marked(m, some, inverted=True).select("file_id", F.col("marked").alias("inverted")), "file_id").select("group_id", "file_id", "marked", "inverted")


@query(_W + _ORDERS + " SELECT count(*) FILTER (NOT is_ref AND rank > 0 AND file_id % 4 = 0) AS marked, CAST(sum(CASE WHEN NOT is_ref AND rank > 0 AND file_id % 4 = 0 THEN size ELSE 0 END) AS BIGINT) AS marked_size, count(*) AS total, CAST(sum(size) AS BIGINT) AS total_size FROM r")
def mark_totals(spark, sf_dir):
    """H6."""
    m = _orders(spark, sf_dir)
    return exact.stats(rank.marked(m, m.where("file_id % 4 = 0").select("file_id")))


@query(_W + _ORDERS + ", k AS (SELECT * FROM r WHERE file_id % 4 <> 0), g AS (SELECT group_id FROM k GROUP BY group_id HAVING count(*) > 1 AND bool_or(NOT is_ref)) SELECT group_id, file_id FROM k WHERE group_id IN (SELECT group_id FROM g)")
def removed_members(spark, sf_dir):
    """L4, L5, M20."""
    m = _orders(spark, sf_dir)
    return rank.remove_members(m, m.where("file_id % 4 = 0")).select("group_id", "file_id")


@query(_W + _ORDERS + ", h AS (SELECT group_id FROM r WHERE rank = 0 AND is_ref) SELECT r.group_id, file_id, CAST(row_number() OVER (PARTITION BY r.group_id ORDER BY CASE WHEN file_id % 4 = 0 AND h.group_id IS NULL THEN 0 ELSE 1 END, rank) - 1 AS INT) AS rank FROM r LEFT JOIN h ON h.group_id = r.group_id")
def switched_references(spark, sf_dir):
    """M18."""
    m = _orders(spark, sf_dir)
    return rank.switch_reference(m, m.where("file_id % 4 = 0")).select("group_id", "file_id", "rank")


@query(_W + _ORDERS + " SELECT DISTINCT least(a.path, b.path) AS lo, greatest(a.path, b.path) AS hi FROM r a JOIN r b ON a.group_id = b.group_id AND a.path <> b.path WHERE a.file_id % 100 = 0")
def ignored_selection(spark, sf_dir):
    """M21."""
    m = _orders(spark, sf_dir)
    return ignore.pairs_of_selected(m, m.where("file_id % 100 = 0").select("file_id"))


# -- exact ------------------------------------------------------------------------------------


@query(_W + v.GROUPS + " SELECT a.file_id AS first_id, b.file_id AS second_id, 100 AS percentage FROM m a JOIN m b ON a.group_id = b.group_id AND a.file_id < b.file_id")
def exact_pairs(spark, sf_dir):
    """D4."""
    return exact.pairs(exact.exact_groups(v.files(spark, sf_dir)))


@query("SELECT group_id, count(*) AS members, 'sha256:' || sha256('EUROPE') = group_id AS named FROM (SELECT 'sha256:' || sha256('EUROPE') AS group_id FROM nation WHERE n_regionkey = 3) GROUP BY group_id")
def known_group(spark, sf_dir):
    """Files that are known to be equal."""
    n = v.table(spark, sf_dir, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("file_id"), F.lit("EUROPE").cast("binary").alias("content"))
    return exact.require_equal(n).groupBy("group_id").agg(F.count("*").alias("members")).withColumn("named", F.col("group_id") == F.concat(F.lit("sha256:"), F.sha2(F.lit("EUROPE"), 256)))


@query("SELECT o_custkey AS cluster_id, count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) <= 1 AND count(DISTINCT CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END) <= 1 AS proven FROM orders GROUP BY o_custkey")
def proven_clusters(spark, sf_dir):
    """Primaries and sidecars, slot by slot."""
    o = v.table(spark, sf_dir, "orders")
    return exact.clusters_equal(o.select(F.col("o_custkey").alias("cluster_id"), (F.col("o_orderkey") % 2).alias("slot"), F.col("o_orderstatus").cast("binary").alias("content")))


@query(_W + v.GROUPS + " SELECT group_id, file_id FROM m WHERE size >= 200")
def report_of_files(spark, sf_dir):
    """M1, M2: groups of files of 200 bytes and more."""
    return report.exact_report(v.files(spark, sf_dir), 200).select("group_id", "file_id")


# -- catalog -----------------------------------------------------------------------------------


@query("SELECT c_custkey AS k, c_name AS name, 'old' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE c_custkey % 3 = 0")
def upserted(spark, sf_dir):
    """F1, F5, F10, F15."""
    c = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return catalog.upsert(c.withColumn("origin", F.lit("old")), c.where("k % 3 = 0").withColumn("origin", F.lit("new")), ["k"])


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM customer")
def inserted_missing(spark, sf_dir):
    """only new keys, each once."""
    c = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    new = c.withColumn("origin", F.lit("new"))
    return catalog.journal(c.where("k % 3 = 0").withColumn("origin", F.lit("old")), new.union(new))


_SCANS = "s AS (SELECT o_orderkey AS scan_id, o_custkey % 10 AS root_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, epoch(o_orderdate) AS finished_at FROM orders)"


def _scans(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("scan_id"), (F.col("o_custkey") % 10).alias("root_id"), status.alias("status"), F.unix_timestamp("o_orderdate").cast("double").alias("finished_at"))


@query(_W + _SCANS + " SELECT scan_id FROM s WHERE status = 'complete' ORDER BY finished_at DESC, scan_id DESC LIMIT 1")
def latest_scan(spark, sf_dir):
    """F3."""
    return catalog.latest_complete(_scans(spark, sf_dir))


@query(_W + _SCANS + ", l AS (SELECT root_id, max_by(status, scan_id) AS status, max(scan_id) AS scan_id FROM s GROUP BY root_id) SELECT root_id, coalesce(status = 'complete' AND root_id % 4 <> 1, false) AS projectable FROM (SELECT DISTINCT root_id FROM s UNION SELECT 99) LEFT JOIN l USING (root_id)")
def projectable_roots(spark, sf_dir):
    """F4."""
    s = _scans(spark, sf_dir)
    last = s.groupBy("root_id").agg(F.max("scan_id").alias("last_complete_scan_id")).withColumn("last_complete_scan_id", F.when(F.col("root_id") % 4 != 1, F.col("last_complete_scan_id")).otherwise(-1))
    none = spark.createDataFrame([(99, None)], "root_id long, last_complete_scan_id long")
    return catalog.projectable(last.union(none), s)


@query(_W + _SCANS + ", n AS (SELECT scan_id, status, CAST(NULL AS DOUBLE) AS finished_at FROM s UNION ALL SELECT -1, 'running', NULL) SELECT scan_id, CASE WHEN scan_id = -1 THEN 'completed_with_errors' WHEN scan_id = (SELECT min(scan_id) FROM s WHERE status = 'running') THEN 'cancelled' ELSE status END AS status, CASE WHEN scan_id = -1 THEN 7.0::DOUBLE WHEN scan_id = (SELECT min(scan_id) FROM s WHERE status = 'running') THEN 5.0::DOUBLE END AS finished_at FROM n")
def scan_states(spark, sf_dir):
    """A scan starts, another is cancelled, the first ends with an error."""
    s = _scans(spark, sf_dir).select("scan_id", "status", F.lit(1.0).alias("started_at"), F.lit(None).cast("double").alias("finished_at"), F.lit(None).cast("long").alias("resume_of"))
    first = s.where("status = 'running'").agg(F.min("scan_id")).first()[0]
    s, roots = catalog.start_scan(s, -1, ["/a", "/b", "/a"], 2.0)
    s = catalog.end_scan(catalog.end_scan(s, first, "cancelled", 5.0), first, "complete", 6.0)
    work = roots.select("scan_id", F.lit("complete").alias("status"))
    errors = catalog.journal(spark.createDataFrame([], "scan_id long, path string"), spark.createDataFrame([(-1, "/a/x"), (-1, "/a/x")], "scan_id long, path string"))
    return catalog.finalize_scan(s, -1, work, errors, 7.0).select("scan_id", "status", "finished_at")


_ITEMS = "i AS (SELECT o_orderkey AS item_id, o_orderkey AS content_version_id, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'claimed' ELSE 'complete' END AS status, CASE WHEN o_orderstatus = 'O' THEN 'other' END AS owner, CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey % 100 AS DOUBLE) END AS lease_until, CAST(o_orderkey % 3 AS INT) AS attempts FROM orders), f AS (SELECT *, CASE WHEN status = 'claimed' AND lease_until < 50 THEN 'pending' ELSE status END AS now FROM i), w AS (SELECT item_id FROM f WHERE now = 'pending' ORDER BY item_id LIMIT 200)"


def _items(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "claimed").otherwise("complete")
    held = F.col("o_orderstatus") == "O"
    return o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("content_version_id"), status.alias("status"), F.when(held, "other").alias("owner"), F.when(held, (F.col("o_custkey") % 100).cast("double")).alias("lease_until"), (F.col("o_orderkey") % 3).cast("int").alias("attempts"))


@query(_W + _ITEMS + " SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM w) THEN 'claimed' ELSE now END AS status, CASE WHEN item_id IN (SELECT item_id FROM w) THEN 'me' ELSE owner END AS owner, CASE WHEN item_id IN (SELECT item_id FROM w) THEN 110.0::DOUBLE ELSE lease_until END AS lease_until FROM f")
def claimed_items(spark, sf_dir):
    """expired leases are free again; the first 200 are claimed, which is the feature."""
    return catalog.claim(_items(spark, sf_dir), "me", 50.0, 60.0, 200, ["item_id"]).select("item_id", "status", "owner", "lease_until")


@query(_W + _ITEMS + " SELECT item_id, CASE WHEN item_id NOT IN (SELECT item_id FROM w) THEN now WHEN item_id % 7 <> 0 THEN 'complete' WHEN attempts + 1 < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN item_id IN (SELECT item_id FROM w) AND item_id % 7 = 0 THEN attempts + 1 ELSE attempts END AS attempts FROM f")
def worked_batch(spark, sf_dir):
    """contents that can't be read go back, or fail for good."""
    return catalog.run_batch(_items(spark, sf_dir), _contents(spark, sf_dir), "me", 50.0, 60.0, 200)[0].select("item_id", "status", "attempts")


def _contents(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0")
    return o.select(F.col("o_orderkey").alias("content_version_id"), F.col("o_orderpriority").cast("binary").alias("content"))


@query("SELECT content_version_id, 'sha256' AS algorithm, sha256(o_orderpriority) AS value FROM (SELECT o_orderkey AS content_version_id, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'F')")
def worked_artifacts(spark, sf_dir):
    """batches until none is pending or unreadable contents have failed."""
    items = _items(spark, sf_dir).where("status = 'pending'")
    return _all(catalog.run_batches(items, _contents(spark, sf_dir), "me", 50.0, 60.0, 200_000)[1])


def _all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


_SEEN = """k AS (SELECT o_orderkey AS native_file_id, '/p/' || o_orderkey AS path_key, o_custkey AS size, 1 AS mtime_ns, 't' AS change_token FROM orders WHERE o_orderkey % 5 <> 0),
n AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS native_file_id, '/p/' || CASE WHEN o_orderkey % 3 = 0 THEN 'moved/' ELSE '' END || o_orderkey AS path_key, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size, o_orderkey FROM orders)"""


def _seen(spark, sf_dir):
    o, k = v.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rest = [F.lit(1).cast("long").alias("mtime_ns"), F.lit("t").alias("change_token"), F.lit("active").alias("state")]
    known = o.where(k % 5 != 0).select(k.alias("native_file_id"), F.concat(F.lit("/p/"), k.cast("string")).alias("path_key"), F.col("o_custkey").alias("size"), *rest)
    seen = o.select(F.when(k % 11 != 0, k).alias("native_file_id"), F.concat(F.lit("/p/"), F.when(k % 3 == 0, "moved/").otherwise(""), k.cast("string")).alias("path_key"), (F.col("o_custkey") + F.when(k % 7 == 0, 1).otherwise(0)).alias("size"), *rest)
    return known, seen


@query(_W + _SEEN + " SELECT o_orderkey % 11 = 0 AS nameless, path_key, CASE WHEN o_orderkey % 5 = 0 OR (o_orderkey % 11 = 0 AND o_orderkey % 3 = 0) THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS generation FROM n")
def observed_files(spark, sf_dir):
    """by native id, else by path."""
    known, seen = _seen(spark, sf_dir)
    return catalog.observe(known, seen).select(F.col("native_file_id").isNull().alias("nameless"), "path_key", "generation")


@query(_W + _SEEN + " SELECT path_key FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path_key = k.path_key AND n.size = k.size)")
def stale_paths(spark, sf_dir):
    """A8, A26, M4, M12."""
    known, seen = _seen(spark, sf_dir)
    return catalog.stale(known, seen).select("path_key")


@query("SELECT 'versions' AS name, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'unstable' ELSE 'stable' END AS state FROM orders UNION ALL SELECT 'artifacts', o_orderkey, 'd' FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'verifications', o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey + 1 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) THEN 'invalidated' ELSE 'verified' END FROM orders UNION ALL SELECT 'work', o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'pending' END FROM orders")
def retired_evidence(spark, sf_dir):
    """F11, F15."""
    i = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("content_version_id"))
    got = catalog.retire(
        i.withColumn("state", F.lit("stable")), i.withColumn("value", F.lit("d")), i.select(F.col("content_version_id").alias("first_content_version_id"), (F.col("content_version_id") + 1).alias("second_content_version_id"), F.lit("verified").alias("state")),
        i.withColumn("status", F.lit("pending")), i.where("content_version_id % 4 = 0"),
    )
    part = lambda name, key, state: got[name].select(F.lit(name).alias("name"), F.col(key).alias("id"), F.col(state).alias("state"))
    return _all([part("versions", "content_version_id", "state"), part("artifacts", "content_version_id", "value"), part("verifications", "first_content_version_id", "state"), part("work", "content_version_id", "status")])


@query(_W + v.GROUPS + " SELECT first_id AS first_content_version_id, file_id AS second_content_version_id, digest AS full_digest, 'verified' AS state FROM m WHERE file_id <> first_id")
def verification_pairs(spark, sf_dir):
    """F14, F15."""
    g = exact.exact_groups(v.files(spark, sf_dir)).withColumnRenamed("file_id", "content_version_id")
    return catalog.verification_pairs(g.select("size", "digest", "content_version_id"))


@query(_W + v.SNAPSHOTS + """ SELECT sha256('{"after_scan":2,"before_scan":1,"change_type":"' || change_type || '","content_changed":' || content_changed || CASE WHEN old_path_key IS NULL THEN '' ELSE ',"old_path_key":"' || old_path_key || '"' END || ',"path_key":"' || path_key || '","root_id":' || root_id || '}') AS change_id, path_key FROM changes""")
def change_ids(spark, sf_dir):
    """F19, Z9."""
    scans = spark.createDataFrame([(1, "complete"), (2, "complete")], "scan_id long, status string")
    catalog.require_snapshots(scans, 1, 2)
    return report.change_records(catalog.scan_changes(*v.snapshots(spark, sf_dir)), 1, 2).select("change_id", "path_key")


@query("""SELECT 'scan status' AS problem, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 100 = 3 UNION ALL SELECT 'path state', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 100 = 5 UNION ALL SELECT 'content state', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 100 = 7
UNION ALL SELECT 'repeated path', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 100 = 9 UNION ALL SELECT 'path without content', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 100 = 11 UNION ALL SELECT 'artifact without content', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 100 = 11""")
def catalog_problems(spark, sf_dir):
    """F21."""
    k = F.col("o_orderkey")
    o = v.table(spark, sf_dir, "orders")
    odd = lambda at, good: F.when(k % 100 == at, "odd").otherwise(good)
    paths = o.select(k.alias("path_id"), k.alias("content_version_id"), odd(5, "active").alias("state"))
    versions = o.where(k % 100 != 11).select(k.alias("content_version_id"), odd(7, "stable").alias("state"))
    return catalog.integrity(paths.union(paths.where("path_id % 100 = 9")), versions, o.select(k.alias("content_version_id")), o.select(k.alias("scan_id"), odd(3, "complete").alias("status")))


# -- groups and datasets -----------------------------------------------------------------------

def _edges(spark, sf_dir):
    """Suppliers of a nation with even and with odd keys are exact classes; in every third nation a visual edge joins the two."""
    s = v.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 2).alias("odd"))
    low = s.groupBy("s_nationkey", "odd").agg(F.min("s_suppkey").alias("first_id"))
    exact_ = s.join(low, ["s_nationkey", "odd"]).where("s_suppkey <> first_id").select("first_id", F.col("s_suppkey").alias("second_id"))
    a, b = low.where("odd = 0").select("s_nationkey", "first_id"), low.where("odd = 1").select("s_nationkey", F.col("first_id").alias("second_id"))
    kind = F.when(F.col("s_nationkey") % 9 == 0, "related").when(F.col("s_nationkey") % 9 == 3, "transformed_variant").otherwise("near")
    return exact_, a.join(b, "s_nationkey").where("s_nationkey % 3 = 0").select("first_id", "second_id", kind.alias("relation"))


_CLUSTERED = """l AS (SELECT s_nationkey AS n, s_suppkey % 2 AS odd, min(s_suppkey) AS low, count(*) AS size FROM supplier GROUP BY ALL),
t AS (SELECT n, count(*) AS halves, min(low) AS low FROM l GROUP BY n),
c AS (SELECT s_suppkey AS member_id, CASE WHEN n % 3 = 0 AND halves = 2 THEN t.low ELSE l.low END AS cluster_id, CASE WHEN n % 3 = 0 AND halves = 2 THEN CASE n % 9 WHEN 0 THEN 'related' WHEN 3 THEN 'transformed_variant' ELSE 'near_duplicate' END ELSE 'verified_exact' END AS relation, (n % 3 = 0 AND halves = 2) OR l.size > 1 AS joined
  FROM supplier JOIN l ON l.n = s_nationkey AND l.odd = s_suppkey % 2 JOIN t USING (n))"""


@query(_W + _CLUSTERED + " SELECT cluster_id, member_id, relation FROM c WHERE joined")
def dataset_clusters(spark, sf_dir):
    """G11."""
    return groups.dataset_clusters(*_edges(spark, sf_dir))


@query(_W + _CLUSTERED + """, a AS (SELECT s_suppkey AS asset_id, '/in/' || s_nationkey || '/' || s_name || '.jpg' AS path, s_suppkey % 13 = 0 AS immutable, round(s_acctbal, 2) AS quality, cluster_id, CASE WHEN joined THEN relation ELSE 'single' END AS relation FROM supplier JOIN c ON member_id = s_suppkey),
k AS (SELECT cluster_id, asset_id AS keeper_id FROM a QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY -quality, path, asset_id) = 1),
h AS (SELECT DISTINCT cluster_id, ('0x' || substr(sha256('s' || chr(0) || cluster_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS p FROM a),
o AS (SELECT a.*, keeper_id, CASE WHEN p < 0.2 THEN 'test' ELSE 'train' END AS split, CASE WHEN immutable THEN 'skip' WHEN relation = 'verified_exact' AND asset_id <> keeper_id THEN 'quarantine' ELSE 'move' END AS operation FROM a JOIN k USING (cluster_id) JOIN h USING (cluster_id)),
d AS (SELECT *, CASE WHEN operation = 'move' THEN '/out/' || split || '/' || regexp_extract(path, '[^/]*$') END AS destination FROM o)
SELECT asset_id, cluster_id, operation, destination, destination IS NOT NULL AND count(*) OVER (PARTITION BY destination) > 1 AS collision, sha256(cluster_id || chr(0) || path || chr(0) || operation) AS action_id FROM d""")
def dataset_actions(spark, sf_dir):
    """M10, M11, M13, C36."""
    s = v.table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("/in/"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".jpg"))
    assets = s.select(F.col("s_suppkey").alias("asset_id"), path.alias("path"), (F.col("s_suppkey") % 13 == 0).alias("immutable"), F.round("s_acctbal", 2).alias("quality"))
    made = dataset.prepare(assets, *_edges(spark, sf_dir), {"train": 0.8, "test": 0.2}, "/out/", "s")
    return made.select("asset_id", "cluster_id", "operation", "destination", "collision", "action_id")


_UNITS = "c AS (SELECT CAST(o_custkey AS VARCHAR) AS cluster_id, CASE WHEN o_orderkey % 50 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS asset_id FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'second', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 300 = 1), a AS (SELECT CAST(o_orderkey AS VARCHAR) AS asset_id FROM orders)"


def _units(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    c = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").cast("string").alias("cluster_id"), F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("asset_id"))
    c = c.union(o.where("o_orderkey % 300 = 1").select(F.lit("second"), key))
    return dataset.units(o.select(key.alias("asset_id")), c)


@query(_W + _UNITS + ", k AS (SELECT cluster_id, list_sort(list(DISTINCT asset_id)) AS m FROM c WHERE asset_id IN (SELECT asset_id FROM a) GROUP BY cluster_id UNION ALL SELECT NULL, [asset_id] FROM a WHERE asset_id NOT IN (SELECT asset_id FROM c)) SELECT CASE WHEN len(m) = 1 THEN sha256('dataset-cluster' || chr(0) || m[1]) ELSE 'dataset-cluster:' || sha256('dataset-cluster' || chr(0) || chr(0) || array_to_string(m, chr(0))) END AS unit_id, unnest(m) AS asset_id FROM k")
def dataset_units(spark, sf_dir):
    """G14, C35."""
    return _units(spark, sf_dir)[0]


@query(_W + _UNITS + " SELECT 'unknown_member' AS kind, asset_id AS id FROM c WHERE asset_id NOT IN (SELECT asset_id FROM a) UNION ALL SELECT 'overlap', asset_id FROM c GROUP BY asset_id HAVING count(DISTINCT cluster_id) > 1 UNION ALL SELECT 'incomplete', cluster_id FROM c GROUP BY cluster_id HAVING count(DISTINCT asset_id) < 2")
def unit_issues(spark, sf_dir):
    """G14."""
    return _units(spark, sf_dir)[1]


@query("WITH m AS (SELECT o_custkey AS group_id, o_orderkey AS asset_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'txt' END AS slot, CASE WHEN o_custkey % 3 = 0 THEN 'd' ELSE o_orderstatus END AS digest FROM orders), n AS (SELECT group_id, count(DISTINCT asset_id) AS members FROM m GROUP BY group_id), s AS (SELECT group_id, slot, count(DISTINCT asset_id) AS have, count(DISTINCT digest) AS contents FROM m WHERE slot IS NOT NULL GROUP BY ALL) SELECT group_id, slot, CASE WHEN contents > 1 THEN 'content_mismatch' ELSE 'presence_mismatch' END AS kind, have, members, contents FROM s JOIN n USING (group_id) WHERE contents > 1 OR have < members")
def sidecar_conflicts(spark, sf_dir):
    """G15."""
    o = v.table(spark, sf_dir, "orders")
    return dataset.sidecar_conflicts(o.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderkey") % 4 != 0, "txt").alias("slot"), F.when(F.col("o_custkey") % 3 == 0, "d").otherwise(F.col("o_orderstatus")).alias("digest")))


@query("SELECT n_regionkey AS region, array_to_string(list(n_nationkey || '=' || CASE WHEN n_nationkey % 5 = 0 THEN 'test' ELSE 'train' END ORDER BY CAST(n_nationkey AS VARCHAR)), ',') AS splits FROM nation GROUP BY n_regionkey")
def split_maps(spark, sf_dir):
    """A map for each region's clusters."""
    n = v.table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").cast("string").alias("cluster_id"), F.when(F.col("n_nationkey") % 5 == 0, "test").otherwise("train").alias("split"))
    maps = [dataset.split_maps(n.where(F.col("n_regionkey") == k)).select(F.lit(k).alias("region"), "cluster_splits") for k in range(5)]
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return _all(maps).where(F.size("cluster_splits") > 0).select("region", F.array_join(F.transform(F.array_sort(F.map_entries("cluster_splits")), entry), ",").alias("splits"))


@query("""WITH o AS (SELECT o_custkey AS cluster_id, o_orderkey AS member_id FROM orders), p AS (SELECT cluster_id + 100000 * (member_id % 2) AS cluster_id, member_id, CASE WHEN member_id % 5 = 0 THEN 'a' ELSE 'b' END AS split FROM o WHERE cluster_id % 3 <> 0),
own AS (SELECT cluster_id, min(split) AS own FROM p GROUP BY cluster_id), votes AS (SELECT o.cluster_id, p.split, count(*) AS n FROM o JOIN (SELECT DISTINCT member_id, split FROM p) p USING (member_id) GROUP BY ALL),
most AS (SELECT cluster_id, split AS most, count(*) OVER (PARTITION BY cluster_id) AS k FROM votes QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, split) = 1)
SELECT c.cluster_id, coalesce(own, most, CASE WHEN ('0x' || substr(sha256('s' || chr(0) || c.cluster_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.5 THEN 'a' ELSE 'b' END) AS split, CASE WHEN own IS NOT NULL THEN 'previous_cluster' WHEN k = 1 THEN 'previous_members' WHEN k > 1 THEN 'majority' ELSE 'hash' END AS reason
FROM (SELECT DISTINCT cluster_id FROM o) c LEFT JOIN own ON own.cluster_id = c.cluster_id LEFT JOIN most ON most.cluster_id = c.cluster_id""")
def kept_splits(spark, sf_dir):
    """Earlier splits of clusters and of their members come first."""
    o = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("member_id"))
    before = o.where("cluster_id % 3 <> 0").select((F.col("cluster_id") + 100_000 * (F.col("member_id") % 2)).alias("cluster_id"), "member_id", F.when(F.col("member_id") % 5 == 0, "a").otherwise("b").alias("split"))
    return dataset.stable_split(o, {"a": 0.5, "b": 0.5}, "s", before)


# -- sources and sinks -------------------------------------------------------------------------


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/kindred-{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS file_id, '/o/' || o_orderkey AS path, o_custkey AS size, o_orderstatus AS digest FROM orders")
def record_lines(spark, sf_dir):
    """Records written as lines and read by their schema."""
    o = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderstatus").alias("digest"))
    path = _path(spark, "records")
    documents.write_lines(o.select("file_id", F.to_json(F.struct(*o.columns)).alias("value")), path)
    return documents.read_records(spark, path, "file").select(*o.columns)


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 = 0")
def odd_records(spark, sf_dir):
    """Lines with fields that the schema doesn't have."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit('{"file_id": '), k.cast("string"), F.when(k % 9 == 0, F.lit(', "colour": 1')).otherwise(F.lit(', "size": 1')), F.lit("}"))
    lines = v.table(spark, sf_dir, "orders").select(line.alias("value"))
    return documents.unknown_fields(lines, "file").select(F.get_json_object("value", "$.file_id").cast("long").alias("k"))


@query(_W + _ORDERS + " SELECT path, CAST(row_number() OVER (PARTITION BY group_id ORDER BY rank) - 1 AS INT) AS rank, is_ref, rank > 0 AND file_id % 4 = 0 AS marked, group_id AS percentage FROM r")
def saved_results(spark, sf_dir):
    """Groups written as XML and read back; the percentage names the group here."""
    m = _orders(spark, sf_dir).withColumn("marked", (F.col("rank") > 0) & (F.col("file_id") % 4 == 0)).withColumn("percentage", F.col("group_id"))
    path = _path(spark, "results")
    documents.write_results(m, path)
    return documents.read_results(spark, path).select("path", "rank", "is_ref", "marked", "percentage")


@query("SELECT a.n_name AS first_path, b.n_name AS second_path FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def ignore_policy(spark, sf_dir):
    """An ignore list in XML."""
    n = v.table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))
    text = "<list>" + "".join(f'<file path="{r.x}"><file path="{r.y}"/></file>' for r in pairs.collect()) + "</list>"  # nations: a table of fixed size
    return documents.ignore_list(spark, text)


@query("SELECT '/' || r_name AS path, CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 3 END AS state FROM region")
def state_policy(spark, sf_dir):
    """Folder states in XML."""
    rows = v.table(spark, sf_dir, "region").collect()  # regions: a table of fixed size
    return documents.directory_policy(spark, "<states>" + "".join(f'<state path="/{r.r_name}" value="{1 if r.r_regionkey % 2 == 0 else 3}"/>' for r in rows) + "</states>")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def table_backup(spark, sf_dir):
    """A copy under a new path, read back."""
    path = _path(spark, "backup")
    documents.backup(v.table(spark, sf_dir, "customer"), path)
    return documents.open_catalog(spark, path, ["c_custkey", "c_name", "c_nationkey"])


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'cached' ELSE 'computed' END AS origin FROM orders")
def digest_cache(spark, sf_dir):
    """What a cache holds for the same generation, the rest computed, and the cache afterwards."""
    f = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"))
    cache = f.where("path % 3 = 0").select("path", (F.col("size") + F.col("path") % 2).alias("size"), F.lit("cached").alias("origin"))
    had, missing = documents.cached(f, cache, ["path", "size"], ["origin"])
    after = documents.refreshed(cache, missing.withColumn("origin", F.lit("computed")), ["path"])
    return after.select("path", "origin")


@query(_W + _ORDERS + """, d AS (SELECT *, CAST(dense_rank() OVER (ORDER BY group_id) - 1 AS INT) AS number FROM r) SELECT number AS "Group ID", name, path FROM d""")
def export_rows(spark, sf_dir):
    """Z1, Z11."""
    return report.csv_rows(_orders(spark, sf_dir), ["name", "path"])


@query(_W + _ORDERS + """ SELECT group_id, rank, CASE WHEN rank = 0 THEN '<tr>' ELSE '<tr class="indented">' END || '<td>' || name || '</td><td>a&amp;b &lt;' || size || '&gt;</td></tr>' AS html FROM r""")
def html_rows(spark, sf_dir):
    """Z2."""
    m = _orders(spark, sf_dir).withColumn("shown", F.concat(F.lit("a&b <"), F.col("size").cast("string"), F.lit(">")))
    return report.html_rows(m, ["name", "shown"])


@query("SELECT m AS capability, true AS available FROM (VALUES ('numpy'), ('pandas'), ('pyarrow'), ('xxhash')) t(m)")
def capabilities(spark, sf_dir):
    """M6: of those this repository needs."""
    return report.doctor(spark).where("capability <> 'PIL'")
