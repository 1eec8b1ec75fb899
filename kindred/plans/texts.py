"""Queries of names, display text and identifiers."""

from pyspark.sql import functions as F

from kindred.functions import digests, text
from kindred.operators import match
from kindred.plans import views as v
from kindred.plans.queries import query


@query("WITH " + v.FILES + """ SELECT file_id, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS folder, lower(regexp_extract(name, '[^.]*$')) AS extension, regexp_replace(name, '\\.[^.]*$', '') AS stem,
  regexp_matches(trim(CASE file_id % 4 WHEN 0 THEN '12' WHEN 1 THEN ' (3)' WHEN 2 THEN ' [4' ELSE 'x1' END), '^(\\d+|\\(\\d+\\)|\\[\\d+\\]|\\{\\d+\\})') AS numbered FROM files""")
def name_parts(spark, sf_dir):
    """B1-B3, B16."""
    f = v.files(spark, sf_dir)
    kind = F.col("file_id") % 4
    other = F.concat("name", F.when(kind == 0, "12").when(kind == 1, " (3)").when(kind == 2, " [4").otherwise("x1"))
    return f.select("file_id", text.file_name(F.col("path")).alias("name"), text.folder_of(F.col("path")).alias("folder"), text.extension(F.col("name")).alias("extension"), text.without_extension(F.col("name")).alias("stem"), text.same_with_digit(other, F.col("name")).alias("numbered"))


_SIZED = "s AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 1500 WHEN 1 THEN -CAST(floor(o_totalprice) AS BIGINT) WHEN 2 THEN CAST(floor(o_totalprice) AS BIGINT) * 1000 ELSE CAST(floor(o_totalprice) AS BIGINT) * 1000000 END AS size FROM orders), p AS (SELECT *, CASE WHEN abs(size) < 1024 THEN 0 ELSE CAST(floor(log2(abs(size)) / 10) AS INT) END AS power FROM s)"


@query("WITH " + _SIZED + """ SELECT o_orderkey, CASE WHEN size < 0 THEN '-' ELSE '' END || CAST(ceil(abs(size) / pow(1024, power)) AS BIGINT) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][power + 1] AS size,
  CASE WHEN size < 0 THEN '-' ELSE '' END || printf('%.2f', ceil(abs(size) / pow(1024, power) * 100) / 100) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][power + 1] AS exact_size, printf('%.0f', ceil(abs(size) / 1024)) = ltrim(CAST(CAST(ceil(abs(size) / 1024.0) AS BIGINT) AS VARCHAR), '-') AS kilobytes FROM p""")
def size_text(spark, sf_dir):
    """Sizes of either sign, in their own unit and in a given one."""
    kind = F.col("o_orderkey") % 4
    whole = F.floor("o_totalprice").cast("long")
    size = F.when(kind == 0, F.col("o_custkey") % 1500).when(kind == 1, -whole).when(kind == 2, whole * 1000).otherwise(whole * 1_000_000)
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"))
    forced = text.format_size(F.abs("size"), power=1, unit=False) == F.ceil(F.abs("size") / 1024).cast("string")
    return o.select("o_orderkey", text.format_size(F.col("size")).alias("s"), text.format_size(F.col("size"), 2).alias("exact_size"), forced.alias("kilobytes")).withColumnRenamed("s", "size")


_TWO = "lpad(CAST({0} AS VARCHAR), CAST(greatest(2, length(CAST({0} AS VARCHAR))) AS INT), '0')"


@query(f"""WITH t AS (SELECT *, o_orderkey * 37 AS s, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS sign FROM orders)
SELECT o_orderkey, CASE WHEN sign < 0 AND s > 0 THEN '-' ELSE '' END || {_TWO.format("(s // 3600)")} || ':' || {_TWO.format("(s // 60 % 60)")} || ':' || {_TWO.format("(s % 60)")} AS clock, {_TWO.format("(s // 60)")} || ':' || {_TWO.format("(s % 60)")} AS minutes,
  CASE WHEN s < 60 THEN printf('%.1f', round(s::DOUBLE, 1)) || CASE WHEN round(s::DOUBLE, 1) > 1 THEN ' seconds' ELSE ' second' END WHEN s < 3600 THEN printf('%.1f', round(s / 60, 1)) || CASE WHEN round(s / 60, 1) > 1 THEN ' minutes' ELSE ' minute' END
    WHEN s < 86400 THEN printf('%.1f', round(s / 3600, 1)) || CASE WHEN round(s / 3600, 1) > 1 THEN ' hours' ELSE ' hour' END ELSE printf('%.1f', round(s / 86400, 1)) || CASE WHEN round(s / 86400, 1) > 1 THEN ' days' ELSE ' day' END END AS words,
  strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS moment, CASE WHEN o_orderkey % 3 = 0 THEN '---' ELSE 'shown' END AS before_1970, (o_orderkey % 5) || CASE WHEN o_orderkey % 5 > 1 THEN ' copies' ELSE ' copy' END AS copies FROM t""")
def time_text(spark, sf_dir):
    """C10, C11."""
    o = v.table(spark, sf_dir, "orders")
    s = F.col("o_orderkey") * 37
    when = text.format_timestamp(F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.unix_timestamp("o_orderdate")))
    return o.select(
        "o_orderkey", text.format_time(F.when(F.col("o_orderkey") % 2 == 0, -s).otherwise(s)).alias("clock"), text.format_time(s, False).alias("minutes"), text.format_time_decimal(s.cast("double")).alias("words"), text.format_timestamp(F.unix_timestamp("o_orderdate")).alias("moment"),
        F.when(when == "---", "---").otherwise("shown").alias("before_1970"), text.plural(F.col("o_orderkey") % 5, "copy", 0, "copies").alias("copies"),
    )


@query("""SELECT c_custkey, replace(replace(c_mktsegment, 'A', 'x'), 'E', 'y') AS replaced, replace(replace(c_mktsegment, 'A', ''), 'E', '') AS removed, len(list_distinct(list_transform(range(1, 4), lambda i: c_mktsegment[i]))) <= 1 AS same,
  CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR) AS percentage, array_to_string(string_split(c_name, '#'), ', ') AS words, coalesce(lower(CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_name END), '') AS sorts_by, c_name || chr(65533) || 'x' AS scalar, c_nationkey || ' x ' || (c_nationkey + 1) AS dimensions, -c_nationkey AS less_wide FROM customer""")
def display_values(spark, sf_dir):
    """C7, C8, C11-C13, C42."""
    c = v.table(spark, sf_dir, "customer")
    size = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    d = size(F.col("c_nationkey"), F.col("c_nationkey") + 1)
    letters = F.array(*[F.substring("c_mktsegment", k, 1) for k in (1, 2, 3)])
    return c.select(
        "c_custkey", text.multi_replace(F.col("c_mktsegment"), "AE", "xy").alias("replaced"), text.multi_replace(F.col("c_mktsegment"), "AE").alias("removed"), text.all_same(letters).alias("same"), F.regexp_replace(text.format_percentage(F.col("c_acctbal")), "^-0$", "0").alias("percentage"),
        text.format_words(F.split("c_name", "#")).alias("words"), text.sort_value(F.when(F.col("c_nationkey") % 2 == 1, F.col("c_name"))).alias("sorts_by"), text.scalar_text(F.concat("c_name", F.lit("\x01x"))).alias("scalar"), text.format_dimensions(d).alias("dimensions"),
        text.delta_dimensions(d, size(F.col("c_nationkey") * 2, F.col("c_nationkey")))["w"].alias("less_wide"),
    )




def words_sql(text_sql: str) -> str:
    """C1 in SQL, of text in which marks are stripped."""
    spaced = "translate(" + text_sql + ", '" + text.SEPARATORS + "', '" + " " * len(text.SEPARATORS) + "')"
    return "list_filter(string_split(regexp_replace(lower(" + spaced + "), '[^A-Za-z0-9\\s\\x{037F}-\\x{10FFFF}]', '', 'g'), ' '), lambda x: x <> '')"


_TEXT_WORDS = words_sql("strip_accents(coalesce(text, ''))")


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS n_words, md5(array_to_string(w, '|')) AS words FROM (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents)")
def accented_words(spark, sf_dir):
    """C1 on text that needs the decomposition."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", "|")).alias("words"))


@query("WITH f AS (SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' - ' || p_name || ' - ' || CASE WHEN p_size % 2 = 0 THEN '..' ELSE p_brand END, ' - '), lambda p: " + words_sql("p") + "), lambda w: len(w) > 0) AS f FROM part) SELECT p_partkey, CAST(len(f) AS INT) AS fields, array_to_string(flatten(f), ' ') AS words FROM f")
def name_fields(spark, sf_dir):
    """Parts without words vanish."""
    p = v.table(spark, sf_dir, "part")
    name = F.concat("p_type", F.lit(" - "), "p_name", F.lit(" - "), F.when(F.col("p_size") % 2 == 0, "..").otherwise(F.col("p_brand")))
    f = p.select("p_partkey", text.fields(name).alias("f"))
    return f.select("p_partkey", F.size("f").alias("fields"), F.array_join(text.unpack_fields(F.col("f")), " ").alias("words"))


_POSTED = "p AS (SELECT DISTINCT id, unnest(words) AS word FROM names), c AS (SELECT *, count(*) OVER (PARTITION BY word) AS n FROM p), u AS (SELECT word, id FROM c WHERE n < 50 OR id NOT IN (SELECT id FROM c WHERE n < 50)), x AS (SELECT DISTINCT l.id AS i, r.id AS j FROM u l JOIN u r ON l.word = r.word AND l.id < r.id)"
_LETTERS = "list_sum(list_transform(list_distinct(a.words), lambda x: least(len(list_filter(a.words, lambda y: y = x)), len(list_filter(b.words, lambda y: y = x))) * length(x)))"


@query("WITH " + v.NAMES + ", " + _POSTED + f", s AS (SELECT i AS first_id, j AS second_id, a.words AS aw, b.words AS bw, CAST(round_even(200.0 * {_LETTERS} / (length(array_to_string(a.words, '')) + length(array_to_string(b.words, ''))), 0) AS INT) AS p FROM x JOIN names a ON a.id = i JOIN names b ON b.id = j) SELECT first_id, second_id, CASE WHEN p = 100 AND aw <> bw THEN 99 ELSE p END AS percentage FROM s WHERE p >= 60")
def weighted_word_match(spark, sf_dir):
    """C4, D5 by letters."""
    return match.matches(v.names(spark, sf_dir), 60, score=lambda a, b: text.compare(a, b, weighted=True))


_ID = "sha256('{0}' || chr(0) || '{1}' || chr(0) || array_to_string(list_sort(list_distinct(m)), chr(0)))"
_PREFIXED = "unhex(printf('%016X', strlen({0}))) || encode({0})"


@query("WITH g AS (SELECT o_custkey, list('/o/' || o_orderkey ORDER BY o_orderkey) AS m, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, 'orders:' || " + _ID.format("orders", "v1") + " AS group_id, CASE WHEN n = 1 THEN sha256('dataset-cluster' || chr(0) || m[1]) ELSE 'dataset-cluster:' || " + _ID.format("dataset-cluster", "") + " END AS unit_id, sha256(" + " || ".join(_PREFIXED.format(x) for x in ("m[1]", "CAST(o_custkey AS VARCHAR)", "'-'")) + ") AS member FROM g")
def identifiers(spark, sf_dir):
    """C34, C35, C37."""
    o = v.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    g = o.select("o_custkey", F.transform("k", lambda x: F.concat(F.lit("/o/"), x.cast("string"))).alias("m"))
    return g.select("o_custkey", digests.group_id("orders", F.col("m"), "v1").alias("group_id"), digests.unit_id(F.col("m")).alias("unit_id"), digests.member_digest(F.col("m")[0], F.col("o_custkey"), F.lit(None).cast("string")).alias("member"))


@query("WITH d AS (SELECT o_custkey, o_orderkey, sha256(" + " || ".join(_PREFIXED.format(x) for x in ("'/o/' || o_orderkey", "CAST(o_orderkey AS VARCHAR)")) + ") AS d FROM orders), g AS (SELECT o_custkey, " + "(" + " || ".join(_PREFIXED.format(x) for x in ("'catalog-group-v1'", "'7'", "CAST(count(*) AS VARCHAR)", "'abc'")) + ") AS head, list(d ORDER BY d) AS m FROM d GROUP BY o_custkey) SELECT o_custkey, sha256(head || unhex(array_to_string(list_transform(m, lambda x: '0000000000000040' || hex(encode(x))), ''))) AS group_id FROM g")
def catalog_group_ids(spark, sf_dir):
    """Over the digests of a group's members."""
    o = v.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    m = o.groupBy("o_custkey").agg(F.collect_list(digests.member_digest(F.concat(F.lit("/o/"), key), key)).alias("m"))
    return m.select("o_custkey", digests.catalog_group_id(F.lit(7), F.size("m"), F.lit("abc"), F.col("m")).alias("group_id"))


_DIRTY = "'/' || o_orderstatus || CASE o_orderkey % 4 WHEN 0 THEN '//a/./b/' WHEN 1 THEN '/./a//B' WHEN 2 THEN '/a/b/.' ELSE '///a/b.c/' END"


@query(f"WITH p AS (SELECT o_orderkey, '/' || o_orderstatus || CASE o_orderkey % 4 WHEN 0 THEN '/a/b' WHEN 1 THEN '/a/B' WHEN 2 THEN '/a/b' ELSE '/a/b.c' END AS path_key FROM orders WHERE length({_DIRTY}) > 0) SELECT o_orderkey, path_key, lower(path_key) AS folded, '/' || split_part(path_key, '/', 2) || '/a' AS parent FROM p")
def path_keys(spark, sf_dir):
    """C41."""
    kind = F.col("o_orderkey") % 4
    dirty = F.concat(F.lit("/"), "o_orderstatus", F.when(kind == 0, "//a/./b/").when(kind == 1, "/./a//B").when(kind == 2, "/a/b/.").otherwise("///a/b.c/"))
    key = digests.path_key(dirty)
    return v.table(spark, sf_dir, "orders").select("o_orderkey", key.alias("path_key"), digests.path_key(dirty, fold=True).alias("folded"), digests.parent_key(key).alias("parent"))


_LARGE = "t AS (SELECT r_regionkey AS id, repeat(r_name || r_regionkey, 700000) AS c FROM region UNION ALL SELECT 1000 + doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') FROM documents)"


@query("WITH " + _LARGE + """, n AS (SELECT *, length(c) AS n FROM t) SELECT id, CAST(n AS INT) AS size, sha256(c) AS whole, CASE WHEN n < 32768 THEN sha256(c) ELSE sha256(substr(c, 16385, 16384)) END AS part,
  CASE WHEN n <= 3145728 THEN sha256(c) ELSE sha256(substr(c, n * 25 // 100 + 1, 1048576) || substr(c, n * 60 // 100 + 1, 1048576) || substr(c, n - 1048576 + 1, 1048576)) END AS samples FROM n""")
def digest_kinds(spark, sf_dir):
    """Of every document, and of five contents that are large enough for samples."""
    r = v.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.repeat(F.concat("r_name", F.col("r_regionkey").cast("string")), 700_000).alias("c"))
    d = v.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("c"))
    c = F.col("c").cast("binary")
    return r.union(d).select("id", F.octet_length("c").alias("size"), digests.content_digest(c).alias("whole"), digests.partial_digest(c).alias("part"), digests.sample_digest(c).alias("samples"))
