"""The driver's tables as files, names, fingerprints, sequences and snapshots, in Spark and in DuckDB SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.functions.bits import sign_bits
from kindred.functions.text import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file; good ones are references."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    df = d.join(l, "doc_id", "left")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, " copy").otherwise(""), F.lit("."), "lang")
    ref = F.coalesce(F.col("quality") == 1, F.lit(False))
    return df.select(
        F.col("doc_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        name.alias("name"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"), F.col("lang").alias("extension"), ref.alias("is_ref"), F.when(ref, "protected").otherwise("incoming").alias("comparison_pool"),
        "source",
    )


FILES = """files AS (SELECT d.doc_id AS file_id, coalesce(text, '') AS content, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
  'doc_' || d.doc_id || CASE WHEN toxic = 1 THEN ' copy' ELSE '' END || '.' || lang AS name,
  '/lib/' || source || '/' || lang || '/' || 'doc_' || d.doc_id || CASE WHEN toxic = 1 THEN ' copy' ELSE '' END || '.' || lang AS path, lang AS extension,
  coalesce(quality = 1, false) AS is_ref, CASE WHEN coalesce(quality = 1, false) THEN 'protected' ELSE 'incoming' END AS comparison_pool, source
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

GROUPS = FILES + """,
g AS (SELECT *, sha256(content) AS digest, count(*) OVER (PARTITION BY size, content) AS members, min(file_id) OVER (PARTITION BY size, content) AS first_id FROM files),
m AS (SELECT *, 'sha256:' || digest AS group_id FROM g WHERE members > 1)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct name of a part, with its words."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return p.select("id", F.col("p_name").alias("name"), words(F.col("p_name"), ascii_only=True).alias("words"))


NAMES = "names AS (SELECT min(p_partkey) AS id, p_name AS name, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS words FROM part GROUP BY p_name)"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage with its words."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words(F.col("text")).alias("words"))


def _code(text: Column) -> Column:
    """The first 64 bits of a text's MD5."""
    half = lambda at: F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _flips(over: Column) -> Column:
    """A bit for each of 64 values over 0."""
    return sign_bits(over)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit fingerprint of each embedding: five in a row are variants of one code, in which large values flip bits."""
    e = table(spark, sf_dir, "embeddings")
    values = F.slice(F.col("embedding").cast("array<double>"), 1, 64)
    return e.select(F.col("vec_id").alias("id"), _code(F.floor(F.col("vec_id") / 5).cast("string")).bitwiseXOR(_flips(F.transform(values, lambda v: v - 0.2))).alias("fingerprint"), "label", values.alias("values"))


def _flips_sql(test: str) -> str:
    return f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 65), lambda i: CASE WHEN {test} THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END)), lambda a, b: a + b)"


_CODE_SQL = "('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 16))::UBIGINT::HUGEINT"
PRINTS = f"prints AS (SELECT vec_id AS id, xor({_CODE_SQL.format('vec_id // 5')}, {_flips_sql('embedding[i]::DOUBLE > 0.2::DOUBLE')}) AS fingerprint, label FROM embeddings)"

#: The turned side of a picture has other fingerprints, by these codes.
TURN = 0x00F0F00F0FF0A55A


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as the features of a picture: the plain and the turned side, coarse blocks, a histogram, two crops; every third is stored turned, every fourth is a reference."""
    f = fingerprints(spark, sf_dir)
    odd = F.col("id") % 3 == 0
    both = lambda x: F.when(odd, F.array(x.bitwiseXOR(F.lit(TURN)), x)).otherwise(F.array(x, x.bitwiseXOR(F.lit(TURN))))
    dhash = _code(F.concat(F.lit("d"), F.floor(F.col("id") / 5).cast("string"))).bitwiseXOR(_flips(F.transform("values", lambda v: -v - 0.15)))
    base = F.floor(F.col("id") / 5)
    gray = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.lit(40) + (base * 7 + i * 13) % 150 + F.floor(F.element_at("values", i) * 40)).cast("int"))
    blocks = F.transform(gray, lambda g: F.struct(g.alias("r"), (g + 1).alias("g"), (g + 2).alias("b")))
    width, height = (F.lit(100) + base % 2 * 20).cast("int"), F.lit(80)
    return f.select(
        "id", both(F.col("fingerprint")).alias("phashes"), both(dhash).alias("dhashes"), F.transform("values", lambda v: F.floor((v + 1) * 16).cast("int")).alias("histogram"),
        F.struct(F.when(odd, height).otherwise(width).alias("w"), F.when(odd, width).otherwise(height).alias("h")).alias("dimensions"), (F.col("id") % 4 == 0).alias("is_ref"),
        F.when(odd, F.array(F.reverse(blocks), blocks)).otherwise(F.array(blocks, F.reverse(blocks))).alias("blocks"),
        F.array(F.struct(F.lit("center").alias("kind"), _code(F.concat(F.lit("t"), F.floor(F.col("id") / 7).cast("string"))).alias("phash"), dhash.alias("dhash")), F.struct(F.lit("edge").alias("kind"), F.col("fingerprint").alias("phash"), dhash.alias("dhash"))).alias("tiles"),
    )


PICTURES = PRINTS + f""",
basis AS (SELECT id, id // 5 AS base, id % 3 = 0 AS odd, fingerprint AS p, xor({_CODE_SQL.format("'d' || (id // 5)")}, {_flips_sql('-(embedding[i]::DOUBLE) > 0.15::DOUBLE')}) AS d, embedding AS e FROM prints JOIN embeddings ON vec_id = id),
gray AS (SELECT *, list_transform(range(1, 17), lambda i: CAST(40 + (base * 7 + i * 13) % 150 + floor(e[i]::DOUBLE * 40) AS INT)) AS blocks FROM basis),
pics AS (SELECT id, CASE WHEN odd THEN [xor(p, {TURN}::HUGEINT), p] ELSE [p, xor(p, {TURN}::HUGEINT)] END AS phashes, CASE WHEN odd THEN [xor(d, {TURN}::HUGEINT), d] ELSE [d, xor(d, {TURN}::HUGEINT)] END AS dhashes,
  list_transform(e, lambda v: CAST(floor((v::DOUBLE + 1) * 16) AS INT)) AS histogram, CASE WHEN odd THEN 80 ELSE 100 + base % 2 * 20 END AS w, CASE WHEN odd THEN 100 + base % 2 * 20 ELSE 80 END AS h, id % 4 = 0 AS is_ref,
  CASE WHEN odd THEN [list_reverse(blocks), blocks] ELSE [blocks, list_reverse(blocks)] END AS blocks, [['center'::VARCHAR, CAST({_CODE_SQL.format("'t' || (id // 7)")} AS VARCHAR), CAST(d AS VARCHAR)], ['edge'::VARCHAR, CAST(p AS VARCHAR), CAST(d AS VARCHAR)]] AS tiles FROM gray)"""


def pixel_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a picture of 24 x 20 pixels in cells of four, with a plain frame around every third."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    # each cell is made once and repeated
    channel = lambda r, q, c: F.floor(F.abs(F.element_at("e", ((r * 6 + q * 5 + c * 11) % 64 + 1).cast("int"))) * 900).cast("int") % 256
    framed = lambda r, q: (F.col("id") % 3 == 0) & ((r == 0) | (r == 5) | (q == 0) | (q == 4))
    pixel = lambda r, q: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(framed(r, q), 250).otherwise(channel(r, q, c)))
    row = lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda q: F.array_repeat(pixel(r, q), 4)))
    return e.select("id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda r: F.array_repeat(row(r), 4))).alias("pixels"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as the metadata of a video."""
    p = table(spark, sf_dir, "part")
    meta = F.struct((F.col("p_retailprice") / 10).alias("duration_seconds"), (F.col("p_size") * 16).cast("int").alias("width"), (F.length("p_type") * 40).cast("int").alias("height"), F.lit(25.0).alias("frame_rate"), F.col("p_brand").alias("video_codec"), F.lit("yuv420p").alias("pixel_format"))
    return p.groupBy("p_retailprice", "p_size", "p_type", "p_brand").agg(F.min("p_partkey").alias("id")).select("id", meta.alias("meta"))


VIDEOS = "videos AS (SELECT min(p_partkey) AS id, p_retailprice / 10 AS dur, p_size * 16 AS w, length(p_type) * 40 AS h, p_brand AS codec FROM part GROUP BY p_retailprice, p_size, p_type, p_brand)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two scans of all orders: finished orders have gone by the second, open ones weren't there at the first, urgent ones have moved, dear ones have new content."""
    o = table(spark, sf_dir, "orders")
    base = lambda folder: F.concat(F.lit("/orders/"), folder, F.lit("/"), F.col("o_orderkey").cast("string"))
    row = lambda df, path, version: df.select(F.lit(1).cast("long").alias("root_id"), path.alias("path_key"), path.alias("display_path"), F.lit(1).cast("long").alias("volume_id"), F.col("o_orderkey").alias("native_file_id"), F.col("o_orderkey").alias("physical_file_id"), version.cast("long").alias("content_version_id"), F.lit("active").alias("path_state"), F.lit("stable").alias("content_state"))
    before = row(o.where("o_orderstatus <> 'O'"), base(F.lit("a")), F.col("o_orderkey"))
    moved = F.when(F.col("o_orderpriority").startswith("1"), "b").otherwise("a")
    after = row(o.where("o_orderstatus <> 'F'"), base(moved), F.when(F.col("o_totalprice") > 150000, F.col("o_orderkey") + 1_000_000_000).otherwise(F.col("o_orderkey")))
    return before, after


SNAPSHOTS = """before AS (SELECT 1::BIGINT AS root_id, '/orders/a/' || o_orderkey AS path_key, o_orderkey AS id, o_orderkey AS version FROM orders WHERE o_orderstatus <> 'O'),
after AS (SELECT 1::BIGINT AS root_id, '/orders/' || CASE WHEN o_orderpriority LIKE '1%' THEN 'b' ELSE 'a' END || '/' || o_orderkey AS path_key, o_orderkey AS id, CASE WHEN o_totalprice > 150000 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS version FROM orders WHERE o_orderstatus <> 'F'),
old AS (SELECT * FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.path_key = b.path_key)),
new AS (SELECT * FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE a.path_key = b.path_key)),
moved AS (SELECT new.path_key, old.path_key AS old_path_key FROM old JOIN new USING (id) WHERE old.version = new.version),
changes AS (
  SELECT a.root_id, a.path_key, 'modified' AS change_type, true AS content_changed, NULL::VARCHAR AS old_path_key, NULL::VARCHAR AS relation_evidence FROM before b JOIN after a ON a.path_key = b.path_key WHERE a.version <> b.version
  UNION ALL SELECT 1, path_key, 'relocation_candidate', false, old_path_key, 'same_catalog_generation' FROM moved
  UNION ALL SELECT root_id, path_key, 'missing', false, NULL, NULL FROM old WHERE path_key NOT IN (SELECT old_path_key FROM moved)
  UNION ALL SELECT root_id, path_key, 'added', false, NULL, NULL FROM new WHERE path_key NOT IN (SELECT path_key FROM moved))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a sequence of coarse codes of its turns."""
    c = table(spark, sf_dir, "conversations")
    code = F.floor(F.length("text") / 40).cast("long")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", code.alias("v")))), lambda x: x["v"]).alias("frames"))
