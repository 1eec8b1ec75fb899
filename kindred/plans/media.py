"""Queries of pictures, videos and their parts."""

from pyspark.sql import functions as F

from kindred.functions import bits, media, pixels
from kindred.operators import pictures, sequence
from kindred.plans import views as v
from kindred.plans.queries import query
from kindred.shared import materialize

# -- pictures ----------------------------------------------------------------------------------

_LIMITS = "(dhash_distance <= 12 OR histogram_distance <= 0.25)"
_HISTOGRAM = "list_sum(list_transform(range(1, 65), lambda i: abs(a.histogram[i] - b.histogram[i]))) / 2048.0"


def _candidates(rotated: bool, dimensions: str, references: bool, within: str = "a.id < b.id") -> str:
    """Every entry of the first against the plain second, the nearest for each pair; by a join of all with all."""
    turns = "generate_series(1, 2)" if rotated else "[1]"
    return f"""t AS (SELECT *, unnest({turns}) AS o FROM pics),
n AS (SELECT a.id AS first_id, b.id AS second_id, CAST(a.o - 1 AS INT) AS orientation, CAST(bit_count(xor(a.phashes[a.o], b.phashes[1])) AS INT) AS phash_distance, CAST(bit_count(xor(a.dhashes[a.o], b.dhashes[1])) AS INT) AS dhash_distance, {_HISTOGRAM} AS histogram_distance
  FROM t a JOIN pics b ON {within} AND bit_count(xor(a.phashes[a.o], b.phashes[1])) <= 8 AND {dimensions}{'' if references else ' AND NOT (a.is_ref AND b.is_ref)'}),
c AS (SELECT *, phash_distance / 64 + dhash_distance / 64 + histogram_distance AS rank FROM n WHERE {_LIMITS}),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY first_id, second_id ORDER BY rank, phash_distance, dhash_distance, histogram_distance, orientation) = 1)"""


_SAME = "a.w = b.w AND a.h = b.h"
_TURNED = f"(({_SAME}) OR (a.w = b.h AND a.h = b.w))"
_SHOWN = "first_id, second_id, phash_distance, dhash_distance, round(histogram_distance, 9) AS histogram_distance, orientation"


def _shown(df):
    return df.select("first_id", "second_id", F.col("phash_distance").cast("int"), F.col("dhash_distance").cast("int"), F.round("histogram_distance", 9).alias("histogram_distance"), "orientation")


@query("WITH " + v.PICTURES + ", " + _candidates(False, _SAME, False) + f" SELECT {_SHOWN} FROM k")
def picture_candidates(spark, sf_dir):
    """D14, B15."""
    return _shown(pictures.candidates(v.pictures(spark, sf_dir), references=False))


@query("WITH " + v.PICTURES + ", " + _candidates(True, _TURNED, True) + f" SELECT {_SHOWN} FROM k")
def turned_candidates(spark, sf_dir):
    """In either orientation."""
    return _shown(pictures.candidates(v.pictures(spark, sf_dir), rotated=True))


def _difference(a: str, b: str, limit: int, least: int) -> str:
    """C21 in SQL, from all running sums."""
    each = f"list_transform(range(1, len({b}) + 1), lambda i: 3 * abs({a}[i] - {b}[i]))"
    sums = f"list_transform(range(1, len({b}) + 1), lambda j: list_sum({each}[1:j]))"
    mean = f"list_sum({each}) // len({b})"
    stopped = f"len(list_filter(range(1, len({b}) + 1), lambda j: j >= {least} AND {sums}[j] > {limit} * j)) > 0"
    return f"CAST(CASE WHEN {stopped} THEN {limit + 1} WHEN list_sum({each}) > 0 AND {mean} = 0 THEN 1 ELSE {mean} END AS INT)"


_PAIRED = "p AS (SELECT a.id AS first_id, b.id AS second_id, a.blocks AS x, b.blocks[1] AS y FROM pics a JOIN pics b ON a.id + 1 = b.id)"


@query("WITH " + v.PICTURES + ", " + _PAIRED + f""", d AS (SELECT *, {_difference('x[1]', 'y', 40, 1)} AS difference, {_difference('x[1]', 'y', 40, 3)} AS plain, {_difference('x[2]', 'y', 40, 3)} AS turned, greatest(0, 100 - {_difference('x[1]', 'y', 768, 3)}) AS s1, greatest(0, 100 - {_difference('x[2]', 'y', 768, 3)}) AS s2 FROM p)
SELECT first_id, second_id, difference, CASE WHEN 100 - plain >= 60 THEN least(100 - plain, 99) WHEN 100 - turned >= 60 THEN least(100 - turned, 99) END AS percentage, greatest(s1, s2) AS similarity, CASE WHEN s2 > s1 THEN 1 ELSE 0 END AS orientation FROM d""")
def block_scores(spark, sf_dir):
    """C20's blocks compared: C21, C23, C24."""
    p = v.pictures(spark, sf_dir).select("id", "blocks")
    a, b = p.alias("a"), p.select((F.col("id") - 1).alias("id"), F.col("blocks")[0].alias("y"))
    x = a.join(b, "id")
    best = bits.block_similarity(F.col("blocks"), F.col("y"))
    return x.select(F.col("id").alias("first_id"), (F.col("id") + 1).alias("second_id"), bits.average_difference(F.col("blocks")[0], F.col("y"), 40).alias("difference"), bits.block_percentage(F.col("blocks"), F.col("y"), 60).alias("percentage"), best["similarity"].alias("similarity"), best["orientation"].alias("orientation"))


_MATCHED = "m AS (SELECT first_id, second_id, " + f"{_difference('a.blocks[1]', 'b.blocks[1]', 20, 3)} AS d1, {_difference('a.blocks[2]', 'b.blocks[1]', 20, 3)} AS d2 FROM k JOIN pics a ON a.id = first_id JOIN pics b ON b.id = second_id), r AS (SELECT first_id, second_id, CASE WHEN d1 <= 20 THEN least(100 - d1, 99) ELSE least(100 - d2, 99) END AS percentage FROM m WHERE d1 <= 20 OR d2 <= 20)"


@query("WITH " + v.PICTURES + ", " + _candidates(True, _TURNED, False) + ", " + _MATCHED + " SELECT * FROM r")
def picture_matches(spark, sf_dir):
    """D15."""
    return pictures.matches(v.pictures(spark, sf_dir), 80, rotated=True)[0]


@query("WITH " + v.PICTURES + ", " + _candidates(True, _TURNED, False) + ", " + _MATCHED + ", q AS (SELECT 'candidates' AS stage, count(*) AS candidates, 1000000 AS most FROM k UNION ALL SELECT 'matches', count(*), 50 FROM r) SELECT stage, candidates, CAST(least(candidates, most) AS BIGINT) AS kept, candidates > most AS limit_reached, candidates <= most AS complete FROM q")
def picture_receipt(spark, sf_dir):
    """What a limit of 50 matches leaves out."""
    return pictures.matches(v.pictures(spark, sf_dir), 80, rotated=True, most_candidates=1_000_000, most_matches=50)[1]


def _evidence(keep: str) -> str:
    block = ", ".join(f"greatest(0, 100 - {_difference(f'a.blocks[{o}]', 'b.blocks[1]', 768, 3)}) AS s{o}" for o in (1, 2))
    return f"""e AS (SELECT k.*, a.w = b.w AND a.h = b.h AS same, {block} FROM k JOIN pics a ON a.id = first_id JOIN pics b ON b.id = second_id),
f AS (SELECT *, greatest(s1, s2) AS block_similarity, CASE WHEN s2 > s1 THEN 1 ELSE 0 END AS block_orientation FROM e),
g AS (SELECT *, CASE WHEN crop THEN 'crop_candidate' WHEN orientation <> 0 OR block_orientation <> 0 OR NOT same THEN 'transformed' WHEN block_similarity >= 95 THEN 'similar' ELSE 'related' END AS relation FROM f)
SELECT first_id, second_id, relation, round(round_even(greatest(block_similarity / 100, 1 - (phash_distance / 64 * 0.5 + dhash_distance / 64 * 0.35 + histogram_distance * 0.15)), 6), 5) AS score, block_similarity, orientation, block_orientation FROM g{keep}"""


def _told(df):
    return df.select("first_id", "second_id", "relation", F.round("score", 5).alias("score"), "block_similarity", "orientation", "block_orientation")


@query("WITH " + v.PICTURES + ", " + _candidates(True, _TURNED, True).replace("FROM n WHERE", ", false AS crop FROM n WHERE") + ", " + _evidence(" WHERE relation <> 'related'"))
def visual_scan(spark, sf_dir):
    """D17, G18, M14."""
    return _told(pictures.evidence(v.pictures(spark, sf_dir), rotated=True))


@query("WITH " + v.PICTURES + ", " + _candidates(True, _TURNED, True, "a.id % 100 = 0 AND a.id <> b.id").replace("FROM n WHERE", ", false AS crop FROM n WHERE") + ", " + _evidence(""))
def visual_query(spark, sf_dir):
    """Every hundredth picture against all."""
    p = v.pictures(spark, sf_dir)
    return _told(pictures.evidence(p.where("id % 100 = 0"), p, related=True, rotated=True))


@query("WITH " + v.PICTURES + """, w AS (SELECT id, 'whole' AS kind, 0 AS o, phashes[1] AS p, dhashes[1] AS d, histogram, w, h FROM pics UNION ALL SELECT id, t[1], 0, t[2]::HUGEINT, t[3]::HUGEINT, histogram, w, h FROM (SELECT *, unnest(tiles) AS t FROM pics)),
n AS (SELECT a.id AS first_id, b.id AS second_id, a.kind AS first_kind, b.kind AS second_kind, bit_count(xor(a.p, b.p)) AS phash_distance, bit_count(xor(a.d, b.d)) AS dhash_distance, """ + _HISTOGRAM + """ AS histogram_distance, a.kind <> 'whole' OR b.kind <> 'whole' AS crop FROM w a JOIN w b ON a.id < b.id AND bit_count(xor(a.p, b.p)) <= 8 AND (a.kind <> 'whole' OR b.kind <> 'whole' OR (a.w = b.w AND a.h = b.h))),
k AS (SELECT *, phash_distance / 64 + dhash_distance / 64 + histogram_distance AS rank FROM n WHERE """ + _LIMITS + """ QUALIFY row_number() OVER (PARTITION BY first_id, second_id ORDER BY rank, crop, phash_distance, dhash_distance, histogram_distance, first_kind, second_kind) = 1)
SELECT first_id, second_id, crop, CAST(phash_distance AS INT) AS phash_distance, CAST(dhash_distance AS INT) AS dhash_distance, first_kind, second_kind FROM k""")
def crop_candidates(spark, sf_dir):
    """D16, C26's entries: whole pictures and crops."""
    found = pictures.candidates(v.pictures(spark, sf_dir), crops=True)
    return found.select("first_id", "second_id", "crop", F.col("phash_distance").cast("int").alias("phash_distance"), F.col("dhash_distance").cast("int").alias("dhash_distance"), "first_kind", "second_kind")


@query("WITH r AS (SELECT o_custkey AS target_id, o_orderkey AS source_id, round(o_totalprice / 1000000, 3) AS score, o_orderkey % 100 AS block_similarity, '/P' || o_orderkey AS path FROM orders) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY score DESC, block_similarity DESC, lower(path)) = 1")
def best_targets(spark, sf_dir):
    """D26."""
    o = v.table(spark, sf_dir, "orders")
    return pictures.best_per_target(o.select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("source_id"), F.round(F.col("o_totalprice") / 1_000_000, 3).alias("score"), (F.col("o_orderkey") % 100).alias("block_similarity"), F.concat(F.lit("/P"), F.col("o_orderkey").cast("string")).alias("path")))


_LUMA = "list_transform(range(0, 72), lambda i: CAST(floor(embedding[i % 64 + 1]::DOUBLE * 500) AS INT))"


@query(f"WITH l AS (SELECT vec_id, {_LUMA} AS l FROM embeddings) SELECT vec_id, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(range(0, 64), lambda i: CASE WHEN l[i // 8 * 9 + i % 8 + 1] > l[i // 8 * 9 + i % 8 + 2] THEN (1::HUGEINT << i) ELSE 0::HUGEINT END)), lambda a, b: a + b) AS VARCHAR) AS dhash FROM l")
def picture_dhash(spark, sf_dir):
    """C17."""
    luma = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(F.element_at(F.col("embedding"), (i % 64 + 1).cast("int")).cast("double") * 500).cast("int"))
    e = v.table(spark, sf_dir, "embeddings").select("vec_id", luma.alias("l"))
    unsigned = F.conv(bits.unsigned_hex(bits.dhash(F.col("l"))), 16, 10)
    return e.select("vec_id", unsigned.alias("dhash"))


_RGB = "list_transform(range(0, 21), lambda i: [CAST(floor(abs(embedding[3 * i + 1]::DOUBLE) * 1000) AS INT) % 256, CAST(floor(abs(embedding[3 * i + 2]::DOUBLE) * 1000) AS INT) % 256, CAST(floor(abs(embedding[3 * i + 3]::DOUBLE) * 1000) AS INT) % 256])"


@query(f"WITH c AS (SELECT vec_id, {_RGB} AS c FROM embeddings), b AS (SELECT vec_id, c, list_transform(c, lambda p: p[1] // 64 * 16 + p[2] // 64 * 4 + p[3] // 64) AS b FROM c) SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda k: len(list_filter(b, lambda x: x = k))), ',') AS histogram, array_to_string(flatten(c), ',') AS colours FROM b")
def color_histograms(spark, sf_dir):
    """Colours from bytes, counted in bins."""
    byte = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.lpad(F.hex(F.floor(F.abs(F.element_at("embedding", i).cast("double")) * 1000) % 256), 2, "0"))
    e = v.table(spark, sf_dir, "embeddings").select("vec_id", bits.bytes_to_colors(F.array_join(byte, "")).alias("c"))
    flat = F.flatten(F.transform("c", lambda p: F.array(p["r"], p["g"], p["b"])))
    return e.select("vec_id", F.array_join(bits.color_histogram(F.col("c")), ",").alias("histogram"), F.array_join(flat, ",").alias("colours"))


@query()
def pixel_features(spark, sf_dir):
    """A10, C16-C18, C20, C25-C28, of pixel grids; held against plain loops in the tests."""
    f = pixels.image_features(v.pixel_grids(spark, sf_dir))
    kinds = F.transform("tiles", lambda t: F.struct(t["kind"], t["phash"], t["dhash"], t["box"]))
    return f.select("id", "dimensions.w", "dimensions.h", "phashes", "dhashes", "blocks", "histogram", kinds.alias("tiles"), "jpeg_artifact_score", "thumbnail")


@query()
def gray_frames(spark, sf_dir):
    """Of frames of gray values; held against plain loops in the tests."""
    g = v.pixel_grids(spark, sf_dir).select("id", F.transform(F.slice("pixels", 1, 16), lambda row: F.transform(F.slice(row, 1, 16), lambda p: p[0].cast("double"))).alias("luma"))
    return materialize(g, "gray").select("id", bits.dct_phash("luma").alias("phash"))


# -- videos ------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_retailprice / 10 END AS duration, CASE WHEN p_size % 7 <> 0 THEN p_size * 16 END AS width, CASE WHEN p_size % 7 <> 0 THEN round(CASE WHEN p_size % 2 = 0 THEN 30000.0 / 1001 ELSE 25 END, 6) END AS rate, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS codec,
  CASE WHEN p_size % 7 <> 0 AND p_size % 3 = 0 THEN 'aac' END AS audio, CASE WHEN p_size % 7 <> 0 THEN p_partkey END AS bit_rate FROM part""")
def probes(spark, sf_dir):
    """The first video and audio stream; nothing without a usable video."""
    p = v.table(spark, sf_dir, "part")
    size = F.col("p_size")
    video = F.struct(F.lit("video").alias("codec_type"), F.col("p_brand").alias("codec_name"), (size * 16).alias("width"), F.when(size % 7 == 0, 0).otherwise(80).alias("height"), F.lit(None).cast("string").alias("duration"), F.when(size % 2 == 0, "30000/1001").otherwise("0/0").alias("avg_frame_rate"), F.lit("25/1").alias("r_frame_rate"))
    audio = F.struct(F.when(size % 3 == 0, "audio").otherwise("data").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("1").alias("duration"), F.lit("0/0").alias("avg_frame_rate"), F.lit("0/0").alias("r_frame_rate"))
    form = F.struct(F.lit("mov").alias("format_name"), (F.col("p_retailprice") / 10).cast("string").alias("duration"), F.col("p_partkey").cast("string").alias("bit_rate"))
    m = p.select("p_partkey", media.parse_probe(F.to_json(F.struct(form.alias("format"), F.array(audio, video).alias("streams")))).alias("m"))
    return m.select("p_partkey", F.col("m.duration_seconds").alias("duration"), "m.width", F.round("m.frame_rate", 6).alias("rate"), F.col("m.video_codec").alias("codec"), F.col("m.audio_codec").alias("audio"), "m.bit_rate")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size * 1.5, p_size * 2.5, p_size * 1.5, 40.5], lambda t: t <= 60))), ',') AS times FROM part")
def scenes(spark, sf_dir):
    """A15."""
    size = F.col("p_size")
    at = lambda x: F.concat(F.lit("frame pts_time: "), F.format_string("%.1f", x.cast("double")), F.lit(" x\n"))
    log = F.concat(at(size * 1.5), at(size * 2.5), at(size * 1.5), at(F.lit(40.5)))
    return v.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(media.scene_times(log, F.lit(60.0)), lambda t: F.format_string("%.1f", t)), ",").alias("times"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1,4294967295,' || p_partkey WHEN 1 THEN '4294967291,' || p_size END AS words FROM part")
def audio_prints(spark, sf_dir):
    """As text, as an array, with a word that is none, empty."""
    kind, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    payload = F.when(kind == 0, F.concat(F.lit('{"duration": 2, "fingerprint": "1, -1,'), F.col("p_partkey").cast("string"), F.lit('"}'))).when(kind == 1, F.concat(F.lit('{"fingerprint": [-5,'), size, F.lit("]}"))).when(kind == 2, '{"fingerprint": "1,x"}').otherwise('{"fingerprint": []}')
    return v.table(spark, sf_dir, "part").select("p_partkey", F.array_join(media.audio_words(payload), ",").alias("words"))


@query("""SELECT p_partkey, round(p_size * 16.0 / (length(p_type) * 40), 9) AS aspect, CAST(round_even(ln(p_size * 16.0 / (length(p_type) * 40)) / ln(1.025), 0) AS INT) AS aspect_bucket, CAST(floor(ln(p_retailprice / 10) / ln(1.25)) AS INT) AS duration_bucket,
  CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 32 WHEN 3 THEN 8 ELSE 0 END AS depth, CASE WHEN p_size % 2 = 0 THEN 12 WHEN p_size % 5 = 1 THEN 16 WHEN p_size % 5 = 3 THEN 8 ELSE CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 5 = 2 THEN 32 ELSE 8 END END AS ranked_depth, CASE p_size % 3 WHEN 0 THEN p_size::DOUBLE END AS number FROM part""")
def media_numbers(spark, sf_dir):
    """C29, C31, C32, C43, C44."""
    size, p = F.col("p_size"), v.table(spark, sf_dir, "part")
    aspect = media.aspect_ratio(size * 16, F.length("p_type") * 40)
    mode = F.when(size % 5 == 0, "1").when(size % 5 == 1, "I;16B").when(size % 5 == 2, "F").when(size % 5 == 3, "RGB").otherwise("?")
    text = F.when(size % 3 == 0, size.cast("string")).when(size % 3 == 1, "NaN").otherwise("-1")
    return p.select(
        "p_partkey", F.round(aspect, 9).alias("aspect"), media.aspect_bucket(aspect).alias("aspect_bucket"), media.duration_bucket(F.col("p_retailprice") / 10).alias("duration_bucket"), media.bit_depth(mode).alias("depth"),
        media.bit_depth(mode, F.when(size % 2 == 0, 12), 8).alias("ranked_depth"), media.finite(text).alias("number"),
    )


@query("""WITH p AS (SELECT p_partkey, p_size, (p_size % 10) / 10 AS score, p_size % 6 AS matched, 0.8 + (p_size % 3) / 20 AS ca, 0.9 AS cb, CASE p_size % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'empty_input' ELSE 'complete' END AS sound, (p_size % 7) / 7 AS heard, p_size % 2 = 0 AS changed, CASE WHEN p_size % 4 = 0 THEN 0.5 ELSE 1.0 END AS ratio FROM part),
s AS (SELECT *, CASE WHEN sound = 'complete' THEN 0.78 * score + 0.22 * heard ELSE score END AS s, least(ca, cb) AS low, greatest(ca, cb) AS high FROM p)
SELECT p_partkey, CASE WHEN p_size % 11 <> 0 THEN CASE WHEN matched >= 3 AND s >= 0.84 AND low >= 0.82 AND changed THEN 'transcoded' WHEN matched >= 3 AND s >= 0.76 AND high >= 0.82 AND (low < 0.82 OR ratio < 0.9) THEN 'trimmed' WHEN matched >= 3 AND s >= 0.88 AND low >= 0.82 THEN 'near_duplicate' WHEN s >= 0.35 THEN 'related' END END AS relation, CASE WHEN p_size % 11 <> 0 THEN round(s, 9) END AS score FROM s""")
def video_relations(spark, sf_dir):
    """From alignments and metadata."""
    p, size = v.table(spark, sf_dir, "part"), F.col("p_size")
    frame = F.struct(F.when(size % 11 == 0, "resource_limit").otherwise("complete").alias("state"), (size % 10 / 10).alias("score"), (size % 6).alias("matched"), (F.lit(0.8) + size % 3 / 20).alias("coverage_first"), F.lit(0.9).alias("coverage_second"))
    audio = F.when(size % 5 != 0, F.struct(F.when(size % 5 == 1, "empty_input").otherwise("complete").alias("state"), (size % 7 / 7).alias("score")))
    side = lambda seconds, codec: F.struct(seconds.alias("duration_seconds"), F.lit(640).alias("width"), F.lit(480).alias("height"), codec.alias("video_codec"), F.lit("yuv").alias("pixel_format"))
    r = p.select("p_partkey", sequence.relation(frame, audio, side(F.lit(100.0), F.lit("a")), side(F.when(size % 4 == 0, 50.0).otherwise(100.0), F.when(size % 2 == 0, "b").otherwise("a"))).alias("r"))
    return r.select("p_partkey", "r.relation", F.round("r.score", 9).alias("score"))


@query()
def frame_plans(spark, sf_dir):
    """G19, over every part as a video with two scene cuts; held against brute force in the tests."""
    p = v.table(spark, sf_dir, "part")
    return p.select("p_partkey", sequence.frame_times(F.col("p_retailprice") / 10, F.array(F.col("p_size").cast("double"), F.col("p_size") + 0.05)).alias("times"))


@query()
def compared_sequences(spark, sf_dir):
    """Each conversation's sequence against the next one's; held against brute force in the tests."""
    s = v.sequences(spark, sf_dir)
    meta = F.struct((F.size("frames") * 10.0).alias("duration_seconds"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("a").alias("video_codec"), F.lit("yuv").alias("pixel_format"))
    artifacts = s.select(F.col("conv_id").alias("id"), meta.alias("meta"), "frames", F.transform("frames", lambda x: x * 3).alias("audio"))
    pairs = artifacts.select(F.col("id").alias("first_id"), (F.col("id") + 1).alias("second_id"))
    out = sequence.compare_sequences(pairs, artifacts)
    return out.select("first_id", "second_id", "relation", F.round("score", 9).alias("score"), F.col("frame.matched").alias("matched"), F.col("sound.state").alias("sound"), "incomplete")
