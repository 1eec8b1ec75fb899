"""The ten operators as queries over ``documents``, and SQL for those that SQL can express."""

import string

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import exactdup, langmodel, license_scan, linedup, matroska, mixing, neardup, packing, quality, tokenfile
from kindred.llm.tokens import public_path
from kindred.shared import materialize

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("links", "version")


def op2_exact_dedup(spark, sf_dir):
    return exactdup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("n_chunks", "version")


def op3_token_file(spark, sf_dir):
    return tokenfile.token_file(_table(spark, sf_dir, "documents"), public_path(TOKENIZER), end_id=1)


def op4_lm_score(spark, sf_dir):
    return langmodel.score_documents(_table(spark, sf_dir, "documents"))


def op5_pack(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_path(TOKENIZER), end_id=2)


def op6_mix(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "source", "epoch", "n_tokens", "block", "weight", "block_order", "place")


def op7_quality(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license_scan(spark, sf_dir):
    return license_scan.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op9_media(spark, sf_dir):
    return matroska.media_digests(materialize(matroska.media_column(_table(spark, sf_dir, "documents")), "media"))


def op10_line_dedup(spark, sf_dir):
    return linedup.line_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_exact_dedup, op3_token_file, op4_lm_score, op5_pack, op6_mix, op7_quality, op8_license_scan, op9_media, op10_line_dedup, pipeline)}

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_WHITE = r"[\x20\x09-\x0D]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP1 = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '{_WHITE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= 75 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

_OP2 = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

_OP8 = rf"""
WITH t(template, label, exact, w) AS (VALUES {", ".join(f"({k}, '{label}', {exact}, {text.split()})" for k, (text, label, exact) in enumerate([(*x, True) for x in license_scan.PHRASES] + [(*x, False) for x in license_scan.NOTICES]))}),
g AS (SELECT template, label, exact, len(w) - 1 AS pairs, i - 1 AS tpos, w[i] AS w1, w[i + 1] AS w2 FROM t, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, w[i] AS w1, w[i + 1] AS w2 FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
v AS (SELECT doc_id, template, label, exact, pairs, pos - tpos AS diagonal, min(pos) AS start, max(pos) AS stop, list(DISTINCT tpos) AS hit FROM p JOIN g USING (w1, w2) GROUP BY ALL),
x AS (SELECT *, CASE WHEN exact OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {license_scan.SLACK} THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM x),
z AS (SELECT doc_id, template, label, exact, pairs, span, len(list_distinct(flatten(list(hit)))) AS n, min(start) AS start, max(stop) + 1 AS stop FROM y GROUP BY ALL),
s AS (SELECT *, CASE WHEN exact THEN n = pairs ELSE n >= {license_scan.NOTICE_SHARE} * pairs AND stop - start <= 1.5 * pairs + 1 END AS whole FROM z),
f AS (SELECT doc_id, count(*) FILTER (whole AND exact) AS n_base, min(start) FILTER (whole AND exact) AS first_word, max(start) FILTER (whole AND exact) AS last_word,
    array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (whole AND exact), [])), ',') AS base_labels, array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (whole), [])), ',') AS labels, round(max(n / pairs), 6) AS score FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN f USING (doc_id)
"""

_OP10 = rf"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_TRIM}), {_LOWER}) AS key FROM l),
h AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT r, doc_id, line, pos, h.key IS NULL OR holder IS NOT DISTINCT FROM doc_id AS stays FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""

#: By query.
ORACLE_SQL = {"op1_near_dedup": _OP1, "op2_exact_dedup": _OP2, "op8_license_scan": _OP8, "op10_line_dedup": _OP10}
