import difflib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from kindred.functions import bits, digests, media, text


def one(spark, column, **values):
    df = spark.createDataFrame([Row(_=0, **values)])
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "name, words",
    [("foo bar", ["foo", "bar"]), ("a - b_c.d", ["a", "b", "c", "d"]), ("it's me", ["its", "me"]), ("", []), (None, []), ("Émile", ["emile"]), ("a\tb", ["a\tb"]), ("日本 語", ["日本", "語"])],
)
def test_words(spark, name, words):
    assert spark.createDataFrame([(name,)], "s string").select(text.words(F.col("s"))).first()[0] == words


@pytest.mark.parametrize(
    "a, b, weighted, pct",
    [
        (["foo", "bar"], ["foo", "bar"], False, 100), (["foo", "bar"], ["bar", "foo"], False, 99), (["foo", "bar"], ["foo"], False, 67), (["a", "a", "b"], ["a", "b"], False, 80),
        (["a", "a"], ["a", "b"], False, 50), ([], ["a"], False, 0), (["foo", "bar"], ["bar", "bleh"], False, 50), (["a", "bbbb"], ["a", "c"], True, 29), (["x"], ["y"], False, 0),
    ],
)
def test_compare(spark, a, b, weighted, pct):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(text.compare(F.col("a"), F.col("b"), weighted)).first()[0] == pct
    if not weighted:
        assert text.words_percentage(a, b, similar=False) == pct


def test_compare_variants(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]], [["c"], ["a", "b"]], ["houses", "mouse"], ["house", "mouse"])], "f array<array<string>>, g array<array<string>>, a array<string>, b array<string>")
    r = df.select(text.compare_fields(F.col("f"), F.col("f")).alias("same"), text.compare_fields(F.col("f"), F.col("g")).alias("ordered"), text.compare_fields_any_order("f", "g").alias("any"), text.compare_similar("a", "b").alias("similar")).first()
    assert (r.same, r.ordered, r.any, r.similar) == (100, 0, 100, 100)


def test_fields(spark):
    df = spark.createDataFrame([("Some Artist - A Song -  - x",)], "s string")
    assert df.select(text.fields(F.col("s"))).first()[0] == [["some", "artist"], ["a", "song"], ["x"]]


@pytest.mark.parametrize("name, ext, stem", [("a.TXT", "txt", "a"), ("a", "", "a"), ("a.", "", "a"), (".x", "x", ""), ("a.b.c", "c", "a.b")])
def test_extension(spark, name, ext, stem):
    df = spark.createDataFrame([(name,)], "s string")
    assert tuple(df.select(text.extension(F.col("s")), text.without_extension(F.col("s"))).first()) == (ext, stem)


def test_display(spark):
    df = spark.createDataFrame([(1024, 1025, 3661, 204, "a1", "a", "a (2)")], "a long, b long, t long, d long, n string, r string, m string")
    r = df.select(
        text.format_size(F.col("a")), text.format_size(F.col("b"), 1), text.format_time(F.col("t")), text.format_time(F.col("d"), False), text.format_time_decimal(F.col("d")), text.same_with_digit(F.col("n"), F.col("r")), text.same_with_digit(F.col("m"), F.col("r")), text.format_timestamp(F.lit(0)),
    ).first()
    assert tuple(r) == ("1 KB", "1.1 KB", "01:01:01", "03:24", "3.4 minutes", True, True, "---")


def test_sizes_of_either_sign_are_rounded_up(spark):
    df = spark.createDataFrame([(-1536,), (1536,), (-1024,), (-1,), (0,), (1025,)], "n long")
    assert [r[0] for r in df.select(text.format_size(F.col("n"))).collect()] == ["-2 KB", "2 KB", "-1 KB", "-1 B", "0 B", "2 KB"]


def close_words(first, second, weighted):
    """The rule told word by word over what is left of the second."""
    left, size, head = list(second), 0, True
    for w in first:
        found = w if w in left else (difflib.get_close_matches(w, left, 1, 0.8) or [None])[0]
        if found is None:
            continue
        head = head and left.index(found) == 0
        left.pop(left.index(found))
        size += len(found) if weighted else 1
    whole = sum(map(len, [*first, *second])) if weighted else len(first) + len(second)
    p = round(200 * size / whole) if first and second else 0
    return 99 if p == 100 and not head else p


@given(st.lists(st.sampled_from(["house", "houses", "mouse", "mouses", "a", "bb", "horse"]), max_size=7), st.lists(st.sampled_from(["house", "houses", "mouse", "housex", "a", "bb", "horses"]), max_size=7), st.booleans())
@settings(max_examples=300, deadline=None)
def test_similar_words_equal_brute_force(first, second, weighted):
    assert text.words_percentage(first, second, True, weighted) == close_words(first, second, weighted)


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=3), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=3), min_size=1, max_size=4))
@settings(max_examples=30, deadline=None)
def test_fields_in_any_order_equal_brute_force(first, second):
    """Each field of the first, in turn, takes the best field that is left."""
    got = text.compare_fields_any_order.func(pd.Series([first]), pd.Series([second]))[0]
    left, worst = list(range(len(second))), 100
    for f in first if len(first) == len(second) else []:
        scores = [text.words_percentage(f, second[k], similar=False) for k in left]
        worst = min(worst, max(scores))
        if max(scores):
            del left[scores.index(max(scores))]
    assert got == (worst if len(first) == len(second) else 0)


def test_digests(spark):
    small, large = b"x" * 100, bytes(range(256)) * 300
    df = spark.createDataFrame([(bytearray(small),), (bytearray(large),)], "c binary")
    import hashlib

    got = [tuple(r) for r in df.select(digests.content_digest(F.col("c")), digests.partial_digest(F.col("c")), digests.sample_digest(F.col("c"))).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [(sha(small),) * 3, (sha(large), sha(large[16384:32768]), sha(large))]


def test_identifiers(spark):
    import hashlib

    df = spark.createDataFrame([(["b", "a", "b"], ["a"])], "m array<string>, s array<string>")
    g, u = df.select(digests.group_id("k", F.col("m")), digests.unit_id(F.col("s"))).first()
    assert g == "k:" + hashlib.sha256(b"k\0\0a\0b").hexdigest()
    assert u == hashlib.sha256(b"dataset-cluster\0a").hexdigest()
    part = int.from_bytes(hashlib.sha256(b"s\0c1").digest()[:8], "big") / 2**64
    split = spark.range(1).select(digests.split_of(F.lit("c1"), "s", {"a": 0.5, "b": 0.5})).first()[0]
    assert split == ("a" if part < 0.5 else "b")
    assert spark.range(1).select(digests.path_key(F.lit("/a//b/./c/"))).first()[0] == "/a/b/c"


def test_phash_and_dhash(spark):
    flat = np.full((32, 32), 7.0)
    assert bits.dct_phash_of(flat) == 0
    rng = np.random.default_rng(1)
    img = rng.random((32, 32)) * 100
    assert bits.dct_phash_of(img) == bits.dct_phash_of(img + 50)
    direct = np.zeros((8, 8))
    for u in range(8):
        for w in range(8):
            a, b = (np.sqrt((1 if k == 0 else 2) / 32) for k in (u, w))
            x, y = (np.cos(np.pi * (2 * np.arange(32) + 1) * k / 64) for k in (u, w))
            direct[u, w] = a * b * (img * np.outer(x, y)).sum()
    expected = (direct.ravel() > np.median(direct.ravel()[1:])).tolist()
    got = bits.dct_phash_of(img)
    assert [bool(got >> i & 1) for i in range(1, 64)] == expected[1:]
    luma = rng.integers(0, 255, 72).tolist()
    d = spark.createDataFrame([(luma,)], "l array<int>").select(bits.dhash(F.col("l"))).first()[0]
    want = sum(int(luma[r * 9 + c] > luma[r * 9 + c + 1]) << (r * 8 + c) for r in range(8) for c in range(8))
    assert d & (2**64 - 1) == want


def test_blocks(spark):
    kind = "array<struct<r:int,g:int,b:int>>"
    df = spark.createDataFrame([([(0, 0, 0)] * 4, [(1, 0, 0)] + [(0, 0, 0)] * 3, [(255, 255, 255)] * 4)], f"a {kind}, b {kind}, c {kind}")
    r = df.select(bits.average_difference(F.col("a"), F.col("a"), 10).alias("s"), bits.average_difference(F.col("a"), F.col("b"), 10).alias("t"), bits.average_difference(F.col("a"), F.col("c"), 10).alias("f"), bits.block_percentage(F.array("c", "a"), F.col("a"), 90).alias("p")).first()
    assert (r.s, r.t, r.f, r.p) == (0, 1, 11, 99)
    with pytest.raises(Exception, match="differ in number"):
        df.select(bits.average_difference(F.col("a"), F.slice("a", 1, 2), 10)).collect()
    px = np.arange(5 * 4 * 3).reshape(5, 4, 3)
    assert bits.blocks_of(px, 2).tolist()[0] == (px[:2, :2].reshape(-1, 3).sum(0) // 4).tolist()
    assert len({o.tobytes() for o in bits.orientations_of(np.arange(9).reshape(3, 3))}) == 8


def test_media(spark):
    probe = '{"format":{"duration":"12.5","bit_rate":"1000","format_name":"mov"},"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"pix_fmt":"yuv420p","avg_frame_rate":"30000/1001"}]}'
    df = spark.createDataFrame([(probe, "pts_time:3.5 x pts_time:1.0 pts_time:99", '{"fingerprint":"1,2,-1","duration":3}', '{"fingerprint":[4294967295,7]}')], "p string, s string, a string, b string")
    r = df.select(media.parse_probe(F.col("p")).alias("m"), media.scene_times(F.col("s"), F.lit(10.0)).alias("t"), media.audio_words(F.col("a")).alias("a"), media.audio_words(F.col("b")).alias("b"), media.rate(F.lit("0/0")).alias("bad"), media.rate(F.lit("N/A")).alias("na")).first()
    assert r.m.duration_seconds == 12.5 and round(r.m.frame_rate, 2) == 29.97 and r.m.audio_codec == "aac"
    assert r.t == [1.0, 3.5] and r.a == [1, 2, 4294967295] and r.b == [4294967295, 7] and r.bad is None and r.na is None


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', "[NaN]", "[" * 70 + "]" * 70])
def test_strict_json(bad):
    with pytest.raises(ValueError):
        media.strict_json(bad)
    assert media.strict_json('{"a":[1,{"b":null}]}') == {"a": [1, {"b": None}]}
