import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kindred.llm import mixing, packing, simple8b, tokenfile, tokens

from .conftest import odd_rows


def reference_ids(tokenizer, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return [t.encode(text or "", add_special_tokens=False).ids for _, text in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# -- the code ----------------------------------------------------------------------------------


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    assert np.array_equal(simple8b.decode(simple8b.encode(v)), v)


def test_simple8b_edges():
    edge = [2**60 - 1, 2**60, 2**64 - 1, int(simple8b.ESCAPE), int(simple8b.ESCAPE), 0] + [1] * 500 + [0] * 300
    v = np.array(edge, dtype=np.uint64)
    assert np.array_equal(simple8b.decode(simple8b.encode(v)), v)
    assert len(simple8b.encode(np.ones(240, dtype=np.uint64))) == 1
    assert len(simple8b.encode(np.full(4, 32767, dtype=np.uint64))) == 1
    ids = [np.arange(k, dtype=np.uint32) for k in (3, 0, 500)]
    assert [x.tolist() for x in tokenfile.unpack_block(tokenfile.pack_block(ids))] == [x.tolist() for x in ids]
    with pytest.raises(ValueError):
        tokenfile.unpack_block(b"nope")


def test_cached_encoding_equals_the_library(tokenizer, monkeypatch):
    texts = [t for _, t in odd_rows()] + ["a` `` b`c ` d", "<|ENDOFTEXT|> X <|endoftext|>y", "１２ ½ ΑΣ İs", "a\x1cb ́x", "é É.", "end.", "A.B, c"]
    want = reference_ids(tokenizer, [(0, t) for t in texts])
    enc = tokens.Encoder(tokenizer)
    assert [x.tolist() for x in enc.encode(texts)] == want
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    monkeypatch.setattr(tokens, "AT_ONCE", 100)
    small = tokens.Encoder(tokenizer)
    for _ in range(2):
        assert [x.tolist() for x in small.encode(texts)] == want
    monkeypatch.setattr(tokens, "CACHED_WORDS", 10**6)
    monkeypatch.setattr(tokens, "CACHED_BYTES", 300)
    short = tokens.Encoder(tokenizer)
    for _ in range(3):
        assert [x.tolist() for x in short.encode(texts)] == want
    assert short.written < 20_000 or len(max("".join(t or "" for t in texts).split(), key=len)) > 20_000


def test_words_of_one_hash_are_told_apart(tokenizer, monkeypatch):
    """Two long words of which polynomial hashes are equal; then with hashes that are all alike, within a text and over the cache."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    texts = [f"{x} {y} {y} {x}", y, x, f"{y} short", "another extraordinary sentence", "extraordinary sentences another"]
    want = reference_ids(tokenizer, [(0, t) for t in texts])
    enc = tokens.Encoder(tokenizer)
    assert [e.tolist() for e in enc.encode(texts)] == want and [e.tolist() for e in enc.encode(texts[::-1])] == want[::-1]
    monkeypatch.setattr(tokens, "word_hashes", lambda raw, starts, ends: np.full(len(starts), 7, dtype=np.uint64))
    texts += ["abcdefg1 abcdefg2", "abcdefg2 abcdefg1", "abcdefg" * 40, "abcdefg"]
    want = reference_ids(tokenizer, [(0, t) for t in texts])
    alike = tokens.Encoder(tokenizer)
    for _ in range(2):
        assert [e.tolist() for t in texts for e in alike.encode([t])] == want
    assert [e.tolist() for e in tokens.Encoder(tokenizer).encode(texts)] == want


def test_workers_keep_an_encoder_only_while_they_encode(spark, tokenizer):
    """One worker encodes twice and keeps the encoder in between; a task of another use drops it."""
    import pyarrow as pa

    from kindred import shared

    def told(use):
        def run(batches):
            from kindred import shared as own

            had = [k for k, v in own.KEPT.items() if v]
            if use:
                tokens.encoder(tokenizer)
            for _ in batches:
                yield pa.RecordBatch.from_pydict({"had": [",".join(had)]})

        return run

    seen = lambda use: spark.range(0, 1, 1, 1).mapInArrow(shared.tidy(told(use), use), "had string").first()[0]
    first, second, other, third = seen(tokens.USE), seen(tokens.USE), seen(None), seen(tokens.USE)
    assert second in ("", tokens.USE) and other == "" and third in ("", tokens.USE)


# -- token files -------------------------------------------------------------------------------


@pytest.mark.parametrize("span", [256, 2])
def test_token_file_equals_the_library(odd, none, tokenizer, monkeypatch, span):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(tokenfile, "SPAN", span)
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text", F.xxhash64("text").alias("v")).orderBy("doc_id", "v").collect()]
    ids = reference_ids(tokenizer, rows)
    at, want = 0, []
    for (doc, _), x in zip(rows, ids, strict=True):
        want.append((doc, at, len(x) + 1, crc([*x, 1])))
        at += len(x) + 1
    got = tokenfile.token_file(odd, tokenizer).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tokenfile.token_file(none, tokenizer).count() == 0


# -- packing -----------------------------------------------------------------------------------


def check_pieces(pieces, rows, ids, end=2, window=4096):
    """Every id in one piece, sequences without gaps or padding; repeated documents as often as they come."""
    full = defaultdict(list)
    for (doc, _), x in zip(rows, ids, strict=True):
        full[doc].append([*x, end])
    whole = defaultdict(int)
    for p in pieces:
        whole[p.doc_id] += p.length
        assert any(p.doc_tokens == len(x) and p.ids_crc32 == crc(x[p.start : p.start + p.length]) for x in full[p.doc_id])
    assert whole == {d: sum(map(len, xs)) for d, xs in full.items()}
    seq = defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append((p.offset, p.length))
    assert sorted(seq) == list(range(len(seq)))
    for s in seq.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist()
        n = sum(n for _, n in s)
        assert n <= window and (n == window or n & (n - 1) == 0)


@pytest.mark.parametrize("span", [1024, 2])
def test_packing_holds_every_id_once(odd, none, tokenizer, monkeypatch, span):
    monkeypatch.setattr(packing, "PART_IDS", 20_000)
    monkeypatch.setattr(packing, "SPAN", span)
    rows = odd_rows()
    check_pieces(packing.pack(odd, tokenizer).collect(), rows, reference_ids(tokenizer, rows))
    assert packing.pack(none, tokenizer).count() == 0


def test_many_copies_of_a_row_fill_several_parts(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART_IDS", 2_000)
    monkeypatch.setattr(packing, "COPIES", 20)
    rows = [(7, "the same words again and again")] * 900 + [(i, f"words of document {i}") for i in range(100, 160)] + [(None, None)] * 30
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    pieces = packing.pack(df, tokenizer).collect()
    check_pieces(pieces, rows, reference_ids(tokenizer, rows))
    assert len({p.sequence_id for p in pieces if p.doc_id == 7}) > 3


def test_windows_follow_the_target():
    left = np.array([400_000, 100_000, 50_000])
    target = left / left.sum()
    plan = packing.schedule(left, target, np.zeros(3))
    assert (plan.sum(axis=0) == left).all()
    full = plan[plan.sum(axis=1) == packing.WINDOW] / packing.WINDOW
    assert np.abs(full - target).max() < 0.01
    late = packing.schedule(left, target, np.array([-5000.0, 5000.0, 0.0]))
    assert late[0, 1] > plan[0, 1] and (late.sum(axis=0) == left).all()
    assert sum(packing.sizes(10_000)) == 10_000 and packing.sizes(0) == []
    tiny = packing.schedule(np.array([100_000, 3, 0]), np.array([0.99997, 0.00003, 0.0]), np.zeros(3))
    assert tiny.sum(axis=0).tolist() == [100_000, 3, 0]


@given(st.lists(st.integers(0, 30_000), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_schedules_use_up_every_queue(left):
    left = np.array(left)
    plan = packing.schedule(left, np.full(len(left), 1 / len(left)), np.zeros(len(left)))
    assert (plan.sum(axis=0) == left).all() and (plan >= 0).all()
    assert plan.sum(axis=1).tolist() == packing.sizes(int(left.sum()))


# -- mixing ------------------------------------------------------------------------------------


def test_exponents_meet_their_aims():
    tokens_ = {"a": 1_000_000, "b": 100_000, "c": 10_000, "e": 0}
    a = mixing.bisect_exponent(tokens_, 2.0, None, None)
    often = mixing.epochs(tokens_, mixing.weights(tokens_, a), None)
    assert abs(max(often.values()) - 2.0) < 1e-6 and abs(often["a"] - 1) < 1e-9 and often["e"] == 1.0
    b = mixing.bisect_exponent(tokens_, None, 0.9, None)
    assert abs(mixing.entropy(mixing.weights(tokens_, b)) - 0.9) < 1e-6
    assert mixing.bisect_exponent(tokens_, 1e9, None, None) == 0.0
    assert mixing.bisect_exponent({}, 2.0, None, None) == 0.0
    # Equal sources stand for one key: 3 of 1,000 tokens and 2 of 10.
    each, one, times = {**{f"a{k}": 1000 for k in range(3)}, "b": 10, "c": 10}, {1000: 1000, 10: 10}, {1000: 3, 10: 2}
    for limit, aim in ((1.5, None), (None, 1.4)):
        a, b = mixing.bisect_exponent(each, limit, aim, None), mixing.bisect_exponent(one, limit, aim, None, times=times)
        assert abs(a - b) < 1e-9 and abs(mixing.weights(each, a)["b"] - mixing.weights(one, b, times)[10]) < 1e-12


def brute_mix(spark, df, limit, seed=1):
    """The same choice in plain Python, from the hashes that Spark gives."""
    from pyspark.sql import functions as F

    rows = df.select(F.coalesce("source", F.lit("")).alias("s"), F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), lambda x: x != "")).alias("n")).collect()
    tokens_, docs = defaultdict(int), defaultdict(int)
    for r in rows:
        tokens_[r.s] += r.n
        docs[r.s] += 1
    often = mixing.epochs(tokens_, mixing.weights(tokens_, mixing.bisect_exponent(tokens_, limit, None, None)), None)
    whole = {s: int(often[s] + 1e-9) for s in tokens_}
    rest = {s: max(0.0, often[s] - whole[s]) * tokens_[s] for s in tokens_}
    blocks = {s: -(-docs[s] // mixing.BLOCK_DOCS) for s in docs}
    place = lambda r: r.k % blocks[r.s]
    keys = spark.createDataFrame(sorted({(r.s, place(r)) for r in rows}), "s string, b long").select("s", "b", F.xxhash64("s", "b", F.lit(seed)).alias("h")).collect()
    inner = {r.k: r.h for r in df.select(F.xxhash64("doc_id", "text").alias("k")).distinct().select("k", F.xxhash64("k", F.lit(seed)).alias("h")).collect()}
    again = set()
    for s in tokens_:
        used = 0
        for b in sorted((x for x in keys if x.s == s), key=lambda x: (x.h, x.b)):
            own = [r for r in rows if r.s == s and place(r) == b.b]
            size = sum(r.n for r in own)
            if used >= rest[s]:
                break
            if used + size <= rest[s]:
                again |= {r.k for r in own}
            else:
                upto = 0
                for k in sorted({r.k for r in own}, key=lambda k: (inner[k], k)):
                    upto += sum(r.n for r in own if r.k == k)
                    if upto <= rest[s] - used:
                        again.add(k)
            used += size
    out = [(r.doc_id, e) for r in rows for e in range(whole[r.s] + (r.k in again))]
    return sorted(out, key=str), often, tokens_


def test_mix_equals_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)), "big" if i % 3 else ("small" if i % 2 else None)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, repetition_limit=1.6)
    want, often, tokens_ = brute_mix(spark, df, 1.6)
    assert sorted(((r.doc_id, r.epoch) for r in got.select("row.doc_id", "epoch").collect()), key=str) == want
    used = defaultdict(int)
    for r in got.select("source", "n_tokens").collect():
        used[r[0]] += r[1]
    assert all(often[s] * tokens_[s] - 60 < used[s] <= often[s] * tokens_[s] + 1e-6 for s in tokens_)
    assert mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.select("row.*").columns == odd.columns
    from collections import Counter

    have = Counter(r.doc_id for r in mixed.select("row.doc_id").collect())
    assert all(have[i] >= n for i, n in Counter(i for i, _ in odd_rows()).items())
    monkeypatch.setattr(mixing, "SEND", -1)
    monkeypatch.setattr(mixing, "SEND_SOURCES", -1)
    assert sorted(((r.doc_id, r.epoch) for r in mixing.mix(df, repetition_limit=1.6).select("row.doc_id", "epoch").collect()), key=str) == want
