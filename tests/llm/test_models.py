import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import langmodel as L, license_scan, matroska as M, quality as Q

from .conftest import odd_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- quality -----------------------------------------------------------------------------------


def test_features_don_t_depend_on_neighbours(monkeypatch):
    texts = [t for _, t in odd_rows()] + ["AAA!! b%%% c|", "line one\nline one\nother"]
    together = Q.features(pa.array(texts))
    assert np.isfinite(together).all()
    alone = np.concatenate([Q.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)
    f = dict(zip(Q.FEATURES, together[-1], strict=True))
    assert f["distinct_lines"] == pytest.approx(2 / 3) and f["words_a_line"] == pytest.approx(5 / 3)


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert np.isclose(Q.fit(x[:0], y[:0]).score(x[:3]), 0.5).all()
    assert (Q.fit(x[:50], np.ones(50)).score(x[:3]) > 0.9).all()


def test_classifier_on_held_out_rows(spark, sf_dir, odd, none):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    r = Q.classify(docs, labels).join(labels, "doc_id").toPandas()
    out = r[r.held_out]
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]).all()
    assert len(out) > 5 and (out.predicted == out.quality).mean() > 0.85
    assert Q.classify(none, labels).count() == 0
    got = Q.classify(odd, labels.limit(0)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= x.score <= 1 for x in got)


def test_training_never_sees_held_out_labels(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(Q.remainder() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.classify(docs, x).orderBy("doc_id").toPandas().score.to_numpy() for x in (labels, flipped))
    assert np.array_equal(a, b)


def brute_features(text):
    """FEATURES of one text, counted in plain Python over its bytes and words."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    share = lambda x, y: x / max(y, 1)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    odd = set(b"#$%&*+<=>@[]^_{|}~\\/")
    distinct = lambda xs: len(set(xs)) / len(xs) if xs else 1.0
    lines = [Counter(bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", line)) for line in raw.split(b"\n")]
    lines = [frozenset(x.items()) for x in lines if x]
    n = len(words)
    return [
        math.log1p(len(raw)), math.log1p(n), share(sum(map(len, words)), n), share(sum(65 <= c <= 90 for c in raw), sum(map(letter, raw))), share(sum(48 <= c <= 57 for c in raw), len(raw)), share(sum(33 <= c <= 126 and not letter(c) and not 48 <= c <= 57 for c in raw), len(raw)),
        share(sum(c in odd for c in raw), len(raw)), share(raw.count(b"!"), n), share(raw.count(b"|"), n), share(sum(c >= 128 for c in raw), len(raw)), distinct(low), share(max(Counter(low).values(), default=0), n), distinct([*zip(low, low[1:], low[2:], strict=False)]),
        share(sum(not any(map(letter, w)) for w in words), n), share(sum(len(w) <= 2 for w in words), n), share(sum(65 <= w[0] <= 90 for w in words), n), share(n, sum(c in b".!?" for c in raw)), share(n, raw.count(b"\n") + 1), distinct(lines), share(sum(w[-1] in odd or w[-1:] == b"!" for w in words), n),
    ]


def brute_score(model, x):
    """Walks the lookup tables, one entry after the other."""
    cell = lambda edges, v: sum(v >= e for e in edges)
    total = model.intercept + sum(float(model.tables[f][cell(model.edges[f], v)]) for f, v in enumerate(x))
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        total += float(table[cell(model.coarse[a], x[a])][cell(model.coarse[b], x[b])])
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_quality_scores_equal_brute_force(spark, sf_dir):
    """Every row of classify(): features, bins, tables, the held-out flag and the threshold; odd rows and repeated doc_ids as well."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    extra = spark.createDataFrame([*[(-i, t) for i, (_, t) in enumerate(odd_rows(), 1)], (-1, "other text of the same doc_id"), (None, "x y z")], "doc_id long, text string")
    rows += [(r.doc_id, r.text) for r in extra.collect()]
    got = Q.classify(docs.select("doc_id", "text").union(extra), labels).collect()
    want = [(i, zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0, round(p, 7), int(p >= 0.3)) for i, t in rows for p in [brute_score(model, brute_features(t))]]
    assert sorted(((r.doc_id, r.held_out, round(r.score, 7), r.predicted) for r in got), key=str) == sorted(want, key=str)


# -- language model ----------------------------------------------------------------------------


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    net = L.Network(np.concatenate([rng.random(20) * 100, [10.0], np.full(L.FORMS, 20.0)]), hidden=5, classes=4)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ins, outs = (rng.integers(0, len(net.cls), (3, 6)) for _ in range(2))

    def loss():
        h, total = np.zeros((3, 5)), 0.0
        for t in range(6):
            h = net.step(ins[:, t], h)[0]
            total -= net.token_logs(h, outs[:, t]).sum()
        return total / 3

    grad, _ = net._gradients(ins, outs, np.zeros((3, 5)))
    for k, g in grad.items():
        full = np.zeros_like(net.p[k])
        if isinstance(g, tuple):
            full[g[0]] = g[1]
        else:
            full[...] = g
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in full.shape)
            keep = net.p[k][at]
            net.p[k][at] = keep + 1e-5
            up = loss()
            net.p[k][at] = keep - 1e-5
            down = loss()
            net.p[k][at] = keep
            assert abs((up - down) / 2e-5 - full[at]) < 2e-3, k


def test_probabilities_sum_to_one_and_windows_carry_state():
    rng = np.random.default_rng(4)
    net = L.Network(np.concatenate([rng.random(30) * 100, [10.0], np.full(L.FORMS, 20.0)]), hidden=6, classes=5)
    h = rng.standard_normal((1, 6)).astype(np.float32)
    logs = [net.token_logs(h, np.array([t]))[0] for t in range(len(net.cls))]
    assert math.isclose(sum(math.exp(x) for x in logs), 1.0, rel_tol=1e-4)
    docs = [rng.integers(0, len(net.cls), n) for n in (1, 7, 200, 33, 64, 65)]
    a, b = net.score(docs, window=64), net.score(docs, window=5)
    single = np.array([net.score([d])[0] for d in docs])
    assert np.allclose(a, b, atol=1e-3) and np.allclose(a, single, atol=1e-3)


def test_hash_tables_find_all_keys():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    t = L.Table(keys, np.arange(len(keys)))
    assert np.array_equal(t.find(keys), np.arange(len(keys)))
    assert (t.find(keys + np.uint64(1)) < 0).all()
    assert (L.Table(keys[:0], np.zeros(0, np.int64)).find(keys[:3]) < 0).all()


def brute_scores(rows):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]) for i, t in rows]
    rem = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5
    c = Counter()
    for i, x in tokens:
        if rem(i) != 1:
            c.update(x)
    n, v = sum(c.values()), len(c)
    return sorted(((i, rem(i) == 1, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 4)) for i, x in tokens), key=str)


@pytest.mark.parametrize("lookup", [L.LOOKUP, 3])
def test_base_scores_equal_brute_force(odd, none, monkeypatch, lookup):
    """With a lookup of few words, nearly all counts come by the join."""
    monkeypatch.setattr(L, "LOOKUP", lookup)
    monkeypatch.setattr(L, "HEAD", 100)
    rows = L.score_documents(odd).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str) == brute_scores(odd_rows())
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert L.score_documents(none).count() == 0


def brute_network_scores(model, docs):
    """Each text token by token in plain Python: the gates, the two softmaxes, and the share of a rarer word within its form."""
    net, end = model.network, model.head
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    n = net.hidden
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOW).encode())
    count = Counter(w for i, t in docs if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1 for w in words(t))
    place = {w: int(model.table.find(L.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])))[0]) for w in {w for _, t in docs for w in words(t)}}
    groups = [b"aeiou", b"n", b"t", b"s", b"r", b"dgh", b"ly", b",.;:!?"]
    form = lambda w: next((k for k, g in enumerate(groups) if w[-1] in g), len(groups)) + (len(groups) + 1) * any(c >= 128 for c in w)
    rare = [w for w in count if not 0 <= place[w] < end]
    of_form, kinds = Counter(), Counter(form(w) for w in rare)
    for w in rare:
        of_form[form(w)] += count[w]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda row, h, c: sum(h[i] * row[i][c] for i in range(n))
    out = []
    for _, t in docs:
        h, last, total = [0.0] * n, end, 0.0
        for w in [*words(t), None]:
            inside = w is not None and 0 <= place[w] < end
            token = end if w is None else place[w] if inside else end + 1 + form(w)
            x = [e + b for e, b in zip(p["E"][last], p["b"], strict=True)]
            z = [sigmoid(x[c] + dot(p["U"], h, c)) for c in range(n)]
            r = [sigmoid(x[n + c] + dot(p["U"], h, n + c)) * h[c] for c in range(n)]
            new = [math.tanh(x[2 * n + c] + dot(p["U"], r, 2 * n + c)) for c in range(n)]
            h = [a + g * (b - a) for a, b, g in zip(h, new, z, strict=True)]
            classes = [math.exp(dot(p["C"], h, c) + p["cb"][c]) for c in range(len(p["cb"]))]
            own = int(net.cls[token])
            members = [m for m in range(len(net.cls)) if net.cls[m] == own]
            weights = [math.exp(sum(h[i] * p["W"][m][i] for i in range(n)) + p["wb"][m]) for m in members]
            total += math.log10(classes[own] / sum(classes)) + (math.log10(weights[members.index(token)] / sum(weights)) if len(members) > 1 else 0.0)
            if w is not None and not inside:
                total += math.log10((count[w] + 0.5) / (of_form[form(w)] + 0.5 * (kinds[form(w)] + 1)))
            last = token
        out.append(total)
    return out


@pytest.mark.parametrize("lookup", [L.LOOKUP, 3])
def test_scores_equal_an_independent_scorer(spark, sf_dir, monkeypatch, lookup):
    """Frequent words, words beyond HEAD, words that only the join knows, words never seen, empty and null texts."""
    monkeypatch.setattr(L, "LOOKUP", lookup)
    monkeypatch.setattr(L, "HEAD", 40)
    docs = [(r.doc_id, " ".join((r.text or "").split()[:60])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()] + [(1001, None), (1002, ""), (1003, "Ünseen wörds, never! seen")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held, learn = [], L.learn
    monkeypatch.setattr(L, "learn", lambda d: held.append(learn(d)) or held[-1])
    got = {r.doc_id: r.score for r in L.score_documents(df).collect()}
    want = brute_network_scores(held[0][0], docs)
    assert all(abs(got[i] - s) < 2e-3 + 1e-5 * abs(s) for (i, _), s in zip(docs, want, strict=True))


def test_scores_beat_the_base_on_held_out_texts(spark, sf_dir):
    r = L.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    out = r[r.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_the_network_trains_on_every_training_token(spark):
    """Far more words than START_WORDS, in more documents than were once drawn."""
    docs = spark.range(0, 12_000, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), (F.col("id") % 50).cast("string"), F.lit(" ")), 100).alias("text"))
    model, _, prepared = L.learn(docs)
    assert prepared.count() == 12_000
    assert model.total > L.START_WORDS and model.ends > 9_000
    assert model.trained == model.total


def test_long_documents_are_dealt_in_pieces():
    """No row of the token table is longer than PIECE, and none of a long document's words is cut."""
    texts = ["a b " * 60_000, None, "b", "c " * (L.PIECE - 1), "a " * L.PIECE]
    tokens = [np.array(["abc".index(w) for w in (t or "").split()] + [3], "<u2").tobytes() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13, 14]), pa.array(tokens, pa.binary())], names=["h", "tokens"])
    rows = [r for out in L._pieces([batch]) for r in out.to_pylist()]
    assert max(len(r["tokens"]) // 2 for r in rows) <= L.PIECE
    assert len({(r["h"], r["part"]) for r in rows}) == len(rows)
    for h, text in zip((10, 11, 12, 13, 14), texts, strict=True):
        own = b"".join(r["tokens"] for r in sorted(rows, key=lambda r: r["part"]) if r["h"] == h)
        assert np.frombuffer(own, "<u2").tolist() == ["abc".index(w) for w in (text or "").split()] + [3]


def test_runs_of_a_chunk_predict_all_its_tokens():
    net = L.Network(np.full(30 + L.FORMS, 5.0), hidden=4, classes=3)
    targets = []
    real = net._gradients
    net._gradients = lambda ins, outs, h: targets.append(outs) or real(ins, outs, h)
    for n in (2, 3, 50, 1001, 4099):
        targets.clear()
        chunk = np.arange(n) % len(net.cls)
        assert net.train([chunk], n, (0.005, 0.003), streams=16, steps=8) == n - 1
        seen = np.bincount(np.concatenate([x.ravel() for x in targets]), minlength=len(net.cls))
        want = np.bincount(chunk[1:], minlength=len(net.cls))
        assert (seen >= want).all() and seen.sum() - want.sum() < 16


# -- licenses ----------------------------------------------------------------------------------


def test_license_scan_equals_brute_force(spark, odd, none):
    rows = [
        (1, "All rights reserved. CC-BY cc by"), (2, "under the GNU General Public License, version 3"), (3, "general publicé license"), (4, "cc"), (5, None), (6, ""), (7, "by cc BY by"),
        (8, "Licensed under the Apache License, Version 2.0."), (9, "licensed under the apache license version 3 0"), (10, "Kll rights reserved all\x00rights-reserved"), (11, "cc by"), (12, "word " * 30_000 + "all rights reserved"),
        (13, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        places = [(k, label) for phrase, label in license_scan.PHRASES for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))), i
    assert got[8].labels == "apache-2" and got[13].labels == "mit" and got[8].score == 1.0 and got[4].score == 0.0
    assert license_scan.license_scan(none).count() == 0
    assert license_scan.license_scan(odd).count() == len(odd_rows())


# -- media -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", [M.XIPH, M.FIXED, M.EBML_LACING, M.NO_LACING])
def test_lacing_round_trip(kind):
    frames = [b"abc"] if kind == M.NO_LACING else [bytes([k]) * (300 if kind == M.FIXED else 255 * k + 1) for k in range(6)]
    body = M.lace(frames, kind)
    assert [body[a : a + n] for a, n in M.unlace(body, 0, len(body), kind)] == frames


def test_variable_integers_and_unknown_sizes():
    for n in (0, 126, 127, 128, 16382, 16383, 2**20, 2**40):
        assert M.read_vint(M.vint(n), 0) == (n, len(M.vint(n)))
    assert M.read_vint(b"\xff", 0) == (-1, 1)
    with pytest.raises(ValueError):
        M.read_vint(b"\x00", 0)
    block = M.block(b"x" * 64, 5, M.NO_LACING)
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M.uint(M.TIMESTAMP, 100) + block
    live = M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska")) + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    t = M.parse(live)
    assert [(p[1], p[3]) for p in t["packets"]] == [(105, 64)] * 2 and t["info"]["doc_type"] == "matroska"
    with pytest.raises(ValueError):
        M.parse(M.mux(b"x" * 64)[:-3])


def test_key_flags_and_the_scale_of_times():
    """Blocks of groups are key frames unless they refer to others; times are in milliseconds whatever the file's scale."""
    block = M.element(M.BLOCK, b"\x81" + struct.pack(">h", 3) + b"\x00" + bytes(4))
    group = lambda *more: M.element(M.BLOCK_GROUP, block + b"".join(more))
    cluster = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 10) + group() + group(M.element(M.REFERENCE_BLOCK, b"\xfd")) + M.element(M.SIMPLE_BLOCK, b"\x81" + struct.pack(">h", 4) + b"\x80" + bytes(4)))
    cues = M.element(M.CUES, M.element(M.CUE_POINT, M.uint(M.CUE_TIME, 10) + M.element(M.CUE_POSITIONS, M.uint(M.CUE_TRACK, 1) + M.uint(M.CUE_CLUSTER, 0))))
    for scale, factor in ((1_000_000, 1), (100_000_000, 100)):
        t = M.parse(M.element(M.SEGMENT, M.element(M.INFO, M.uint(M.TIMESTAMP_SCALE, scale)) + cluster + cues))
        assert [(p[1], p[5]) for p in t["packets"]] == [(13 * factor, True), (13 * factor, False), (14 * factor, True)]
        assert t["cues"] == [(10 * factor, 1, 0)]


def test_media_round_trip(odd, none):
    media = M.media_column(odd)
    rows = M.media_digests(media).collect()
    want = sorted((((i, n, len(p), M.hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))) for i, t in odd_rows() for p, n in [M.payload_of(t)]), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str) == want
    packets = M.packet_table(media).collect()
    assert sum(p["size"] for p in packets) == sum(r.payload_bytes for r in rows)
    assert M.media_digests(M.media_column(none)).count() == 0 and M.packet_table(M.media_column(none)).count() == 0
    same = {r.media_sha256 for r in rows if r.doc_id in (3, 4)}
    assert len(same) == 1
