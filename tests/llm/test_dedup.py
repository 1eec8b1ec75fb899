import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import exactdup, linedup, neardup, setsketch as S, words as W

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, percent=75):
    """Every row is a document; a component is named by its smallest doc_id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    name = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            name[find(k)] = min(i, name.get(find(k), i))
    return sorted(((i, len(s), name[find(k)] if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


# -- the kernel --------------------------------------------------------------------------------


def test_shingles_agree_with_plain_python():
    texts = [None, "", "a", "A b C d", "a b c d e f a b c d e f", "é É\x0bx\x1cy", " \t\n", "x" * 5000]
    assert [len(s) for s in W.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    a, b = W.shingle_sets(pa.array(["The Cat sat", "the  cat\nsat"]))
    assert np.array_equal(a, b)


def test_words_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 16)
    texts = ["aaaa " * 20 + "b" * 100, "short one", "", "c" * 40 + " d"]
    small = [s.tolist() for s in W.shingle_sets(pa.array(texts))]
    monkeypatch.undo()
    assert small == [s.tolist() for s in W.shingle_sets(pa.array(texts))]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 1000, dtype=np.uint64) for _ in range(2))
    assert np.array_equal(np.minimum(S.minima(a), S.minima(b)), S.minima(np.concatenate([a, b])))
    for j in (0.0, 0.4, 0.75, 0.95):
        shared = int(2000 * j / (1 + j))
        x = np.concatenate([a[:shared], a[shared:]])
        y = np.concatenate([a[:shared], b[shared:]])
        ra, rb = (S.registers(S.minima(v))[None] for v in (x, y))
        n = np.array([1000])
        best, ok = S.plausible(ra, rb, n, n, 0.75)
        assert abs(best[0] - j) < 0.2 and (ok[0] or j < 0.7)
        equal = 128 - sum(int(v).bit_count() for v in np.bitwise_or.reduce((S.planes(ra[0]) ^ S.planes(rb[0])).view(np.uint64).reshape(S.PLANES, 2)))
        assert (equal >= S.least_equal(0.75)) or j < 0.7


def thue_morse(a, b, doublings=10):
    """Two words of which polynomial hashes mod 2**64 are equal, whatever the base."""
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_word_hashes_tell_words_apart():
    x, y = thue_morse("a", "b")
    rnd = random.Random(9)
    texts = [x, y, x + x, x + y, y + x, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "abcdefgh" + "12345678", "12345678" + "abcdefgh", "a\x00", "a", "a\x00\x00"] + ["".join(rnd.choices("ab", k=rnd.randrange(1, 40))) for _ in range(2000)]
    raw, at = W.text_bytes(pa.array(texts))
    hashes = W.word_hashes(raw, at[:-1], at[1:])
    assert len(set(hashes.tolist())) == len(set(texts))
    low = W.padded(raw)
    a, b = (np.array(k) for k in zip(*[(i, j) for i in range(60) for j in range(60) if len(texts[i]) == len(texts[j])], strict=True))
    assert W.same_bytes(low, at[a], low, at[b], at[a + 1] - at[a]).tolist() == [texts[i] == texts[j] for i, j in zip(a, b, strict=True)]


# -- near duplicates ---------------------------------------------------------------------------


def test_near_odd_rows(odd, none):
    from .conftest import odd_rows

    rows = got(neardup.near_duplicates(odd))
    assert rows == brute_components(odd_rows())
    assert neardup.near_duplicates(none).count() == 0


def family(rnd, n, words, change):
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    return [" ".join(f"c{rnd.randrange(10**6)}" if rnd.random() < change else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("seed, listed", [(1, 64), (2, 3), (3, 10**9)])
def test_near_equals_brute_force(spark, monkeypatch, seed, listed):
    """Groups around the threshold, chains, a passage that many share; with short and with endless lists of rows."""
    monkeypatch.setattr(neardup, "LISTED", listed)
    rnd = random.Random(seed)
    texts = family(rnd, 60, 120, 0.02) + family(rnd, 40, 60, 0.03) + family(rnd, 60, 140, 0.03) + family(rnd, 10, 300, 0.005)
    chain = [f"k{i}" for i in range(100)]
    for i in range(12):
        chain = chain[2:] + [f"z{i}", f"y{i}"]
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rnd.random()}" for _ in range(rnd.randrange(10, 80))) for _ in range(30)]
    texts += texts[:5] + ["a b c", "a b c", "a b", "", ""]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = neardup.near_duplicates(df)
    assert got(out) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_near_rows_that_repeat_a_doc_id_with_other_texts(spark):
    """Each text has the component of its own, and words of equal polynomial hashes are no duplicates."""
    x, y = thue_morse("a", "b")
    base = [f"w{i}" for i in range(40)]
    near = [*base[:-1], "other"]
    rows = [(5, " ".join(base)), (2, " ".join(near)), (2, "quite another text of several words"), (2, " ".join(near)), (3, "quite another text of several words"), (8, x), (9, y), (1, f"{x} z z z z"), (4, f"{y} z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(neardup.near_duplicates(df)) == brute_components(rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_hubs_of_many_rows_are_dealt_to_several_tasks(spark, monkeypatch, seed):
    """The same answers where a hub stands beside three rows a task only."""
    monkeypatch.setattr(neardup, "AT_A_HUB", 3)
    rnd = random.Random(seed)
    texts = family(rnd, 70, 100, 0.03) + family(rnd, 30, 80, 0.02)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rnd.randrange(500)}" for _ in range(rnd.randrange(5, 40))) for _ in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(neardup.near_duplicates(df)) == brute_components(rows)


# -- exact duplicates --------------------------------------------------------------------------


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, keep[t], len(groups[t]), i is not None and i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)), key=str)


def test_exact_odd_rows(odd, none):
    from .conftest import odd_rows

    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in exactdup.exact_duplicates(odd).select(*cols).collect()), key=str) == brute_exact(odd_rows())
    assert exactdup.exact_duplicates(none).count() == 0


def test_chunks_rebuild_the_text_and_survive_a_shift(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    text = " ".join(rnd.choice(["alpha", "beta,", "gamma.", "delta"]) for _ in range(5000))
    df = spark.createDataFrame([(1, text), (2, "a new beginning. " + text), (3, "x" * 10_000)], "doc_id long, text string")
    cut = {r[0]: r[1] for r in df.select("doc_id", F.regexp_extract_all(exactdup.normalised(F.col("text")), F.lit(exactdup.CHUNK), F.lit(0))).collect()}
    assert "".join(cut[1]) == text and "".join(cut[3]) == "x" * 10_000 and max(map(len, cut[3])) <= exactdup.MOST
    assert len(set(cut[1]) & set(cut[2])) > 0.8 * len(cut[1])


@pytest.mark.parametrize("letters", ["".join(chr(0x4E00 + 7 * i) for i in range(900)), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"])
def test_chunks_resynchronise_in_text_without_marks(spark, letters):
    """Ideographs and encoded data, cut again where they were after something is put in front."""
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    text = "".join(rnd.choices(letters, k=30_000))
    df = spark.createDataFrame([(1, text), (2, letters[:5] + text)], "doc_id long, text string")
    cut = {r[0]: r[1] for r in df.select("doc_id", F.regexp_extract_all("text", F.lit(exactdup.CHUNK), F.lit(0))).collect()}
    assert "".join(cut[1]) == text and len(set(cut[1]) & set(cut[2])) > 0.8 * len(cut[1])


def test_clashing_identifiers_fall_back_on_digests(spark, monkeypatch):
    """With identifiers that say nothing, the verification digests alone tell texts apart."""
    from pyspark.sql import functions as F

    plain = exactdup.recipes
    blind = lambda docs: plain(docs).withColumn("recipe", F.transform("recipe", lambda c: F.struct(F.lit(7).cast("long").alias("id"), c["v1"].alias("v1"), c["v2"].alias("v2"))))
    monkeypatch.setattr(exactdup, "recipes", blind)
    rows = [(1, "a b"), (2, "a  b"), (3, "c"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exactdup.exact_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


# -- lines -------------------------------------------------------------------------------------


def brute_lines(rows, least=40, documents=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    count = defaultdict(int)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].add(i)
                count[k] += 1
    last = {k: max((i for i in held[k] if i is not None), default=None) for k in held if count[k] >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark, odd, none):
    from .conftest import odd_rows

    common = "This line stands in many documents, and is long enough"
    rows = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nrest {i}\n{common}" + ("\n" + "é" * 40 if i < 6 else "")) for i in range(8)]
    rows += [(20, common), (20, common + "\nother text"), (None, common), (21, "x" * 39), (22, "short\n" * 3)]
    cols = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    for data in (rows, odd_rows()):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        assert sorted((tuple(r) for r in linedup.line_dedup(df).select(*cols).collect()), key=str) == brute_lines(data)
    assert linedup.line_dedup(none).count() == 0
    assert linedup.line_dedup(odd).count() == len(odd_rows())


def test_lines_by_a_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(linedup, "SEND", -1)
    line = "z" * 50
    rows = [(i, f"{line}\n{i}") for i in range(6)] + [(None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in linedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str) == brute_lines(rows)
