import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kindred.functions.text import words
from kindred.operators import catalog, dataset, exact, files as fs, folders, groups, hamming, hot, ignore, match, pictures, rank, report, sequence
from kindred.operators.components import connected_components


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# -- exact -------------------------------------------------------------------------------------


def test_exact_groups_hold_only_equal_bytes(spark):
    f = spark.createDataFrame([(1, bytearray(b"aa")), (2, bytearray(b"aa")), (3, bytearray(b"ab")), (4, None), (5, bytearray(b"")), (6, bytearray(b""))], "file_id long, content binary")
    for staged in (False, True):
        assert rows(exact.exact_groups(f, staged=staged), "first_id", "file_id") == [(1, 1), (1, 2), (5, 5), (5, 6)]
    assert exact.exact_groups(f.limit(0)).count() == 0
    assert rows(exact.pair_count(exact.exact_groups(f)), "pairs") == [(1,), (1,)]
    assert rows(exact.pairs(exact.exact_groups(f)), "first_id", "second_id", "percentage") == [(1, 2, 100), (5, 6, 100)]
    with pytest.raises(ValueError):
        exact.require_equal(f.where("file_id in (1, 3)"))


def test_colouring_parts_ignored_pairs(spark):
    m = spark.createDataFrame([("g", i, f"/{i}", "txt") for i in range(1, 5)], "group_id string, file_id long, path string, extension string")
    ig = ignore.canonical(spark.createDataFrame([("/1", "/2"), ("/2", "/1"), ("/2", "/3"), ("/x", "/x")], "first_path string, second_path string"))
    assert ig.count() == 2
    assert rows(exact.colour(m, ig), "file_id", "colour") == [(1, 0), (2, 1), (3, 0), (4, 0)]
    done = exact.colour(m, ig).withColumn("is_ref", F.lit(False)).withColumn("comparison_pool", F.when(F.col("file_id") == 4, "protected"))
    assert rows(exact.finish(done, cross_pool=True), "file_id") == [(1,), (3,), (4,)]


# -- names -------------------------------------------------------------------------------------


def objects(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "id long, name string").select("id", words(F.col("name")).alias("words"))


def test_common_words_are_kept_only_without_others(spark):
    o = objects(spark, [f"the n{i}" for i in range(5)] + ["the", "the"])
    p = match.uncommon_postings(o, common=5)
    assert rows(p.where("word = 'the'"), "id") == [(5,), (6,)]
    assert p.where("word <> 'the'").count() == 5


def test_matches_equal_brute_force(spark):
    rnd = random.Random(3)
    names = [" ".join(rnd.choices(["a", "b", "c", "dd", "ee", "fff"], k=rnd.randint(1, 4))) for _ in range(30)]
    o = objects(spark, names)
    got = rows(match.matches(o, 60), "first_id", "second_id", "percentage")

    def percentage(a, b):
        """Words struck off a copy of the second, one by one."""
        rest, shared, ordered = list(b), 0, True
        for k, w in enumerate(a):
            if w in rest:
                ordered = ordered and rest.index(w) == 0
                del rest[rest.index(w)]
                shared += 1
        p = round(200 * shared / (len(a) + len(b)))
        return 99 if p == 100 and not ordered else p

    want = [(i, j, p) for i, j in itertools.combinations(range(30), 2) if set(names[i].split()) & set(names[j].split()) and (p := percentage(names[i].split(), names[j].split())) >= 60]
    assert got == want


def test_too_many_comparisons_fail_before_the_join(spark, monkeypatch):
    monkeypatch.setattr(match, "MOST_COMPARISONS", 3)
    with pytest.raises(match.MatchLimit):
        match.matches(objects(spark, ["a"] * 4), 60)


def test_similar_words_merge_into_the_shortest(spark):
    v = spark.createDataFrame([("mouse",), ("mouses",), ("house",), ("zebra",)], "word string")
    got = dict(rows(match.similar_words(v), "word", "canonical"))
    assert got == {"house": "house", "mouse": "house", "mouses": "mouses", "zebra": "zebra"}


def test_timestamps(spark):
    p = spark.createDataFrame([(1, "2020", "a"), (2, "2020", "b"), (3, "0000:00:00 00:00:00", "a"), (4, "0000:00:00 00:00:00", "a"), (5, "", "a"), (6, "", "a"), (7, None, "a")], "id long, ts string, dimensions string")
    assert rows(match.timestamp_matches(p), "first_id", "second_id") == [(1, 2)]
    assert match.timestamp_matches(p, scaled=False).count() == 0


# -- fingerprints ------------------------------------------------------------------------------


@pytest.mark.parametrize("bits, radius", [(16, 3), (12, 2), (64, 8), (4, 3)])
def test_hamming_pairs_equal_brute_force(spark, bits, radius):
    rnd = random.Random(bits)
    prints = [rnd.getrandbits(bits) for _ in range(60)]
    prints += [p ^ 1 for p in prints[:10]] + prints[:5]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    e = spark.createDataFrame(list(enumerate(signed)), "id long, fingerprint long")
    want = sorted((i, j, d) for i, j in itertools.combinations(range(len(prints)), 2) if (d := (prints[i] ^ prints[j]).bit_count()) <= radius)
    assert rows(hamming.hamming_pairs(e, radius, bits), "first_id", "second_id", "distance") == want
    probe = e.where("id = 0").select(F.col("id").alias("probe_id"), "fingerprint")
    assert rows(hamming.query(e, probe, radius, bits), "id", "distance") == sorted((j, d) for i, j, d in want if i == 0)
    with pytest.raises(ValueError):
        hamming.guarded(hamming.hamming_pairs(e, radius, bits), len(want) - 1)


def test_radii_beyond_the_bits_are_no_search(spark):
    e = spark.createDataFrame([(1, 1), (2, 2)], "id long, fingerprint long")
    with pytest.raises(ValueError):
        hamming.hamming_pairs(e, 4, 4)


def test_picture_candidates(spark):
    flat = [0] * 63 + [1024]
    kind = "id long, phashes array<long>, dhashes array<long>, histogram array<int>, dimensions struct<w:int,h:int>, is_ref boolean, tiles array<struct<kind:string,phash:long,dhash:long>>, blocks array<array<struct<r:int,g:int,b:int>>>"
    grid, other = [(10, 10, 10)] * 4, [(200, 10, 10)] * 4
    p = spark.createDataFrame(
        [(1, [0, 7], [0, 0], flat, (10, 20), False, [("center", 2**40, 0)], [grid, other]), (2, [7], [0], flat, (20, 10), False, [], [other]), (3, [0], [0], flat, (10, 20), True, [], [grid]), (4, [0], [0], flat, (10, 20), True, [], [other]), (5, [2**40], [0], flat, (5, 5), False, [], [grid])],
        kind,
    )
    assert rows(pictures.candidates(p, radius=0, references=False), "first_id", "second_id") == [(1, 3), (1, 4)]
    assert (1, 2, 1) in rows(pictures.candidates(p, radius=0, rotated=True), "first_id", "second_id", "orientation")
    assert (1, 5, "center", "whole") in rows(pictures.candidates(p, radius=0, crops=True), "first_id", "second_id", "first_kind", "second_kind")
    found, receipt = pictures.matches(p, 95, radius=0)
    assert rows(found, "first_id", "second_id", "percentage") == [(1, 3, 99)] and rows(receipt, "stage", "kept", "complete") == [("candidates", 2, True), ("matches", 1, True)]
    told = {(r.first_id, r.second_id): (r.relation, r.block_similarity) for r in pictures.evidence(p, radius=0, rotated=True, related=True).collect()}
    assert told[1, 3] == ("similar", 100) and told[1, 2] == ("transformed", 100) and told[3, 4] == ("related", 0)
    assert rows(pictures.evidence(p.where("id = 4"), p, radius=0, related=True), "second_id") == [(1,), (3,)]


# -- groups ------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(80, 100)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_greedy_groups_are_disjoint_cliques(edges):
    known = {(min(a, b), max(a, b)): p for a, b, p in edges if a != b}
    made = groups.greedy_cliques([(a, b, p) for (a, b), p in known.items()])
    members = [m for g in made for m in g]
    assert len(members) == len(set(members))
    assert all((min(a, b), max(a, b)) in known for g in made for a, b in itertools.combinations(g, 2))


def test_better_matches_group_first():
    assert groups.greedy_cliques([(1, 2, 80), (2, 3, 90)]) == [[2, 3]]
    assert [sorted(g) for g in groups.greedy_cliques([(1, 2, 100), (1, 3, 100), (2, 3, 100)])] == [[1, 2, 3]]
    assert sorted(map(sorted, groups.greedy_cliques([(1, 2, 100), (3, 4, 90), (1, 3, 80)]))) == [[1, 2], [3, 4]]


def test_components_and_invariants(spark):
    chain = [(i, i + 1, 100) for i in range(1, 40)] + [(100, 101, 100), (101, 102, 100), (100, 102, 100), (100, 100, 100), (None, 5, 1)]
    e = spark.createDataFrame(chain, "first_id long, second_id long, percentage int")
    c = dict(rows(connected_components(e), "member_id", "component_id"))
    assert {c[i] for i in range(1, 41)} == {1} and {c[i] for i in (100, 101, 102)} == {100}
    assert connected_components(e.limit(0)).count() == 0
    g = spark.createDataFrame([("a", 100), ("a", 101), ("a", 102), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 3)], "group_id string, member_id long")
    got = {r[0]: r[1:] for r in rows(groups.invariants(g, e.where("first_id is not null")), "group_id", "connected", "clique", "star")}
    assert got["b"] == (True, False, True) and got["c"] == (False, False, False)


def test_group_percentage(spark):
    """The best match, 2 and 3, makes the group; 2, its first member, is the reference, so 90 and 99 count."""
    m = spark.createDataFrame([(1, 2, 90), (1, 3, 81), (2, 3, 99)], "first_id long, second_id long, percentage int")
    g = groups.clique_groups(m)
    assert rows(g, "member_id", "rank") == [(1, 2), (2, 0), (3, 1)]
    assert rows(groups.group_percentage(g, m), "percentage") == [(94,)]


def brute_groups(edges):
    """The rule as it is told: matches from the best on; a file is claimed by one group at first sight, is a member once it matches all members; what touches no member is grouped again."""
    todo, out = sorted(edges, key=lambda e: (-e[2], e[0], e[1])), []
    while todo:
        owner, member, match = {}, [], set()
        for a, b, _ in todo:
            if a not in owner and b not in owner:
                owner[a] = owner[b] = len(member)
                member.append([])
            elif a not in owner:
                owner[a] = owner[b]
            elif b not in owner:
                owner[b] = owner[a]
            if owner[a] != owner[b]:
                continue
            match |= {(a, b), (b, a)}
            g = member[owner[a]]
            g += [x for x in (a, b) if x not in g and all((x, o) in match for o in g)] if not g or len({a, b} - set(g)) == 1 else []
        good = [g for g in member if len(g) > 1]
        out += good
        used = {x for g in good for x in g}
        rest = [e for e in todo if not {e[0], e[1]} & used]
        if len(rest) == len(todo):
            break
        todo = rest
    return out


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(80, 84)), max_size=40))
@settings(max_examples=300, deadline=None)
def test_greedy_groups_equal_brute_force(edges):
    known = {(min(a, b), max(a, b)): p for a, b, p in edges if a != b}
    todo = [(a, b, p) for (a, b), p in known.items()]
    assert [sorted(g) for g in groups.greedy_cliques(todo)] == [sorted(g) for g in brute_groups(todo)]


# -- large groups ------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [10**6, 5])
def test_ranks_in_windows_and_by_a_sort_are_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(hot, "MOST_IN_WINDOW", most)
    rnd = random.Random(8)
    data = [(rnd.choice("aaaab"), rnd.randrange(10), i) for i in range(60)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(3)
    want = {}
    for g in "ab":
        for k, (_, _, i) in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[i] = k
    got = hot.ranked(df, "g", [F.col("v").desc(), F.col("i")])
    assert got.schema["rank"].dataType.simpleString() == "int"
    assert {r.i: r["rank"] for r in got.collect()} == want
    assert hot.ranked(df.limit(0), "g", ["i"]).count() == 0


def test_running_sums_and_numbers_over_spans(spark):
    rnd = random.Random(4)
    data = [(rnd.choice("xy"), i, rnd.randrange(9)) for i in range(80)]
    df = spark.createDataFrame(data, "k string, at int, n int").repartition(3)
    for by in ((), ("k",)):
        got = hot.running_sums(df, {"before": "n"}, ["at"], F.floor(F.col("at") / 7), by)
        want = {i: sum(n for c, j, n in data if j < i and (not by or c == k)) for k, i, _ in data}
        assert {r.at: r.before for r in got.collect()} == want
    assert [(r.at, r.place) for r in hot.numbered(df.orderBy("at"), "place").orderBy("place").collect()] == [(i, i) for i in range(80)]


def test_hot_groups_join_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(hot, "PARTS", 4)
    df = spark.createDataFrame([("a" if i % 3 else f"g{i}", i) for i in range(60)] + [(None, 99)], "k string, i int")
    sizes = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    got = {r.i: r.n for r in hot.join_groups(df, sizes, ["k"], "n", 61).collect()}
    assert got == {**{i: 40 if i % 3 else None for i in range(60)}, 99: None}


def test_pairs_are_guarded(spark):
    f = spark.createDataFrame([(i, bytearray(b"aa")) for i in range(10)], "file_id long, content binary")
    g = exact.exact_groups(f)
    assert exact.pairs(g).count() == 45
    with pytest.raises(ValueError):
        exact.pairs(g, most=44)
    with pytest.raises(match.MatchLimit):
        match.timestamp_matches(spark.createDataFrame([(i, "2020", "a") for i in range(4)], "id long, ts string, dimensions string"), most=5)


# -- ranking -----------------------------------------------------------------------------------


def members(spark, *files):
    return spark.createDataFrame([("g", i, n, p, s, r) for i, (n, p, s, r) in enumerate(files)], "group_id string, file_id long, name string, path string, size long, is_ref boolean")


def test_keepers(spark):
    m = members(spark, ("a.png", "/x/a.png", 10, False), ("a copy.png", "/x/a copy.png", 10, False), ("a.png", "/downloads/a.png", 10, False), ("z.txt", "/z.txt", 1, True))
    got = {r.file_id: r for r in rank.choose_keepers(m).collect()}
    assert [got[i]["rank"] for i in range(4)] == [1, 2, 3, 0]
    text = {r.file_id: r.explanation for r in rank.explanations(rank.choose_keepers(m)).collect()}
    assert text[3].startswith("keep: a reference") and "named like a copy" in text[1]


def test_filters_marks_and_removal(spark):
    m = members(spark, ("a", "/x/a", 1, False), ("b", "/y/b", 2, False), ("c", "/y/c", 3, False)).withColumn("rank", F.col("file_id").cast("int"))
    assert rows(rank.filtered(m, "/Y/").where("shown"), "file_id") == [(1,), (2,)]
    assert rank.filtered(m, "/x/", "/y/").count() == 0
    marks = spark.createDataFrame([(0,), (1,)], "file_id long")
    assert rows(rank.marked(m, marks).where("marked"), "file_id") == [(1,)]
    assert rows(rank.marked(m, marks, inverted=True).where("marked"), "file_id") == [(2,)]
    assert rank.remove_members(m, marks).count() == 0
    assert rows(rank.switch_reference(m, marks.where("file_id = 1")).where("rank = 0"), "file_id") == [(1,)]
    assert rows(rank.deltas(m, ["size"], ["name"]).where("rank > 0"), "delta_size", "differs_name") == [(1, True), (2, True)]


# -- files -------------------------------------------------------------------------------------


def test_states_come_from_the_nearest_folder(spark):
    f = spark.createDataFrame([(1, "/a/b/x"), (2, "/a/x"), (3, "/c/x"), (4, "/c/.h/x")], "file_id long, path string")
    s = spark.createDataFrame([("/a", 1), ("/a/b", 3)], "path string, state int")
    assert rows(fs.directory_states(f, s), "file_id", "state") == [(1, 3), (2, 1), (3, 0), (4, 2)]
    assert rows(fs.folders_of(f), "folder", "depth") == [("/a", 1), ("/a/b", 2), ("/c", 1), ("/c/.h", 2)]


def test_exclusion_and_names(spark):
    f = spark.createDataFrame([("/a/.hidden",), ("/a/Thumbs.db",), ("/a/thumbs.db",), ("/a/b",)], "path string")
    assert rows(f.where(fs.excluded(F.col("path"))), "path") == [("/a/.hidden",), ("/a/thumbs.db",)]
    n = spark.createDataFrame([("ok",), ("",), ("..",), ("a/b",), ("CON.txt",), (None,)], "n string")
    assert rows(n.where(~fs.unsafe_component(F.col("n"))), "n") == [("ok",)]


def test_hardlinks_and_budget(spark):
    f = spark.createDataFrame([(1, 5, 9), (2, 5, 9), (3, 0, 9), (4, 0, 9), (5, None, None)], "file_id long, device long, inode long")
    assert rows(fs.without_hardlinks(f), "file_id") == [(1,), (3,), (4,), (5,)]
    with pytest.raises(ValueError):
        fs.within_budget(f, 4)


def test_folder_digests_and_nesting(spark):
    f = spark.createDataFrame([(f"/r/{d}/s/{n}", 1, n) for d in "ab" for n in "xy"], "path string, size long, digest string")
    made = folders.folder_digests(f)
    assert made.where("size = 2").select("digest").distinct().count() == 2
    g = exact.manifest_groups(made.withColumn("is_ref", F.lit(False))).withColumn("group_id", F.col("digest"))
    assert rows(folders.suppress_nested(g.select("group_id", "folder")), "folder") == [("/r/a",), ("/r/b",)]


# -- catalog -----------------------------------------------------------------------------------

SNAP = "root_id long, path_key string, display_path string, volume_id long, native_file_id long, physical_file_id long, content_version_id long, path_state string, content_state string"


def snap(spark, *items):
    return spark.createDataFrame([(1, p, p, 1, n, n or 0, v, "active", "stable") for p, n, v in items], SNAP)


def test_scan_changes(spark):
    before = snap(spark, ("/same", 1, 1), ("/mod", 2, 2), ("/old", 3, 3), ("/gone", 4, 4), ("/u1", 5, 5), ("/r1", 6, 6), ("/n", None, 9))
    after = snap(spark, ("/same", 1, 1), ("/mod", 2, 20), ("/new", 3, 3), ("/u2", 5, 50), ("/r2", 6, 60), ("/n2", None, 9))
    art = spark.createDataFrame([(6, "d", 1), (60, "d", 1), (5, "e", 1), (50, "f", 1)], "content_version_id long, sha256 string, size long")
    got = {r.path_key: (r.change_type, r.relation_evidence) for r in catalog.scan_changes(before, after, art).collect()}
    assert got["/mod"] == ("modified", None) and got["/new"] == ("relocation_candidate", "same_catalog_generation") and got["/r2"] == ("relocation_candidate", "matching_full_sha256")
    assert {k for k, x in got.items() if x[0] == "missing"} == {"/gone", "/u1", "/n"} and {k for k, x in got.items() if x[0] == "added"} == {"/u2", "/n2"}


def test_missing_only_under_clean_folders(spark):
    p = spark.createDataFrame([(1, "/a/x", "active", "/a"), (1, "/b/x", "active", "/b")], "root_id long, path_key string, state string, parent_key string")
    none = p.limit(0)
    clean = spark.createDataFrame([(1, "/a")], "root_id long, folder_key string")
    assert rows(catalog.finish_scan(p, none, clean, 0), "path_key", "state") == [("/a/x", "missing"), ("/b/x", "active")]
    assert rows(catalog.finish_scan(p, none, clean, 1), "state") == [("active",), ("active",)]


def test_leases(spark):
    items = spark.createDataFrame([(1, "pending", None, None, 0), (2, "claimed", "x", 5.0, 0), (3, "claimed", "y", 50.0, 0)], "item_id long, status string, owner string, lease_until double, attempts int")
    got = catalog.claim(items, "me", 10.0, 60.0, 5, ["item_id"])
    assert rows(got, "item_id", "owner") == [(1, "me"), (2, "me"), (3, "y")]
    failed = catalog.fail(got, got.where("item_id = 1"), "me", 1)
    assert rows(failed.where("item_id = 1"), "status") == [("failed",)]


def test_pages(spark):
    g = spark.createDataFrame([(s, d, 10 * s + i) for s, d, n in ((1, "a", 2), (2, "b", 3), (3, "c", 2)) for i in range(n)], "size long, digest string, physical_file_id long").withColumn("members", F.lit(0))
    assert catalog.digest_page(g, limit=2).count() == 5
    assert catalog.digest_page(g, max_rows=4).count() == 2
    assert rows(catalog.digest_page(g, after_size=1, after_digest="a", limit=1), "size") == [(2,)] * 3


def test_batches_until_none_is_pending(spark):
    """As many batches as it takes: three of two items, then the unreadable one's other attempts."""
    items = spark.createDataFrame([(i, i, "pending", None, None, 0) for i in range(5)], "item_id long, content_version_id long, status string, owner string, lease_until double, attempts int")
    contents = spark.createDataFrame([(i, bytearray(b"x")) for i in range(5) if i != 4], "content_version_id long, content binary")
    left, made = catalog.run_batches(items, contents, "me", 1.0, 1.0, 2)
    assert rows(left, "item_id", "status", "attempts") == [*[(i, "complete", 0) for i in range(4)], (4, "failed", 3)]
    assert sorted(r.content_version_id for m in made for r in m.collect()) == [0, 1, 2, 3] and len(made) == 5
    assert len(catalog.run_batches(items, contents, "me", 1.0, 1.0, 2, 1)[1]) == 1


# -- datasets ----------------------------------------------------------------------------------


def test_bundles(spark):
    p = spark.createDataFrame([("1", "/a.jpg"), ("2", "/a.png"), ("3", "/b.png")], "asset_id string, primary_path string")
    s = spark.createDataFrame([("/a.txt",), ("/a.jpg.txt",), ("/b.txt",), ("/b.png.txt",), ("/zz.txt",)], "sidecar_path string")
    attached, issues = dataset.bundles(p, s, ("txt",), required=("txt",))
    assert rows(attached, "asset_id", "sidecar_path") == [("1", "/a.jpg.txt"), ("3", "/b.png.txt"), ("3", "/b.txt")]
    assert rows(issues, "kind") == [("ambiguous_owner",), ("missing_required",), ("multiple_for_slot",), ("orphan",)]


def test_bundles_by_naming(spark):
    """Where sidecars go by whole paths alone, x.txt is not x.html's too, nor y.txt y.html's."""
    p = spark.createDataFrame([("x", "x"), ("x.html", "x.html"), ("y.html", "y.html")], "asset_id string, primary_path string")
    s = spark.createDataFrame([("x.txt",), ("x.html.txt",), ("y.txt",)], "sidecar_path string")
    for naming, owned, kinds in (("full_name", [("x", "x.txt"), ("x.html", "x.html.txt")], ["orphan"]), ("stem", [("y.html", "y.txt")], ["ambiguous_owner", "orphan"])):
        attached, issues = dataset.bundles(p, s, ("txt",), naming=naming)
        assert rows(attached, "asset_id", "sidecar_path") == owned and rows(issues, "kind") == [(k,) for k in kinds]


def test_split_precedence(spark):
    c = spark.createDataFrame([("c1", "m1"), ("c2", "m2"), ("c2", "m3"), ("c2", "m4"), ("c3", "m9")], "cluster_id string, member_id string")
    prev = spark.createDataFrame([("c1", "m1", "test"), ("o", "m2", "train"), ("o2", "m3", "test"), ("o3", "m4", "test")], "cluster_id string, member_id string, split string")
    got = {r[0]: r[1:] for r in rows(dataset.stable_split(c, {"train": 0.5, "test": 0.5}, "s", prev), "cluster_id", "split", "reason")}
    assert got["c1"] == ("test", "previous_cluster") and got["c2"] == ("test", "majority") and got["c3"][1] == "hash"


def test_selection(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "asset_id long, q double")
    got = dict(rows(dataset.select_top(a, [("q", 1.0, False)], 2, forced=F.col("asset_id") == 4), "asset_id", "status"))
    assert got == {1: "not_selected", 2: "not_selected", 3: "selected", 4: "selected"}
    d = spark.createDataFrame([(2, 3, 0.0), (1, 3, 1.0)], "first_id long, second_id long, distance double")
    assert [r.asset_id for r in dataset.select_diverse(a.where("q is not null"), d, [("q", 1.0, False)], 2, 2.0).orderBy("step").collect()] == [3, 1]


def test_diverse_selection_beyond_one_task(spark, monkeypatch):
    """More assets or distances than one task takes are selected step by step, with the same result."""
    rng = random.Random(5)
    a = spark.createDataFrame([(i, float(rng.randrange(6))) for i in range(12)], "asset_id long, q double")
    d = spark.createDataFrame([(i, j, rng.random()) if rng.random() < 0.5 else (j, i, 0.5) for i in range(12) for j in range(i) if rng.random() < 0.7], "first_id long, second_id long, distance double")
    columns = ("step", "asset_id", "quality", "diversity", "marginal")
    want = [rows(dataset.select_diverse(a, d, [("q", 1.0, False)], most, 0.8), *columns) for most in (5, 20)]
    monkeypatch.setattr(dataset, "MOST_DIVERSE", 10)
    assert [rows(dataset.select_diverse(a, d, [("q", 1.0, False)], most, 0.8), *columns) for most in (5, 20)] == want and len(want[1]) == 12


def test_units_of_large_clusters(spark):
    """A cluster's id is made once of its members as they are read: no row carries the members of its cluster, and batches end anywhere."""
    members = {"a": [str(i) for i in range(3000)], "b": ["7"], None: ["x", "\u00e9", "y"], "c": ["8", "unknown"]}
    a = spark.createDataFrame([(str(i),) for i in range(3002)] + [("x",), ("\u00e9",), ("y",)], "asset_id string")
    c = spark.createDataFrame([(k, m) for k, ms in members.items() for m in [*ms, ms[0]]], "cluster_id string, asset_id string")
    members["c"].pop()
    made, issues = dataset.units(a, c)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    sha = lambda *parts: hashlib.sha256("\0".join(parts).encode()).hexdigest()
    want = [(sha("dataset-cluster", ms[0]) if len(ms) == 1 else "dataset-cluster:" + sha("dataset-cluster", "", *sorted(ms)), m) for ms in [*members.values(), ["3000"], ["3001"]] for m in ms]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(made, "unit_id", "asset_id") == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows(issues, "kind", "id") == [("incomplete", "b"), ("overlap", "7"), ("overlap", "8"), ("unknown_member", "unknown")]


# -- sequences ---------------------------------------------------------------------------------


def brute_alignment(x, y, most, band=None, offset=0):
    """Cell by cell in plain Python: each holds its score and the pairs of its best path; diagonal before up before left."""
    n, m = len(x), len(y)
    cell = {}
    best = (0.0, None, ())
    for i in range(n):
        for j in range(m):
            if band is not None and not i + offset - band <= j <= i + offset + band:
                continue
            d = (int(x[i]) ^ int(y[j])).bit_count()
            zero = (0.0, ())
            diagonal, up, left = (cell.get(k, zero) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
            moves = [
                (diagonal[0] + (2.0 * (1 - d / (most + 1)) if d <= most else sequence.MISMATCH), (*diagonal[1], (i, j, d)) if d <= most else diagonal[1]),
                (up[0] + sequence.GAP, up[1]),
                (left[0] + sequence.GAP, left[1]),
            ]
            top = max(moves[0][0], moves[1][0])
            chosen = moves[0] if moves[0][0] >= moves[1][0] else moves[1]
            chosen = moves[2] if moves[2][0] > max(top, 0.0) + 1e-12 else chosen
            cell[i, j] = chosen if chosen[0] > 0 else zero
            if cell[i, j][0] > best[0] + 1e-12:
                best = (cell[i, j][0], (i, j), cell[i, j][1])
    pairs = best[2]
    if not pairs:
        return (0, None, None)
    return (len(pairs), (*pairs[0][:2], *pairs[-1][:2]), round(sum(p[2] for p in pairs) / len(pairs), 9))


def told(a):
    return (a[2], a[6:10] if a[2] else None, round(a[5], 9) if a[2] else None)


@given(st.lists(st.integers(0, 15), max_size=14), st.lists(st.integers(0, 15), max_size=14), st.integers(0, 2), st.one_of(st.none(), st.integers(1, 4)), st.integers(-3, 3))
@settings(max_examples=400, deadline=None)
def test_alignments_equal_brute_force(x, y, most, band, offset):
    a = sequence.align(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64), most, 10_000, band, offset)
    if x and y:
        assert a[0] == "complete" and told(a) == brute_alignment(x, y, most, band, offset)
        if a[2]:
            assert abs(a[1] - min(1.0, (1 - a[5] / (most + 1)) * (0.85 + 0.15 * max(a[2] / len(x), a[2] / len(y)) ** 0.5))) < 1e-9


def test_alignment_cases():
    x = np.arange(1, 11, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = sequence.align(x, x, 14, 10_000)
    assert same[:5] == ("complete", 1.0, 10, 1.0, 1.0)
    cut = sequence.align(x, x[3:8], 14, 10_000)
    assert cut[2] == 5 and cut[6:10] == (3, 0, 7, 4)
    assert sequence.align(x, x[:0], 14, 10)[0] == "empty_input"
    assert sequence.align(x, x, 14, 10)[0] == "resource_limit"
    gap = sequence.align(np.delete(x, 5), x, 14, 10_000)
    assert gap[2] == 9
    words = np.arange(500) * 2654435761 % 2**32
    assert sequence.best_offset(words[100:], words) == 100
    banded = sequence.align(words[100:], words, 8, 2_500_000, 128, 100)
    assert banded[0] == "complete" and banded[2] == 400


def test_metadata_classes(spark):
    meta = "struct<duration_seconds:double,width:int,height:int,frame_rate:double,video_codec:string,pixel_format:string>"
    base = (100.0, 1920, 1080, 30.0, "h264", "yuv420p")
    others = [base, (100.5, 1280, 720, 30.0, "vp9", "yuv420p"), (40.0, 1920, 1080, 30.0, "h264", "x"), (50.0, 100, 100, 30.0, "h264", "x"), (5.0, 1920, 1080, 30.0, "h264", "x")]
    df = spark.createDataFrame([(i, base, o) for i, o in enumerate(others)], f"i int, a {meta}, b {meta}")
    got = [r[0] for r in df.orderBy("i").select(sequence.metadata_class(F.col("a"), F.col("b")).getField("kind")).collect()]
    assert got == ["same_encode", "transcode", "trim", "related", "rejected"]
    v = spark.createDataFrame([(i, o) for i, o in enumerate(others)], f"id int, meta {meta}")
    found = {(a, b) for a, b in rows(sequence.metadata_candidates(v), "first_id", "second_id")}
    assert {(0, 1), (0, 2), (1, 2)} <= found and (0, 4) not in found


def test_frame_plan():
    plan = sequence.frame_plan(100.0, [50.0, 50.05, 99.9])
    assert len(plan) == 14 and plan == sorted(plan)


@given(st.floats(1, 500), st.lists(st.floats(-5, 505), max_size=40))
@settings(max_examples=200, deadline=None)
def test_frame_plans_equal_brute_force(duration, scenes):
    """Twelve middles of equal parts within the margins; then, one by one, the cut farthest from all that are chosen, the earlier of two, while it is a fifth of a second away."""
    inner = duration * 0.98
    chosen = [duration * 0.01 + inner * (2 * k + 1) / 24 for k in range(12)]
    cuts = {t for t in scenes if 0 <= t <= duration}
    while cuts and len(chosen) < 32:
        gap, t = max((min(abs(t - u) for u in chosen), -t) for t in cuts)
        if gap < 0.20:
            break
        chosen.append(-t)
        cuts.discard(-t)
    got = sequence.frame_plan(duration, scenes)
    assert len(got) == len(chosen) and np.allclose(got, sorted(chosen), atol=1e-9)


def test_large_groups_are_compared_by_several_tasks(spark, monkeypatch):
    """One file of a hundred differs from a first that it shares a digest with: the bucket is withheld, whichever task meets it."""
    monkeypatch.setattr(exact, "AT_A_FIRST", 8)
    monkeypatch.setattr(exact, "content_digest", lambda c: F.lit("same"))
    f = spark.createDataFrame([(i, bytearray(b"ab" if i == 77 else b"aa")) for i in range(100)] + [(200 + i, bytearray(b"zzz")) for i in range(20)], "file_id long, content binary")
    assert exact.exact_groups(f).count() == 20


def test_spans_of_videos_are_dealt_to_several_tasks(spark, monkeypatch):
    v = spark.createDataFrame([(i, (100.0 + i % 7, 1920, 1080, 30.0, "h264", "x")) for i in range(60)], "id int, meta struct<duration_seconds:double,width:int,height:int,frame_rate:double,video_codec:string,pixel_format:string>")
    want = rows(sequence.metadata_candidates(v), "first_id", "second_id", "kind")
    monkeypatch.setattr(sequence, "AT_A_SPAN", 5)
    assert rows(sequence.metadata_candidates(v), "first_id", "second_id", "kind") == want and len(want) == 60 * 59 // 2


@pytest.mark.parametrize("odd", [False, True])
def test_sums_of_candidates_equal_their_pairs(spark, monkeypatch, odd):
    """Of several shapes, rates and codecs, over short and long durations and several parts of a bucket; no pairs are made unless a number is missing."""
    rng = random.Random(3)
    shape = lambda: rng.choice([(1920, 1080), (1280, 720), (1900, 1080), (640, 480), (650, 480)])
    v = spark.createDataFrame([(i, (rng.choice([0.4, 1.3, 2.0, 9.9, 10.0, 10.9, 50.0, 51.0, 99.9, 100.0, 101.5, 480.0, 900.0]), *shape(), rng.choice([25.0, 25.5, 30.0]), rng.choice("ab"), "x")) for i in range(200)] + [(200, (5.0, 640, 480, None, "a", "x"))] * odd, "id int, meta struct<duration_seconds:double,width:int,height:int,frame_rate:double,video_codec:string,pixel_format:string>")
    pairs = sequence.metadata_candidates(v)
    other = F.col("second_id").cast("long")
    want = rows(pairs.groupBy("first_id", "kind").agg(F.count("*").alias("n"), F.sum(other).alias("ids"), F.sum(other * other % 1_000_003).alias("squares"), F.round(F.sum("score"), 6).alias("score")), "first_id", "kind", "n", "ids", "squares", "score")
    assert {w[1] for w in want} == {"same_encode", "transcode", "trim", "related"}
    monkeypatch.setattr(sequence, "AT_A_SHAPE", 30)
    if not odd:
        monkeypatch.setattr(sequence, "metadata_candidates", None)
    got = rows(sequence.metadata_sums(v).withColumn("score", F.round("score", 6)), "first_id", "kind", "n", "ids", "squares", "score")
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-5)


# -- reports -----------------------------------------------------------------------------------


def test_plan_and_lines(spark):
    f = spark.createDataFrame([(1, bytearray(b"aa"), "/x/a", "a", False), (2, bytearray(b"aa"), "/x/b", "b", False), (3, bytearray(b"zz"), "/x/c", "c", False)], "file_id long, content binary, path string, name string, is_ref boolean")
    r = report.exact_report(f)
    acts = report.checked_plan(report.plan_actions(r)).collect()
    assert [(a.target, a.reference) for a in acts] == [("/x/b", "/x/a")]
    with pytest.raises(ValueError):
        report.plan_actions(r, complete=False)
    lines = report.jsonl(r, "s")
    assert lines.count() == 5 and report.check_jsonl(lines).count() == 0
    assert report.check_jsonl(lines.where("_o < 2")).count() == 1
    assert report.query_report(r, path="/x/b").count() == 2
    cell = spark.createDataFrame([("=1",), (" -x",), ("ok",), (None,)], "c string").select(report.csv_cell(F.col("c")).alias("c"))
    assert rows(cell, "c") == [("",), ("' -x",), ("'=1",), ("ok",)]


