"""Near duplicates by SetSketch registers: band, estimate by likelihood, verify on full shingle sets."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm import setsketch as S
from kindred.llm.words import shingle_sets
from kindred.operators.components import connected_components
from kindred.operators.hot import join_groups
from kindred.shared import bound_batches, discard, materialize, tidy

#: Shingles beyond a centre's that more rows of its family have count as the centre's; so lists of rows stay this short.
LISTED = 64
#: Columns of the sketch that joins compare.
PLANES = [f"p{k}" for k in range(2 * S.PLANES)]
#: Texts of at most so many candidates are picked by a broadcast list of ids (8 MB), and an eighth as many pairs are broadcast
#: themselves; more are joined by a shuffle.
PICK_BY_BROADCAST = 1_000_000
#: A hub is compared by one task with about so many rows; those beyond go to other tasks with a copy of the hub.
AT_A_HUB = 64


def _sketches(shingle: int):
    def run(batches):
        for batch in batches:
            n, digest, regs, bits = [], [], [], []
            for x in shingle_sets(batch.column("text"), shingle):
                n.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sketch = S.registers(S.minima(x))
                regs.append(sketch.astype("<u2").tobytes() if len(x) else None)
                bits.append(S.planes(sketch))
            bits = np.array(bits, dtype=np.int64).reshape(len(n), len(PLANES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), *map(pa.array, np.ascontiguousarray(bits.T))], names=["doc_id", "version", "n_shingles", "digest", "regs", *PLANES])

    return run


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(batch.num_rows, S.REGISTERS)
        keys = S.band_keys(regs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(S.BANDS, dtype=np.int32), batch.num_rows)), pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), S.BANDS))], names=["band", "key", "rep"]
        )


def _beside(pairs: DataFrame, pool: DataFrame, *more: str) -> DataFrame:
    """Rows (a, b, n, regs, text, *more) of pairs (a, b, *more): each hub ``a`` once, with b null, and behind it its partners, in one partition.

    A hub of many partners stands in several places, each with its share of them, so no task has
    more than about AT_A_HUB rows of it and no text is repeated on every row.
    """
    n_pairs = pairs.count()
    few = n_pairs <= PICK_BY_BROADCAST // 8
    send = lambda df, n: F.broadcast(df) if n <= PICK_BY_BROADCAST // 8 else df
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / AT_A_HUB).cast("int").alias("places")).where("places > 1")
    dealt = pairs.join(send(hot, n_pairs // AT_A_HUB), "a", "left").withColumn("place", F.pmod(F.xxhash64("b"), F.coalesce("places", F.lit(1)))).drop("places")
    hubs = dealt.select("a", "place").distinct()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    picked = pool.join(F.broadcast(ids) if few else ids, "rep", "left_semi").select("rep", F.col("n_shingles").alias("n"), "regs", "text")
    first = picked.join(send(hubs, n_pairs), picked.rep == hubs.a).select("a", "place", F.lit(None).cast("long").alias("b"), "n", "regs", "text", *[F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in more])
    rest = picked.join(send(dealt, n_pairs), picked.rep == dealt.b).select("a", "place", "b", "n", "regs", "text", *more)
    return first.union(rest).repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").isNotNull(), "b").select("a", "b", "n", "regs", "text", *more)


def _hub_runs(batches, shingle: int):
    """Of rows of _beside(): each batch, the places of its partners, and for each of these the number of its hub among the batch's hubs, which are (shingles, registers, set)."""
    last = []
    for batch in batches:
        if batch.num_rows:
            head = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(head)
            regs = batch.column("regs").take(pa.array(at)).to_pylist()
            hubs = last + list(zip(batch.column("n").to_numpy()[at].tolist(), (np.frombuffer(r, "<u2") for r in regs), shingle_sets(batch.column("text").take(pa.array(at)), shingle), strict=True))
            yield batch, np.flatnonzero(~head), (np.cumsum(head) - 1 + len(last))[~head], hubs
            last = hubs[-1:]


def _verified(shingle: int, percent: int):
    """Of rows of _beside(), the pairs (a, b) that likelihood allows and full sets confirm."""
    def run(batches):
        for batch, rows, hub, hubs in _hub_runs(batches, shingle):
            if not len(rows):
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").take(pa.array(rows)).to_pylist()), dtype="<u2").reshape(len(rows), S.REGISTERS)
            sizes = np.array([h[0] for h in hubs])[hub]
            ok = S.plausible(np.stack([h[1] for h in hubs])[hub], regs, sizes, batch.column("n").to_numpy()[rows], percent / 100)[1]
            rows, hub, keep = rows[ok], hub[ok], []
            for k, other in zip(hub.tolist(), shingle_sets(batch.column("text").take(pa.array(rows)), shingle), strict=True):
                own = hubs[k][2]
                both = int(np.count_nonzero(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).take(pa.array(rows)).filter(pa.array(keep, pa.bool_()))

    return run


def _test(pairs: DataFrame, pool: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of representatives, those whose full sets are similar."""
    return materialize(_beside(pairs, pool).mapInArrow(tidy(_verified(shingle, percent)), "a long, b long"), "links", small=True)


def _alike(x: Column, percent: int) -> Column:
    """Whether sizes and register planes of rows ``y`` and structs ``x`` allow the similarity; evaluated inside the join."""
    small, large = F.least("y.n_shingles", x["n_shingles"]), F.greatest("y.n_shingles", x["n_shingles"])
    apart = F.lit(0)
    for w in (0, 1):
        differ = F.lit(0).cast("long")
        for p in PLANES[w::2]:
            differ = differ.bitwiseOR(F.col(f"y.{p}").bitwiseXOR(x[p]))
        apart = apart + F.bit_count(differ)
    return (small * 100 >= large * percent) & (apart <= S.REGISTERS - S.least_equal(percent / 100))


def _pairs(joined: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows ``y`` and structs ``x`` that weren't tested before."""
    pairs = joined.select(F.least("y.rep", "x.rep").alias("a"), F.greatest("y.rep", "x.rep").alias("b")).distinct()
    return materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs", small=True)


def _around(family: DataFrame, pool: DataFrame, tested: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs of a family (hub, rep, n_shingles, c), rows of different components c around one hub, that can be similar.

    Rows of n and m shingles are similar if they share k or more, k the least whole number of
    percent (n + m) / (100 + percent). Call centre the hub's shingles and those that more than
    LISTED rows of the family have. Of shingles in the centre a pair shares no more than its row
    with fewer of them has; the others must be shared beyond it. So a pair either shares enough of
    the short lists beyond the centre, or both its rows have k in the centre: these two joins miss
    no similar pair. The first grows with the rows, not with the square of a group. The second lists
    every pair of rows of different components that are both central, dealt over tasks; rows that
    central are mostly of one component already, and of its pairs none is listed.
    """
    def beyond(batches):
        for b, rows, hub, hubs in _hub_runs(batches, shingle):
            for i, k, x in zip(rows.tolist(), hub.tolist(), shingle_sets(b.column("text").take(pa.array(rows)), shingle), strict=True):
                own = hubs[k][2]
                inside = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
                grams = pa.array(x[~inside].view(np.int64)) if not inside.all() else pa.nulls(1, pa.int64())
                same = lambda c, n=len(grams), i=i, b=b: pa.array(np.full(n, b.column(c)[i].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([same("a"), same("b"), same("n"), same("c"), pa.array(np.full(len(grams), int(inside.sum()))), grams], names=["hub", "rep", "n", "c", "inside", "gram"])

    rows = _beside(family.select(F.col("hub").alias("a"), F.col("rep").alias("b"), "c"), pool, "c")
    out = materialize(rows.mapInArrow(tidy(beyond), "hub long, rep long, n long, c long, inside long, gram long"), "beyond")
    met = out.where("gram is not null").groupBy("hub", "gram").agg(F.count("*").alias("rows")).where("rows > 1")
    listed = out.join(met, ["hub", "gram"])
    often = listed.where(F.col("rows") > LISTED).groupBy("hub", "rep").agg(F.count("*").alias("often"))
    each = out.select("hub", "rep", "n", "c", "inside").distinct().join(often, ["hub", "rep"], "left")
    each = materialize(each.select("hub", "rep", "n", "c", (F.col("inside") + F.coalesce("often", F.lit(0))).alias("inside")), "centres", small=True)
    k = F.ceil((F.col("x.n") + F.col("y.n")) * percent / F.lit(100.0 + percent) - 1e-9)
    sized = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    short = listed.where(F.col("rows") <= LISTED).select("hub", "gram", "rep", "c")
    a, b = short.alias("a"), short.alias("b")
    shared = a.join(b, (F.col("a.hub") == F.col("b.hub")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.c") != F.col("b.c"))).groupBy(F.col("a.hub").alias("hub"), F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).agg(F.count("*").alias("shared"))
    x, y = each.alias("x"), each.alias("y")
    listed_pairs = shared.join(x, (shared.hub == F.col("x.hub")) & (shared.a == F.col("x.rep"))).join(y, (shared.hub == F.col("y.hub")) & (shared.b == F.col("y.rep"))).where(sized & (F.col("shared") + F.least("x.inside", "y.inside") >= k)).select("a", "b")
    # Most rows of a family are of one component: pairs have at least one row of another.
    main = each.groupBy("hub", "c").agg(F.count("*").alias("rows")).groupBy("hub").agg(F.max_by("c", F.struct("rows", "c")).alias("main"))
    places = each.groupBy("hub").agg(F.ceil(F.count("*") / AT_A_HUB).cast("int").alias("places"))
    minor = each.join(main, "hub").where("c <> main").drop("main").join(places, "hub").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).alias("x")
    y = each.join(places, "hub").withColumn("place", F.pmod(F.xxhash64("rep"), "places")).alias("y")
    central = minor.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.place") == F.col("y.place")) & (F.col("x.c") != F.col("y.c")) & sized & (F.least("x.inside", "y.inside") >= k)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    pairs = materialize(listed_pairs.union(central).distinct().join(tested, ["a", "b"], "left_anti"), "pairs", small=True)
    discard(out, each)
    return pairs


def _open(labelled: DataFrame, rows: int) -> DataFrame:
    """Buckets of several components and at least so many rows: three while no row has been set aside, as a bucket's hub is tested against all."""
    several = labelled.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where((F.col("n") >= rows) & (F.col("lo") < F.col("hi"))).select("band", "key")
    return materialize(labelled.join(several, ["band", "key"]), "open", small=True)


def _promising(open_: DataFrame, pool: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows that can be linked to another row of their bucket at all, with ``own``: how many of a row's shingles no other row has.

    What isn't a row's own, c of its n shingles, is the most that it can share, so with a row of at
    least m shingles it is similar by c / (n + max(m, c) - c) at most. Copies that are edited too
    much, and texts that share but a passage, end here, and their buckets are never paired.
    Shingles are counted map-side first, so a group of copies costs its size, not its square.
    """
    ids = open_.select("rep").distinct()
    ids = F.broadcast(ids) if ids.count() <= PICK_BY_BROADCAST else ids

    def grams(batches):
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), shingle), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), doc)), pa.array(x.view(np.int64))], names=["rep", "gram"])

    each = pool.join(ids, "rep", "left_semi").select("rep", "text").mapInArrow(tidy(grams), "rep long, gram long")
    alone = each.groupBy("gram").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
    own = alone.groupBy("rep").agg(F.count("*").alias("own"))
    counted = open_.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    least = open_.groupBy("band", "key").agg(F.min("n_shingles").alias("least"))
    n, c = F.col("n_shingles"), F.col("n_shingles") - F.col("own")
    m = F.greatest(F.col("least"), F.ceil(n * percent / 100))
    out = counted.join(least, ["band", "key"]).where(c * 100 >= (n + F.greatest(m, c) - c) * percent).drop("least")
    return materialize(out, "promising", small=True)


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those between components, which are few, are joined among themselves."""
    of = lambda x: component.select(F.col("member_id").alias(x), F.col("component_id").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    if not links.limit(1).count():
        return component
    moved = materialize(connected_components(between, "a", "b").select(F.col("member_id").alias("component_id"), F.col("component_id").alias("root")), "moved", small=True)
    few = F.broadcast(moved) if moved.count() <= PICK_BY_BROADCAST // 8 else moved
    old = component.join(few, "component_id", "left").select("member_id", F.coalesce("root", "component_id").alias("component_id"))
    new = moved.join(component.select(F.col("member_id").alias("component_id")), "component_id", "left_anti").select(F.col("component_id").alias("member_id"), F.col("root").alias("component_id"))
    return materialize(old.union(new), "components", small=True)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, links, version) of every row of ``docs`` (doc_id, text, any more columns).

    Texts are sets of ``shingle`` consecutive words (A-Z lower-cased); two are linked where
    100 * shared >= percent * united, and a component is what links connect. First, rows of equal
    sets become one class; classes with four equal SetSketch registers in a band are candidates;
    candidates that the joint likelihood of their registers doesn't rule out are verified on full
    sets. Within a bucket one hub is tested against all. Of buckets that still hold several
    components, rows whose own shingles alone rule out any link are set aside, by exact counts;
    a bucket's most central row is tested against other components; and of the pairs that still
    lie across components, those are tested that exact counts of shingles allow (see _around). So
    no link between components is lost, and few within one are listed. Joins of hubs compare sizes
    and four bits of every register, which rule out what is six standard deviations away.

    ``version`` is the xxhash64 of the row's text. ``links`` counts the verified links that were
    needed from the row's class to others. Null or empty texts and texts without words have 0
    shingles and are linked with nothing. Rows that repeat a doc_id are documents of their own, each
    with the component of its own text; a null doc_id stands alone (component_id null, kept false).
    An empty table gives no rows.

    Words and shingles stand as 64-bit hashes, sets of equal shingles as 128 bits of BLAKE2.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    sets = materialize(docs.mapInArrow(tidy(_sketches(shingle)), f"doc_id long, version long, n_shingles long, digest binary, regs binary, {', '.join(f'{p} long' for p in PLANES)}"), "sketches")
    first = [F.first(c).alias(c) for c in ("n_shingles", "regs", *PLANES)]
    # A class is numbered as it is written, so that numbers differ even where doc_ids repeat.
    reps = sets.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("doc"), F.count("*").alias("members"), *first)
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    bands = reps.select("rep", "regs").mapInArrow(tidy(_bands), "band int, key long, rep long")
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(bands.join(shared.select("band", "key"), ["band", "key"]).join(reps.select("rep", "n_shingles", *PLANES), "rep"), "buckets")
    # All that tests need of the rows in shared buckets: one pass over the texts.
    wanted = reps.select("rep", F.col("doc.doc_id").alias("doc_id"), F.col("doc.version").alias("version")).join(buckets.select("rep").distinct(), "rep", "left_semi")
    wanted = materialize(wanted, "wanted", small=True)
    n_wanted = wanted.count()
    pool = docs.join(F.broadcast(wanted) if n_wanted <= PICK_BY_BROADCAST // 3 else wanted, ["doc_id", "version"]).select("rep", "text").join(reps.select("rep", "n_shingles", "regs"), "rep")
    pool = materialize(pool, "pool")
    if pool.count() > n_wanted:  # rows that repeat doc_id and text
        pool = materialize(pool.dropDuplicates(["rep"]), "pool")
    row = F.struct("rep", "n_shingles", *PLANES)
    hubs = materialize(buckets.groupBy("band", "key").agg(F.min(row).alias("x"), F.count("*").alias("n")), "hubs")
    near = join_groups(buckets, hubs, ["band", "key"], "n", buckets.count()).alias("y")
    tested = _pairs(near.where(_alike(F.col("x"), percent) & (F.col("y.rep") != F.col("x.rep"))), None)
    discard(hubs)
    links = _test(tested, pool, shingle, percent)
    component = materialize(connected_components(links, "a", "b"), "components", small=True)
    for last in (False, True):
        labels = component.select(F.col("member_id").alias("rep"), "component_id")
        open_ = _open(buckets.join(labels, "rep", "left").withColumn("c", F.coalesce("component_id", "rep")).drop("component_id"), 2 if last else 3)
        if not last:
            discarded, buckets = buckets, _promising(open_, pool, shingle, percent)
            discard(open_, discarded)
            open_ = _open(buckets, 2)
            buckets = buckets.drop("c")
        if not open_.limit(1).count():
            discard(open_)
            break
        # The member that has least of its own is a bucket's centre.
        centre = open_.groupBy("band", "key").agg(F.min_by(F.struct("rep", "n_shingles", *PLANES, "c"), F.struct(F.col("own") / F.col("n_shingles"), "rep")).alias("x"), F.count("*").alias("n"))
        centre = materialize(centre, "centre", small=True)
        near = join_groups(open_, centre, ["band", "key"], "n", open_.count()).alias("y")
        if last:
            pairs = _around(near.select(F.col("x.rep").alias("hub"), "rep", "c").distinct(), pool, tested, shingle, percent)
        else:
            pairs = _pairs(near.where((F.col("x.c") != F.col("y.c")) & _alike(F.col("x"), percent)), tested)
        found = _test(pairs, pool, shingle, percent)
        discard(open_, centre)
        tested, links = tested.union(pairs), links.union(found)
        component = _joined(component, found)
    discard(pool, wanted)
    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    classes = reps.select("digest", "rep", "doc.doc_id", "members").join(component.withColumnRenamed("member_id", "rep"), "rep", "left").join(degree, "rep", "left")
    classes = materialize(classes.select("digest", "members", F.col("doc_id").alias("own"), "component_id", F.coalesce("links", F.lit(0)).alias("links")), "labels")
    # A component is named by its smallest doc_id.
    names = materialize(classes.where("component_id is not null").groupBy("component_id").agg(F.min("own").alias("name"), F.count("*").alias("n")), "names", small=True)
    named = join_groups(classes, names, ["component_id"], "n", classes.count()).select("digest", "members", F.coalesce("name", "own").alias("component_id"), "links")
    answers = materialize(named, "answers")
    discard(classes, component, names)
    rows = sets.select("doc_id", "version", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = join_groups(rows, answers, ["digest"], "members", sets.count())
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "version")
