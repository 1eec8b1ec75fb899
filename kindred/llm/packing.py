"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed size."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.tokens import USE, encoder
from kindred.operators.hot import running_sums
from kindred.shared import bound_batches, materialize, tidy

WINDOW = 4096
#: Ids that are packed by one task, about; also bounds its memory.
PART_IDS = 2 << 20
#: Rows of one doc_id and text that may lie in one part.
COPIES = 10_000
#: Parts whose sums run in one window.
SPAN = 1024
#: A source that is due fewer ids than this waits for a later window, unless its queue ends.
LEAST_PIECE = 64


def _tokens(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            got = [np.append(x, np.uint32(end_id)) for x in enc.encode(batch.column("text"))]
            wide = [x.astype("<u2" if int(x.max()) < 65536 else "<u4").tobytes() for x in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("version"), pa.array([len(x) for x in got], pa.int64()), pa.array(wide, pa.binary())], names=["doc_id", "source", "version", "n", "ids"])

    return run


def shares(due: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Whole ids of each source for a window of ``room`` ids (at most what is left): in proportion to ``due``, as far as queues last."""
    take = np.zeros(len(due), dtype=np.int64)
    due = np.where(left > 0, np.maximum(due, 0.0), 0.0)
    due = np.where((due < LEAST_PIECE) & (left > due), 0.0, due)
    while (open_ := room - int(take.sum())) > 0:
        rest = left - take
        weight = np.where(rest > 0, due, 0.0)
        if weight.sum() <= 0:  # nobody is due: the longest queues go on
            weight = rest.astype(np.float64)
        exact = weight * (open_ / weight.sum())
        more = np.minimum(np.floor(exact).astype(np.int64), rest)
        if not more.any():
            best = int(np.argmax(np.where(rest > 0, exact, -1.0)))
            more[best] = min(open_, int(rest[best]))
        take += more
    return take


def sizes(total: int, window: int = WINDOW) -> list[int]:
    """Windows of a part: full ones, and what remains as powers of two, which need no padding."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def schedule(left: np.ndarray, target: np.ndarray, deficit: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ids of each source (columns) in each window (rows).

    A window gives each source its target share and up to as much again, or as much less, of the
    deficit that it carries; what it is given more or less is its deficit in the next window.
    """
    left, deficit = left.astype(np.int64).copy(), deficit.astype(np.float64).copy()
    plan = sizes(int(left.sum()), window)
    out = np.zeros((len(plan), len(left)), dtype=np.int64)
    for w, room in enumerate(plan):
        quantum = target * room
        reach = np.maximum(quantum, LEAST_PIECE)
        out[w] = shares(quantum + np.clip(deficit, -reach, reach), left, room)
        deficit += quantum - out[w]
        left -= out[w]
    return out


def pack_part(table: pa.Table, aims: pa.Table) -> pa.Table:
    """The pieces of one part: its documents (doc_id, source, version, n, ids, place) in queues by source, packed by ``aims`` (source, target, carry, first_sequence)."""
    rows = table.sort_by([("source", "ascending"), ("place", "ascending"), ("doc_id", "ascending"), ("version", "ascending")])
    source, n = rows.column("source").to_numpy(zero_copy_only=False), rows.column("n").to_numpy()
    docs = rows.column("doc_id").to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    end = np.append(begin[1:], len(source))
    of = {s: (t, c) for s, t, c in zip(*(aims.column(k).to_pylist() for k in ("source", "target", "carry")), strict=True)}
    target, carry = np.array([of[s] for s in source[begin]], dtype=np.float64).T
    plan = schedule(np.add.reduceat(n, begin), target, carry)
    at = np.cumsum(plan, axis=1) - plan  # where each source begins in each window
    first = int(aims.column("first_sequence")[0].as_py())
    raw = rows.column("ids").to_pylist()
    out: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "sequence", "offset")}
    for s, (a, b) in enumerate(zip(begin, end, strict=True)):
        stream = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(raw[a:b], n[a:b].tolist(), strict=True)])
        bytes_ = memoryview(stream.view(np.uint8))
        doc_at, win_at = np.cumsum(n[a:b]) - n[a:b], np.cumsum(plan[:, s])
        cuts = np.union1d(doc_at, np.concatenate([[0], win_at[plan[:, s] > 0]]))
        cuts = cuts[cuts < len(stream)]
        stops = np.append(cuts[1:], len(stream))
        row = np.searchsorted(doc_at, cuts, "right") - 1
        window = np.searchsorted(win_at, cuts, "right")
        out["row"].append(a + row)
        out["start"].append(cuts - doc_at[row])
        out["length"].append(stops - cuts)
        out["sequence"].append(first + window)
        out["offset"].append(at[window, s] + cuts - (win_at[window] - plan[window, s]))
        out["crc"].append(np.fromiter((zlib.crc32(bytes_[4 * x : 4 * y]) for x, y in zip(cuts.tolist(), stops.tolist(), strict=True)), dtype=np.int64, count=len(cuts)))
    c = {k: np.concatenate(v) for k, v in out.items()}
    return pa.table({"doc_id": rows.column("doc_id").take(pa.array(c["row"])), "start": c["start"], "length": c["length"], "ids_crc32": c["crc"], "doc_tokens": n[c["row"]], "sequence_id": c["sequence"], "offset": c["offset"], "source": rows.column("source").take(pa.array(c["row"]))})


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, target: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source): the pieces of every row of ``docs`` (doc_id, text, source, any more columns).

    Each document's ids end with ``end_id``. Windows of WINDOW ids take from every source its
    ``target`` share (default: its share of all ids), by deficits that are carried from window to
    window and from part to part. A part's last ids fill windows of sizes that are powers of two, so
    nothing is padded. Parts are drawn by a hash of the document, so no source can crowd one.

    Null texts are empty and have the end id alone; a null source is "" ; each row is a document,
    also where a doc_id repeats; an empty table gives no rows. The number of sources is taken to
    be small; they are never collected.
    """
    bound_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64("text").alias("version"))
    tokens = named.mapInArrow(tidy(_tokens(tokenizer, end_id), USE), "doc_id long, source string, version long, n long, ids binary")
    tokens = materialize(tokens.withColumn("row", F.monotonically_increasing_id()), "ids")
    # Rows that repeat doc_id and text hash alike: many of them are dealt out one by one, which is the same whichever goes where.
    many = materialize(tokens.groupBy("doc_id", "version").agg(F.count("*").alias("copies")).where(F.col("copies") > COPIES), "copies", small=True)
    if many.limit(1).count():
        known = F.broadcast(many.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "copies"))  # a COPIES-th of all rows at most
        tokens = tokens.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left").withColumn("row", F.when(F.col("copies").isNotNull(), F.col("row"))).drop("d", "v", "copies")
    else:
        tokens = tokens.withColumn("row", F.lit(None).cast("long"))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PART_IDS))
    tokens = tokens.withColumn("part", F.pmod(F.xxhash64("doc_id", "version", "row", F.lit(1)), F.lit(parts)).cast("int")).withColumn("place", F.xxhash64("doc_id", "version", F.lit(2))).drop("row")
    held = materialize(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "held")
    by_part = held.groupBy("part").agg(F.sum("n").alias("of_part"))
    by_part = by_part.withColumn("windows", F.floor(F.col("of_part") / WINDOW) + F.bit_count(F.col("of_part") % WINDOW))
    span = F.floor(F.col("part") / SPAN)
    by_part = running_sums(by_part, {"before_part": "of_part", "first_sequence": "windows"}, ["part"], span).select("part", "before_part", "first_sequence")
    if target is None:
        aims = held.groupBy("source").agg((F.sum("n") / F.lit(max(total, 1))).alias("target"))
    else:
        whole = sum(target.values())
        aims = docs.sparkSession.createDataFrame([(k, v / whole) for k, v in target.items()], "source string, target double")
    carry = running_sums(held, {"had": "n"}, ["part"], span, ("source",)).join(aims, "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0))).join(by_part, "part")
    carry = carry.select("part", "source", "target", (F.col("target") * F.col("before_part") - F.col("had")).alias("carry"), "first_sequence")
    # Each part's documents and aims meet in one shuffle.
    return tokens.groupBy("part").cogroup(carry.groupBy("part")).applyInArrow(pack_part, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
