"""Token files: every text's ids in ascending doc_id order, in blocks of Simple-8b words with offsets."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kindred.llm import simple8b
from kindred.llm.tokens import USE, encoder
from kindred.operators.hot import running_sums
from kindred.shared import bound_batches, materialize, tidy

#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
#: Bytes of text that a shard is made of, about.
SHARD_BYTES = 32 << 20
#: Shards whose sums run in one window.
SPAN = 256
MAGIC = b"S8B1"


def pack_block(ids: list[np.ndarray]) -> bytes:
    """Magic, number of documents, each document's first id and the end, then the block's words; every number little-endian."""
    at = np.cumsum([0, *map(len, ids)])
    return MAGIC + np.array([len(ids), 0, 0], dtype="<u4").tobytes() + at.astype("<u8").tobytes() + simple8b.encode(np.concatenate(ids)).astype("<u8").tobytes()


def unpack_block(block: bytes) -> list[np.ndarray]:
    """Each document's ids, from the block's words, which are decoded at once."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n = int(np.frombuffer(block, "<u4", 1, 4)[0])
    at = np.frombuffer(block, "<u8", n + 1, 16).astype(np.int64)
    ids = simple8b.decode(np.frombuffer(block, "<u8", -1, 24 + 8 * n))
    return np.split(ids, at[1:-1]) if n else []


def _write(path: str, end_id: int):
    def run(batches):
        enc, shard, block = encoder(path), TaskContext.get().partitionId(), 0
        docs, ids, held = [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "n_ids": pa.array([held], pa.int64()), "data": pa.array([pack_block(ids)], pa.binary())})

        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                docs.append(doc)
                ids.append(np.append(got, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    docs, ids, held, block = [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def _read(batches):
    for batch in batches:
        for shard, block, docs, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            ids = unpack_block(data)
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                names=["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def write_token_file(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The token file of ``docs`` (doc_id, text): blocks (shard, block, doc_ids, n_ids, data) in the shared folder.

    Texts are sorted by doc_id over shards of about SHARD_BYTES; rows that repeat a doc_id follow
    each other by a hash of their text and, where that repeats too, as they come, so that they can
    fill several shards. A null doc_id comes first, null texts are empty. Each document's ids end
    with ``end_id``. The folder lasts as long as the application; copy it to keep it.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.repartitionByRange(max(1, -(-size // SHARD_BYTES), docs.sparkSession.sparkContext.defaultParallelism), "doc_id", "version", "row").sortWithinPartitions("doc_id", "version", "row").select("doc_id", "text")
    return materialize(ordered.mapInArrow(tidy(_write(tokenizer, end_id), USE), "shard int, block long, doc_ids array<long>, n_ids long, data binary"), "tokens")


def read_token_file(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token file, from its decoded ids.

    Starts are running sums over blocks, in spans of SPAN shards.
    """
    bound_batches(blocks.sparkSession)
    starts = running_sums(blocks.select("shard", "block", "n_ids"), {"base": "n_ids"}, ["shard", "block"], F.floor(F.col("shard") / SPAN)).select(F.col("shard").alias("s"), F.col("block").alias("b"), "base")
    rows = blocks.select("shard", "block", "doc_ids", "data").mapInArrow(tidy(_read, USE), "shard int, block long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token file of ``docs`` and read it back; any more columns of ``docs`` are ignored, an empty table gives no rows."""
    return read_token_file(write_token_file(docs, tokenizer, end_id))
