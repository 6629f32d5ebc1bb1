"""Binary token files in doc_id order: blocks of the context-mixing range coder, written and read by Spark.

A table of blocks (Parquet as the container, so any store that Spark writes to will do) has a row per block:
part and block order them, n_ids counts its ids, `docs` has the documents in it and `payload` the coded ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm import tokens
from pointloom.llm.mixing_coder import decode_block, encode_block
from pointloom.llm.storage import fresh_path

VOCABULARY = 49408
#: Whole documents are gathered until a block has so many ids.
BLOCK_IDS = 4_000_000
#: Bytes of text encoded at once: pieces that repeat within them are looked up once.
CHUNK = 4 << 20

_BLOCKS = "part int, block int, n_ids long, docs binary, payload binary"


def _directory(doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """Presence, doc_id and number of ids of each document, compressed, with a crc32."""
    raw = np.array([x is not None for x in doc_ids], "u1").tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes()
    return zlib.compress(raw, 1) + zlib.crc32(raw).to_bytes(4, "little")


def _read_directory(data: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zlib.decompress(data[:-4])
    if zlib.crc32(raw) != int.from_bytes(data[-4:], "little"):
        raise ValueError("directory checksum")
    n = len(raw) // 17
    return pa.array(np.frombuffer(raw, "<i8", n, n), mask=np.frombuffer(raw, "u1", n) == 0), np.frombuffer(raw, "<i8", n, 9 * n)


def write_tokens(docs: DataFrame, out: str, path: str | None = None, partitions: int | None = None) -> None:
    """Encode every whole text of docs and write the ids as blocks to `out`, in ascending doc_id order.

    Rows are range-partitioned by (doc_id, a hash of the text), so many rows of one doc_id still spread; null
    doc_ids come first. A null or empty text is the end id alone. Repeated rows are each written. An empty
    table gives a table without blocks. Other columns of docs are not written.
    """
    path = path or tokens.vocabulary_path()
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def coded(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        size = 0

        def block():
            ids = np.concatenate(held)
            columns = {"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "n_ids": [len(ids)], "docs": [_directory(names, np.concatenate(sizes))], "payload": [encode_block(ids, VOCABULARY)]}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b, ids, bounds in tokens.encode(batch.column("text"), path, CHUNK):
                held.append(ids)
                names += doc_ids[a:b]
                sizes.append(np.diff(bounds))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    number, size = number + 1, 0
                    held, names, sizes = [], [], []
        if held:
            yield block()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = keyed.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")
    ordered.select("doc_id", "text").mapInArrow(coded, _BLOCKS).write.option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, source: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked, ids) of every document in the blocks at `source`, checksums verified.

    start counts the ids of all documents before; ids are little-endian unsigned 32-bit numbers.
    """
    names = ["part", "block", "doc_id", "_at", "n_tokens", "ids_crc32"] + ["ids"] * ids
    blocks = spark.read.schema(_BLOCKS).parquet(source)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(F.col("part"), F.col("block"), F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_base"))
    bases = bases.join(parts, F.col("part") == F.col("_part")).select(F.col("part").alias("_part"), F.col("block").alias("_block"), (F.col("_before") + F.col("_base")).alias("_base"))

    def decoded(batches):
        for batch in batches:
            for part, block, docs, payload in zip(*(batch.column(c) for c in ("part", "block", "docs", "payload"))):
                doc_ids, sizes = _read_directory(docs.as_py())
                raw = decode_block(payload.as_py()).astype("<u4")
                starts = np.cumsum(sizes) - sizes
                at = 0
                while at < len(sizes):  # some documents at once
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + 500_000)))
                    offsets = np.append(starts[at:to], starts[to - 1] + sizes[to - 1])
                    span = raw[offsets[0] : offsets[-1]]
                    n, raw_span, cuts = to - at, memoryview(span.tobytes()), (4 * (offsets - offsets[0])).tolist()
                    sums = [zlib.crc32(raw_span[x:y]) for x, y in zip(cuts, cuts[1:])]
                    columns = [pa.array([part.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), doc_ids[at:to], pa.array(starts[at:to]), pa.array(sizes[at:to]), pa.array(sums, pa.int64())]
                    if ids:
                        columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.array(cuts, "i8").tobytes()), pa.py_buffer(raw_span)]).cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    at = to

    schema = "part int, block int, doc_id long, _at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    rows = blocks.select("part", "block", "docs", "payload").mapInArrow(decoded, schema)
    on = (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))
    return rows.join(bases, on).select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), *names[4:])


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), out)
    return read_tokens(spark, out, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
