"""Packing by power-of-two decomposition: documents are cut into pieces of binary lengths, and a sequence
is one piece, so that none crosses documents or is padded. Pieces of equal length are numbered together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import tokens
from pointloom.llm.names import hide
from pointloom.llm.storage import materialise, number_gapless

MAX_TOKENS = 4096
#: Lots that the pieces of one length are numbered in; one lot meets in a task.
LOTS = 512
#: Columns that cutting adds; the last one only if asked for.
ADDED = ("start", "length", "doc_tokens", "ids_crc32", "ids")


def binary_lengths(total: int, most: int = MAX_TOKENS) -> list[int]:
    """`most` as often as it goes, then the powers of two in what is left, largest first."""
    rest = total % most
    return [most] * (total // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if rest >> k & 1]


def cut_documents(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS, ids: bool = True) -> DataFrame:
    """A row per piece: docs' columns but text, then start, length, doc_tokens, ids_crc32 and (if asked) ids.

    Every text is encoded whole, the end id is appended, and ids are little-endian unsigned 32-bit numbers. A
    null or empty text is the end id alone. Repeated rows are cut alike; an empty table gives no pieces. Columns
    of docs that are named like the added ones are replaced.
    """
    path = path or tokens.vocabulary_path()
    hidden, show = hide(docs, ("text",), ADDED)
    return show(_cut(hidden, path, most, ids), *ADDED[: 4 + ids], less=["text"])


def _cut(docs: DataFrame, path: str, most: int, ids: bool) -> DataFrame:
    """cut_documents for columns whose names are none of the added ones."""
    own = [c for c in docs.columns if c != "text"]
    docs = docs.select(*own, "text")
    schema = docs.select(own).schema.add("start", "long").add("length", "long").add("doc_tokens", "long").add("ids_crc32", "long")
    schema = schema.add("ids", "binary") if ids else schema
    added = ADDED[: 4 + ids]

    def cut(batches):
        from zlib import crc32

        for batch in batches:
            rest = batch.select(own)
            for a, b, flat, bounds in tokens.encode(batch.column("text"), path):
                raw, rows, starts, lengths, sums, pieces = flat.astype("<u4").tobytes(), [], [], [], [], []
                sizes = np.diff(bounds)
                for i, (at, n) in enumerate(zip(bounds.tolist(), sizes.tolist())):
                    done = 0
                    for k in binary_lengths(n, most):
                        part = raw[4 * (at + done) : 4 * (at + done + k)]
                        rows.append(a + i)
                        starts.append(done)
                        lengths.append(k)
                        sums.append(crc32(part))
                        if ids:
                            pieces.append(part)
                        done += k
                index = np.array(rows)
                new = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sizes[index - a]), pa.array(sums, pa.int64())]
                taken = rest.take(pa.array(index))
                yield pa.RecordBatch.from_arrays([*taken.columns, *new] + [pa.array(pieces, pa.binary())] * ids, [*own, *added])

    return docs.mapInArrow(cut, schema)


def number_sequences(pieces: DataFrame, order: list[Column], lot: Column) -> DataFrame:
    """Add sequence_id, gapless from 0, and offset (0: a sequence is one piece).

    Longer pieces come first, those of one length in a row, by `lot` (under 2**32) and then `order`. pieces are
    counted and then numbered, so they should be a table.
    """
    length = (64 - F.length(F.bin("length"))).cast("long") * F.lit(1 << 32)
    return number_gapless(pieces, "sequence_id", [], length + lot, order).withColumn("offset", F.lit(0).cast("long"))


def pack_documents(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS, ids: bool = True) -> DataFrame:
    """The pieces of cut_documents, written out once, with the numbers of number_sequences.

    Pieces of one length are ordered by a hash of (doc_id, start) and then doc_id, start and ids_crc32, so repeated rows
    get neighbouring numbers.
    """
    return _packed(docs, path, most, ids, None)


def _packed(docs: DataFrame, path: str | None, most: int, ids: bool, order: tuple[Column, Column] | None) -> DataFrame:
    path = path or tokens.vocabulary_path()
    more = [x.alias(n) for x, n in zip(order or (), ("_pl_file", "_pl_at"))]
    hidden, show = hide(docs, ("doc_id", "text"), (*ADDED, "sequence_id", "offset"), *more)
    pieces = materialise(_cut(hidden, path, most, ids), "pieces")
    if order:
        numbered = number_sequences(pieces, [F.col("_pl_at"), F.col("start")], F.coalesce("_pl_file", F.lit(0)))
    else:
        numbered = number_sequences(pieces, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], F.pmod(F.xxhash64("doc_id", "start"), F.lit(LOTS)))
    return show(numbered, *ADDED[: 4 + ids], "sequence_id", "offset", less=["text"])


def pack_in_order(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS, ids: bool = True) -> DataFrame:
    """Like pack_documents, but pieces of one length are numbered in the order of docs' files and the rows in them.

    The order is that of the numbers in the names that Spark gives to files (part-00000...); a file with another name
    counts as the first. docs must be read from files: others have no such order, and Spark refuses them.
    """
    return _packed(docs, path, most, ids, (F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.col("_metadata.row_index")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
