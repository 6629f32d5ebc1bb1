"""Exact deduplication by two-pass Bloom filtering: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.names import hide
from pointloom.llm.storage import materialise

BITS_A_ROW = 8
#: Bits of each of the two tables at most (32 MB); fuller tables let more rows through to the shuffle, with the same result.
MAX_BITS = 1 << 28
SEGMENT_BITS = 18
#: Bits in one bitmap of bitmap_construct_agg.
BUCKET_BITS = 15
#: Hashes that a task holds at most before it sends their places on.
HELD_PLACES = 1 << 20


def _two_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u & np.uint64(bits - 1)).astype(np.uint32), ((u >> np.uint64(34)) & np.uint64(bits - 1)).astype(np.uint32)


def _filter_size(rows: int) -> int:
    return min(MAX_BITS, 1 << max(12, (max(1, rows) * BITS_A_ROW - 1).bit_length()))


def own_column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy(zero_copy_only=False)


def repeated_places(rows: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = own_column) -> list[np.ndarray]:
    """For both tables, a packed bitmap of the places that two or more of the rows' 64-bit hashes fall on.

    Each task sends the places it has seen, HELD_PLACES hashes at a time and each place once, with a flag for those it
    saw twice; a task per segment of a table merges them. The bitmaps (bits / 8 bytes each) are what reaches the driver.
    """

    def seen(batches):
        parts: list[list[np.ndarray]] = [[], []]
        held = 0

        def sent():
            for t, p in enumerate(parts):
                places, counts = np.unique(np.concatenate(p), return_counts=True)
                cuts = np.flatnonzero(np.diff(places >> SEGMENT_BITS)) + 1
                for part, n in zip(np.split(places, cuts), np.split(counts, cuts), strict=True):
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([t << 16 | int(part[0]) >> SEGMENT_BITS], pa.int32()), "places": [part.tobytes()], "twice": [np.packbits(n > 1).tobytes()]})
                p.clear()

        for b in batches:
            for h in hashes(b):
                if len(h):
                    for t, p in enumerate(_two_places(h, bits)):
                        parts[t].append(p)
                    held += len(h)
                if held >= HELD_PLACES:
                    yield from sent()
                    held = 0
        if held:
            yield from sent()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        segment = int(pdf["segment"].iloc[0])
        places = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["places"]]) & np.uint32((1 << SEGMENT_BITS) - 1)
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(x) // 4) for t, x in zip(pdf["twice"], pdf["places"], strict=True)])
        counts = np.bincount(places, minlength=1 << SEGMENT_BITS) + np.bincount(places[twice == 1], minlength=1 << SEGMENT_BITS)
        return pd.DataFrame({"segment": [segment], "places": [np.packbits(counts > 1, bitorder="little").tobytes()]})

    parts = rows.mapInArrow(seen, "segment int, places binary, twice binary")
    maps = [np.zeros(max(bits, 1 << SEGMENT_BITS) // 8, np.uint8) for _ in range(2)]
    for r in parts.groupBy("segment").applyInPandas(merged, "segment int, places binary").toLocalIterator():
        at = (r["segment"] & 0xFFFF) << SEGMENT_BITS >> 3
        part = np.frombuffer(r["places"], np.uint8)
        maps[r["segment"] >> 16][at : at + len(part)] = part
    return maps


def _places(h: Column, bits: int) -> list[Column]:
    """A hash's places in the two tables, which stand one behind the other; each table has whole buckets."""
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(bits - 1)) + F.lit(bits)]


def _at(place: Column) -> tuple[Column, Column]:
    """The bucket of a place, and its number there."""
    return F.shiftright(place, BUCKET_BITS).cast("int"), place.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")


def split_by_filter(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose text may occur again, rows whose text can't), without a shuffle of either.

    The first pass counts the hashes that fall on each place of the two tables, partly before the shuffle; places with
    two or more become bitmaps, BUCKET_BITS of a table's bits in a row, 2 * bits / 8 bytes in all. The second pass
    looks every row up in them.
    """
    hashed = docs.withColumn("_pl_h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    bits = max(_filter_size(docs.count()), 1 << BUCKET_BITS)
    counted = hashed.select(F.explode(F.array(*_places(F.col("_pl_h"), bits))).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bucket, number = _at(F.col("place"))
    maps = materialise(counted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(number.cast("long")).alias("bitmap")), "bitmaps")
    found = hashed
    for i, place in enumerate(_places(F.col("_pl_h"), bits)):
        bucket, number = _at(place)
        own = F.broadcast(maps.select(F.col("bucket").alias(f"_pl_b{i}"), F.col("bitmap").alias(f"_pl_m{i}")))  # MAX_BITS / 8 bytes a table at most
        byte = F.conv(F.hex(F.substring(F.col(f"_pl_m{i}"), F.shiftright(number, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, number.bitwiseAND(F.lit(7))) == 1, F.lit(False))
        found = found.join(own, bucket == F.col(f"_pl_b{i}"), "left").withColumn(f"_pl_hit{i}", hit).drop(f"_pl_b{i}", f"_pl_m{i}")
    maybe = F.col("_pl_hit0") & F.col("_pl_hit1")
    return found.filter(maybe).select(docs.columns), found.filter(~maybe).select(docs.columns)


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row of docs.

    Texts are equal when identical, a null text counts as empty. Of equal texts the row with the largest
    doc_id stays (a null doc_id counts as smallest); of repeated rows with that doc_id, one. Rows that
    the filter clears keep their place and are never shuffled; the others are counted by the text's
    SHA-256, partly before the shuffle, and joined with the counts; both sides are plain shuffles, so Spark splits a hot text.
    docs must read the same on every pass, as a table does. An empty table gives an empty result. Other
    columns stay, whatever their names; those named like the added ones are replaced.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    hidden, show = hide(docs, ("doc_id", "text"), added, F.monotonically_increasing_id().alias("_pl_row"))
    again, alone = split_by_filter(hidden)
    again = again.withColumn("_pl_sha", _sha(F.col("text")))
    groups = again.groupBy(F.col("_pl_sha").alias("_pl_group")).agg(F.count(F.lit(1)).alias("_pl_size"), F.max(F.struct("doc_id", "_pl_row")).alias("_pl_best"))
    joined = again.join(groups, F.col("_pl_sha") == F.concat("_pl_group", F.lit("")))  # as an expression, for a shuffle of its own: see keys.unknown_key
    first = show(alone, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), _sha(F.col("text")).alias("text_sha256"))
    return first.unionAll(show(joined, F.col("_pl_best.doc_id").alias("keep_id"), F.col("_pl_size").alias("group_size"), (F.col("_pl_row") == F.col("_pl_best._pl_row")).alias("kept"), F.col("_pl_sha").alias("text_sha256")))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with docs' columns as they are.

    Of the rows that may repeat, the best of each text is found within tasks first, so a text's copies cross the shuffle
    once a task at most.
    """
    hidden, show = hide(docs, ("doc_id", "text"), (), F.monotonically_increasing_id().alias("_pl_row"))
    again, alone = split_by_filter(hidden)
    own = F.struct(*hidden.columns)
    best = again.groupBy(_sha(F.col("text")).alias("_pl_sha")).agg(F.max_by(own, F.struct("doc_id", "_pl_row")).alias("_pl_best"))
    return show(alone).unionAll(show(best.select("_pl_best.*")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
