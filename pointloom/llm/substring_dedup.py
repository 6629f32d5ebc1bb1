"""Substring deduplication: an FM-index per shard, and matching statistics of streamed documents above a threshold.

A window of WINDOW words is sent to a shard by its minimiser, the least hash among its runs of GRAM words, so equal
windows always meet in one shard, and a shard holds only what may repeat. Consecutive windows with one
minimiser travel as a segment. Segments with the same words are indexed once, with their number as weight.
A segment none of whose windows can repeat, by the words beside its minimiser, isn't sent at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.keys import unknown_key
from pointloom.llm import words as W
from pointloom.llm.exact_dedup import _filter_size, _two_places, repeated_places
from pointloom.llm.fm_index import repeated_windows
from pointloom.llm.names import hide
from pointloom.llm.storage import discard, materialise

WINDOW = 35
GRAM = 8
#: Words of the segments in one shard, about.
SHARD_WORDS = 300_000
#: Distinct segments' words of one minimiser that still go to one shard; beyond, its windows are counted one by one.
HOT_WORDS = 2 * SHARD_WORDS


def segments(t: W.Texts, window: int = WINDOW, gram: int = GRAM):
    """(text, first word in it, windows, minimiser, hash of the words, sides) of each segment, and the word hashes.

    A window goes on for half of the words besides its minimiser's run, or more, to the left of that run or to the right. Sides are the
    hashes of the run with so many words to its left, and to its right, 0 where the segment's words end before: equal windows have a side
    in common.
    """
    h = t.hashes()
    valid = W.inside_one_text(t, window)
    n = len(valid)
    if not valid.any():
        none = np.zeros(0, np.int64)
        return (none, none, none, none.view(np.uint64), none.view(np.uint64), np.zeros((2, 0), np.uint64)), h
    value, wide = W.window_hashes(h, gram), 1
    at = np.arange(len(value))
    grams = window - gram + 1
    while wide < grams:
        step = min(wide, grams - wide)
        right = value[step:]
        keep = value[: len(right)] <= right
        value = np.where(keep, value[: len(right)], right)
        at = np.where(keep, at[: len(keep)], at[step:])
        wide += step
    doc = t.word_doc()[:n]
    new = np.ones(n, bool)
    new[1:] = (at[1:n] != at[: n - 1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    ends = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1
    windows = ends - first
    content = W.span_hashes(h, first, ends + window - 1)
    run, reach, sides = at[first], -(-(window - gram) // 2), np.zeros((2, len(first)), np.uint64)
    for side, start, there in ((0, run - reach, run - reach >= first), (1, run, run + gram + reach <= ends + window - 1)):
        sides[side, there] = W.span_hashes(h, start[there], start[there] + gram + reach)
    return (doc[first], first - t.first[doc[first]], windows, value[first], content, sides), h


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeats(docs: DataFrame) -> DataFrame:
    """(row, spans): for the rows of docs (numbered by `_pl_row`) with repeated windows, (first word, mask of windows)."""
    spark = docs.sparkSession

    def sides_of(batch):
        for _, _, t in W.chunks(batch.column("text")):
            sides = segments(t)[0][5].ravel()
            yield sides[sides != 0]

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 2 * _filter_size(size // 80)  # a segment, with one side or two, begins about every 80 bytes
    maps = spark.sparkContext.broadcast(repeated_places(docs.select("text"), bits, sides_of))

    def refer(batches):
        for batch in batches:
            for a, b, t in W.chunks(batch.column("text")):
                (doc, first, windows, value, content, sides), _ = segments(t)
                again = sides != 0
                for bitmap, p in zip(maps.value, _two_places(sides, bits), strict=True):
                    again &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                keep = again.any(0)
                rows = batch.column("_pl_row").slice(a, b - a).take(pa.array(doc[keep]))
                yield pa.RecordBatch.from_arrays([rows, pa.array(first[keep].astype(np.int32)), pa.array(windows[keep].astype(np.int32)), _signed(value[keep]), _signed(content[keep])], ["row", "first", "windows", "m", "c"])

    refs = materialise(docs.select("_pl_row", "text").mapInArrow(refer, "row long, first int, windows int, m long, c long"), "segments")
    maps.destroy()  # or workers keep it for later stages
    contents = refs.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "windows")).alias("at"))
    sizes = contents.groupBy("m").agg(F.sum("n").alias("_n"), F.sum(F.col("at.windows") + WINDOW - 1).alias("_words"))
    sizes = materialise(sizes.filter("_n > 1").select(F.col("m").alias("_m"), (F.col("_words") > HOT_WORDS).alias("_hot")), "minimisers")
    often = sizes.filter("NOT _hot").select("_m")
    hot = sizes.filter("_hot").select("_m")
    wanted = contents.join(often, F.col("m") == F.col("_m")).select("m", "c", F.least("n", F.lit(2)).cast("int").alias("n"), "at.*")
    listed = wanted.groupBy(F.col("row").alias("_pl_at")).agg(F.collect_list(F.struct("first", "windows", "n", "m", "c")).alias("_pl_asked"))

    def fetch(batches):
        for batch in batches:
            asked = batch.column("_pl_asked")
            for a, b, t in W.chunks(batch.column("text")):
                h = t.hashes()
                part = asked.slice(a, b - a)
                doc = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                flat = part.flatten()
                first, windows = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                start, sizes = t.first[doc] + first, windows + WINDOW - 1
                raw = h[W.flat_ranges(start, sizes)].tobytes()
                offsets = np.concatenate([[0], np.cumsum(8 * sizes)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([flat.field(3), flat.field(4), flat.field(2), words], ["m", "c", "n", "words"])

    asked = docs.select("_pl_row", "text").join(listed, F.col("_pl_row") == F.col("_pl_at")).select("text", "_pl_asked")
    held = materialise(asked.mapInArrow(fetch, "m long, c long, n int, words binary"), "contents")
    total = held.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, total // 8 // SHARD_WORDS)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, np.uint64) for x in pdf["words"]]
        found = repeated_windows(texts, pdf["n"].to_numpy().astype(np.int64), WINDOW)
        mask = np.array([int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little") for x in found], np.int64)
        out = pd.DataFrame({"_m": pdf["m"], "_c": pdf["c"], "mask": mask})
        return out[out["mask"] != 0]

    shard = F.pmod(F.xxhash64("m"), F.lit(shards))
    verdicts = materialise(held.groupBy(shard.alias("shard")).applyInPandas(search, "_m long, _c long, mask long"), "verdicts")
    discard(held)
    hits = refs.join(verdicts, (F.col("m") == F.col("_m")) & (F.col("c") == F.col("_c"))).select("row", "first", "mask")
    if not hot.isEmpty():
        hits = hits.unionByName(_counted_windows(docs, refs, hot))
    return hits.groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("spans"))


def _counted_windows(docs: DataFrame, refs: DataFrame, hot: DataFrame) -> DataFrame:
    """(row, first, mask): the repeated windows of segments whose minimiser has more distinct words than a shard takes.

    Such a minimiser is in a passage with many different neighbours. Its windows are counted by their hashes instead, partly
    before the shuffle, so its segments never meet; equal windows have equal minimisers, so no count is split.
    """
    of_hot = refs.join(hot, F.col("m") == F.col("_m"), "left_semi")
    listed = of_hot.groupBy(F.col("row").alias("_pl_at")).agg(F.collect_list(F.struct("first", "windows")).alias("_pl_asked"))

    def hashes(batches):
        for batch in batches:
            asked = batch.column("_pl_asked")
            for a, b, t in W.chunks(batch.column("text")):
                h, part = t.hashes(), asked.slice(a, b - a)
                lengths = np.diff(part.offsets.to_numpy())
                doc, flat = np.repeat(np.arange(b - a), lengths), part.flatten()
                first, windows = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                at = W.flat_ranges(first, windows)
                doc = np.repeat(doc, windows)
                start = t.first[doc] + at
                row = batch.column("_pl_row").slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([row, pa.array(at.astype(np.int32)), _signed(W.span_hashes(h, start, start + WINDOW))], ["row", "first", "w"])

    asked = docs.select("_pl_row", "text").join(listed, F.col("_pl_row") == F.col("_pl_at")).select("_pl_row", "text", "_pl_asked")
    windows = materialise(asked.mapInArrow(hashes, "row long, first int, w long"), "windows")
    again = windows.groupBy(F.col("w").alias("_w")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return windows.join(again, F.col("w") == unknown_key(F.col("_w"))).select("row", "first", F.lit(1).cast("long").alias("mask"))


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n words are in a window that the spans mark."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        bits = np.flatnonzero(np.unpackbits(np.array([s["mask"]], "<i8").view(np.uint8), bitorder="little"))
        np.add.at(edge, s["first"] + bits, 1)
        np.add.at(edge, s["first"] + bits + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed, kept_text (the words left, joined by one space) and removed (arrays of [from, to)).

    A word goes if a window of WINDOW words over it starts at another place too, in any document or the same;
    all is judged on the input. A null text has no words; one shorter than a window loses none. Repeated rows
    of WINDOW words or more lose all. docs must read the same on every pass, as a table does. An empty table
    gives an empty result. docs' columns stay, whatever their names, except those named like the added.
    """
    added = "n_words", "n_removed", "kept_text", "removed"
    numbered, show = hide(docs, ("text",), added, F.monotonically_increasing_id().alias("_pl_row"))
    own = [c for c in numbered.columns if c != "_pl_row"]
    found = repeats(numbered).select(F.col("row").alias("_pl_found"), F.col("spans").alias("_pl_spans"))
    joined = numbered.join(found, F.col("_pl_row") == F.col("_pl_found"), "left").select(*own, "_pl_spans")
    schema = numbered.select(own).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("removed", T.ArrayType(T.ArrayType(T.LongType())))

    def cut(batches):
        for batch in batches:
            spans = batch.column("_pl_spans")
            rest = batch.select(own)
            for a, b, t in W.chunks(batch.column("text")):
                counts, gone, kept, ranges = [], [], [], []
                for i in range(a, b):
                    words = t.data[t.bounds[i - a] : t.bounds[i - a + 1]].tobytes().split()
                    covered = _covered(len(words), spans[i].as_py() or [])
                    counts.append(len(words))
                    gone.append(int(covered.sum()))
                    kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words).decode())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                    ranges.append(edges.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(ranges, pa.list_(pa.list_(pa.int64())))], [*own, *added])

    return show(joined.mapInArrow(cut, schema), *added)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
