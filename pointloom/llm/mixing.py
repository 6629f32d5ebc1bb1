"""Mixing sources to target weights by Pfair scheduling: blocks of each source get release times and deadlines from
its weight, and earliest deadline first interleaves them with a deviation below one block.

Weights are whole numbers of SCALE (largest remainders), so windows are exact over the whole run and nothing repeats.
The driver sees a count per source and runs the scheduler, a step per block; the slots go out in lots of `cycle` blocks
of a source, PART lots at a time. Rows go through DataFrame expressions only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.names import hide
from pointloom.llm.storage import fresh_path, number_gapless

BLOCK_ROWS = 16
CYCLE = 1024
#: Without given weights, a source weighs its number of rows to this power.
TEMPERATURE = 0.5
#: Lots that a source is ranked in at least, and rows in a lot, about, beyond that.
LOTS, LOT_ROWS = 256, 1 << 18
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_index")
#: Weights are whole multiples of 1 / SCALE, and LEAST / SCALE at least, so that slots are longs.
SCALE, LEAST = 2**60, 2**30
#: Lots that the driver holds at once, and blocks and sources up to which the schedule and the weights are broadcast.
PART, BROADCAST_BLOCKS, BROADCAST_SOURCES = 1024, 2**22, 2**18


def whole_slots(weights: dict[str | None, float], cycle: int = SCALE) -> dict[str | None, int]:
    """Slots of `cycle` by source, by largest remainders: `cycle` in all, each less than one from its exact share."""
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    total = sum(map(Fraction, weights.values()))
    exact = {s: cycle * Fraction(weights[s]) / total for s in names}
    slots = {s: int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: slots[s] - exact[s])[: cycle - sum(slots.values())]:
        slots[s] += 1
    return slots


def edf(slots: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int]]:
    """(source, slot) of all sources' blocks 0, 1, ..., by slot.

    Block i of a source with n of all H slots is released at floor(i H / n) and due by ceil((i + 1) H / n);
    in each slot the released block with the earliest deadline goes, so none is early or late. A source without
    further blocks leaves its slots empty.
    """
    whole = sum(slots.values())
    names = [s for s in slots if slots[s] and blocks[s]]
    share, left, done = [slots[s] for s in names], [blocks[s] for s in names], [0] * len(names)
    waiting = [(0, k) for k in range(len(names))]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * whole // share[k]), k))
        k = heapq.heappop(ready)[1]
        yield names[k], t
        done[k] += 1
        if done[k] < left[k]:
            heapq.heappush(waiting, (done[k] * whole // share[k], k))
        t += 1


def edf_cycle(slots: dict[str | None, int]) -> dict[str | None, list[int]]:
    """The slot of each source's blocks 0, 1, ... in as many slots as there are."""
    out: dict[str | None, list[int]] = {s: [] for s in slots}
    for s, t in edf(slots, slots):
        out[s].append(t)
    return out


def lots(slots: dict[str | None, int], blocks: dict[str | None, int], cycle: int = CYCLE) -> Iterator[tuple[str | None, int, list[int]]]:
    """(source, lot, slots of the source's blocks lot * cycle, lot * cycle + 1, ...), each when it is full."""
    open_: dict[str | None, list[int]] = {s: [] for s in slots}
    full = dict.fromkeys(slots, 0)
    for s, t in edf(slots, blocks):
        open_[s].append(t)
        if len(open_[s]) == cycle:
            yield s, full[s], open_[s]
            full[s], open_[s] = full[s] + 1, []
    for s, at in open_.items():
        if at:
            yield s, full[s], at


def schedule(spark: SparkSession, slots: dict[str | None, int], blocks: dict[str | None, int], cycle: int = CYCLE) -> DataFrame:
    """The table of lots(). Beyond PART lots it goes to the shared folder part by part."""
    schema = "_source string, _lot long, _slots array<long>"
    found = lots(slots, blocks, cycle)
    part = list(islice(found, PART))
    more = next(found, None)
    if more is None:
        table = spark.createDataFrame(part, schema)
    else:
        path, found = fresh_path(spark, "schedule"), chain([more], found)
        while part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
            part = list(islice(found, PART))
        table = spark.read.schema(schema).parquet(path)
    return F.broadcast(table) if sum(blocks.values()) <= BROADCAST_BLOCKS else table


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """docs with mix_block (the row's block within its source), mix_release, mix_deadline, mix_slot and mix_index.

    mix_slot orders the blocks of all sources and mix_index the rows of a block. Within a source rows are taken by
    a hash of (doc_id, text), then doc_id; a source's rank is counted in lots, so a hot source is spread over tasks. All
    rows are placed: when a source runs out its slots stay empty and the others go on in their proportions. A null
    source is a source of its own, and one without a given weight weighs as its rows do. Repeated rows get
    neighbouring places; an empty table gives an empty result. docs' columns stay, whatever their names, except those
    named like the added.
    """
    hidden, show = hide(docs, ("doc_id", "text", "source"), ADDED)
    return show(_placed(hidden, weights, block_rows, cycle), *ADDED)


def _placed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """mix() for columns whose names are none of those used here."""
    spark, own = docs.sparkSession, docs.columns
    rows = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {s: (weights or {}).get(s, n**TEMPERATURE) for s, n in rows.items()}
    slots = {s: max(n, LEAST) for s, n in whole_slots(shares).items()} if shares else {}
    table = schedule(spark, slots, {s: -(-n // block_rows) for s, n in rows.items()}, cycle)
    counts = spark.createDataFrame([(s, str(n)) for s, n in slots.items()], "_name string, _n string")  # a row per source
    counts = F.broadcast(counts) if len(slots) <= BROADCAST_SOURCES else counts
    lots = max(LOTS, sum(rows.values()) // LOT_ROWS)
    keyed = docs.select(*own, F.xxhash64("doc_id", F.col("text")).alias("_h"))
    ranked = number_gapless(keyed, "_rank", ["source"], F.pmod("_h", F.lit(lots)), [F.col("_h"), F.col("doc_id")])
    ranked = ranked.withColumn("mix_block", F.floor(F.col("_rank") / block_rows))
    placed = ranked.join(counts, F.col("source").eqNullSafe(F.col("_name")))
    placed = placed.join(table, F.col("source").eqNullSafe(F.col("_source")) & (F.expr(f"mix_block div {cycle}") == F.col("_lot")))
    whole = f"cast('{sum(slots.values())}' as decimal(20, 0))"  # windows in decimals: products are beyond longs
    n = "cast(_n as decimal(20, 0))"
    return placed.withColumns({
        "mix_release": F.expr(f"cast(mix_block as decimal(18, 0)) * {whole} div {n}"),
        "mix_deadline": F.expr(f"(cast(mix_block + 1 as decimal(18, 0)) * {whole} + {n} - 1) div {n}"),
        "mix_slot": F.element_at("_slots", F.expr(f"mix_block % {cycle} + 1").cast("int")),
        "mix_index": F.col("_rank") % block_rows,
    }).select(*own, *ADDED)


def positions(mixed: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """Add mix_pos, gapless from 0, in the order of mix_slot and mix_index. The rows of `cycle` slots meet in a task."""
    hidden, show = hide(mixed, ("mix_slot", "mix_index"), ("mix_pos",))
    return show(number_gapless(hidden, "mix_pos", [], F.floor(F.col("mix_slot") / cycle), [F.col("mix_slot"), F.col("mix_index")]), "mix_pos")


def interleave(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """docs' rows and columns in the mix's order: sorted partitions, the first rows in the first."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hidden, show = hide(docs, ("doc_id", "text", "source"))
    mixed = _placed(hidden, weights)
    return show(mixed.repartitionByRange(partitions, "mix_slot", "mix_index").sortWithinPartitions("mix_slot", "mix_index"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    thin = mix(docs).drop("text")
    return positions(thin).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_pos")
