"""Sharding by fixed virtual slots: documents hash into slots, a versioned map sends slots to shards.

The rows' path is DataFrame expressions only. What reaches the driver is one number per virtual slot
(`n_slots`, a fixed parameter), never anything that grows with the rows.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.names import hide
from pointloom.llm.storage import fresh_path

N_SLOTS = 4096
N_SHARDS = 16
ADDED = ("size", "text_crc32", "virtual_slot", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map: `shards[i]` is the shard of virtual slot i."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def initial(n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> SlotMap:
        return SlotMap(0, n_shards, tuple(i * n_shards // n_slots for i in range(n_slots)))

    def rebalanced(self, slot_bytes: list[int]) -> SlotMap:
        """The next version: slots leave the fullest shard for the emptiest until no move or swap evens the two out."""
        shards = list(self.shards)
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(shards):
            if slot_bytes[slot]:
                own[shard].append((slot_bytes[slot], slot))
        for x in own:
            x.sort()
        load = [sum(b for b, _ in x) for x in own]

        def move(k: int, a: int, b: int) -> None:
            size, slot = own[a].pop(k)
            own[b].insert(bisect_left(own[b], (size, slot)), (size, slot))
            load[a] -= size
            load[b] += size
            shards[slot] = b

        for _ in range(16 * len(shards)):
            order = sorted(range(self.n_shards), key=load.__getitem__)
            done = True
            for lo in order[:4]:
                hi = order[-1]
                gap = load[hi] - load[lo]
                best = min(((abs(2 * own[hi][k][0] - gap), k) for k in _around(own[hi], gap / 2)), default=(gap, -1))
                if best[0] < gap:
                    move(best[1], hi, lo)
                    done = False
                    break
                swaps = [(abs(2 * (size - own[lo][j][0]) - gap), k, j) for k, (size, _) in enumerate(own[hi]) for j in _around(own[lo], size - gap / 2)]
                best_swap = min(swaps, default=(gap, -1, -1))
                if best_swap[0] < gap:
                    _, k, j = best_swap
                    taken = own[lo][j]
                    move(k, hi, lo)
                    move(own[lo].index(taken), lo, hi)
                    done = False
                    break
            if done:
                break
        return SlotMap(self.version + 1, self.n_shards, tuple(shards))

    def grown(self, slot_bytes: list[int] | None = None) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest shards; no other slot moves."""
        weight = slot_bytes or [1] * len(self.shards)
        shards, new = list(self.shards), self.n_shards
        load = [0] * (new + 1)
        own: list[list[tuple[int, int]]] = [[] for _ in range(new)]
        for slot, shard in enumerate(shards):
            load[shard] += weight[slot]
            own[shard].append((weight[slot], slot))
        for x in own:
            x.sort()
        goal = sum(load) / (new + 1)
        while load[new] < goal:
            hi = max(range(new), key=load.__getitem__)
            if not own[hi]:
                break
            size, slot = own[hi].pop()
            if load[new] + size > goal and load[new]:
                own[hi].insert(0, (0, slot))
                size, slot = own[hi].pop(max(0, bisect_left(own[hi], (goal - load[new], -1)) - 1))
                if load[new] + size > goal:
                    break
            shards[slot] = new
            load[hi] -= size
            load[new] += size
        return SlotMap(self.version + 1, new + 1, tuple(shards))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, i, s) for i, s in enumerate(self.shards)], "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table; earlier versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        table = spark.read.parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def _latest(spark: SparkSession, path: str) -> SlotMap | None:
    try:
        return SlotMap.load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _around(sizes: list[tuple[int, int]], x: float) -> list[int]:
    k = bisect_left(sizes, (x, -1))
    return [j for j in (k - 1, k) if 0 <= j < len(sizes)]


def virtual_slot(n_slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Add size, text_crc32, virtual_slot, law, shard, slot and grown_shard to every row of docs.

    A row's virtual slot is a hash of (doc_id, text), so copies of one text spread over all slots. The
    bytes of every slot are summed and the initial map is edited until shards are near equal in bytes (law
    `bytes`). With `map_path` the latest map there is edited, or the initial one if there is none, every version
    is saved there, and rows are placed by the new version as it is read back. `slot` is the row's place within
    its shard, gapless from 0, by virtual slot, doc_id, size and crc32; only one virtual slot's rows meet
    in a task. A null text has no bytes and crc32 0; every row's size has 1 added. A null doc_id hashes
    like any key. Repeated rows share a virtual slot and get places of their own. An empty table gives
    an empty result. Columns of docs stay, whatever their names, except that those named like the added ones are replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    hidden, show = hide(docs, ("doc_id", "text"), ADDED)
    keyed = hidden.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text).cast("long"), "virtual_slot": virtual_slot(n_slots, F.col("doc_id"), text)})
    slot_bytes, slot_rows = [0] * n_slots, [0] * n_slots
    for r in keyed.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        slot_bytes[r["virtual_slot"]], slot_rows[r["virtual_slot"]] = r["b"], r["n"]
    stored = _latest(spark, map_path) if map_path else None
    if stored and (stored.n_shards, len(stored.shards)) != (n_shards, n_slots):
        raise ValueError(f"the map at {map_path} has {stored.n_shards} shards and {len(stored.shards)} slots")
    first = stored or SlotMap.initial(n_shards, n_slots)
    second = first.rebalanced(slot_bytes)
    if map_path:
        if not stored:
            first.save(spark, map_path)
        second.save(spark, map_path)
        second = SlotMap.load(spark, map_path, second.version)
    filled, rows = [0] * n_shards, []
    for i, shard in enumerate(second.shards):
        rows.append((i, shard, filled[shard]))
        filled[shard] += slot_rows[i]
    placed = spark.createDataFrame(rows, "_slot int, _shard int, _base long")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    out = keyed.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(placed), F.col("virtual_slot") == F.col("_slot"))  # n_slots rows
    out = out.withColumns({"law": F.lit("bytes"), "shard": F.col("_shard"), "slot": F.col("_base") + F.col("_rank") - 1, "grown_shard": F.lit(None).cast("int")})
    return show(out, *ADDED)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs, map_path=fresh_path(spark, "slot-map")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")
