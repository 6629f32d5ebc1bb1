"""Segmented scans: what lies before a row within its key, for associative summaries, without a task that holds a key.

Rows are written out once in ranges of (key, order). Within a range a window does the work; a range's summary for each of its keys is a
row, summaries are combined over the ranges of a key, and what came before goes back to the range's rows. A key that fills a third of
the table fills a third of the ranges, and only its summaries, one a range, ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pointloom.operators.order import in_ranges

PART = "_order_part"


def ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return in_ranges(df, *keys, *order)


def inside(keys: list[str], order: list[str]) -> WindowSpec:
    """A key's rows of one range, in order, up to the current one."""
    return Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def back(parts: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """parts with the other columns of found, which has a row for each key and range."""
    named = found.withColumnsRenamed({k: f"_s{i}" for i, k in enumerate(keys)} | {PART: "_sp"})
    on = F.col(PART) == F.col("_sp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    return parts.join(named, on).drop("_sp", *[f"_s{i}" for i in range(len(keys))])


def running_sums(parts: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """parts (of `ranges`) with the sum of each column up to and with the row, and as <name>_all the key's sum.

    Fractions are added in the rows' order, the key's sum too, so it is what the last row's is; in any other order the last bits would
    differ, and with them whether a limit is met that is a share of the sum.
    """
    rows = parts.withColumns({f"_{n}_in": c for n, c in sums.items()})
    kinds = dict(rows.dtypes)
    rounded = [n for n in sums if kinds[f"_{n}_in"] in ("double", "float")]
    whole = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    in_order = inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    added = rows.withColumns({f"_{n}_sum": F.sum(f"_{n}_in").over(in_order) for n in rounded})
    each = added.groupBy(*keys, PART).agg(*[(F.max(f"_{n}_sum") if n in rounded else F.sum(f"_{n}_in")).alias(f"_{n}_sum") for n in sums])
    named = [F.coalesce(F.sum(f"_{n}_sum").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums] + [F.sum(f"_{n}_sum").over(whole).alias(f"{n}_all") for n in sums]
    placed = back(rows.withColumns({f"_{n}_run": F.sum(f"_{n}_in").over(inside(keys, order)) for n in sums}), each.select(*keys, PART, *named), keys)
    out = placed.withColumns({n: F.col(f"_{n}_before") + F.coalesce(f"_{n}_run", F.lit(0)) for n in sums})
    return out.drop(*[f"_{n}_{x}" for n in sums for x in ("in", "run", "before")])


def best_of_key(parts: DataFrame, keys: list[str], best: dict[str, Column]) -> DataFrame:
    """parts with each aggregate (a least or largest value, say) of its key; aggregates must combine with themselves by min."""
    each = parts.groupBy(*keys, PART).agg(*[F.min(c).alias(n) for n, c in best.items()])
    over = each.select(*keys, PART, *[F.min(n).over(Window.partitionBy(*keys)).alias(n) for n in best])
    return back(parts, over, keys)


def runs(parts: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """parts with _k, the row's number in its run of equal states in the range, and _head, whether that run is the range's first of the key."""
    w = Window.partitionBy(key, PART).orderBy(*order)
    changed = ~F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1)
    numbered = parts.withColumn("_changed", changed.cast("int")).withColumn("_run", F.sum("_changed").over(inside([key], order)))
    placed = numbered.withColumn("_k", F.row_number().over(Window.partitionBy(key, PART, "_run").orderBy(*order)))
    return placed.withColumn("_head", F.col("_run") == 0).drop("_changed")


def carried_runs(rows: DataFrame, key: str, order: list[str], state: str, repeats: int) -> DataFrame:
    """rows (of `runs`) with _before: the state of the key's last row before the range, its run's length there, and what was committed.

    A range's summary for a key is its first run, its last run, and what its other runs commit; a key's summaries, one a
    range, are folded in order.
    """
    at = F.struct(*order)
    kept = F.when(~F.col("_head") & (F.col("_k") >= repeats) & F.col(state).isNotNull(), F.struct(at.alias("at"), F.col(state).alias("s")))
    each = rows.groupBy(key, PART).agg(
        F.count_if("_head").alias("first_len"), F.min(F.struct(at.alias("at"), F.col(state).alias("s"))).alias("_first"),
        F.max(F.struct(at.alias("at"), F.col(state).alias("s"), F.col("_k").alias("k"), F.col("_run").alias("run"))).alias("_last"), F.max(kept).alias("_kept"),
    )
    each = each.select(key, F.struct(PART, "first_len", F.col("_first.s").alias("first"), F.col("_last.s").alias("last"), F.col("_last.k").cast("long").alias("last_len"), (F.col("_last.run") == 0).alias("one"), F.col("_kept.s").alias("kept")).alias("x"))
    kind = dict(rows.dtypes)[state]
    carry = f"struct<state:{kind},length:bigint,held:{kind}>"
    start = F.struct(F.lit(None).cast(kind).alias("state"), F.lit(0).cast("long").alias("length"), F.lit(None).cast(kind).alias("held"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        length = x["first_len"] + F.when(x["first"].eqNullSafe(now["state"]), now["length"]).otherwise(0)
        held = F.coalesce(x["kept"], F.when(length >= repeats, x["first"]), now["held"])
        after = F.struct(x["last"].alias("state"), F.when(x["one"], length).otherwise(x["last_len"]).alias("length"), held.alias("held"))
        return F.struct(after.alias("now"), F.concat(acc["befores"], F.array(F.struct(x[PART].alias(PART), now.alias("_before")))).alias("befores"))

    folded = each.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list("x")), F.struct(start.alias("now"), F.array().cast(f"array<struct<{PART}:int,_before:{carry}>>").alias("befores")), step).alias("f"))
    return back(rows, folded.select(key, F.explode("f.befores").alias("b")).select(key, "b.*"), [key])
