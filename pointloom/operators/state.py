"""Folds over ordered observations of a key: smoothing, hysteresis, cooldown. Extensions, in batch form.

The streaming module runs the same step functions over Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import scan
from pointloom.operators.order import numbered, quantiles


def ema(df: DataFrame, key: str, order: list[str], value: str, beta: float = 0.9) -> DataFrame:
    """(key, ema): beta * ema + (1 - beta) * value in order, the first non-null value starting it; nulls are skipped.

    The fold is a weighted sum: a row's weight follows from its place, so a key's rows need not meet.
    """
    rows = df.filter(F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias("_v"))
    placed = numbered(rows, [key, *order, "_v"], "_place")
    ends = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"))
    share = F.when(F.col("_place") == F.col("_first"), 1.0).otherwise(1 - beta)
    weighted = placed.join(ends, F.col(key).eqNullSafe(F.col("_key")))
    return weighted.groupBy(key).agg(F.sum(F.col("_v") * share * F.pow(F.lit(float(beta)), F.col("_last") - F.col("_place"))).alias("ema"))


def hysteresis(df: DataFrame, key: str, order: list[str], state: str, repeats: int = 3, out: str = "committed") -> DataFrame:
    """Add the state that last came `repeats` times in a row; null before the first. A null state breaks a run and commits nothing."""
    rows = scan.carried_runs(scan.runs(scan.ranges(df, [key], order), key, order, state), key, order, state, repeats)
    length = F.col("_k") + F.when(F.col("_head") & F.col(state).eqNullSafe(F.col("_before.state")), F.col("_before.length")).otherwise(0)
    held = F.last(F.when(length >= repeats, F.col(state)), ignorenulls=True).over(scan.inside([key], order))
    return rows.withColumn(out, F.coalesce(held, F.col("_before.held"))).select(*df.columns, out)


def cooldown(df: DataFrame, key: str, order: list[str], fire: Column, rest: int, block: int = 4096) -> DataFrame:
    """(key, fired): how often an event counts when each that counts silences the `rest` rows behind it.

    A key's rows are folded a block at a time, for each number of rows that may still be silent at the block's start; the
    blocks' outcomes are then chained, so of a hot key a task sees `block` rows or one entry a block.
    """
    flags = df.select(key, *order, F.coalesce(fire, F.lit(False)).alias("_f"))
    placed = numbered(flags, [key, *order, "_f"], "_place")
    blocks = placed.groupBy(key, F.floor(F.col("_place") / block).alias("_block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_f"))), lambda r: r["_f"]).alias("_flags"))
    starts = F.array(*[F.struct(F.lit(left).alias("left"), F.lit(0).alias("fired")) for left in range(rest + 1)])

    def step(states, go):
        def one(s):
            now = go & (s["left"] == 0)
            return F.struct(F.when(now, F.lit(rest)).otherwise(F.greatest(s["left"] - 1, F.lit(0))).alias("left"), (s["fired"] + now.cast("int")).alias("fired"))

        return F.transform(states, one)

    outcomes = blocks.select(key, "_block", F.aggregate("_flags", starts, step).alias("_ends"))
    chained = outcomes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_block", "_ends"))).alias("_rows"))

    def follow(s, r):
        end = F.get(r["_ends"], s["left"])
        return F.struct(end["left"].alias("left"), (s["fired"] + end["fired"]).alias("fired"))

    return chained.select(key, F.aggregate("_rows", F.struct(F.lit(0).alias("left"), F.lit(0).alias("fired")), follow)["fired"].alias("fired"))


def ramp_to(current: Column, goal: Column, most: float = 0.1) -> Column:
    """One bounded step towards a goal."""
    return current + F.least(F.lit(most), F.greatest(F.lit(-most), goal - current))


def decay(step: Column, end: float = 30000.0, span: float = 15000.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (end - step) / span))


# First iteration, name, and what is on, of each phase.
PHASES = (
    (0, "start", ()), (1000, "warm-up", ("evidence",)), (5000, "shadow", ("evidence", "states")),
    (7000, "repair", ("evidence", "states", "routing", "lifecycle", "ray_colour", "truncation")),
    (15000, "refine", ("evidence", "states", "routing", "ray_colour", "ray_normal", "prior_decay")),
)
SWITCHES = ("evidence", "states", "routing", "lifecycle", "ray_colour", "ray_normal", "truncation", "prior_decay")


def phase(iteration: Column) -> Column:
    """The phase of an iteration as a struct: name, whether each of SWITCHES is on, and the prior's weight. Null before the first."""
    out = F.lit(None)
    for first, name, on in PHASES:
        weight = decay(iteration.cast("double")) if "prior_decay" in on else F.lit(1.0)
        now = F.struct(F.lit(name).alias("phase"), *[F.lit(s in on).alias(s) for s in SWITCHES], weight.alias("prior_weight"))
        out = F.when(iteration >= first, now).otherwise(out)
    return out


def need(ambiguity: Column, sufficiency: Column) -> Column:
    return 1 - sufficiency * (1 - ambiguity)


def arbitrate(need: Column, prior: Column, geometry: Column, agreement: Column, prior_valid: Column | None = None, geometry_valid: Column | None = None, t_need: float = 0.5, t_prior: float = 0.5, t_geometry: float = 0.5, t_agree: float = 0.6, margin: float = 0.1) -> Column:
    """The first that holds of bypass (need at the limit, too), consensus, prior-led, geometry-led, then by the larger reliability, abstain.

    A side may lead only where it is valid (both are by default; null isn't).
    """
    p, g = (F.coalesce(x >= t, F.lit(False)) & (F.lit(True) if v is None else F.coalesce(v, F.lit(False))) for x, t, v in ((prior, t_prior, prior_valid), (geometry, t_geometry, geometry_valid)))
    return (
        F.when(need <= t_need, "bypass")
        .when(p & g & (agreement >= t_agree), "consensus")
        .when(p & ~g, "prior")
        .when(~p & g, "geometry")
        .when(p & g & (prior - geometry > margin), "prior")
        .when(p & g & (geometry - prior > margin), "geometry")
        .otherwise("abstain")
    )


def transitions(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(before, after, n): how often one state follows another."""
    rows = scan.carried_runs(scan.ranges(df.select(key, *order, state), [key], order).transform(lambda p: scan.runs(p, key, order, state)), key, order, state, 1)
    last = F.lag(F.struct(state)).over(Window.partitionBy(key, scan.PART).orderBy(*order))
    before = F.when(last.isNotNull(), last[state]).otherwise(F.col("_before.state"))
    return rows.select(before.alias("before"), F.col(state).alias("after")).filter("before IS NOT NULL").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def dwell_times(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(state, runs, mean_rows): the runs of equal states and their mean length."""
    rows = scan.carried_runs(scan.runs(scan.ranges(df.select(key, *order, state), [key], order), key, order, state), key, order, state, 1)
    goes_on = F.col("_head") & F.col(state).eqNullSafe(F.col("_before.state")) & (F.col("_before.length") > 0)
    begins = (F.col("_k") == 1) & ~goes_on
    return rows.groupBy(state).agg(F.count_if(begins).alias("runs"), (F.count(F.lit(1)) / F.count_if(begins)).alias("mean_rows"))


def ambiguity(df: DataFrame, value: str, low: float = 0.10, high: float = 0.95, eps: float = 1e-8) -> DataFrame:
    """Add ambiguity: the value between two of its quantiles, clipped to [0, 1]."""
    q = quantiles(df, value, [low, high])
    scaled = (F.col(value) - F.col("_q")[0]) / (F.col("_q")[1] - F.col("_q")[0] + eps)
    return df.join(F.broadcast(q)).withColumn("ambiguity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("_q")  # one row


def pooled(df: DataFrame, key: str, weight: str, mask: Column, value: str, least_weight: float = 1e-4, least_views: int = 2, eps: float = 1e-8) -> DataFrame:
    """(key, value, support, valid): the weighted mean over masked rows."""
    w = F.when(mask, F.col(weight)).otherwise(0.0)
    g = df.groupBy(key).agg(F.sum(w * F.col(value)).alias("_s"), F.sum(w).alias("support"), F.count_if(w > least_weight).alias("_n"))
    return g.select(key, (F.col("_s") / (F.col("support") + eps)).alias(value), "support", (F.col("_n") >= least_views).alias("valid"))
