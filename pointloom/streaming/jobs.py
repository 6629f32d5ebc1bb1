"""Structured Streaming forms: running statistics, windows, and the stateful folds of operators.state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_stats(events: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the running sum, largest value and count; for update or complete mode."""
    return events.groupBy(key).agg(F.sum(value).alias("total"), F.max(value).alias("largest"), F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Per window and key the count and sum; rows later than `late` are dropped with the window's state."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = events.withWatermark(time, late).groupBy(w.alias("window"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window(time, gap)
    g = events.withWatermark(time, late).groupBy(s.alias("window"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def cadence(iteration: str, every: int):
    """The number of the count-based trigger that an iteration belongs to."""
    return F.floor(F.col(iteration) / every)


def _fold(df: DataFrame, key: str, order: list[str], out: str, state: str, step) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(k, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        now, result = step(now, rows)
        if now is not None:
            held.update(now)
        yield pd.DataFrame([(*k, *result)], columns=[key, *[x.split()[0] for x in out.split(", ")]])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", state, "update", GroupStateTimeout.NoTimeout)


def ema(events: DataFrame, key: str, order: list[str], value: str, beta: float = 0.9) -> DataFrame:
    """(key, ema) after each batch, rows of a batch in order; the first non-null value starts it."""

    def step(now, rows):
        v = now[0] if now else None
        for x in rows[value].dropna():
            v = float(x) if v is None else v * beta + x * (1 - beta)
        return ((v,) if v is not None else None), (v,)

    return _fold(events, key, order, "ema double", "ema double", step)


def hysteresis(events: DataFrame, key: str, order: list[str], state: str, repeats: int = 3) -> DataFrame:
    """(key, committed): the state that last came `repeats` times in a row."""

    def step(now, rows):
        last, run, held = now or (None, 0, None)
        for x in rows[state]:
            run = run + 1 if x == last else 1
            last = x
            held = x if run >= repeats else held
        return (last, run, held), (held,)

    return _fold(events, key, order, "committed string", "last string, run int, held string", step)


def cooldown(events: DataFrame, key: str, order: list[str], fire: str, rest: int) -> DataFrame:
    """(key, fired): events that count, each silencing the `rest` rows behind it; fire: a boolean column."""

    def step(now, rows):
        left, fired = now or (0, 0)
        for x in rows[fire]:
            go = bool(x) and left == 0
            left, fired = (rest if go else max(0, left - 1)), fired + go
        return (left, int(fired)), (int(fired),)

    return _fold(events, key, order, "fired int", "remaining int, fired int", step)
