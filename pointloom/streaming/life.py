"""Extension: the particles' state machine of operators.life over a stream, as an operator with state.

Four variables of state and a timer for each particle, by transformWithStateInPandas. The session's state store must be RocksDB
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pointloom.operators.life import BLANK, INPUT, MEMORY, OUTPUT, Rules, step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The variables of state and what each holds of the memory.
VARIABLES = {"candidate": ["candidate", "times", "committed"], "life": ["life", "dwell"], "events": ["clones", "splits", "prunes", "rest", "left"], "truncation": ["truncation"]}


def _plain(x):
    return None if x is None or x is pd.NaT or x != x else x.item() if hasattr(x, "item") else x


class Life(StatefulProcessor):
    def __init__(self, key: str, order: list[str], rules: Rules, time: str | None, idle: int) -> None:
        self.key, self.order, self.rules, self.time, self.idle = key, order, rules, time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = {n: handle.getValueState(n, ", ".join(f"{c} {MEMORY[c]}" for c in cols)) for n, cols in VARIABLES.items()}

    def _memory(self) -> tuple:
        if not self.held["life"].exists():
            return BLANK
        found = {}
        for n, cols in VARIABLES.items():
            found |= dict(zip(cols, self.held[n].get(), strict=True))
        return tuple(found[c] for c in MEMORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory, out, latest = self._memory(), [], None
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        for r in batch[[*self.order, *INPUT]].itertuples(index=False, name=None):
            memory, result = step(memory, tuple(map(_plain, r[len(self.order) :])), self.rules)
            out.append((*key, *r[: len(self.order)], *result))
        if self.time:
            latest = int(batch[self.time].max().timestamp() * 1000)
        if memory == BLANK:
            for v in self.held.values():
                v.clear()
        else:
            named = dict(zip(MEMORY, memory, strict=True))
            for n, cols in VARIABLES.items():
                self.held[n].update(tuple(named[c] for c in cols))
        if latest is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest + self.idle)
        yield pd.DataFrame(out, columns=[self.key, *self.order, *OUTPUT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A particle that wasn't refreshed for `idle` milliseconds is forgotten; should it come back, it begins anew."""
        for v in self.held.values():
            v.clear()
        return iter(())

    def close(self) -> None:
        pass


def lives(refreshes: DataFrame, key: str, order: list[str], rules: Rules = Rules(), time: str | None = None, idle: int = 86_400_000) -> DataFrame:
    """A row (key, order..., the columns of OUTPUT) per refresh, in append mode. Rows of a key must come in order from batch to batch.

    With `time`, a column that the stream has a watermark on, particles idle for that many milliseconds are forgotten.
    """
    types = {f.name: f.dataType.simpleString() for f in refreshes.schema}
    out = ", ".join([f"`{c}` {types[c]}" for c in (key, *order)] + [f"{k} {v}" for k, v in OUTPUT.items()])
    return refreshes.groupBy(key).transformWithStateInPandas(Life(key, order, rules, time, idle), out, "Append", "EventTime" if time else "None")
