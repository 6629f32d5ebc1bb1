"""Orders of an epoch without a sort: a keyed permutation of the rows' numbers, and its inverse, as column expressions.

Each round pairs number x with (key - x) mod n and swaps the pair or not, by a bit that is drawn from the larger of both; a round is its own
inverse, so the rounds backwards give the number at a place. The order of an epoch can be taken up again at any place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import let
from pointloom.operators.order import numbered

ROUNDS = 48
#: Fixed value: the modulus of the draws; there are no more rows than that.
PRIME = 2147483647


def draws(seed: int, epoch: int) -> list[tuple[int, int, int, int, int]]:
    """Numbers below PRIME that each round is made of: its key and the coefficients of its bit."""
    r = np.random.default_rng([seed, epoch])
    return [tuple(int(x) for x in row) for row in r.integers(1, PRIME, (ROUNDS, 5))]


def _through(number: Column, n: Column, rounds: list[tuple[int, int, int, int, int]]) -> Column:
    keys = F.array(*[F.array(*[F.lit(x).cast("long") for x in k]) for k in rounds])
    size = n.cast("long")

    def step(x: Column, k: Column) -> Column:
        def chosen(y: Column) -> Column:
            most = F.greatest(x, y)
            a, b = ((most * k[m] + k[m + 1]) % PRIME for m in (1, 3))
            return F.when(F.shiftright(a * b % PRIME, 7) % 2 == 1, y).otherwise(x)

        return let((k[0] % size - x + size) % size, chosen)

    return F.aggregate(keys, number.cast("long"), step)


def place_of(number: Column, n: Column, seed: int, epoch: int) -> Column:
    """The place in the epoch's order, from 0, of each number from 0 to n - 1."""
    return _through(number, n, draws(seed, epoch))


def number_at(place: Column, n: Column, seed: int, epoch: int) -> Column:
    """The number at each place of the epoch's order."""
    return _through(place, n, draws(seed, epoch)[::-1])


def in_epoch(df: DataFrame, keys: list[str], seed: int = 0, epoch: int = 0, out: str = "place") -> DataFrame:
    """Add `out`, the row's place in the epoch's order, a permutation of all rows; rows are numbered once, by keys."""
    rows = numbered(df, keys, "_number")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.join(F.broadcast(n))  # one row
    return placed.withColumn(out, place_of(F.col("_number"), F.col("_n"), seed, epoch)).drop("_number", "_n")
