"""Columns of the caller under names that no operator uses, while an operator works."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def hide(docs: DataFrame, used: Iterable[str], added: Iterable[str] = (), *more: Column) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(docs with the columns `used` as they are and the others as _own0, _own1, ..., the way back).

    Columns named like the `added` ones go. The way back selects docs' columns under their names and in their order,
    without those listed in `less`, and then the added ones, as columns or (name, column).
    """
    used, names = list(used), {x.lower() for x in added}
    own = {c: c if c in used else f"_own{i}" for i, c in enumerate(docs.columns) if c.lower() not in names or c in used}
    hidden = docs.select(*[column(c).alias(x) for c, x in own.items()], *more)

    def show(out: DataFrame, *added: str | Column, less: Iterable[str] = ()) -> DataFrame:
        return out.select(*[F.col(x).alias(c) for c, x in own.items() if c not in less], *added)

    return hidden, show
