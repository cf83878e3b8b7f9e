"""Functions that a user adds: aggregates given as partial, merge and finish columns, and table functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@dataclass(frozen=True)
class Aggregate:
    """An algebraic aggregate.

    ``partial`` makes states, by name, from a value and the text of ``by``; each is an aggregate over rows and
    sees nulls where a row has no value. ``merge`` says for each state how states of two parts become one.
    ``finish`` makes a number of the states. A bucket without a value has none.
    """

    partial: Callable[[Column, Column], dict[str, Column]]
    merge: dict[str, Callable[[Column], Column]]
    finish: Callable[[dict[str, Column]], Column]
    by: bool = False


def _same(f: Callable) -> Aggregate:
    return Aggregate(lambda v, _: {"x": f(v)}, {"x": f}, lambda s: s["x"])


#: Functions of the catalog that are algebraic as well.
ALGEBRAIC = {
    "sum": _same(F.sum),
    "min": _same(F.min),
    "max": _same(F.max),
    "mean": Aggregate(lambda v, _: {"s": F.sum(v), "n": F.count(v)}, {"s": F.sum, "n": F.sum}, lambda s: s["s"] / F.nullif(s["n"], F.lit(0))),
    "count": Aggregate(lambda v, _: {"n": F.count(v)}, {"n": F.sum}, lambda s: F.nullif(s["n"], F.lit(0))),
}
AGGREGATES: dict[str, Aggregate] = {}
TABLE_FUNCTIONS: dict[str, type] = {}


def register_aggregate(name: str, aggregate: Aggregate, replace: bool = False) -> None:
    """Let specs say ``using: name``. Names of the catalog stay as they are."""
    from tallyframe.plans.catalogs import FUNCTIONS

    if not name or name in FUNCTIONS or (name in AGGREGATES and not replace):
        raise ValueError(f"aggregate '{name}': needs a name of its own")
    AGGREGATES[name] = aggregate


def algebraic(name: str) -> Aggregate | None:
    return AGGREGATES.get(name) or ALGEBRAIC.get(name)


def states_of(name: str, value: Column, by: Column) -> dict[str, Column]:
    """The states of a function over rows, as aggregates."""
    states = algebraic(name).partial(value, F.when(value.isNotNull(), by))
    if missing := set(states) ^ set(algebraic(name).merge):
        raise ValueError(f"aggregate '{name}': states and merges differ in {', '.join(sorted(missing))}")
    return states


def over_rows(name: str, value: Column, by: Column) -> Column:
    """The function over rows of one bucket, as one aggregate column; null without a value."""
    return F.when(F.count(value) > 0, algebraic(name).finish(states_of(name, value, by)).cast("double"))


def register_table_function(name: str, handler: type, replace: bool = False) -> None:
    """A UDTF handler for what is not relational: a class with ``eval(row, ...)`` and a static ``analyze`` that gives its columns."""
    if not name or (name in TABLE_FUNCTIONS and not replace):
        raise ValueError(f"table function '{name}': needs a name of its own")
    if not (hasattr(handler, "analyze") and hasattr(handler, "eval")):
        raise ValueError(f"table function '{name}': needs eval and a static analyze")
    TABLE_FUNCTIONS[name] = handler


def through(df: DataFrame, name: str, by: list[str], order: list[str], **options) -> DataFrame:
    """Rows of a registered table function over ``df``: one pass over the rows of each ``by`` in ``order``.

    A group's rows stream through one task, so a handler should hold little of them.
    """
    if name not in TABLE_FUNCTIONS:
        raise ValueError(f"table function: unknown '{name}' (known: {', '.join(sorted(TABLE_FUNCTIONS))})")
    table = df.asTable()
    table = (table.partitionBy(*by) if by else table.withSinglePartition()).orderBy(*order)
    return udtf(TABLE_FUNCTIONS[name])(table, **{k: F.lit(v) for k, v in options.items()})
