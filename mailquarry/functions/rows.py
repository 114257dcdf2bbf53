"""Exploding derived arrays.

The optimizer adds a non-empty test below a plain ``explode`` and pushes filters on derived columns down
through every projection, each time with a full copy of the expression. For columns that took many steps
to compute this multiplies the work. An outer generator with a filter on its own output stops both:
a generated column cannot be pushed below its generator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first(values: Column | str, n: int | None) -> Column:
    """The first ``n`` elements of an array; all of them when ``n`` is None."""
    values = F.col(values) if isinstance(values, str) else values
    return values if n is None else F.slice(values, 1, n)


def explode_values(df: DataFrame, keep: Sequence[str | Column], values: Column | str, name: str) -> DataFrame:
    """One row per non-NULL element."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def explode_with_pos(df: DataFrame, keep: Sequence[str | Column], values: Column | str, pos: str, name: str) -> DataFrame:
    """One row per element with its position, from 0."""
    return df.select(*keep, F.posexplode_outer(values).alias(pos, name)).where(F.col(pos).isNotNull())


def explode_structs(df: DataFrame, keep: Sequence[str | Column], structs: Column, test: str) -> DataFrame:
    """One row per struct with its fields as columns; ``test`` names a field that is never NULL in a struct."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(test).isNotNull())


def with_fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that filters can use without being pushed below it, so what it is made of is not computed again."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; inside a lambda nothing else keeps it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
