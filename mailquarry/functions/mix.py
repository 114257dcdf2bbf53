"""Reproducible pseudo-random numbers from whole numbers, in plain integer arithmetic that any SQL engine repeats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2_147_483_647       # a prime; squares of smaller numbers fit 64 bits


_A, _C = 48271, 1_013_904_223


def _square(h: Column) -> Column:
    return F.aggregate(F.array(h), F.lit(0).cast("bigint"), lambda _, q: (q * q + F.lit(_C)) % P)


def mix(*parts: Column) -> Column:
    """A number from 0 to P - 1."""
    h = F.lit(7).cast("bigint")
    for p in parts:
        h = _square((h * F.lit(_A) + F.pmod(p.cast("bigint"), F.lit(P))) % P)
    return h


def pick(n: int, *parts: Column) -> Column:
    """A number from 0 to n - 1."""
    return (F.shiftright(mix(*parts), 7) % n).cast("int")


def begun(*parts: Column) -> Column:
    """The parts mixed, for :func:`pick_at`, :func:`picks` and :func:`picked`, which add a last part that is a position."""
    return mix(*parts) * F.lit(_A)


def pick_at(n: int, start: Column, i: Column) -> Column:
    """``pick(n, *parts, i)`` from ``begun(*parts)``."""
    return (F.shiftright(_square((start + i) % P), 7) % n).cast("int")


def picks(n: int, start: Column, count: Column) -> Column:
    """``pick(n, *parts, i)`` for each i below ``count`` (1 at least), as an array, from ``begun(*parts)``."""
    steps = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: (start + i) % P)
    return F.transform(steps, lambda q: F.shiftright((q * q + F.lit(_C)) % P, 7) % n)


def picked(n: int, start: int, at: np.ndarray) -> np.ndarray:
    """The same for an array of positions, in tasks."""
    q = (start + at) % P
    return ((q * q + _C) % P >> 7) % n
