"""Column expressions on points and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)).cast("double")


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def round6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def draw(key: Column, salt: int, n: int = 101) -> Column:
    """A repeatable draw from 0 to n-1 by arithmetic on a key, the same in any SQL engine."""
    return F.pmod(key.cast("long") * 7919 + salt * 104729, F.lit(n).cast("long"))
