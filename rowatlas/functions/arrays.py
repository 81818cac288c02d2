"""Expressions over arrays that take time in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are summed up in one go: adding up takes time in proportion to an array's length, up to CHUNK ** 4.
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often and in whatever inner lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(numbers: Column, levels: int = 4) -> Column:
    """For each of some long numbers the sum of those before it: sums inside chunks, then of chunks."""
    upto = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    most = lambda sums: F.slice(sums, F.lit(1), F.size(sums) - 1)
    if levels == 1:
        return let(upto(numbers), most)
    cut = let(numbers, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda k: upto(F.slice(a, k * CHUNK + 1, F.lit(CHUNK)))))
    return let(cut, lambda chunks: F.flatten(F.zip_with(chunks, sums_before(F.transform(chunks, lambda c: F.element_at(c, -1)), levels - 1), lambda c, first: F.transform(most(c), lambda v: v + first))))
