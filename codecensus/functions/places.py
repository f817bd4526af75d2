"""Running sums inside a row, and names for values that expressions use several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For every element of an array the sum of those before it.

    Sums over blocks of ``BLOCK``, and over the blocks before each, keep this from growing with the square of the
    length; nothing is appended to a growing array.
    """
    def over(values: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int")),
            lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda sums: let(
            F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))),
            lambda ahead: F.transform(values, lambda _, i: F.get(ahead, F.floor(i / BLOCK).cast("int")) + total(
                F.slice(values, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, i % BLOCK)))))

    return let(F.transform(numbers, lambda x: x.cast("bigint")), over)
