"""Array helpers that stay in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where the body uses it in every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def running_sums(numbers: Column, levels: int = 2) -> Column:
    """Sums of the first 1, 2, ... numbers, as longs.

    Sums of blocks are summed up first (in blocks of their own), so an element costs a block and not the whole array.
    """
    none = F.expr("cast(array() as array<bigint>)")
    block = lambda i: F.floor(i / BLOCK).cast("int")
    totals = lambda n: F.transform(F.sequence(F.lit(0), block(F.size(n) - 1)), lambda k: total(F.slice(n, k * BLOCK + 1, BLOCK)))

    def before(x: Column, i: Column) -> Column:
        """What stands in the blocks before that of an element."""
        return F.coalesce(F.get(x["b"], block(i) - 1), F.lit(0)) if levels else total(F.slice(x["b"], F.lit(1), block(i)))

    sums = lambda x: F.transform(x["n"], lambda _, i: before(x, i) + total(F.slice(x["n"], block(i) * BLOCK + 1, i % BLOCK + 1)))
    blocks = lambda n: running_sums(totals(n), levels - 1) if levels else totals(n)
    return let(numbers, lambda n: F.when(F.size(n) > 0, let(F.struct(n.alias("n"), blocks(n).alias("b")), sums)).otherwise(none))
