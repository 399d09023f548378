"""Array expressions whose work is linear, or nearly so, in the length of an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a block that running results are made in.
BLOCK = 64


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of an array ``x`` that is computed once, not once for each use in ``f``."""
    return F.transform(F.array(x), f)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], start: Column) -> Column:
    """``start`` combined with the first 0, 1, ... of an array of longs, made block by block.

    ``combine`` is associative and ``start`` changes nothing. Appending to an array copies it, so a
    block has as many values as there are blocks, if there are many.
    """

    def chain(own: Column, first: Column) -> Column:
        return F.aggregate(own, F.array(first), lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), x))))

    def made(own: Column) -> Column:
        size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(own))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), size), lambda i: F.slice(own, i + 1, size))
        return bound(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, start, combine))
        # the last total has no block behind it: the result of all values
        parts = F.zip_with(blocks, chain(totals, start), lambda b, first: F.slice(chain(F.coalesce(b, F.array().cast("array<long>")), first), 1, F.greatest(F.size(b), F.lit(1))))
        return F.flatten(parts)

    return bound(values, made)


def begins(values: str, same: Callable[[Column, Column], Column]) -> Column:
    """The places, from 0, of an array column where a value is not the ``same`` as the one before."""
    places = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | ~same(F.get(values, i - 1), F.get(values, i)))
    return F.when(F.size(values) > 0, places).otherwise(F.array().cast("array<int>"))
