"""Column functions: exact sums, and the named aggregations of neighbour values.

A double is a whole number of some power of two. ``spans`` finds, for each column,
the unit that all its values share and how many 32-bit limbs hold the largest; a
sum is then a sum of whole numbers for each limb, whatever the order of the rows,
and is rounded once. Equal sums therefore tie exactly, from 1e-290 to 1e308.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 32
#: Smaller parts of a value than 2**LEAST_UNIT are dropped.
LEAST_UNIT = -1000


@dataclass(frozen=True)
class Span:
    """Values are multiples of ``2**unit`` under ``2**(unit + 32 * limbs)``; ``odd``: some are infinite or NaN."""

    unit: int = 0
    limbs: int = 1
    odd: bool = False

    @classmethod
    def of(cls, most: float | None, least: float | None, whole: bool | None, odd: bool | None = False) -> Span:
        """From the largest and the smallest non-zero magnitude, and whether all values are whole numbers."""
        if not most:
            return cls(odd=bool(odd))
        unit = 0 if whole else max(math.frexp(least)[1] - 53, LEAST_UNIT)
        return cls(unit, max(1, -(-(math.frexp(most)[1] - unit) // LIMB)), bool(odd))

    def exact(self, limbs: Sequence[int]) -> Fraction:
        """The number that limb sums stand for."""
        total = sum(int(x) << LIMB * j for j, x in enumerate(limbs))
        return Fraction(total) * Fraction(2) ** self.unit


def spans(table: DataFrame, columns: Mapping[str, Column]) -> dict[str, Span]:
    """The span of each column: one pass, one row to the driver."""
    if not columns:
        return {}
    outs = []
    for value in columns.values():
        size = F.abs(value.cast("double"))
        fit = size < F.lit(math.inf)
        outs += [F.max(F.when(fit, size)), F.min(F.when(fit & (size > 0), size)), F.bool_and(F.when(fit, size == F.rint(size))), F.bool_or(~fit)]
    row = table.agg(*(c.alias(f"x{k}") for k, c in enumerate(outs))).first()
    return {name: Span.of(*row[4 * k : 4 * k + 4]) for k, name in enumerate(columns)}


def limbs_of(value: Column, span: Span) -> list[Column]:
    """The value's limbs, lowest first, each with the value's sign; zeros where it is not finite."""
    value = value.cast("double")
    if span.odd:
        value = F.when(F.abs(value) < F.lit(math.inf), value).otherwise(F.lit(0.0))
    out = []
    for j in range(span.limbs):
        part = value if j == span.limbs - 1 else value % F.lit(2.0 ** (span.unit + LIMB * (j + 1)))
        out.append((part * F.lit(2.0 ** -(span.unit + LIMB * j))).cast("bigint"))
    return out


def carried(sums: Sequence[Column]) -> list[Column]:
    """Limb sums with all but the last in 0 .. 2**32 - 1: equal numbers then have equal limbs."""
    out, carry = [], None
    for k, x in enumerate(sums):
        x = x if carry is None else x + carry
        if k == len(sums) - 1:
            return [*out, x]
        out.append(x.bitwiseAND(F.lit((1 << LIMB) - 1)))
        carry = F.shiftright(x, LIMB)
    return out


def as_double(sums: Sequence[Column], span: Span) -> Column:
    """The double that limb sums stand for."""
    total = None
    for j, x in reversed(list(enumerate(carried(sums)))):
        term = x.cast("double") * F.lit(2.0 ** (span.unit + LIMB * j))
        total = term if total is None else total + term
    return total


def exact_sum(value: Column, span: Span) -> Column:
    """The sum of the group, the same in any order; null if there is no value."""
    total = as_double([F.sum(x) for x in limbs_of(value, span)], span)
    if span.odd:
        value = value.cast("double")
        total = total + F.sum(F.when(F.abs(value) < F.lit(math.inf), F.lit(0.0)).otherwise(value))
    return total


@dataclass(frozen=True)
class Aggregation:
    """A named reduction of neighbour values and what a node without neighbours gets.

    ``reduce`` makes an aggregate of a column; with ``exact`` it also gets the
    column's span. ``python`` is instead a function from a node's neighbour values
    (a pandas series) to a number, for what no column function expresses.
    """

    name: str
    reduce: Callable[..., Column] | None
    empty: float = 0.0
    exact: bool = False
    python: Callable | None = None


def reducer(name: str, function: Callable, empty: float = 0.0) -> Aggregation:
    """An aggregation by any Python function of a pandas series of neighbour values."""
    return Aggregation(name, None, empty, python=function)


_NAMED = {
    a.name: a
    for a in (
        Aggregation("sum", exact_sum, exact=True),
        Aggregation("mean", lambda c, span: exact_sum(c, span) / F.count(c), exact=True),
        Aggregation("min", F.min),
        Aggregation("max", F.max),
        Aggregation("count", F.count),
        Aggregation("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))),
        Aggregation("var", lambda c: F.coalesce(F.var_samp(c), F.lit(0.0))),
        Aggregation("median", F.median),
        Aggregation("nunique", F.count_distinct),
        Aggregation("prod", F.product, 1.0),
    )
}
DEFAULT_AGGS = ("sum", "mean")


def aggregations(given: Sequence | None) -> list[Aggregation]:
    """Names, ``(name, column function)`` pairs or ``Aggregation``s; nothing given means sum and mean."""
    found = []
    for item in given or DEFAULT_AGGS:
        if isinstance(item, Aggregation):
            found.append(item)
        elif isinstance(item, str):
            if item not in _NAMED:
                raise ValueError(f"unknown aggregation {item!r}; known: {', '.join(_NAMED)}")
            found.append(_NAMED[item])
        else:
            found.append(Aggregation(*item))
    return found
