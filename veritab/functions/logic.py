"""Two-valued conditions: a comparison with a missing value is false, but for `!=`, which is true.

Spark's own logic has three values; rules need every row to hold or not. Comparisons built here are never
null, so `&`, `|` and `~` over them stay two-valued. NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def number(name: str) -> Column:
    """A numeric column as double with NaN as null."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def eq(a, b) -> Column:
    return F.coalesce(_col(a) == _col(b), F.lit(False))


def ne(a, b) -> Column:
    return F.coalesce(_col(a) != _col(b), F.lit(True))


def lt(a, b) -> Column:
    return F.coalesce(_col(a) < _col(b), F.lit(False))


def le(a, b) -> Column:
    return F.coalesce(_col(a) <= _col(b), F.lit(False))


def gt(a, b) -> Column:
    return F.coalesce(_col(a) > _col(b), F.lit(False))


def ge(a, b) -> Column:
    return F.coalesce(_col(a) >= _col(b), F.lit(False))


def holds(sql: str) -> Column:
    """A Spark SQL condition as a rule; unknown counts as false."""
    return F.coalesce(F.expr(sql).cast("boolean"), F.lit(False))


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


def for_all(family: Sequence[str], body: Callable[[Column], Column]) -> Column:
    """The condition for every column of a family."""
    return all_of([body(F.col(f"`{c}`")) for c in family])


def exists(family: Sequence[str], body: Callable[[Column], Column]) -> Column:
    return any_of([body(F.col(f"`{c}`")) for c in family])


def row_min(*cols) -> Column:
    """Over columns of a row, missing ones skipped."""
    return F.least(*map(_col, cols)) if len(cols) > 1 else _col(cols[0])


def row_max(*cols) -> Column:
    return F.greatest(*map(_col, cols)) if len(cols) > 1 else _col(cols[0])


def row_sum(*cols) -> Column:
    """Missing values count as 0."""
    return reduce(Column.__add__, [F.coalesce(_col(c), F.lit(0)) for c in cols])


def row_count(*cols) -> Column:
    return reduce(Column.__add__, [_col(c).isNotNull().cast("int") for c in cols])


def row_avg(*cols) -> Column:
    return F.try_divide(row_sum(*cols).cast("double"), row_count(*cols))


def row_std(*cols) -> Column:
    """Population deviation over the columns that aren't missing."""
    mean = row_avg(*cols)
    squares = [F.coalesce((_col(c).cast("double") - mean) * (_col(c).cast("double") - mean), F.lit(0.0)) for c in cols]
    return F.sqrt(F.try_divide(reduce(Column.__add__, squares), row_count(*cols)))


def floor_mod(a, b) -> Column:
    """Remainder with the sign of the divisor; null for a divisor of 0."""
    a, b = _col(a), _col(b)
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def ratio(a, b) -> Column:
    """Null for a denominator of 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def nonzero(c) -> Column:
    """Missing values count as other than zero."""
    return F.coalesce(_col(c) != 0, F.lit(True))


def count_nonzero(*cols) -> Column:
    return reduce(Column.__add__, [nonzero(c).cast("int") for c in cols])
