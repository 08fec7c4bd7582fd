"""Profiles of columns: exact quantiles, commonest values, domains, widths of numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: bins of a bracket in a round
_BINS = 1024


@dataclass(frozen=True)
class _Bracket:
    """Where values of a column are still looked for: finite ones from low to high, of which `below` smaller ones exist. ranks: of the values wanted."""

    column: int
    low: float
    high: float
    below: int
    ranks: tuple[int, ...]


def _values(df: DataFrame, cols: Sequence[str], ranks: Callable[[int, int], Iterable[int]]) -> list[dict[int, float]]:
    """Of each column the values at some ranks (from 0, in ascending order; NaN last). ranks: (column, number of values) -> ranks.

    Rounds of histograms: a bracket is cut to bins, a bin becomes the next bracket, from its least to its greatest value, until it has one value. A round is one pass
    for all columns and brackets; what is shuffled are bins with counts, whatever the number of different values.
    """
    v = [F.col(f"`{c}`").cast("double") for c in cols]
    finite = [~F.isnan(x) & (F.abs(x) != float("inf")) for x in v]
    of = lambda f: [f(x, ok) for x, ok in zip(v, finite)]
    first = df.agg(
        *of(lambda x, _: F.count_if(x == float("-inf"))), *of(lambda x, ok: F.count_if(ok)), *of(lambda x, _: F.count_if(x == float("inf"))), *of(lambda x, _: F.count_if(F.isnan(x))),
        *of(lambda x, ok: F.min(F.when(ok, x))), *of(lambda x, ok: F.max(F.when(ok, x))),
    ).first()
    n = len(cols)
    found: list[dict[int, float]] = [{} for _ in cols]
    brackets = []
    for c in range(n):
        minus, middle, plus, nan = (first[c + n * k] or 0 for k in range(4))
        wanted = set(ranks(c, minus + middle + plus + nan))
        for r in wanted:
            if not minus <= r < minus + middle:
                found[c][r] = float("-inf") if r < minus else float("inf") if r < minus + middle + plus else float("nan")
        if inside := tuple(sorted(r for r in wanted if minus <= r < minus + middle)):
            brackets.append(_Bracket(c, first[c + 4 * n], first[c + 5 * n], minus, inside))
    while brackets:
        for b in brackets:
            if b.low == b.high:
                found[b.column].update(dict.fromkeys(b.ranks, b.low))
        brackets = [b for b in brackets if b.low < b.high]
        if brackets:
            brackets = _narrowed(df, v, brackets)
    return found


def _narrowed(df: DataFrame, v: Sequence[Column], brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """The bins that hold the wanted ranks, from one pass."""

    def place(b: _Bracket) -> Column:
        x, wide = v[b.column], b.high - b.low == float("inf")
        part = (x / 2 - b.low / 2) / (b.high / 2 - b.low / 2) if wide else (x - b.low) / (b.high - b.low)
        return F.when((x >= b.low) & (x <= b.high), F.least(F.floor(part * _BINS), F.lit(_BINS - 1)))

    here = F.array(*(F.struct(F.lit(i).alias("b"), place(b).alias("bin"), v[b.column].alias("v")) for i, b in enumerate(brackets)))
    bins = df.select(F.inline(here)).where("bin is not null").groupBy("b", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # at most _BINS rows a bracket
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("bin"))
    below = F.element_at(F.array(*(F.lit(b.below) for b in brackets)), F.col("b") + 1)
    asked = F.element_at(F.array(*(F.array(*map(F.lit, b.ranks)) for b in brackets)), F.col("b") + 1)
    kept = bins.withColumn("begin", below + upto - F.col("n")).withColumn("end", below + upto)
    kept = kept.withColumn("ranks", F.filter(asked, lambda r: (r >= F.col("begin")) & (r < F.col("end")))).where(F.size("ranks") > 0)
    return [_Bracket(brackets[r.b].column, r.low, r.high, r.begin, tuple(r.ranks)) for r in kept.collect()]


def quantiles(df: DataFrame, cols: Sequence[str], points: Sequence[float]) -> DataFrame:
    """column, label (p25), value: exact, with linear interpolation; whole-number columns are rounded half to even, a column without values gives nulls."""
    places: dict[int, list[tuple[int, int, float]]] = {}

    def ranks(c: int, n: int) -> set[int]:
        at = [p * (n - 1) for p in points]
        places[c] = [(math.floor(x), math.ceil(x), x - math.floor(x)) for x in at] if n else []
        return {r for low, high, _ in places[c] for r in (low, high)}

    found, rows = _values(df, cols, ranks), []
    for c, name in enumerate(cols):
        whole = isinstance(df.schema[name].dataType, T.IntegralType)
        for k, p in enumerate(points):
            low, high, share = places[c][k] if places[c] else (None, None, 0.0)
            rows.append((name, f"p{round(p * 100):g}", found[c].get(low), found[c].get(high), share, whole))
    made = df.sparkSession.createDataFrame(rows, "column string, label string, low double, high double, share double, whole boolean")
    value = F.when(F.col("high") == F.col("low"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    return made.select("column", "label", F.when(F.col("whole"), F.bround(value)).otherwise(value).alias("value"))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k commonest values with their counts, ties by value."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def domain(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("value")).where("value is not null").distinct()


def number_widths(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, negative, digits, least, greatest: what a fixed-width code needs."""
    one = df.agg(*(x for c in cols for x in (F.bool_or(F.col(c) < 0).alias(f"{c}_neg"), F.max(F.length(F.floor(F.abs(c)).cast("long").cast("string"))).alias(f"{c}_dig"), F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_neg").alias("negative"), F.col(f"{c}_dig").alias("digits"), F.col(f"{c}_min").alias("least"), F.col(f"{c}_max").alias("greatest")) for c in cols))))


def number_codecs(df: DataFrame, cols: Sequence[str], precision: int = 4) -> DataFrame:
    """column, negative, digits, places: the fixed-width code that holds all values, fractions rounded to `precision` decimals; one pass for all columns."""
    parts = []
    for c in cols:
        x = F.col(f"`{c}`")
        whole = isinstance(df.schema[c].dataType, T.IntegralType)
        # a double's shortest text, rounded half to even
        text = F.abs(x).cast("string") if whole else F.bround(F.abs(x).cast("decimal(38,10)"), precision).cast(f"decimal(38,{precision})").cast("string")
        places = F.lit(0) if whole else F.length(F.rtrim(F.substring_index(text, ".", -1), F.lit("0")))
        own = (F.bool_or(x < 0), F.max(F.length(F.substring_index(text, ".", 1))), F.max(F.when(x.isNotNull(), places)))
        parts += [F.coalesce(v, F.lit(d)).alias(f"{c}_{n}") for n, v, d in zip(("negative", "digits", "places"), own, (False, 1, 0))]
    one = df.agg(*parts)
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}_{n}`").alias(n) for n in ("negative", "digits", "places"))) for c in cols))))
