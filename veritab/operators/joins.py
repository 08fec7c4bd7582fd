"""Join of values with bands, of which several may hold a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(rows: DataFrame, value: str, bands: DataFrame, low: str, high: str, on: Sequence[str] = (), bins: int = 256, most_rows: int = 1_000_000, left: bool = False) -> DataFrame:
    """Each row with each band of the same keys that holds its value (both ends belong to a band); with `left`, rows without a band once, with nulls.

    The values' range is cut to bins; a band goes to every bin that it touches and has rows, so that rows and bands meet by equal keys and bin, not each with
    each. Of a bin with more than most_rows rows the rows are dealt to parts and its bands copied to each, so no task gets a hot bin whole; such
    bins are fewer than rows / most_rows, and are broadcast. Null values and bands with a null end match nothing.
    """
    taken = {c.lower() for c in (*rows.columns, *bands.columns)}
    bin_, part, parts, number = (next(n for n in (f"{name}{'_' * k}" for k in range(1, 9)) if n not in taken) for name in ("bin", "part", "parts", "row"))
    ends = rows.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).first()
    a, b = (ends.a or 0.0), (ends.b or 0.0)
    width = (b - a) / bins or 1.0

    def of(x: Column) -> Column:
        """Bins ascend with the value, so a band's bins are those between its ends'."""
        return F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(float(bins)), (x.cast("double") - a) / width))).cast("int")

    keys = [*on, bin_]
    placed = rows.withColumn(bin_, of(F.col(value)))
    counts = placed.where(F.col(bin_).isNotNull()).groupBy(*keys).agg(F.ceil(F.count("*") / most_rows).cast("int").alias(parts))
    hot = F.broadcast(counts.where(F.col(parts) > 1))
    placed = placed.withColumn(number, F.monotonically_increasing_id()).join(hot, keys, "left")
    placed = placed.withColumn(part, F.coalesce(F.pmod(F.xxhash64(number), F.col(parts)), F.lit(0)).cast("int")).drop(parts, number)
    ready = bands.where(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) <= F.col(high)))
    touched = ready.withColumn(bin_, F.explode(F.sequence(of(F.col(low)), of(F.col(high))))).join(counts, keys)
    touched = touched.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    l, r, same = placed.alias("l"), touched.alias("r"), [*keys, part]
    held = (F.col(f"l.{value}") >= F.col(f"r.{low}")) & (F.col(f"l.{value}") <= F.col(f"r.{high}"))
    for k in same:
        held = held & (F.col(f"l.`{k}`") == F.col(f"r.`{k}`"))
    out = [F.col(f"l.`{c}`") for c in rows.columns] + [F.col(f"r.`{c}`") for c in bands.columns if c not in on]
    return l.join(r, held, "left" if left else "inner").select(*out)
