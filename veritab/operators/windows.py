"""Context windows: fixed-size runs of ordered rows, flattened to one row each; and checks against earlier rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.predicates import Field
from veritab.sources.staging import staged


def context_windows(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int, stride: int = 1, cols: Sequence[str] | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """Columns {name}_ctx{i} for i < size. Windows begin every `stride` rows; partitions with fewer rows than `size` give none.

    Null order keys come last. A partition of more than block_rows rows is spread over blocks with carried edges (see blocked); without partition
    keys the table is one run of rows (see positioned). Without an order the partition keys are it, and without those the first column.
    """
    cols = list(cols or df.columns)
    order = list(order or partition or df.columns[:1])
    if partition:
        df = blocked(df, partition, order, size, block_rows)
        w = Window.partitionBy(*partition, "_block").orderBy("_position")
    else:
        df = positioned(df, order, size, block_rows)
        w = Window.partitionBy("_block").orderBy("_position")
    place, own = F.col("_position"), F.col("_own")
    shifted = [F.lead(c, i).over(w).alias(f"{c}_ctx{i}") if i else F.col(c).alias(f"{c}_ctx0") for c in cols for i in range(size)]
    whole = F.lead(F.lit(1), size - 1).over(w) if size > 1 else F.lit(1)
    out = df.select(*shifted, place.alias("_place"), own.alias("_begins"), whole.alias("_whole"))
    return out.where(F.col("_whole").isNotNull() & F.col("_begins") & (F.col("_place") % stride == 0)).drop("_place", "_begins", "_whole")


def positioned(df: DataFrame, order: Sequence[str], size: int, block_rows: int) -> DataFrame:
    """Adds _position (0.. in the order of all rows, nulls last), _block and _own.

    Rows are cut to ranges of the order, numbered there, and dealt to blocks of block_rows positions. A block also gets copies (_own false) of the
    size - 1 rows after it, so windows that begin in it find all their rows, and no task holds the whole table.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    n = df.count()
    if n <= block_rows:
        w = Window.partitionBy("_block").orderBy(*keys)
        return df.withColumn("_block", F.lit(0).cast("long")).withColumn("_position", F.row_number().over(w) - 1).withColumn("_own", F.lit(True))
    ties = [F.col(c).asc_nulls_last() for c in df.columns if c not in order]
    ranged = staged(df.repartitionByRange(_ranges(df, n, block_rows), *keys, *ties).withColumn("_range", F.spark_partition_id()))
    # a row per range, 10,000 at most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*keys, *ties))
    return _dealt(ranged.join(counts, "_range").withColumn("_position", F.col("_before") + number - 1).drop("_range", "_before"), size, block_rows)


def _ranges(df: DataFrame, n: int, block_rows: int) -> int:
    """How many ranges n rows are cut to: one a block, but no more than the session's shuffle partitions or one a million rows, whichever is more.

    The driver samples rows for each range and gets a status from each, so small blocks must not mean many ranges.
    """
    most = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1_000_000))
    return min(10_000, most, -(-n // block_rows))


def _dealt(rows: DataFrame, size: int, block_rows: int) -> DataFrame:
    """Deals numbered rows to blocks; the first size - 1 rows of a block go to the block before as well."""
    length = max(block_rows, size)
    block = F.floor(F.col("_position") / length)
    here, carried = F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))
    edge = (block > 0) & (F.col("_position") % length < size - 1)
    return rows.withColumn("_to", F.explode(F.when(edge, F.array(here, carried)).otherwise(F.array(here)))).select("*", F.col("_to.block").alias("_block"), F.col("_to.own").alias("_own")).drop("_to")


def blocked(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int, block_rows: int) -> DataFrame:
    """As positioned, within each partition: _position (0.. in the order, nulls last), _block and _own.

    Only if some partition has more than block_rows rows, rows are cut to ranges of (partition, order): a range numbers its own rows, and a table with a
    row per range and partition that it ends with tells what came before. So no task holds a partition with most of the rows.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    largest = df.groupBy(*partition).agg(F.count("*").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if (largest[0] or 0) <= block_rows:
        place = F.row_number().over(Window.partitionBy(*partition).orderBy(*keys)) - 1
        return df.withColumns({"_position": place, "_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    ties = [F.col(c).asc_nulls_last() for c in df.columns if c not in order and c not in partition]
    by = [F.col(c).asc_nulls_last() for c in partition]
    ranged = staged(df.repartitionByRange(_ranges(df, largest[1], block_rows), *by, *keys, *ties).withColumn("_range", F.spark_partition_id()))
    # of each range only its last partition goes on in later ranges, so the sums below are of a row per range and partition within it
    counts = ranged.groupBy("_range", *partition).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_key{k}") for k, c in enumerate(partition)), "_before").where("_before > 0")
    number = F.row_number().over(Window.partitionBy("_range", *partition).orderBy(*keys, *ties)) - 1
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{k}"))
    # a range begins with one partition that others have begun: a row per range at most
    rows = ranged.withColumn("_number", number).join(F.broadcast(counts), same, "left").withColumn("_position", F.coalesce("_before", F.lit(0)) + F.col("_number"))
    return _dealt(rows.drop("_range", "_number", "_r", "_before", *(f"_key{k}" for k in range(len(partition)))), size, block_rows)


def window_fields(fields: Sequence[Field], size: int) -> list[Field]:
    """Descriptions of the columns that context_windows makes: each field once for each place, with the role "window" besides its own."""
    return [replace(f, name=f"{f.name}_ctx{i}", family=f.name, roles=tuple(dict.fromkeys((*f.roles, "window")))) for f in fields for i in range(size)]


def families(cols: Sequence[str]) -> dict[str, list[str]]:
    """Column families by name: x_ctx0, x_ctx1, ... or xCtx0, xCtx1, ..."""
    found: dict[str, list[tuple[int, str]]] = {}
    for c in cols:
        if m := re.fullmatch(r"(.+?)_?[cC]tx(\d+)", c):
            found.setdefault(m[1], []).append((int(m[2]), c))
    return {k: [c for _, c in sorted(v)] for k, v in found.items()}


def select_families(fields: Sequence[Field], name: str | None = None, kinds: Sequence[str] = (), roles: Sequence[str] = ()) -> dict[str, list[str]]:
    """Column families by name whose first column meets every condition given: the family's name, one of the kinds, one of the roles."""
    by_name = {f.name: f for f in fields}
    found = {}
    for family, cols in families(list(by_name)).items():
        first = by_name[cols[0]]
        if (name is None or family == name) and (not kinds or first.kind in kinds) and (not roles or set(roles) & set(first.roles)):
            found[family] = cols
    return found


def family_values(df: DataFrame, family: Sequence[str]) -> DataFrame:
    """All values of a family's columns, one under the other."""
    return df.select(F.explode(F.array(*family)).alias("value"))


def previous(c: str, partition: Sequence[str], period: str, gap: int = 1) -> Column:
    """The value one row before, if that row's period is exactly `gap` before; else null."""
    w = Window.partitionBy(*partition).orderBy(period)
    return F.when(F.col(period) - F.lag(period).over(w) == gap, F.lag(c).over(w))


def at_offset(df: DataFrame, partition: Sequence[str], period: str, cols: Sequence[str], offset: int, last: Sequence[str] = ()) -> DataFrame:
    """Adds {col}_before: the value at period - offset, by the period's value; null where there is none.

    Where a period repeats, its last row counts: by the columns in `last`, else by all other columns, so that reruns agree.
    """
    w = Window.partitionBy(*partition).orderBy(period).rangeBetween(-offset, -offset)
    by = F.struct(*(last or [c for c in df.columns if c not in partition and c != period]))
    return df.withColumns({f"{c}_before": F.max_by(F.struct(F.col(c).alias("v")), by).over(w)["v"] for c in cols})
