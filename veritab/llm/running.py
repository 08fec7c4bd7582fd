"""Running totals along keys of any length: rows are cut to ranges of key and order, and totals are carried from range to range."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import batch, written

#: add and xor: of all rows of the key up to this one. last: the latest value that isn't null, up to this row; before: up to the row before.
MODES = ("add", "xor", "last", "before")


def running(df: DataFrame, key: Sequence[str], order: Sequence[Column], modes: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """df with the columns of `modes` (long) replaced by their running totals over the rows of a key in the order.

    Keys are non-null longs. Rows are range-partitioned by key and order, so that a key with most of the rows is spread over tasks; a task totals its sorted
    range; what a range's last key has reached is carried to the ranges after it that begin with this key. The carried table has a row
    per range. Rows alike in key and order come in any order. Columns in `drop` are needed for the order alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, names = df.sparkSession, list(modes)
    keep = [c for c in df.columns if c not in drop]
    part, place = "_range", "_place"
    sides = [f"_{c}_after" for c in names]  # "before" needs the value of the row itself too
    sorted_rows = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).select(*keep)
    fields = [T.StructField(f.name, T.LongType() if f.name in modes else f.dataType) for f in sorted_rows.schema]
    out = T.StructType([*fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType()), *(T.StructField(c, T.LongType()) for c in sides)])
    ranges = written(sorted_rows.mapInArrow(_totals(list(key), modes, sides, to_arrow_schema(out)), out), "ranges")
    # of each range: its first key, and the totals of its last key
    keys = F.struct(*key)
    edges = ranges.groupBy(part).agg(F.min(keys).alias("first"), F.max(F.struct(keys.alias("key"), place, *sides)).alias("last"))
    # a row per range
    along = Window.partitionBy("last.key").orderBy(part)
    totals = {"add": lambda c: F.sum(f"last.{c}").over(along), "xor": lambda c: F.bit_xor(f"last.{c}").over(along)}
    latest = lambda c: F.last(f"last.{c}", ignorenulls=True).over(along)
    edges = edges.select(part, "first", F.col("last.key").alias("key"), *(totals.get(modes[c], latest)(s).alias(s) for c, s in zip(names, sides)))
    every = Window.orderBy(part)
    edges = edges.select(part, "first", *(F.when(F.lag("key").over(every) == F.col("first"), F.lag(s).over(every)).alias(s) for s in sides))
    carried = edges.select(F.col(part), *(F.col(f"first.{k}").alias(k) for k in key), *(F.col(s).alias(f"{s}_carried") for s in sides)).where(
        F.coalesce(*(F.col(f"{s}_carried") for s in sides)).isNotNull()
    )
    joined = ranges.join(F.broadcast(carried), [part, *key], "left")
    value = {
        "add": lambda c, x: c + F.coalesce(x, F.lit(0)), "xor": lambda c, x: c.bitwiseXOR(F.coalesce(x, F.lit(0))),
        "last": F.coalesce, "before": F.coalesce,
    }
    return joined.select(*(value[modes[c]](F.col(c), F.col(f"_{c}_after_carried")).alias(c) if c in modes else F.col(c) for c in keep))


def _total(x: pa.Array, mode: str, head: np.ndarray, old: int | None) -> pa.Array:
    """Totals from each row's head on; where the head is -1, with what the key had before this batch."""
    op = np.add if mode == "add" else np.bitwise_xor
    total = op.accumulate(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    earlier = np.where(head > 0, total[head - 1], 0)
    earlier[head < 0] = 0
    total = total - earlier if mode == "add" else total ^ earlier
    if old is not None:
        total[head < 0] = op(total[head < 0], np.int64(old))
    return pa.array(total)


def _latest(x: pa.Array, head: np.ndarray, old: int | None) -> tuple[pa.Array, pa.Array]:
    """The latest value of the key that isn't null, up to each row and up to the row before."""
    valid = x.is_valid().to_numpy(zero_copy_only=False)
    upto = np.maximum.accumulate(np.where(valid, np.arange(len(x)), -1))
    fallback = pc.if_else(pa.array(head < 0), pa.scalar(old, pa.int64()), pa.scalar(None, pa.int64()))
    found = [pc.if_else(pa.array(at >= np.maximum(head, 0)), x.take(pa.array(np.maximum(at, 0))), fallback) for at in (upto, np.concatenate([[-1], upto[:-1]]))]
    return found[0], found[1]


def _totals(key: list[str], modes: dict[str, str], sides: list[str], schema: pa.Schema):
    def run(batches):
        at = TaskContext.get().partitionId()
        last_key, seen = None, 0
        state: dict[str, int | None] = {}
        for rb in batches:
            n = rb.num_rows
            if not n:
                continue
            keys = [rb.column(k).to_numpy() for k in key]
            new = np.zeros(n, bool)
            new[0] = last_key != tuple(k[0] for k in keys)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            if new[0]:
                state = {}
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # first row of the key; -1: it began in an earlier batch
            columns = {c: rb.column(i) for i, c in enumerate(rb.schema.names)}
            after = {}
            for c, mode in modes.items():
                if mode in ("add", "xor"):
                    columns[c] = after[c] = _total(columns[c], mode, head, state.get(c))
                else:
                    after[c], before = _latest(columns[c], head, state.get(c))
                    columns[c] = after[c] if mode == "last" else before
                state[c] = after[c][n - 1].as_py()
            places = np.arange(seen, seen + n)
            seen += n
            last_key = tuple(k[-1] for k in keys)
            yield batch(schema, [*columns.values(), np.full(n, at, np.int32), places, *(after[c] for c in modes)])

    return run
