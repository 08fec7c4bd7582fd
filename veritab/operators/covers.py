"""Minimal covers by a depth-first search whose subtrees are dealt to tasks.

Signatures are numbered by size and kept transposed: a bit vector over the signatures for each predicate, packed to whole numbers of any length. A clause
that grows keeps, for each literal, the signatures that it alone meets (critical ones); a literal that would take the last
critical signature from another is left out, so each minimal clause is found once and no clause is compared with others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.sources.staging import staged


@dataclass(frozen=True)
class Node:
    """A clause so far, and the predicates that may still join it."""

    chosen: tuple[int, ...]
    allowed: int


class Bitmaps:
    """columns: signatures that hold a predicate, a bit each; rows: predicates of a signature, a bit each. Signatures ascend by size."""

    def __init__(self, rows: Sequence[int], columns: Sequence[int]):
        self.rows, self.columns = rows, columns
        self.all = (1 << len(rows)) - 1

    def left(self, chosen: Sequence[int]) -> int:
        met = 0
        for p in chosen:
            met |= self.columns[p]
        return self.all & ~met

    def critical(self, chosen: Sequence[int]) -> list[int]:
        return [self.columns[p] & self.left([q for q in chosen if q != p]) for p in chosen]

    def branches(self, node: Node, left: int, critical: list[int], most: int) -> Iterator[tuple[Node, int, list[int]]]:
        """The clauses with one literal more, most signatures first: the literals of the smallest signature that is still missed."""
        room = most - len(node.chosen)
        if room <= 0:
            return
        need, gains, rest = left.bit_count(), {}, node.allowed
        while rest:
            p = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            if n := (left & self.columns[p]).bit_count():
                gains[p] = n
        if sum(sorted(gains.values(), reverse=True)[:room]) < need:
            return
        pivot = self.rows[(left & -left).bit_length() - 1] & node.allowed
        allowed = node.allowed & ~pivot
        for p in sorted((p for p in gains if pivot >> p & 1), key=lambda p: (-gains[p], p)):
            column = self.columns[p]
            kept = [c & ~column for c in critical]
            if all(kept):
                yield Node((*node.chosen, p), allowed), left & ~column, [*kept, left & column]
                allowed |= 1 << p

    def search(self, node: Node, most: int, first: int | None) -> list[tuple[int, ...]]:
        """Minimal clauses below a node, at most `first`, in the order of the search."""
        found: list[tuple[int, ...]] = []

        def go(node: Node, left: int, critical: list[int]) -> bool:
            if not left:
                found.append(node.chosen)
                return first is None or len(found) < first
            return all(go(*branch) for branch in self.branches(node, left, critical, most))

        go(node, self.left(node.chosen), self.critical(node.chosen))
        return found

    def frontier(self, enough: int, most: int) -> list[Node]:
        """Roots of subtrees that are the whole search together, in its order: levels are opened until there are `enough`."""
        nodes = [Node((), (1 << len(self.columns)) - 1)]
        while len(nodes) < enough:
            opened, changed = [], False
            for n in nodes:
                left = self.left(n.chosen)
                if left and len(n.chosen) < most:
                    opened += [b[0] for b in self.branches(n, left, self.critical(n.chosen), most)]
                    changed = True
                else:
                    opened.append(n)
            nodes = opened
            if not changed:
                break
        return nodes


def bitmaps(sigs: DataFrame, most_signatures: int) -> Bitmaps:
    """Packed by Spark: what reaches the driver is a bit for each signature and predicate, of at most `most_signatures` signatures."""
    sigs = staged(sigs.select(F.array_sort("sig").alias("sig")).distinct().limit(most_signatures + 1))
    n = sigs.count()
    if n > most_signatures:
        raise ValueError(f"more than {most_signatures} different signatures: use fewer or coarser predicates")
    number = F.row_number().over(Window.orderBy(F.size("sig"), "sig"))  # bounded, see above
    held = sigs.select(number.cast("long").alias("at"), "sig").select("at", F.explode("sig").alias("p"))
    parts = held.groupBy("p", F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    found = parts.collect()
    packed = np.zeros((max((r.p for r in found), default=-1) + 1, (n // 32768 + 1) * 4096), np.uint8)
    for r in found:
        packed[r.p, (r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    across = np.packbits(np.unpackbits(packed, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    rows, columns = ([int.from_bytes(x.tobytes(), "little") for x in m] for m in (across, packed))
    return Bitmaps(rows, columns)


def covers(sigs: DataFrame, most_literals: int, most_signatures: int, first: int | None = None) -> DataFrame:
    """clause, ascending: the minimal covers of at most `most_literals` predicates; with `first`, the first so many in the search's order.

    The order is fixed by the signatures alone, so the result doesn't depend on the number of tasks. With `first`, subtrees are searched
    in waves, each twice as many as before, until the first subtrees have enough.
    """
    spark = sigs.sparkSession
    maps = bitmaps(sigs, most_signatures)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    nodes = maps.frontier(8 * tasks, most_literals)
    shared = spark.sparkContext.broadcast((maps.rows, maps.columns))
    schema = pa.schema([("subtree", pa.int64()), ("place", pa.int64()), ("clause", pa.list_(pa.int32()))])

    def run(batches):
        held = Bitmaps(*shared.value)
        for rb in batches:
            for at, chosen, allowed in zip(*(rb.column(c).to_pylist() for c in ("subtree", "chosen", "allowed"))):
                found = held.search(Node(tuple(chosen), int.from_bytes(allowed, "little")), most_literals, first)
                columns = [[at] * len(found), list(range(len(found))), [sorted(c) for c in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    size = len(maps.columns) // 8 + 1
    rows = [(k, list(n.chosen), bytearray(n.allowed.to_bytes(size, "little"))) for k, n in enumerate(nodes)]
    kinds, out, start, wave = "subtree long, chosen array<int>, allowed binary", None, 0, tasks if first else len(rows)
    while start < len(rows) or out is None:
        part = rows[start : start + wave]
        dealt = spark.createDataFrame(part, kinds).repartition(max(1, min(len(part), tasks if first else 8 * tasks)))
        found = staged(dealt.mapInArrow(run, "subtree long, place long, clause array<int>"))
        out = found if out is None else out.unionByName(found)
        start, wave = start + wave, wave * 2
        if first is not None and out.count() >= first:
            break
    return (out if first is None else out.orderBy("subtree", "place").limit(first)).select("clause")
