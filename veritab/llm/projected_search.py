"""Operator 9: nearest neighbours by largest inner product, through stable projections in kd-trees.

Largest inner product becomes smallest distance when every vector gets one more coordinate that
brings it to the length of the longest, and queries get zero there. Vectors are projected to a few dimensions with Gaussian
(2-stable) weights. A kd-tree over the projections of a sample (at most `sample_rows` rows, a documented bound) cuts the space to cells; every
row goes to its cell, and a cell with too many rows (copies, say) is dealt to several blocks. In a block a kd-tree of its own indexes the projections.

A query first goes to its `first_cells` nearest cells. In a block the tree's leaves come in order of their
projected distance; their vectors are verified by the exact inner product in double precision. As a projected distance,
squared and divided by the true one squared, follows a chi-square law, the search ends when a vector nearer than the k-th found would
with probability `confidence` already have been met. By the same test against the cells' boxes a query then goes on only to cells that
its k-th score so far still reaches.

The blocks' results are merged by query. Vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do those with a null id or another number of dimensions than most (ties: the larger). Equal scores
go to the smaller vec_id; repeated rows of one vec_id are candidates each, but for rows with the query's own id. Fewer candidates
than k: all of them. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import batch, table, written


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Of an even number m of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, m // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_point(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


class KdTree:
    """Splits points at the median of the widest dimension down to leaves; keeps the leaves' boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        order, bounds, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[order[a:b]]
            spread = own.max(0) - own.min(0)
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            mid, axis = (b - a) // 2, int(spread.argmax())
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.order, self.bounds = order, np.array(sorted(bounds))
        self.low = np.array([points[order[a:b]].min(0) for a, b in self.bounds])
        self.high = np.array([points[order[a:b]].max(0) for a, b in self.bounds])


class Cells:
    """Cuts the space at medians of sample points to a number of cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple] = []  # (axis, value, below, above), or (number of the cell,)
        self.count = 0
        self._cut(points, max(1, cells))

    def _cut(self, points: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(1)
        if cells == 1 or not spread.max() > 0:
            self.nodes[at] = (self.count,)
            self.count += 1
            return at
        axis, below = int(spread.argmax()), cells // 2
        value = float(np.quantile(points[:, axis], below / cells))
        left = points[:, axis] <= value
        if left.all():
            value = float((points[:, axis].min() + points[:, axis].max()) / 2)
            left = points[:, axis] <= value
        self.nodes[at] = (axis, value, self._cut(points[left], below), self._cut(points[~left], cells - below))
        return at

    def assign(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                left = points[rows, node[0]] <= node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def box_distances(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distance from each query to each box."""
    out = np.zeros((len(queries), len(low)))
    for k in range(queries.shape[1]):
        q = queries[:, k : k + 1]
        gap = np.maximum(np.maximum(low[None, :, k] - q, q - high[None, :, k]), 0)
        out += gap * gap
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, longest: float, projection: np.ndarray, k: int, point: float, leaf: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, vec_ids, scores) of up to k found in a block for each query.

    start: scores that each query's k-th found has already. Queries go on leaf by leaf, each in its own order, in rounds; the queries that are at
    a leaf in a round meet it together.
    """
    lifted = np.concatenate([vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))[:, None]], 1)
    tree = KdTree(lifted @ projection, leaf)
    ids, vectors, bounds = ids[tree.order], np.ascontiguousarray(vectors[tree.order]), tree.bounds
    near = box_distances(tree.low, tree.high, queries @ projection[:-1])
    ranked = np.argsort(near, 1, kind="stable")
    own, length = longest**2 + (queries**2).sum(1), len(bounds)
    slack = 1e-9 * longest * np.sqrt((queries**2).sum(1)).max()
    best_q, best_i, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kth = np.full(len(queries), -np.inf) if start is None else start.copy()
    at, take = 0, 1
    active = np.flatnonzero(near[np.arange(len(queries)), ranked[:, 0]] <= point * np.maximum(own - 2 * kth, 0))
    while len(active) and at < length:
        some = ranked[active, at : at + take]
        leaf_of, q_of = some.ravel(), np.repeat(active, some.shape[1])
        order = np.argsort(leaf_of, kind="stable")
        leaf_of, q_of = leaf_of[order], q_of[order]
        cuts = np.flatnonzero(np.diff(leaf_of, prepend=-1, append=length))
        parts = [(best_q, best_i, best_s)]
        for x, y in zip(cuts, cuts[1:]):
            lo, hi = bounds[leaf_of[x]]
            qs = q_of[x:y]
            rough = queries[qs] @ vectors[lo:hi].T
            qn, rn = np.nonzero(rough >= (kth[qs] - slack)[:, None])
            qn, rn = qs[qn], rn + lo
            other = ids[rn] != query_ids[qn]
            qn, rn = qn[other], rn[other]
            # scores proper: the same order of additions for every vector, whatever stands beside it
            parts.append((qn, ids[rn], np.einsum("ij,ij->i", vectors[rn], queries[qn])))
        best_q, best_i, best_s = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((best_i, -best_s, best_q))
        best_q, best_i, best_s = best_q[order], best_i[order], best_s[order]
        rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
        full = rank == k - 1
        kth[best_q[full]] = np.maximum(kth[best_q[full]], best_s[full])
        best_q, best_i, best_s = best_q[rank < k], best_i[rank < k], best_s[rank < k]
        at, take = at + take, min(max(1, at + take), 32)
        if at < length:
            # vectors of the next leaf lie at least near[...] from the query in the projection
            true = np.maximum(own - 2 * kth, 0)
            active = active[near[active, ranked[active, at]] <= point * true[active]]
    return best_q, best_i, best_s


class BoxTree:
    """Boxes of neighbouring cells gathered by sixteens, level over level, so that a query measures only the boxes that its reach leads to."""

    def __init__(self, low: np.ndarray, high: np.ndarray, fan: int = 16):
        self.fan, levels = fan, [(low, high)]
        while len(levels[-1][0]) > fan:
            starts = np.arange(0, len(levels[-1][0]), fan)
            levels.append((np.minimum.reduceat(levels[-1][0], starts), np.maximum.reduceat(levels[-1][1], starts)))
        self.levels = levels[::-1]

    def _distances(self, level: int, queries: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        low, high = self.levels[level]
        q = queries[rows]
        return (np.maximum(np.maximum(low[nodes] - q, q - high[nodes]), 0) ** 2).sum(1)

    def _below(self, level: int, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
        rows, there = np.repeat(rows, self.fan), below < len(self.levels[level + 1][0])
        return rows[there], below[there]

    def _top(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        top = len(self.levels[0][0])
        return np.repeat(np.arange(n), top), np.tile(np.arange(top), n)

    def within(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of all cells whose box is at most `reach` from the query, squared; ascending."""
        rows, nodes = self._top(len(queries))
        for level in range(len(self.levels)):
            if level:
                rows, nodes = self._below(level - 1, rows, nodes)
            near = self._distances(level, queries, rows, nodes) <= reach[rows]
            rows, nodes = rows[near], nodes[near]
        return rows, nodes

    def nearest(self, queries: np.ndarray, n: int, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of n near cells of each query: the nearest below the nearest boxes of each level, of which `beam` go on."""
        rows, nodes = self._top(len(queries))
        for level in range(len(self.levels)):
            if level:
                rows, nodes = self._below(level - 1, rows, nodes)
            order = np.lexsort((nodes, self._distances(level, queries, rows, nodes), rows))
            rows, nodes = rows[order], nodes[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < (n if level == len(self.levels) - 1 else max(n, beam))
            rows, nodes = rows[kept], nodes[kept]
        return rows, nodes


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    e = F.col(embedding).cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


_PLACED = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int64()), ("spread", pa.int64()), ("p", pa.list_(pa.float64()))])
_ROUTED = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("kth", pa.float64()), ("cell", pa.int64())])
_ROUTED_SQL = "query_id long, v array<double>, kth double, cell long"


def _route(asked: DataFrame, boxes: tuple[np.ndarray, np.ndarray, np.ndarray], projection: np.ndarray, first_cells: int, point: float, longest: float, again: bool) -> DataFrame:
    """(query_id, v, kth, cell): each query's nearest cells; or, again, the cells beyond them that its k-th score still reaches.

    asked: query_id, v, kth. boxes: cells and their bounds; there are as many as rows by block, 128 bytes each.
    """
    shared = asked.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        cells, low, high = shared.value
        tree = BoxTree(low, high)
        step = max(1, (1 << 19) // len(cells))  # queries at a time, should they reach every cell
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                q = _matrix(part.column(1))
                places = q @ projection[:-1]
                row, cell = tree.nearest(places, first_cells)
                if again:
                    done = set(zip(row.tolist(), cell.tolist()))
                    kth = part.column(2).to_numpy(zero_copy_only=False)
                    row, cell = tree.within(places, point * np.maximum(longest**2 + (q**2).sum(1) - 2 * kth, 0))
                    new = np.array([x not in done for x in zip(row.tolist(), cell.tolist())], bool)
                    row, cell = row[new], cell[new]
                for x in range(0, len(row), 5_000):
                    r = pa.array(row[x : x + 5_000])
                    yield pa.RecordBatch.from_arrays([*(c.take(r) for c in part.columns), pa.array(cells[cell[x : x + 5_000]])], schema=_ROUTED)

    return asked.select("query_id", "v", "kth").mapInArrow(run, _ROUTED_SQL)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, dimensions: int = 8, confidence: float = 0.8, block_rows: int = 20_000, query_rows: int = 20_000, leaf: int = 256, first_cells: int = 3, sample_rows: int = 50_000, seed: int = 20240613) -> DataFrame:
    """query_id, rank, vec_id, score for queries with an id divisible by `every`.

    A task holds a block of about block_rows rows and at most about query_rows queries.
    """
    spark = vectors.sparkSession
    v = usable(vectors)
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, longest = most.d, math.sqrt(most.longest)
    v = v.where(F.size("v") == d)
    projection = np.random.default_rng(seed).standard_normal((d + 1, dimensions))
    point = chi_square_point(confidence, dimensions)

    def projected(m):
        return np.concatenate([m, np.sqrt(np.maximum(longest**2 - (m**2).sum(1), 0))[:, None]], 1) @ projection

    def project(batches):
        schema = pa.schema([("p", pa.list_(pa.float64()))])
        for b in batches:
            if b.num_rows:
                yield batch(schema, [projected(_matrix(b.column(0))).tolist()])

    share = min(1.0, sample_rows / most.n)
    some = v.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    some = some.orderBy(F.xxhash64(F.lit(1), "vec_id", "v"), "vec_id").limit(sample_rows).select("v")
    points = some.mapInArrow(project, "p array<double>").toArrow()
    cells = Cells(_matrix(points["p"]) if points.num_rows else np.zeros((0, dimensions)), -(-most.n // block_rows))

    def place(batches):
        n = 0
        for b in batches:
            if b.num_rows:
                p = projected(_matrix(b.column(1)))
                yield batch(_PLACED, [b.column(0), b.column(1), cells.assign(p), np.arange(n, n + b.num_rows), p.tolist()])
                n += b.num_rows

    rows = written(v.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, cell long, spread long, p array<double>"), "nearest-rows")
    bounds = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dimensions)]
    boxes = rows.groupBy("cell").agg(F.count("*").alias("n"), *bounds).orderBy("cell").toArrow()
    number, n = boxes["cell"].to_numpy(), boxes["n"].to_numpy()
    low, high = (np.stack([boxes[f"{name}{i}"].to_numpy() for i in range(dimensions)], 1) for name in ("low", "high"))
    # a cell that the sample didn't cut small enough, or can't be cut, is dealt to blocks
    blocks = np.maximum(1, n // block_rows)
    dealt = spark.createDataFrame([(int(c), int(b)) for c, b in zip(number, blocks)], "cell long, blocks long")
    rows = rows.join(dealt, "cell").select("vec_id", "v", "cell", F.expr("spread % blocks").alias("block"))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id", "v"])
    asked = written(asked, "nearest-queries")

    def search(_key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], _FOUND)
        query_ids, start = right["query_id"].to_numpy(), right["kth"].to_numpy()
        found = search_block(left["vec_id"].to_numpy(), _matrix(left["v"]), query_ids, _matrix(right["v"]), longest, projection, k, point, leaf, start)
        return pa.Table.from_batches([batch(_FOUND, [query_ids[found[0]], found[1], found[2]])])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def searched(routed: DataFrame) -> DataFrame:
        routed = written(routed, "nearest-routed")
        # rows of a block are copied once for each query_rows queries that come to its cell
        groups = routed.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).alias("groups")).join(dealt, "cell")
        key = ["cell", "block", "group"]
        q = routed.join(groups, "cell").withColumn("group", F.pmod(F.xxhash64("query_id", "v"), F.col("groups")))
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        r = rows.join(groups.select("cell", "groups"), "cell").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        return r.select("vec_id", "v", *key).groupBy(key).cogroup(q.select("query_id", "v", "kth", *key).groupBy(key)).applyInArrow(search, "query_id long, vec_id long, score double")

    box, none = (number, low, high), F.lit(float("-inf"))
    first = written(best(searched(_route(asked.withColumn("kth", none), box, projection, first_cells, point, longest, False))), "nearest-first")
    if len(number) <= first_cells:
        return first
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    further = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", none))
    more = searched(_route(further, box, projection, first_cells, point, longest, True))
    return best(written(first.select("query_id", "vec_id", "score").unionByName(more), "nearest"))


def op9_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
