"""Operator 6: n-gram Jaccard join by T-occurrence search (DivideSkip), and its components.

A document's set is that of its distinct word shingles, as 64-bit hashes. Documents with one set are one node.
Two nodes link when their sets' Jaccard similarity reaches the threshold, tested in whole numbers.

1. Every (shingle, node) goes, packed, to a bucket of the hash space, which counts the nodes of each shingle. There are as many
   buckets as the texts' bytes ask for, so a bucket's size doesn't grow with the table. Of many buckets up to `_TOGETHER` beside each other
   travel as one row a slice, as each row names its nodes, and are counted one after another. Only shingles
   of two nodes or more go on: no other counts in an intersection. A shingle that is common within a slice of texts sends
   one count there, while its nodes stay spread and get the total by a join: no task gathers a common shingle. If it isn't
   common in all slices, its other nodes take that way too, where equal (shingle, node) of several slices become one.
   A common shingle's count is that of its slices together, copies included; it only orders shingles.
2. Of each set, rarest first, a prefix is kept such that linked sets share a shingle of their prefixes. Components over shared prefix
   shingles hold all links between them.
3. Each candidate component has inverted lists. A node's short lists are merged on a heap, which skips what can't occur often
   enough (MergeSkip); nodes that do, and that aren't linked to it already through others, are probed by binary search in
   the long lists. Found links that join two parts are kept, at most one a node. Components with more than `block` rows
   (shingles of nodes) lose those nodes that a leader settles; the rest is cut to bands of set size, as linked sets
   stand in one band or two beside each other, and to blocks in a band. A block is searched in itself and kept once as a file of the
   shared folder; then the blocks of such bands meet in pairs, and a task reads the two files of each of its pairs.
4. Components of the links.

Very long texts are compared whole. Null and empty texts have empty sets and link with nothing. Fewer words than a shingle: all of them are one shingle. Null doc_id
takes part, but never gives a component its id. Rows that repeat a doc_id are documents each. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from veritab.llm.common import batch, open_fs, shared_dir, table, typed, write_atomically, written
from veritab.llm.components import components
from veritab.llm.wordhash import bounded, give_back, mix, shingles, words

_COMMON = 16  # more nodes of a slice than these share a shingle: only its count goes to its bucket
_BUCKET_BYTES = 8 << 20  # text bytes a bucket of shingles
_FEW = 128  # so many buckets travel alone; of more, groups do
_TOGETHER = 8  # buckets a group at most, which a task holds packed
_PACK = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_PACK_SQL = "bucket long, hashes binary, places binary, nodes binary, sizes binary"
#: kind 0: a document (id, node, n); 1: a shared shingle (hash, node, n, count); 2: nodes of a shingle that is common in some slice (hash, nodes, sizes); 3: its count (hash, count)
_OUT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("count", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_OUT_SQL = "kind int, doc_id long, hash long, node long, n long, count long, nodes binary, sizes binary"
_SHARED = pa.schema([("hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("count", pa.int64())])


def _out(kind: int, rows: int, **columns) -> pa.RecordBatch:
    return batch(_OUT, [np.full(rows, kind), *(columns.get(f.name, pa.nulls(rows, f.type)) for f in list(_OUT)[1:])])


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    w = words(column)
    h, d = shingles(w, w.hashes(lower=True), size)
    if len(d) and (d[1:] < d[:-1]).any():
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    cuts = np.searchsorted(d, np.arange(len(column) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cuts, cuts[1:])]


def _node(s: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(s).sum() + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64))
    return int(x.view(np.int64)[0])


def _together(buckets: int) -> int:
    """How many buckets travel in one row."""
    return max(1, min(_TOGETHER, buckets // _FEW))


def _edges(buckets: int) -> np.ndarray:
    """Where the buckets of the hash space begin, but for the first."""
    return (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)


def _packed(sets: dict[int, np.ndarray], buckets: int):
    """The slice's entries by group of buckets, and the nodes of shingles that are common in it."""
    nodes = np.array(list(sets), np.int64)
    sizes = np.array([len(s) for s in sets.values()], np.int64)
    h = np.concatenate(list(sets.values())) if sets else np.zeros(0, np.uint64)
    place = np.repeat(np.arange(len(nodes), dtype=np.uint32), sizes)
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    head = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(h)))
    common = np.repeat(count > _COMMON, count)
    hot = (h[common], nodes[place[common]], sizes[place[common]])
    # a common shingle keeps one entry, which holds its count above the largest place
    first = np.zeros(len(h), bool)
    first[head] = True
    place[head[count > _COMMON]] = count[count > _COMMON] + (1 << 24)
    h, place = h[~common | first], place[~common | first]
    together = _together(buckets)
    cuts = [0, *np.searchsorted(h, _edges(buckets)[together - 1 :: together]).tolist(), len(h)]
    rows = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a == b:
            continue
        used, local = np.unique(np.where(place[a:b] < 1 << 24, place[a:b], 0), return_inverse=True)
        local = np.where(place[a:b] < 1 << 24, local, place[a:b]).astype("<u4")
        gaps = np.diff(h[a:b], prepend=np.uint64(0)).astype("<u8")
        # six bytes for a gap, but eight for the first
        wide = gaps.view(np.uint8).reshape(-1, 8)
        raw = wide[0].tobytes() + (b"\1" + wide[1:, :6].tobytes() if not wide[1:, 6:].any() else b"\0" + wide[1:].tobytes())
        rows.append((k, raw, local.tobytes() if local.max() >= 65536 else local.astype("<u2").tobytes(), nodes[used].tobytes(), sizes[used].astype("<u2" if sizes[used].max() < 65536 else "<i8").tobytes()))
    return rows, hot


def _unpacked(t: pa.RecordBatch, edges: np.ndarray) -> Iterator[tuple]:
    """Of each row its hashes, and views of the places, nodes and sizes in the batch; and where the row's buckets begin and end."""
    for raw, places, nodes, sizes in zip(*(t.column(c) for c in ("hashes", "places", "nodes", "sizes"))):
        raw, places, sizes = (np.frombuffer(x.as_buffer(), np.uint8) for x in (raw, places, sizes))
        nodes = np.frombuffer(nodes.as_buffer(), np.int64)
        wide = np.zeros(((len(raw) - 9) // (6 if raw[8] else 8) + 1, 8), np.uint8)
        wide[0] = raw[:8]
        wide[1:, : 6 if raw[8] else 8] = raw[9:].reshape(-1, 6 if raw[8] else 8)
        h = np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)
        places = places.view("<u2" if len(places) == 2 * len(h) else "<u4")
        yield h, places, nodes, sizes.view("<u2" if len(sizes) == 2 * len(nodes) else "<i8"), [0, *np.searchsorted(h, edges).tolist(), len(h)]


def _entries(row: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, nodes, sizes and counts (0 but for common shingles) of the row's k-th bucket."""
    h, places, nodes, sizes, cuts = row
    place = places[cuts[k] : cuts[k + 1]].astype(np.int64)
    count = np.where(place >= 1 << 24, place - (1 << 24), 0)
    place = np.where(count > 0, 0, place)
    return h[cuts[k] : cuts[k + 1]], nodes[place], sizes[place].astype(np.int64), count


def shared_shingles(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Rows of the kinds 0 to 3, written."""
    d = typed(docs, doc_id="long", text="string")
    together = _together(buckets)

    def send(batches):
        seen: set[int] = set()
        turn = 0
        for b in bounded(batches):
            sets = shingle_sets(b.column(1), size)
            nodes = [_node(s) if len(s) else None for s in sets]
            fresh = {v: s for v, s in zip(nodes, sets) if v is not None and v not in seen}
            seen.update(fresh)
            rows, hot = _packed(fresh, buckets)
            # what only passes through goes to any bucket, under a name of its own
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False).astype("<u1")
            turn += 1
            rows.append((-1 - (turn % buckets), ids.tobytes(), known.tobytes(), np.array([v or 0 for v in nodes], "<i8").tobytes(), np.array([len(s) for s in sets], "<i8").tobytes()))
            if len(hot[0]):
                each, times = np.unique(hot[0], return_counts=True)
                rows.append((-1 - buckets - (turn % buckets), each.tobytes(), times.astype("<i8").tobytes(), hot[1].tobytes(), hot[2].tobytes()))
            yield batch(_PACK, [list(c) for c in zip(*rows)])

    def count_bucket(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        h, v, n, c = (np.concatenate(x) for x in zip(*rows))
        rows.clear()
        order = np.lexsort((v, c > 0, h))
        h, v, n, c = h[order], v[order], n[order], c[order]
        same_h = np.concatenate([[False], h[1:] == h[:-1]])
        # a node that several slices have counts once
        keep = ~(same_h & np.concatenate([[False], (v[1:] == v[:-1]) & (c[1:] == 0) & (c[:-1] == 0)]))
        h, v, n, c, same_h = h[keep], v[keep], n[keep], c[keep], same_h[keep]
        run = np.cumsum(~same_h) - 1
        total = np.bincount(run, np.where(c > 0, c, 1))
        some_common = np.bincount(run, c > 0) > 0
        plain = (c == 0) & (total[run] >= 2) & ~some_common[run]
        for a in range(0, int(plain.sum()), 200_000):
            i = np.flatnonzero(plain)[a : a + 200_000]
            yield _out(1, len(i), hash=h[i].view(np.int64), node=v[i], n=n[i], count=total[run[i]].astype(np.int64))
        # a node can be plain in one slice and in the list of another
        i = np.flatnonzero((c == 0) & some_common[run])
        at = np.union1d(np.flatnonzero(np.diff(run[i], prepend=-1)), np.arange(0, len(i), 4096))
        if len(i):
            ends = [*at[1:].tolist(), len(i)]
            vs, ns = v[i], n[i]
            yield _out(2, len(at), hash=h[i[at]].view(np.int64), nodes=[vs[x:y].tobytes() for x, y in zip(at, ends)], sizes=[ns[x:y].tobytes() for x, y in zip(at, ends)])
        i = np.flatnonzero(~same_h)[some_common]
        if len(i):
            yield _out(3, len(i), hash=h[i].view(np.int64), count=total[some_common].astype(np.int64))
        del h, v, n, c, order, same_h, keep, run, total, plain, i

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        if k < -buckets:
            for r in (r for t in batches for r in t.to_pylist()):
                h, times, v, n = (np.frombuffer(r[c], np.int64) for c in ("hashes", "places", "nodes", "sizes"))
                at = [0, *np.cumsum(times).tolist()]
                yield _out(2, len(h), hash=h, nodes=[v[x:y].tobytes() for x, y in zip(at, at[1:])], sizes=[n[x:y].tobytes() for x, y in zip(at, at[1:])])
            return
        if k < 0:
            for r in (r for t in batches for r in t.to_pylist()):
                ids, v, n = (np.frombuffer(r[c], np.int64) for c in ("hashes", "nodes", "sizes"))
                missing = np.frombuffer(r["places"], np.uint8) == 0
                yield _out(0, len(v), doc_id=pa.array(ids, mask=missing), node=v, n=n)
            return
        edges = _edges(buckets)[k * together : (k + 1) * together - 1]
        rows = [r for t in batches for r in _unpacked(t, edges)]
        for j in range(len(edges) + 1):
            entries = [_entries(r, j) for r in rows if r[-1][j] < r[-1][j + 1]]
            if j == len(edges):
                rows.clear()
            yield from count_bucket(entries)
        give_back()

    packs = d.mapInArrow(send, _PACK_SQL)
    counted = packs.groupBy("bucket").applyInArrow(count, _OUT_SQL)
    return written(counted, "jaccard-shingles")


def occurrence_links(h: np.ndarray, v: np.ndarray, size: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between nodes 0.. that join parts not joined before. (h, v): each shared shingle of each node; size: of the nodes' sets.

    Nodes in ascending order of size ask for earlier ones that share enough shingles (T-occurrence), with DivideSkip's split of lists.
    Given each node's side (0 or 1), only nodes of different sides are compared.
    """
    rank = np.argsort(size, kind="stable")
    at = np.empty(len(size), np.int64)
    at[rank] = np.arange(len(size))
    size, v = size[rank], at[v]
    if side is None:
        order = np.lexsort((v, h))
        h, v = h[order], v[order]
        head = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        lists = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
        heads, until_own = head[lists], np.arange(len(h))  # a node's list up to the node
    else:
        # a shingle's nodes of side 0, then those of side 1, each in their order; shingles of one side alone count for nothing
        of = side[rank][v]
        order = np.lexsort((v, of, h))
        h, v, of = h[order], v[order], of[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        middle = first + np.bincount(run, of == 0, len(first)).astype(np.int64)
        heads = np.where(of == 0, middle[run], first[run])
        # the other side's nodes that are before a node, counted along its shingle
        by_node = np.lexsort((v, run))
        before = np.empty((2, len(h)), np.int64)
        for k in (0, 1):
            n = np.cumsum(of[by_node] == k)
            before[k, by_node] = n - np.concatenate([[0], n])[first[run[by_node]]]
        until_own = heads + np.where(of == 0, before[1], before[0])
    own = np.argsort(v, kind="stable")  # where each node stands in its lists
    heads, own, cut = heads[own].tolist(), until_own[own].tolist(), np.searchsorted(v[own], np.arange(len(size) + 1)).tolist()
    nodes, sizes = v.tolist(), size.tolist()
    part = np.arange(len(size))  # smallest label wins; relabelled as parts join
    links = []
    for q in range(1, len(size)):
        need = -(-percent * sizes[q] // 100)
        if cut[q + 1] - cut[q] < need:
            continue
        low = int(np.searchsorted(size[:q], need))
        if low == q or (part[low:q] == part[q]).all():
            continue
        # of each list the entries before the node's own, from the smallest set that can link
        mine = [(bisect_left(nodes, low, heads[i], own[i]), own[i]) for i in range(cut[q], cut[q + 1])]
        mine = sorted((x for x in mine if x[0] < x[1]), key=lambda x: x[1] - x[0])
        if len(mine) < need:
            continue
        longest = max(2, mine[-1][1] - mine[-1][0])
        n_long = int(min(need - 1, need / (0.01 * math.log2(longest) + 1)))
        short, long_ones = mine[: len(mine) - n_long], mine[len(mine) - n_long :]
        times = need - n_long  # so often at least a node stands in the short lists
        heap = [(nodes[a], a, b) for a, b in short]
        heapq.heapify(heap)
        while len(heap) >= times:
            c, popped = heap[0][0], []
            while heap and heap[0][0] == c:
                popped.append(heapq.heappop(heap))
            if len(popped) < times:
                # skip to what the last list needed for enough occurrences has
                while len(popped) < times - 1:
                    popped.append(heapq.heappop(heap))
                until = heap[0][0]
                for _, a, b in popped:
                    a = bisect_left(nodes, until, a, b)
                    if a < b:
                        heapq.heappush(heap, (nodes[a], a, b))
                continue
            for _, a, b in popped:
                if a + 1 < b:
                    heapq.heappush(heap, (nodes[a + 1], a + 1, b))
            if part[c] == part[q]:
                continue
            n, target = len(popped), -(-percent * (sizes[q] + sizes[c]) // (100 + percent))
            for k, (a, b) in enumerate(long_ones):
                if n + n_long - k < target:
                    break
                a = bisect_left(nodes, c, a, b)
                n += a < b and nodes[a] == c
            if 100 * n >= percent * (sizes[q] + sizes[c] - n):
                links.append((int(rank[q]), int(rank[c])))
                keep, gone = min(part[c], part[q]), max(part[c], part[q])
                part[part == gone] = keep
                if (part[low:q] == part[q]).all():
                    break
    return links


def _common(rows: DataFrame) -> DataFrame:
    """The common shingles' nodes with their counts. A row per slice and shingle meets the count; nodes come out of it after that, evenly dealt."""
    met = rows.where("kind = 2").select("hash", "nodes", "sizes").join(rows.where("kind = 3").select("hash", "count"), "hash")

    def expand(batches):
        for b in batches:
            if b.num_rows:
                h, nodes, sizes, count = (c.to_pylist() for c in b.columns)
                v, n = (np.frombuffer(b"".join(x), np.int64) for x in (nodes, sizes))
                times = [len(x) // 8 for x in nodes]
                yield batch(_SHARED, [np.repeat(h, times), v, n, np.repeat(count, times)])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts).mapInArrow(expand, "hash long, node long, n long, count long").distinct()


def _around_leaders(kept: DataFrame, candidates: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """What is left to search of candidates (node, root, n, m), and links (a, b) of large components to their leaders.

    A component of more than `block` rows is compared with one of its nodes first. Nodes that link to it are one part, so they needn't meet each
    other. As 1 - similarity is a metric, one of them can link to a node outside only if it is nearly as far from the leader: the
    others are done.
    """
    large = candidates.groupBy("root").agg(F.sum("m").alias("rows"), F.min("node").alias("leader")).where(F.col("rows") > block).select("root", "leader")
    members = written(candidates.join(large, "root", "left"), "jaccard-members")
    rows = kept.join(members.where("leader is not null").drop("n"), "node")
    lead = rows.where("node = leader").select("root", "hash", F.col("n").alias("n_leader"))
    # every member has at least a row: what it shares with the leader is counted before the exchange
    shared = rows.join(lead, ["root", "hash"], "left").groupBy("node", "root", "leader", "n", "m").agg(F.count("n_leader").alias("both"))
    sizes = lead.select("root", "n_leader").distinct()
    far = shared.join(sizes, "root").withColumn("union", F.col("n") + F.col("n_leader") - F.col("both"))
    far = far.withColumn("linked", 100 * F.col("both") >= percent * F.col("union")).withColumn("distance", 1 - F.col("both") / F.col("union"))
    far = written(far.select("node", "root", "n", "m", "leader", "linked", "distance"), "jaccard-leaders")
    outside = far.where("not linked").groupBy("root").agg(F.min("distance").alias("nearest"))
    left = far.join(outside, "root").where(~F.col("linked") | (F.col("distance") >= F.col("nearest") - (1 - percent / 100) - 1e-9))
    star = far.where("linked and node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    columns = ["node", "root", "n", "m"]
    return members.where("leader is null").select(columns).unionByName(left.select(columns)), star


def _blocks(candidates: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, root, band, own): the block of its component that a node belongs to, by bands of set size; -1 and 0 for components of one block."""
    width = max(math.log(100 / percent) * (1 + 1e-9), 1e-9)
    banded = candidates.withColumn("band", F.floor(F.log("n") / width))
    bands = banded.groupBy("root", "band").agg(F.sum("m").alias("rows"))
    large = bands.groupBy("root").agg(F.sum("rows").alias("all")).where(F.col("all") > block).select("root")
    bands = bands.join(large, "root").select("root", "band", F.ceil(F.col("rows") / block).alias("blocks"))
    met = banded.join(bands, ["root", "band"], "left")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int")
    return met.select("node", "root", F.when(F.col("blocks").isNull(), -1).otherwise(F.col("band")).cast("long").alias("band"), own.alias("own"))


def _pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of different blocks (root, band, own) of a component that stand in one band or in bands beside each other."""
    a = blocks.select("root", F.col("band").alias("i_band"), F.col("own").alias("i"))
    b = blocks.select("root", F.col("band").alias("j_band"), F.col("own").alias("j"))
    later = ((F.col("j_band") == F.col("i_band")) & (F.col("j") > F.col("i"))) | (F.col("j_band") == F.col("i_band") + 1)
    return a.join(b, "root").where(later)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: a link, or a block that was kept
_FOUND = pa.schema([*_LINK, ("root", pa.int64()), ("band", pa.int64()), ("own", pa.int32())])
_BLOCK = pa.schema([("hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, buckets: int | None = None, block: int = 40_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every document. A search task holds two blocks of about `block` rows."""
    spark = docs.sparkSession
    if buckets is None:
        most = docs.select(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // _BUCKET_BYTES))
    rows = shared_shingles(docs, size, buckets)
    documents = rows.where("kind = 0").select("doc_id", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n")
    shared = rows.where("kind = 1").select(_SHARED.names).unionByName(_common(rows))
    # sets rarest first: shingles of one node alone come before all shared ones
    own = Window.partitionBy("node")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = shared.withColumn("m", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("count", "hash")))
    # a set whose prefix has no shared shingle links with nothing: all its rows go
    alone = F.col("n") - F.col("m")
    kept = kept.where(alone < prefix).select("hash", "node", "n", "m", (F.col("rank") <= prefix - alone).alias("early"), (F.col("rank") == 1).alias("head"))
    kept = written(kept, "jaccard-kept")
    ranked = kept.where("early").select("hash", "node")
    first = ranked.groupBy("hash").agg(F.min("node").alias("b"), F.count("*").alias("times")).where("times > 1").select("hash", "b")
    edges = ranked.join(first, "hash").select(F.col("node").alias("a"), "b")
    candidates = components(edges).join(kept.where("head").select("node", "n", "m"), "node")
    kept = kept.select("hash", "node", "n")
    candidates, star = _around_leaders(kept, candidates, percent, block)
    keys = ["root", "band", "own"]
    tasks = kept.join(_blocks(candidates, percent, block), "node").select(*keys, "hash", "node", "n")
    tasks = tasks.repartition(*keys).sortWithinPartitions(*keys)
    folder = shared_dir(spark, "jaccard-blocks")

    def links(h, v, n, side=None):
        """Columns a and b; side: of each row."""
        nodes, place, back = np.unique(v, return_index=True, return_inverse=True)
        found = np.array(occurrence_links(h.view(np.uint64), back, n[place], percent, None if side is None else side[place]), np.int64).reshape(-1, 2)
        return nodes[found[:, 0]], nodes[found[:, 1]]

    def name(root, band, own):
        return f"{folder}/{root}_{band}_{own}.arrow"

    def searched(key, held):
        h, v, n = (np.concatenate(p) for p in zip(*held))
        a, b = links(h, v, n)
        empty = pa.nulls(len(a), pa.int64())
        yield batch(_FOUND, [a, b, empty, empty, pa.nulls(len(a), pa.int32())])
        if key[1] >= 0:
            def fill(out):
                with pa.ipc.new_stream(out, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                    w.write_batch(batch(_BLOCK, [h, v, n]))

            write_atomically(name(*key), fill)
            yield batch(_FOUND, [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *([k] for k in key)])

    def search(batches):
        held: list[list[np.ndarray]] = []
        last = None
        for b in batches:
            c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            key = np.stack(c[:3], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                this = tuple(key[x].tolist())
                if held and this != last:
                    yield from searched(last, held)
                    held = []
                last = this
                held.append([p[x:y] for p in c[3:]])
        if held:
            yield from searched(last, held)
        give_back()

    def read(key):
        fs, path = open_fs(name(*key))
        with fs.open_input_stream(path) as f, pa.ipc.open_stream(f) as r:
            return [c.to_numpy() for c in r.read_all().columns]

    def meet(batches):
        # pairs come by their first block, which is read once for them
        last, one = None, []
        for b in batches:
            for root, i_band, i, j_band, j in zip(*(c.to_pylist() for c in b.columns)):
                if last != (root, i_band, i):
                    last = root, i_band, i
                    one = read(last)
                two = read((root, j_band, j))
                side = np.repeat([0, 1], [len(one[0]), len(two[0])])
                yield batch(_LINK, list(links(*(np.concatenate(p) for p in zip(one, two)), side)))
        give_back()

    found = written(tasks.mapInArrow(search, "a long, b long, root long, band long, own int"), "jaccard-searched")
    pairs = written(_pairs(found.where("root is not null").select(*keys)), "jaccard-pairs")
    first = ["root", "i_band", "i"]
    dealt = pairs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *first, "j_band", "j").sortWithinPartitions(*first)
    met = written(dealt.select(*first, "j_band", "j").mapInArrow(meet, "a long, b long"), "jaccard-met")
    found = written(found.where("a is not null").select("a", "b").unionByName(met).unionByName(star), "jaccard-links")
    roots = components(found)
    classes = documents.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    linked = roots.join(classes, "node")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = roots.join(ids, "root").select("node", "component_id")
    named = classes.join(ids, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    out = documents.join(written(named, "jaccard-classes"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
