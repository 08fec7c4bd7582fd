"""Operator 13: ranked lexical search over a tiered index, exact for every query item.

A document's score for an item is the sum of weight * part over the item's terms, where part = 1e9 tf div (1000 tf + 20 m) lies in the index and the
weight comes from how many documents have the term. All is integer arithmetic.

1. Index: documents are dealt to shards of about `postings` (document, term) pairs, and a shard is a row. Each of its terms has its
   postings by falling part, cut to three tiers (the best sixteenth, the next quarter, the rest; 16 postings at least stay together), with a residual per tier: the best
   part in the tiers below. Tiers are columns, so a round reads only those it needs. The documents' own terms are columns too.
2. A round adds up the tiers read so far: a document's low score, and a high one with the residuals of the terms not seen in it. Unseen documents have the
   sum of residuals. An item is proven when its `top` best low scores exceed what any document may have that isn't among at most `most` candidates;
   their exact scores are then read from the documents' terms.
3. Items without that proof fall through to the next tier. After the last one residuals are 0 and scores exact.

Items stand in blocks of about `block_words` words in the shared folder, which tasks read one at a time, so the number of items isn't bounded. A bitmap of
fixed size (8 MB) of the items' terms keeps most other terms out of the index; terms that it lets pass wrongly are only indexed in vain.

A document is a row: repeated rows are documents each. Null or empty texts have no terms, don't count and are never found. Null doc_id: last among equal scores.
Null item texts have no results; repeated items and null item_ids have results of their own. Very long texts are indexed whole. Empty tables: no rows. Other columns
don't matter.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import batch, open_fs, shared_dir, table, typed, write_atomically, written
from veritab.llm.decontaminate import item_words
from veritab.llm.running import running
from veritab.llm.wordhash import NOT_ALNUM, bounded, utf8

TIERS = 3
_BITS = 26


@dataclass
class Index:
    shards: DataFrame
    documents: int  # with at least one term
    words: int  # terms with repeats


# ---- statistics and index


def _place(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - _BITS)


def _item_terms(batches):
    """Each different term of an item once, with its place in the bitmap."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary()), ("place", pa.int64())])
    for rb in batches:
        found = [(i, t) for i, text in zip(rb.column("item").to_pylist(), rb.column("text").to_pylist()) for t in dict.fromkeys(item_words(text or b""))]
        yield batch(schema, [[i for i, _ in found], [t for _, t in found], [_place(t) for _, t in found]])


def bitmap(places: DataFrame) -> bytes:
    """A bit for each place that stands in the column "place": 8 MB, however many there are."""
    at = F.col("place") + 1
    parts = places.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((1 << (_BITS - 15), 4096), np.uint8)
    for r in parts.collect():  # at most 2,048 rows of 4 KB
        out[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _count_words(batches):
    schema = pa.schema([("documents", pa.int64()), ("words", pa.int64())])
    for rb in bounded(batches):
        data, offsets = utf8(rb.column(0))
        word = ~NOT_ALNUM[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = word[edges]
        upto = np.searchsorted(np.flatnonzero(begins), offsets)
        yield batch(schema, [[int((np.diff(upto) > 0).sum())], [int(upto[-1] - upto[0])]])


class _Shard:
    """Documents gathered for one row of the index."""

    SCHEMA = pa.schema(
        [("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("m", pa.binary()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32()))]
        + [(f"{c}{j}", pa.binary()) for j in range(TIERS) for c in ("at", "doc", "tf", "rest")]
        + [("doc_at", pa.binary()), ("doc_term", pa.binary()), ("doc_tf", pa.binary())]
    )

    def __init__(self):
        self.ids: list[int | None] = []
        self.m: list[int] = []
        self.number: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, m: int, counts: Iterable[tuple[bytes, int]]) -> None:
        before = len(self.term)
        for t, tf in counts:
            self.term.append(self.number.setdefault(t, len(self.number)))
            self.tf.append(tf)
        if len(self.term) > before:
            self.ids.append(doc_id)
            self.m.append(m)
            self.sizes.append(len(self.term) - before)

    def row(self, shard: int) -> pa.RecordBatch:
        term, tf, m = np.array(self.term, np.int32), np.array(self.tf, np.int64), np.array(self.m, np.int64)
        doc = np.repeat(np.arange(len(m), dtype=np.int32), self.sizes)
        part = parts(tf, m[doc])
        by = np.lexsort((doc, -part, term))
        df = np.bincount(term, minlength=len(self.number))
        at = np.concatenate([[0], np.cumsum(df)])
        rank = np.arange(len(by)) - np.repeat(at[:-1], df)
        ends = [np.minimum(df, np.maximum(16, df // 16)), np.minimum(df, np.maximum(32, df // 16 + df // 4)), df]
        columns: list = [[shard], [self.ids], [m.tobytes()], [list(self.number)], [df.astype(np.int32)]]
        begin = np.zeros_like(df)
        for end in ends:
            here = by[(rank >= np.repeat(begin, df)) & (rank < np.repeat(end, df))]
            rest = np.where(end < df, part[by[np.minimum(at[:-1] + end, len(by) - 1)]], 0)
            offsets = np.concatenate([[0], np.cumsum(end - begin)])
            columns += [[x.astype(np.int32).tobytes()] for x in (offsets, doc[here], tf[here], rest)]
            begin = end
        columns += [[x.astype(np.int32).tobytes()] for x in (np.concatenate([[0], np.cumsum(self.sizes)]), term, tf)]
        return batch(self.SCHEMA, columns)


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def build_index(docs: DataFrame, terms: DataFrame | None = None, postings: int = 1_000_000) -> Index:
    """docs: doc_id, text. terms: their column "place" tells which terms to index; None: all."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    n = d.select("text").mapInArrow(_count_words, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
    documents, words = n[0] or 0, n[1] or 0
    bits = spark.sparkContext.broadcast(bitmap(terms) if terms is not None else b"")

    def run(batches):
        asked, known, shard, number = bits.value, {}, _Shard(), TaskContext.get().partitionId() << 32
        for rb in bounded(batches):
            for doc_id, text in zip(rb.column("doc_id").to_pylist(), rb.column("text")):
                counts = Counter(item_words(text.as_py() or b""))
                if not counts:
                    continue
                if asked:
                    if len(known) > 1_000_000:
                        known.clear()
                    for t in counts:
                        if t not in known:
                            p = _place(t)
                            known[t] = asked[p >> 3] >> (p & 7) & 1
                m = 50 + 50 * counts.total() * documents // words
                shard.add(doc_id, m, ((t, tf) for t, tf in counts.items() if not asked or known[t]))
                if len(shard.term) >= postings:
                    yield shard.row(number)
                    shard, number = _Shard(), number + 1
        if shard.term:
            yield shard.row(number)

    # 32-bit numbers as bytes
    tiers = ", ".join(f"{c}{j} binary" for j in range(TIERS) for c in ("at", "doc", "tf", "rest"))
    kinds = f"shard long, doc_ids array<long>, m binary, terms array<binary>, df array<int>, {tiers}, doc_at binary, doc_term binary, doc_tf binary"
    return Index(written(d.mapInArrow(run, kinds), "tiered-index"), documents, words)


# ---- items


def _weighted(index: Index, terms: DataFrame) -> DataFrame:
    """item, term, weight of the terms that some document has."""
    df = index.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    df = terms.select("term").distinct().join(df, "term")
    n = F.lit(index.documents)
    weight = F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    return terms.select("item", "term").join(df.select("term", weight.alias("weight")), "term").where("weight > 0")


def _blocks(items: DataFrame, folder: str, block_words: int) -> DataFrame:
    """block, path: files of items with their weighted terms. A block ends with the item that fills it."""
    n = items.groupBy("item").agg(F.count("*").alias("upto")).withColumn("one", F.lit(0).cast("long"))
    n = running(n, ["one"], [F.col("item").asc()], {"upto": "add"}).select("item", F.floor(F.col("upto") / block_words).alias("block"))

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by([("item", "ascending"), ("term", "ascending")])
        item = t.column("item").to_numpy()
        block = t.column("block")[0].as_py()
        names, term = np.unique(np.array(t.column("term").to_pylist(), object), return_inverse=True)
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        path = f"{folder}/items-{block}"
        content = {"items": item[first], "at": np.append(first, len(item)), "terms": list(names), "term": term, "weight": t.column("weight").to_numpy()}
        content |= {"least": np.zeros(len(first), np.int64)}
        write_atomically(path, lambda out: out.write(pickle.dumps(content)))
        return pa.table({"block": [block], "path": [path]})

    return items.join(n, "item").groupBy("block").applyInArrow(write, "block long, path string")


def _read(path: str) -> dict:
    fs, p = open_fs(path)
    with fs.open_input_stream(p) as f:
        return pickle.loads(f.read())


# ---- search


def _ints(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.int32)


_FOUND = pa.schema([("block", pa.int64()), ("item", pa.int64()), ("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_FOUND_DDL = "block long, item long, shard long, place long, doc_id long, low long, high long"


def _best(score: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The n of `among` with the largest scores, and all that equal the last of these."""
    if len(among) <= n:
        return among
    s = score[among]
    return among[s >= np.partition(s, len(s) - n)[len(s) - n]]


def _search(blocks: list[tuple[int, str]], tier: int, top: int, most: int):
    """A round over the tiers up to `tier`. Rows of place -1 tell what documents that aren't listed may have at most."""
    last = tier == TIERS - 1

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}  # the best low scores of an item in this task
        at_path, b = "", {}
        for rb in batches:
            for k in range(rb.num_rows):
                row = {c: rb.column(c)[k] for c in rb.schema.names}
                m, ids = np.frombuffer(row["m"].as_py(), np.int64), row["doc_ids"].as_py()
                order = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
                number = {t: i for i, t in enumerate(row["terms"].as_py())}
                tiers = []
                for j in range(tier + 1):
                    at, doc = _ints(row[f"at{j}"]), _ints(row[f"doc{j}"])
                    tiers.append((at, doc, parts(_ints(row[f"tf{j}"]).astype(np.int64), m[doc])))
                rest = _ints(row[f"rest{tier}"]).astype(np.int64)
                for block, path in blocks:
                    if path != at_path:
                        at_path, b = path, _read(path)
                    if len(held) > 100_000:
                        held.clear()
                    here = np.array([number.get(t, -1) for t in b["terms"]], np.int64)
                    out: list[tuple] = []
                    for i, item in enumerate(b["items"].tolist()):
                        if b["least"][i] < 0:
                            continue
                        span = slice(b["at"][i], b["at"][i + 1])
                        term, weight = here[b["term"][span]], b["weight"][span]
                        term, weight = term[term >= 0], weight[term >= 0]
                        low, seen, possible = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), int((weight * rest[term]).sum())
                        for t, w in zip(term.tolist(), weight.tolist()):
                            r = w * int(rest[t])
                            for at, doc, part in tiers:
                                d = doc[at[t] : at[t + 1]]
                                low[d] += w * part[at[t] : at[t + 1]]
                                if r:
                                    seen[d] += r
                        high = low + (possible - seen)
                        best = _best(low, np.flatnonzero(low), top)[: 4 * top]
                        known = np.sort(np.concatenate([held.get((block, i), np.zeros(0, np.int64)), low[best]]))[-top:]
                        held[block, i] = known
                        least = max(int(b["least"][i]), int(known[0]) if len(known) == top else 0)
                        open_ = np.flatnonzero(high >= max(least, 1))
                        if last:
                            chosen = open_[np.lexsort((order[open_], -low[open_]))][:top]
                        elif len(open_) <= most:
                            chosen = open_
                        else:
                            chosen = np.union1d(best[: 2 * top], _best(high, open_, top)[: 2 * top])
                        left = 0
                        if not last and len(chosen) < len(open_):
                            high[chosen] = -1
                            left = int(high.max())
                        out += [(block, item, row["shard"].as_py(), int(p), ids[p], int(low[p]), int(low[p] if last else high[p] if high[p] >= 0 else low[p] + possible - seen[p])) for p in chosen]
                        if left:
                            out.append((block, item, None, -1, None, 0, left))
                    yield batch(_FOUND, [list(c) for c in zip(*out)] if out else [[]] * len(_FOUND))

    return run


def _exact(candidates: list[str]):
    """Exact scores of candidates, from the terms of their documents."""

    def run(batches):
        for rb in batches:
            for k in range(rb.num_rows):
                shard, m, ids = rb.column("shard")[k].as_py(), np.frombuffer(rb.column("m")[k].as_py(), np.int64), rb.column("doc_ids")[k]
                at, terms, tf = (_ints(rb.column(c)[k]) for c in ("doc_at", "doc_term", "doc_tf"))
                number = None
                for path in candidates:
                    c = _read(path)
                    mine = c["here"].get(shard, [])
                    if mine and number is None:
                        number = {t: i for i, t in enumerate(rb.column("terms")[k].as_py())}
                    b, out = _read(c["block"]) if mine else None, []
                    for item, place in mine:
                        i = int(np.searchsorted(b["items"], item))
                        span = slice(b["at"][i], b["at"][i + 1])
                        weight = {number[t]: w for x, w in zip(b["term"][span].tolist(), b["weight"][span].tolist()) if (t := b["terms"][x]) in number}
                        own = slice(at[place], at[place + 1])
                        part = parts(tf[own].astype(np.int64), m[place])
                        score = sum(weight[t] * p for t, p in zip(terms[own].tolist(), part.tolist()) if t in weight)
                        out.append((0, item, shard, place, ids[place].as_py(), score, score))
                    yield batch(_FOUND, [list(x) for x in zip(*out)] if out else [[]] * len(_FOUND))

    return run


def tiered_search(index: Index, terms: DataFrame, top: int = 50, most: int = 200, block_words: int = 300_000) -> DataFrame:
    """item, rank, doc_id, score: each item's `top` documents. terms: item, term, place."""
    shards = index.shards
    folder = shared_dir(shards.sparkSession, "tiered-items")
    blocks = [(r.block, r.path) for r in written(_blocks(_weighted(index, terms), folder, block_words), "blocks").collect()]  # a row per block
    results = None
    for tier in range(TIERS):
        if not blocks:
            break
        columns = ["shard", "doc_ids", "m", "terms", *(f"{c}{j}" for j in range(tier + 1) for c in ("at", "doc", "tf")), f"rest{tier}"]
        found = written(shards.select(columns).mapInArrow(_search(blocks, tier, top, most), _FOUND_DDL), f"tier-{tier}")
        if tier == TIERS - 1:
            exact = found
        else:
            paths = dict(blocks)
            after = written(_decided(found, paths, f"{folder}/round-{tier}", top, most), f"decided-{tier}").collect()  # a row per block
            blocks = [(r.block, r.path) for r in after if r.path]
            if not (candidates := [r.candidates for r in after if r.candidates]):
                continue
            forward = shards.select("shard", "doc_ids", "m", "terms", "doc_at", "doc_term", "doc_tf")
            exact = written(forward.mapInArrow(_exact(candidates), _FOUND_DDL), f"exact-{tier}")
        results = exact if results is None else results.unionByName(exact)
    if results is None:
        return shards.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    scored = results.where("low > 0").select("item", "doc_id", F.col("low").alias("score"))
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def _decided(found: DataFrame, paths: dict[int, str], folder: str, top: int, most: int) -> DataFrame:
    """Which items are proven: writes each block's open items with the score that a document must reach, and the candidates of its proven ones.

    Gives block, path (null: no item is open), candidates (null: none is proven).
    """
    ranked = Window.partitionBy("item").orderBy(F.col("low").desc())
    best = found.where("low > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    best = best.groupBy("item").agg(F.when(F.count("*") == top, F.min("low")).otherwise(0).alias("least"))
    left = found.groupBy("block", "item").agg(F.max(F.when(F.col("place") < 0, F.col("high"))).alias("left"))
    items = left.join(best, "item", "left").select("block", "item", F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("left", F.lit(0)).alias("left"))
    listed = found.where("place >= 0").join(items.select("item", "least"), "item").where("high >= least")
    counts = listed.groupBy("item").agg(F.count("*").alias("n"))
    items = items.join(counts, "item", "left").withColumn("proven", (F.col("least") > F.col("left")) & (F.coalesce("n", F.lit(0)) <= most))
    kept = listed.join(items.where("proven").select("item"), "item", "left_semi")
    rows = items.select("block", "item", "least", "proven", F.lit(None).cast("long").alias("shard"), F.lit(-1).cast("long").alias("place"))
    rows = rows.unionByName(kept.select("block", "item", "least", F.lit(True).alias("proven"), "shard", "place"))

    def write(t: pa.Table) -> pa.Table:
        block, rows = t.column("block")[0].as_py(), t.to_pylist()
        b = _read(paths[block])
        state = {r["item"]: -1 if r["proven"] else r["least"] for r in rows if r["place"] < 0}
        b["least"] = np.where(b["least"] < 0, -1, [state.get(i, 0) for i in b["items"].tolist()])
        here: dict[int, list] = {}
        for r in rows:
            if r["place"] >= 0:
                here.setdefault(r["shard"], []).append((r["item"], r["place"]))
        path = f"{folder}-{block}" if (b["least"] >= 0).any() else None
        if path:
            write_atomically(path, lambda out: out.write(pickle.dumps(b)))
        candidates = f"{folder}-{block}-candidates" if here else None
        if candidates:
            write_atomically(candidates, lambda out: out.write(pickle.dumps({"block": paths[block], "here": here})))
        return pa.table({"block": [block], "path": pa.array([path], pa.string()), "candidates": pa.array([candidates], pa.string())})

    return rows.groupBy("block").applyInArrow(write, "block long, path string, candidates string")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50, postings: int = 1_000_000, most: int = 200, block_words: int = 300_000) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each row of items (item_id, text) with the highest scores above 0."""
    numbered = written(items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"), F.monotonically_increasing_id().alias("item")), "items")
    terms = written(numbered.select("item", "text").mapInArrow(_item_terms, "item long, term binary, place long"), "item-terms")
    index = build_index(docs, terms, postings)
    return tiered_search(index, terms, top, most, block_words).join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
p AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS size, unnest(ws) AS term FROM d),
f AS (SELECT r, doc_id, size, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, s.n),
u AS (SELECT i, item_id, unnest(ts) AS term FROM q),
x AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * size * s.n) // s.l))))) AS BIGINT) AS score
      FROM u JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM y WHERE rank <= 50
"""
