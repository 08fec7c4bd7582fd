"""Operator 8: substring deduplication with compressed FM-indexes over shards.

A word is removed if a window of `window` words over it also starts in a document with a smaller doc_id.

1. A window's key is the smallest hash of its runs of `seed` words, so equal windows have equal keys. Neighbouring windows of
   one key make a stretch, and a stretch's content is its words. Each content is gathered with its first and its last document.
2. Contents of keys that have several, and contents of several documents, are dealt to shards by key. A shard has an FM-index
   (suffix array order, BWT in a wavelet matrix of packed bits with counts, sampled nowhere as no text place is asked for); its contents stream
   through backward search, all side by side, and the matching range, held at `window` words, tells the smallest document: for each window of a content, whether it
   stands in a document before the content's first one, and whether before its later ones.
3. Keys with more than `most` contents (an edge of a passage that very many documents share) would make a shard too large.
   Their windows are spread by hash and aggregated one by one instead.
4. Removed intervals are gathered per document and cut out.

Very long texts are cut whole. Null and empty texts have no words. Null doc_id counts as larger than all, and doesn't remove from other null ones. Rows of one doc_id don't
remove from each other. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import batch, table, written
from veritab.llm.wordhash import bounded, give_back, mix, utf8, words

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_STRETCH = 64  # windows in a stretch at most
_LAST = (1 << 63) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    out, done = x, 1
    while done * 2 <= width:
        out, done = np.minimum(out[: len(out) - done], out[done:]), done * 2
    return np.minimum(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1])


def stretches(h: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, key, content, place in the text, windows) of all stretches of a batch; h: hashes of its words."""
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    g = np.zeros(len(h) - seed + 1, np.uint64)
    for k in range(seed):
        g = g * _STEP + h[k : len(h) - seed + 1 + k]
    key = _sliding_min(mix(g), window - seed + 1)
    fine = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(fine):
        return none, none, none, none, none
    k = key[fine]
    new = np.ones(len(fine), bool)
    new[1:] = (k[1:] != k[:-1]) | (np.diff(fine) != 1) | (doc[fine][1:] != doc[fine][:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(fine)))
    # long stretches (of one key, in repeating text) are cut
    pieces = -(-count // _STRETCH)
    head = np.repeat(head, pieces) + _STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.diff(np.append(head, len(fine)))
    start = fine[head]
    end = start + count + window - 1
    powers = np.full(len(h) + 1, _STEP, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(len(h) + 1, pow(int(_STEP), -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:-1], out=total[1:])
    content = mix((total[end] - total[start]) * back[start] + count.astype(np.uint64))
    d = doc[start]
    return d, k[head].view(np.int64), content.view(np.int64), start - first[d], count


class WaveletMatrix:
    """Ranks over a sequence of numbers: a packed bit and a running count per level, highest bit first."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.bits, self.counts, self.zeros = levels, [], [], []
        for b in range(levels - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(np.uint8)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            w = packed.view("<u8")
            self.bits.append(w)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)[:-1]]).astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.base = None

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before place i, plus a number that depends on c alone."""
        for level in range(self.levels):
            w = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][w] + np.bitwise_count(self.bits[level][w] & below)
            one = (c >> (self.levels - 1 - level)) & 1
            i = np.where(one == 1, self.zeros[level] + ones, i - ones).astype(np.int64)
        return i


class FmIndex:
    """Of texts of word numbers from 1, each closed by 0; good for patterns of up to `longest` words."""

    def __init__(self, text: np.ndarray, longest: int):
        n = len(text)
        self.ranks = [text.astype(np.int64)]
        for k in range(longest.bit_length()):
            r = self.ranks[-1]
            nxt = np.zeros(n, np.int64)
            if n > 1 << k:
                nxt[: n - (1 << k)] = r[1 << k :] + 1
            self.ranks.append(np.unique(r * (nxt.max() + 1) + nxt, return_inverse=True)[1])
        self.sa = np.argsort(self.ranks[-1], kind="stable")
        bwt = text[self.sa - 1].astype(np.int64)
        self.levels = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(bwt, self.levels)
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))[:-1]])
        symbols = np.arange(1 << self.levels)
        # place of a symbol's first suffix, less what rank() adds
        self.first = before - self.wavelet.rank(symbols, np.zeros(len(symbols), np.int64))

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: ranges of c followed by what the ranges stand for."""
        both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low, high])) + np.concatenate([self.first[c]] * 2)
        return both[: len(c)], both[len(c) :]

    def common(self) -> np.ndarray:
        """Words, up to `longest` at least, that each suffix shares with the one before it in order."""
        a, b = self.sa[:-1], self.sa[1:]
        n, out = len(self.sa), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            x, y = a + out, b + out
            same = (x < n) & (y < n)
            same[same] = self.ranks[k][x[same]] == self.ranks[k][y[same]]
            out += same << k
        return np.concatenate([[0], out])


def earlier_windows(contents: list[np.ndarray], docs: np.ndarray, last: np.ndarray, window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each content (word codes) the window places whose words also stand in a content with a smaller document than docs, and how many do with a smaller than last."""
    sizes = np.array([len(c) for c in contents])
    codes = np.unique(np.concatenate(contents), return_inverse=True)[1] + 1
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = codes
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    index = FmIndex(text, window)
    common = index.common()
    # suffixes that share window - 1 words, and window words, stand side by side: a group's bounds and smallest document
    group = np.cumsum(common < window - 1) - 1
    low_of = np.flatnonzero(common < window - 1)
    high_of = np.append(low_of[1:], len(text))
    same = np.flatnonzero(common < window)
    smallest = np.minimum.reduceat(docs[owner[index.sa]], same)
    window_group = np.cumsum(common < window) - 1
    at = ends - 1
    low, high = np.zeros(len(contents), np.int64), np.full(len(contents), len(text))
    length, lane, start = np.zeros(len(contents), np.int64), np.arange(len(contents)), ends - sizes
    found: list[list[np.ndarray]] = [[], []]
    later = np.zeros(len(contents), np.int64)
    while len(lane):
        low, high = index.extend(text[at], low, high)
        length = length + 1
        full = np.flatnonzero(length == window)
        if len(full):
            first = smallest[window_group[low[full]]]
            later[lane[full]] += first < last[lane[full]]
            hit = full[first < docs[lane[full]]]
            found[0].append(lane[hit])
            found[1].append(at[hit] - start[hit])
            # let go of the last word
            g = group[low[full]]
            low[full], high[full], length[full] = low_of[g], high_of[g], window - 1
        at = at - 1
        go = at >= start
        if not go.all():
            lane, at, low, high, length, start = lane[go], at[go], low[go], high[go], length[go], start[go]
    lanes = np.concatenate([*found[0], np.zeros(0, np.int64)]).astype(np.int64)
    places = np.concatenate([*found[1], np.zeros(0, np.int64)]).astype(np.int64)
    order = np.lexsort((places, lanes))
    return np.split(places[order], np.searchsorted(lanes[order], np.arange(1, len(contents)))), later


_RUN = pa.schema([("uid", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("content", pa.int64()), ("place", pa.int32()), ("n", pa.int32())])
_RUN_SQL = "uid long, doc long, key long, content long, place int, n int"
_PART = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("hot", pa.bool_()), ("words", pa.binary())])
_PART_SQL = "key long, content long, doc long, last long, hot boolean, words binary"
#: places: of the first document's windows that go; whole: whether all windows of later documents go
_PLACES = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("first", pa.int64()), ("whole", pa.bool_()), ("places", pa.list_(pa.int32()))])
_PLACES_SQL = "key long, content long, first long, whole boolean, places array<int>"
_WINDOW = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])


def _found_in_shards(parts: DataFrame, window: int, shards: int) -> DataFrame:
    def run(_key, t):
        contents = [np.frombuffer(w, "<u4") for w in t["words"].to_pylist()]
        key, docs = t["key"].to_numpy(), t["doc"].to_numpy()
        found, later = earlier_windows(contents, docs, t["last"].to_numpy(), window)
        whole = later == np.array([len(c) for c in contents]) - window + 1
        keep = [i for i, f in enumerate(found) if len(f) or whole[i]]
        columns = [key[keep], t["content"].to_numpy()[keep], docs[keep], whole[keep], [found[i].tolist() for i in keep]]
        give_back()
        return pa.Table.from_batches([batch(_PLACES, columns)])

    dealt = parts.where("not hot").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, _PLACES_SQL)


def _found_by_window(parts: DataFrame, window: int) -> DataFrame:
    """The same for keys with very many contents: one row per window, dealt by the window's own hash."""

    def cut(batches):
        for b in batches:
            for key, content, doc, _, _, raw in zip(*(c.to_pylist() for c in b.columns)):
                c = np.frombuffer(raw, "<u4").astype(np.uint64)
                n = len(c) - window + 1
                h1 = h2 = np.zeros(n, np.uint64)
                for k in range(window):
                    h1 = h1 * _STEP + mix(c[k : k + n])
                    h2 = h2 * np.uint64(0x9E3779B97F4A7C15) + mix(c[k : k + n] + np.uint64(1 << 40))
                yield batch(_WINDOW, [np.full(n, key), np.full(n, content), np.full(n, doc), np.arange(n), mix(h1).view(np.int64), mix(h2).view(np.int64)])

    hot = parts.where("hot")
    rows = hot.mapInArrow(cut, "key long, content long, doc long, place int, h1 long, h2 long")
    first = rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("times")).where("times > 1").select("h1", "h2", "first")
    found = rows.join(first, ["h1", "h2"]).where("first < doc")
    places = found.groupBy("key", "content").agg(F.sort_array(F.collect_list("place")).alias("places"))
    # later documents of a content have all its windows in its first one
    every = hot.select("key", "content", F.col("doc").alias("first"), (F.col("last") > F.col("doc")).alias("whole"))
    return every.join(places, ["key", "content"], "left").where("whole or places is not null")


def repeated_spans(docs: DataFrame, window: int = 50, seed: int = 8, most: int = 5_000, shard_contents: int = 4_000) -> DataFrame:
    """(uid, spans): removed word intervals (start, end, start, ...) by row; uid is the hash of doc_id and text. docs: uid, doc_id, text."""
    if not 1 <= seed <= window:
        raise ValueError("a window has at least as many words as a seed, and that at least one")
    numbered = docs.select("uid", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text")

    def runs_of(batches):
        for b in bounded(batches):
            w = words(b.column(2))
            h = w.hashes()
            d, key, content, place, n = stretches(h, w.doc, w.first, window, seed)
            uid, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield batch(_RUN, [uid[d], doc[d], key, content, place, n])

    runs = written(numbered.mapInArrow(runs_of, _RUN_SQL), "substring-runs")
    contents = runs.groupBy("key", "content").agg(F.min(F.struct("doc", "uid", "place", "n")).alias("first"), F.max("doc").alias("last"))
    contents = written(contents, "substring-contents")
    keys = contents.groupBy("key").agg(F.count("*").alias("contents"), F.min("first.doc").alias("least"), F.max("first.doc").alias("greatest"))
    keys = keys.where("contents > 1 and least < greatest").select("key", (F.col("contents") > most).alias("hot"))
    several = F.col("last") > F.col("first.doc")
    asked = contents.join(keys, "key", "left").where(F.col("hot").isNotNull() | several).select("key", "content", F.coalesce("hot", F.lit(False)).alias("hot"), "first", "last")
    asked = written(asked, "substring-asked")
    n_asked = asked.count()
    if not n_asked:
        found = docs.sparkSession.createDataFrame([], _PLACES_SQL)
    else:
        by_doc = asked.groupBy(F.col("first.uid").alias("uid"), F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct("key", "content", "hot", "last", F.col("first.place").alias("place"), F.col("first.n").alias("n"))).alias("asked"))
        # equal rows are one text
        texts = docs.select("uid", "text").join(by_doc, "uid")

        def words_of(batches):
            seen: set[int] = set()
            for b in bounded(batches):
                c = {f: b.column(k) for k, f in enumerate(b.schema.names)}
                w = words(c["text"])
                h = (w.hashes() >> np.uint64(32)).astype("<u4")
                rows = []
                for i, (uid, doc, some) in enumerate(zip(c["uid"].to_pylist(), c["doc"].to_pylist(), c["asked"].to_pylist())):
                    if uid in seen:
                        continue
                    seen.add(uid)
                    for s in some:
                        a = w.first[i] + s["place"]
                        rows.append((s["key"], s["content"], doc, s["last"], s["hot"], h[a : a + s["n"] + window - 1].tobytes()))
                if rows:
                    yield batch(_PART, [list(x) for x in zip(*rows)])

        parts = written(texts.mapInArrow(words_of, _PART_SQL), "substring-parts")
        found = _found_in_shards(parts, window, max(1, -(-n_asked // shard_contents)))
        found = written(found.unionByName(_found_by_window(parts, window)), "substring-found")
    # a later document's stretch goes as a whole, of a first one what the index found
    hit = runs.join(found, ["key", "content"])
    after = F.col("whole") & (F.col("doc") > F.col("first"))
    spans = F.when(after, F.array(F.struct(F.col("place").alias("s"), (F.col("place") + F.col("n") + window - 1).alias("e")))).otherwise(F.transform("places", lambda p: F.struct((F.col("place") + p).alias("s"), (F.col("place") + p + window).alias("e"))))
    return hit.select("uid", F.explode(spans).alias("x")).select("uid", "x.s", "x.e").distinct().groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def without_repeats(docs: DataFrame, window: int = 50, seed: int = 8, most: int = 5_000, shard_contents: int = 4_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans of every document; the kept words too, if asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(d, window, seed, most, shard_contents)
    schema = _DONE.append(pa.field("text", pa.string())) if with_text else _DONE

    def cut(batches):
        for b in bounded(batches):
            c = {f: b.column(k) for k, f in enumerate(b.schema.names)}
            data, offsets = utf8(c["text"])
            raw, at = data.tobytes(), offsets.tolist()
            rows = []
            for doc_id, found, i, j in zip(c["doc_id"].to_pylist(), c["spans"].to_pylist(), at, at[1:]):
                ws = raw[i:j].split()
                kept, out, last = [], [], 0
                for s in found or ():
                    a, e = s["s"], s["e"]
                    if out and a <= out[-1]:
                        out[-1] = max(out[-1], e)
                    else:
                        out += [a, e]
                for a, e in zip(out[::2], out[1::2]):
                    kept += ws[last:a]
                    last = e
                kept += ws[last:]
                whole = b" ".join(kept)
                row = (doc_id, len(ws), len(ws) - len(kept), hashlib.sha256(whole).hexdigest(), out)
                rows.append((*row, whole.decode()) if with_text else row)
            yield batch(schema, [list(x) for x in zip(*rows)])

    both = d.join(spans, "uid", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>" + ", text string" * with_text)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS c FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
