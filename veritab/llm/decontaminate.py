"""Operator 5: benchmark decontamination with a generalised suffix automaton of the test items.

Test items and documents are lower-cased (A-Z) and cut to words of digits, letters and characters
beyond ASCII. The automaton of all items gives, at each word of a streamed document, the longest run
of words ending there that some item holds. A run of at least `window` words makes the last `window`
words of it a hit; an item with fewer words hits where it occurs whole.

Items are dealt to blocks of about `block_words` words, longer ones in overlapping pieces that keep every window. A task builds a block's automaton
and writes it to the shared folder; the driver only learns where it is. A document streams against one block after the
other, which tasks read one at a time, and its hits are the union.

Very long texts stream whole, and very long items are cut to overlapping pieces. Null or empty text: no words, no hit. Null item ids take part under the text "null". Items without
words take no part. Repeated items and item ids count once in the list of ids. Empty tables: an empty
benchmark hits nothing; no documents, no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import batch, open_fs, shared_dir, table, typed, write_atomically, written
from veritab.llm.wordhash import NOT_ALNUM, bounded, utf8

_TABLE = bytes(0x20 if NOT_ALNUM[i] else (i + 32 if 65 <= i <= 90 else i) for i in range(256))


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of several sequences of word numbers. States: next (word -> state), link, longest length; and for
    each state which items' windows end there."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        coded = [(number[i], [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.full: dict[int, set[int]] = {}  # state of a window of full size -> its items
        self.short: dict[int, set[int]] = {}  # state of a whole shorter item -> its items
        for k, ws in coded:
            v = 0
            for n, w in enumerate(ws, 1):
                v = self.next[v][w]
                if n >= window:
                    self.full.setdefault(self._shrunk(v), set()).add(k)
            if len(ws) < window:
                self.short.setdefault(v, set()).add(k)
        # the nearest state, itself or along the links, in which a short item ends
        self.ends = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.longest.__getitem__):
            self.ends[v] = v if v in self.short else self.ends[self.link[v]]
        self.least = min((window if len(ws) >= window else len(ws) for _, ws in coded), default=0)

    def _shrunk(self, v: int) -> int:
        """The state of the last `window` words of a longer match."""
        while self.longest[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.longest.append(self.longest[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, w, q)
        v = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.longest.append(self.longest[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[v] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, w, q)
        return v

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (start, end), ascending and apart, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[int] = set()
        if len(ws) < self.least or not self.least:
            return [], items
        # a word that no item has ends every match: only runs of known words of sufficient length are streamed
        codes = np.fromiter(map(self.vocabulary.get, ws, (-1,) * len(ws)), np.int64, len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]])))
        nexts, link, longest, window, ends = self.next, self.link, self.longest, self.window, self.ends
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.least:
                continue
            v = n = 0
            for i, w in enumerate(codes[a:b].tolist(), a + 1):
                while w not in nexts[v] and v:
                    v = link[v]
                    n = longest[v]
                if w in nexts[v]:
                    v = nexts[v][w]
                    n += 1
                size = 0
                if n >= window:
                    items |= self.full[self._shrunk(v)]
                    size = window
                s = ends[v]
                if s >= 0 and longest[s] > n:
                    s = ends[link[s]]
                while s > 0:
                    items |= self.short[s]
                    size = max(size, longest[s])
                    s = ends[link[s]]
                if size:
                    start = i - size
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = i
                    else:
                        spans.append([start, i])
        return [tuple(s) for s in spans], items


_PIECE = pa.schema([("item_id", pa.string()), ("piece", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])
_FILE = pa.schema([("block", pa.int64()), ("file", pa.string())])


def item_blocks(items: DataFrame, window: int, block_words: int) -> list[str]:
    """Files that hold the pickled automaton of each block of items."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = max(block_words, window)

    def pieces(batches):
        for b in bounded(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = item_words(t.encode())
                for k in range(0, max(1, len(ws) - window + 1) if ws else 0, size):
                    part = ws[k : k + size + window - 1]
                    out.append((i, k, b" ".join(part), len(part)))
            if out:
                yield batch(_PIECE, [list(c) for c in zip(*out)])

    cut = written(rows.mapInArrow(pieces, "item_id string, piece long, words binary, n long").distinct(), "item-pieces")
    blocks = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // block_words))
    folder = shared_dir(items.sparkSession, "item-automata")

    def build(key, t):
        n = key[0].as_py()
        automaton = SuffixAutomaton(sorted((r["item_id"], r["words"].split()) for r in t.to_pylist()), window)
        write_atomically(f"{folder}/block-{n:07d}", lambda out: pickle.dump(automaton, out, protocol=5))
        return pa.Table.from_batches([batch(_FILE, [[n], [f"{folder}/block-{n:07d}"]])])

    made = cut.groupBy(F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)).alias("block")).applyInArrow(build, "block long, file string")
    return [r.file for r in made.orderBy("block").collect()]


def _automaton(file: str, held: dict) -> SuffixAutomaton:
    """A block's automaton, read once a task."""
    if file not in held:
        fs, path = open_fs(file)
        with fs.open_input_stream(path) as f:
            held[file] = pickle.loads(f.read())
    return held[file]


_HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _stream(docs: DataFrame, block: str | None, window: int, only_hits: bool) -> DataFrame:
    def run(batches):
        a = _automaton(block, {}) if block else SuffixAutomaton([], window)
        for b in bounded(batches):
            data, offsets = utf8(b.column(2))
            raw, at = data.tobytes(), offsets.tolist()
            rows = []
            for row, doc_id, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at, at[1:]):
                ws = item_words(raw[i:j])
                spans, items = a.hits(ws)
                if items or not only_hits:
                    rows.append((row, doc_id, len(ws), [x for s in spans for x in s], [a.ids[k] for k in items]))
            if rows:
                yield batch(_HITS, [list(c) for c in zip(*rows)])

    return docs.mapInArrow(run, "row long, doc_id long, n_words long, spans array<long>, items array<string>")


def union_of_spans(flat: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.int64()))])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 100_000) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and the spans of hit words (start, end, start, ...)."""
    blocks = item_blocks(items, window, block_words) or [None]
    d = typed(docs, doc_id="long", text="string").select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    if len(blocks) > 1:
        d = written(d.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    hits = _stream(d, blocks[0], window, only_hits=False)
    if len(blocks) > 1:
        for b in blocks[1:]:
            hits = hits.unionByName(_stream(d, b, window, only_hits=True))
        hits = hits.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        hits = hits.select("row", "doc_id", "n_words", "spans", "items")

    def digest(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                spans, names = union_of_spans(r["spans"]), sorted(set(r["items"]))
                hit = sum(e - s for s, e in spans)
                rows.append((r["doc_id"], r["n_words"], hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, [x for s in spans for x in s]))
            if rows:
                yield batch(_DIGEST, [list(c) for c in zip(*rows)])

    return hits.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<long>")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    raw = text.encode()
    low, at, places = raw.translate(_TABLE), 0, []
    for w in low.split():
        i = low.index(w, at)
        places.append((i, i + len(w)))
        at = i + len(w)
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : places[s][0]])
        last = places[e - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5, block_words: int = 100_000) -> DataFrame:
    """Cuts hit spans out of the texts; a document with more than `coverage` of its words hit goes as a whole.

    Returns the input's columns. A text that is null or has no hit stays as it is.
    """
    blocks = item_blocks(items, window, block_words) or [None]
    fields = docs.schema
    place = fields.fieldNames().index("text")
    # found spans travel in a column of their own when there are several blocks
    extra = "spans_" + "_".join(fields.fieldNames())
    alone = len(blocks) == 1
    if not alone:
        row = "row_" + extra
        docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        d = docs.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hits = [_stream(d, b, window, only_hits=True) for b in blocks]
        for h in hits[1:]:
            hits[0] = hits[0].unionByName(h)
        found = hits[0].groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("spans")).alias(extra))
        docs = docs.join(found, row, "left").drop(row)

    def run(batches):
        automaton = (_automaton(blocks[0], {}) if blocks[0] else SuffixAutomaton([], window)) if alone else None
        for b in bounded(batches):
            keep, texts = [], []
            known = [None] * b.num_rows if alone else b.column(b.num_columns - 1).to_pylist()
            for t, spans in zip(b.column(place).to_pylist(), known):
                ws = item_words(t.encode()) if t else []
                spans = automaton.hits(ws)[0] if alone else union_of_spans(spans or [])
                hit = sum(e - s for s, e in spans)
                keep.append(hit <= coverage * len(ws))
                texts.append(without_spans(t, spans) if hit and keep[-1] else t)
            b = b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))
            yield b.select(fields.fieldNames()).filter(pa.array(keep))

    return docs.mapInArrow(run, fields)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
