"""Operator 1: token ids as bit or byte planes.

A shard file holds the ids of some consecutive documents. Blocks of a fixed number of ids are
transposed into planes (plane k has byte k, or bit k, of every id), each plane is compressed with
zstandard, and an index of the chunks closes the file:

    b"VTPLANE1" | planes of chunk 0 | planes of chunk 1 | ... | footer (zstandard) | footer size u64 | b"VTPLANE1"

The footer is JSON: mode, block, the chunks (offset, ids, sizes of the planes), then the documents
(ids and lengths, as binary columns after the JSON). Any chunk can be read without the others.

Shards are cut by range of doc_id, so shard number and place in the shard give ascending order.
Empty and null texts give only the end id. Null doc_ids come last; equal doc_ids go by a hash of the text. Very long texts
are encoded whole, in one shard.
An empty table gives no shard and no row. Other columns of the input don't matter.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import batch, open_fs, shared_dir, table, typed, write_atomically
from veritab.llm.wordhash import Words, bounded, utf8

MAGIC = b"VTPLANE1"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, highest last; planes above the largest id are left out."""
    if mode == "byte":
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        n = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
        return [raw[:, k].tobytes() for k in range(n)]
    n = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    return [np.packbits(((ids >> k) & 1).astype(np.uint8)).tobytes() for k in range(n)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        part = np.frombuffer(p, np.uint8)
        if mode == "byte":
            out |= part.astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(part, count=n).astype(np.uint32) << np.uint32(k)
    return out


class PlaneWriter:
    """Takes the ids of one document after the other; holds at most one block of ids."""

    def __init__(self, out, mode: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.mode, self.block, self.at = out, mode, block, len(MAGIC)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.parts, self.held, self.chunks, self.docs, self.lengths = [], 0, [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            rest = np.concatenate(self.parts)
            while len(rest) >= self.block:
                self._chunk(rest[: self.block])
                rest = rest[self.block :]
            self.parts, self.held = [rest], len(rest)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.mode)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.parts))
        known = np.array([d is not None for d in self.docs], np.uint8).tobytes()
        docs = np.array([d or 0 for d in self.docs], "<i8").tobytes()
        head = json.dumps({"mode": self.mode, "block": self.block, "docs": len(self.docs), "chunks": self.chunks}).encode()
        footer = self.zstd.compress(struct.pack("<Q", len(head)) + head + known + docs + np.array(self.lengths, "<i8").tobytes())
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class PlaneReader:
    def __init__(self, file, size: int):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        file.seek(size - 16 - n)
        raw = self.zstd.decompress(file.read(n))
        k = 8 + struct.unpack("<Q", raw[:8])[0]
        head = json.loads(raw[8:k])
        n = head["docs"]
        self.mode, self.chunks = head["mode"], head["chunks"]
        known = np.frombuffer(raw, np.uint8, n, k)
        self.docs = [int(d) if ok else None for d, ok in zip(np.frombuffer(raw, "<i8", n, k + n), known)]
        self.lengths = np.frombuffer(raw, "<i8", n, k + 9 * n)

    def chunk(self, number: int) -> np.ndarray:
        at, n, sizes = self.chunks[number]
        self.file.seek(at)
        return from_planes([self.zstd.decompress(self.file.read(s)) for s in sizes], n, self.mode)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids); one chunk at a time, besides the parts of a document."""
        number, ids, at, start = 0, np.zeros(0, np.uint32), 0, 0
        for doc_id, n in zip(self.docs, self.lengths.tolist()):
            parts, need = [], n
            while need:
                if at == len(ids):
                    ids, at, number = self.chunk(number), 0, number + 1
                parts.append(ids[at : at + need])
                at += len(parts[-1])
                need -= len(parts[-1])
            yield doc_id, start, parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])
            start += n


_ENCODERS: dict = {}
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def led_pieces(column: pa.Array) -> Words:
    """Cuts texts, none of them empty, at each single space that has no white space beside it.

    First bytes that white space beyond ASCII shares with other characters count as white space: that only leaves a text uncut there.
    """
    data, offsets = utf8(column)
    n = len(data)
    white = np.ones(n + 6, bool)
    white[3:-3] = _WHITE[data]
    cut = data == 0x20
    cut &= ~(white[2 : n + 2] | white[4 : n + 4])
    if n > 3 and data.max() >= 0x80:
        lead = np.zeros(n + 6, bool)  # a character from here on may be white space of two or three bytes
        pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
        lead[3 : n + 2] = np.isin(pair, np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380], np.uint16))
        cut &= ~(lead[4 : n + 4] | lead[:n] | lead[1 : n + 1])
    cut[offsets[:-1]] = cut[offsets[1:] - 1] = False
    at = np.flatnonzero(cut)
    starts = np.sort(np.concatenate([offsets[:-1], at + 1]))
    first = np.searchsorted(starts, offsets)
    ends = np.append(starts[1:] - 1, n)
    ends[first[1:] - 1] = offsets[1:]
    return Words(data, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def same_bytes(w: Words, like: np.ndarray, at_once: int = 1 << 18) -> bool:
    """Has every piece the bytes of piece like[...]?"""
    size = w.ends - w.starts
    if not np.array_equal(size, size[like]):
        return False
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
        n = size[a:b]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(w.data[np.repeat(w.starts[a:b], n) + step], w.data[np.repeat(w.starts[like[a:b]], n) + step]):
            return False
        a = b
    return True


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library.

    Its pre-tokenizer always begins a new piece at a single space between two characters that aren't
    white space, so the ids of such a text are those of its space-led pieces in a row. Equal pieces of a slice are found
    by hash and checked byte by byte; pieces met before come from a table of bounded size; new ones are encoded many at a time,
    joined to one text, which the ids that begin with a space cut again. Texts with special tokens' strings are encoded whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer") and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.led = np.zeros(max(vocab.values()) + 1, bool)
        self.led[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """The table: hashes ascending; of each piece its place and size in keys, and the place and number of its ids in flat."""
        self.hashes = np.zeros(0, np.uint64)
        self.where = np.zeros((0, 4), np.int32)
        self.keys, self.flat = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _led_ids(self, pieces: list[bytes], at_once: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each with a space before it, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), at_once):
            some = b" " + b" ".join(pieces[k : k + at_once])
            n = min(at_once, len(pieces) - k)
            if some.count(b" ") == n:
                ids.append(self._raw([some.decode()])[0])
                cuts = np.flatnonzero(self.led[ids[-1]])
                if len(cuts) == n:
                    sizes.append(np.diff(cuts, append=len(ids[-1])))
                    continue
                ids.pop()
            each = self._raw([" " + p.decode() for p in pieces[k : k + at_once]])
            ids += each
            sizes.append(np.fromiter(map(len, each), np.int64, n))
        return np.concatenate(ids), np.concatenate(sizes)

    def _known(self, w: Words, h: np.ndarray, first: np.ndarray) -> np.ndarray | None:
        """Rows of the table for the pieces first[...] with ascending hashes h; learns new ones. None if a hash stands for two pieces."""
        at = np.searchsorted(self.hashes, h)
        met = np.zeros(len(h), bool)
        met[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] == h[at < len(self.hashes)]
        rows = self.where[at[met]]
        both = Words(np.concatenate([w.data, self.keys]), np.concatenate([w.starts[first[met]], len(w.data) + rows[:, 0]]), np.concatenate([w.ends[first[met]], len(w.data) + rows[:, 0] + rows[:, 1]]), w.doc, w.first)
        if not same_bytes(both, np.tile(np.arange(len(rows), 2 * len(rows)), 2)):
            return None
        del both
        fresh = first[~met]
        if len(fresh):
            if len(self.hashes) + len(fresh) > self.most or len(self.keys) > 32 * self.most or len(self.flat) > 32 * self.most:
                # start again with what this slice has
                self._forget()
                met[:] = False
                fresh = first
            starts, size = w.starts[fresh], w.ends[fresh] - w.starts[fresh]
            raw = w.data.tobytes()
            ids, count = self._led_ids([raw[i:j] for i, j in zip(starts.tolist(), (starts + size).tolist())])
            del raw
            places = np.stack([len(self.keys) + np.cumsum(size) - size, size, len(self.flat) + np.cumsum(count) - count, count], 1).astype(np.int32)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            self.keys = np.concatenate([self.keys, w.data[np.repeat(starts, size) + step]])
            self.flat = np.concatenate([self.flat, ids])
            merged = np.concatenate([self.hashes, h[~met]])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.where = merged[order], np.concatenate([self.where, places])[order]
        return self.where[np.searchsorted(self.hashes, h)]

    def _plain(self, texts: list[str]) -> list[np.ndarray] | None:
        """Ids of texts without special tokens' strings; none if a hash stands for two pieces."""
        w = led_pieces(pa.array(texts, pa.large_string()))
        h, first, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if not same_bytes(w, first[place]):
            return None
        led = np.ones(len(w.starts), bool)
        led[w.first[:-1]] = False
        used = np.zeros(len(h), bool)
        used[place[led]] = True
        rows = np.zeros((len(h), 4), np.int32)
        known = self._known(w, h[used], first[used])
        if known is None:
            return None
        rows[used] = known
        heads = self._raw([w.data[i:j].tobytes().decode() for i, j in zip(w.starts[w.first[:-1]].tolist(), w.ends[w.first[:-1]].tolist())])
        # ids of the table, then of the texts' first pieces, which have no space before them
        head_size = np.fromiter(map(len, heads), np.int64, len(heads))
        start, count = np.empty(len(led), np.int64), np.empty(len(led), np.int64)
        start[led], count[led] = rows[place[led], 2], rows[place[led], 3]
        start[~led], count[~led] = len(self.flat) + np.cumsum(head_size) - head_size, head_size
        ends = np.cumsum(count)
        ids = np.concatenate([self.flat, *heads])[np.repeat(start - ends + count, count) + np.arange(int(ends[-1]))]
        cuts = ends[w.first[1:] - 1].tolist()
        return [ids[i:j] for i, j in zip([0, *cuts], cuts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [np.zeros(0, "<u4")] * len(texts)
        plain, whole = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self.by_piece and not any(s in t for s in self.special) else whole).append(i)
        if plain:
            found = self._plain([texts[i] for i in plain])
            if found is None:
                whole += plain
            else:
                for i, ids in zip(plain, found):
                    out[i] = ids
        for i, ids in zip(whole, self._raw([texts[i] for i in whole])):
            out[i] = ids
        return out


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_SHARD = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())])


def write_token_planes(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, mode: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encodes `text` of all rows, ascending by doc_id, into shard files in `folder`; returns a row per shard."""
    ordered = typed(docs, doc_id="long", text="string").withColumn("tie", F.xxhash64("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, shard, end = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], "<u4")
        batches = bounded(batches)
        head = next(batches, None)
        if head is None:
            return
        n_docs = n_ids = 0

        def fill(out):
            nonlocal n_docs, n_ids
            w = PlaneWriter(out, mode, block)
            for b in ([head], batches):
                for x in b:
                    ids = x.column(0).to_pylist()
                    for doc_id, e in zip(ids, enc.encode([t or "" for t in x.column(1).to_pylist()])):
                        w.add(doc_id, np.concatenate([e, end]))
                        n_docs += 1
                        n_ids += len(e) + 1
            w.close()

        file = f"{folder}/shard-{shard:07d}.vtp"
        size = write_atomically(file, fill)
        yield batch(_SHARD, [[shard], [file], [n_docs], [n_ids], [size]])

    rows = ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long, bytes long")
    rows.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_planes(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads shard files: per document its place among all ids, number of ids and their crc32, and the ids if asked for."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", "file", "bytes", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    schema = _DOC.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _DOC

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, path = open_fs(r["file"])
                with fs.open_input_file(path) as f:
                    rows, held = [], 0
                    for doc_id, start, ids in PlaneReader(f, r["bytes"]).documents():
                        row = (doc_id, r["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        rows.append((*row, ids.tolist()) if with_ids else row)
                        held += len(ids) if with_ids else 1
                        if held >= (1 << 20 if with_ids else 10_000):
                            yield batch(schema, [list(c) for c in zip(*rows)])
                            rows, held = [], 0
                    if rows:
                        yield batch(schema, [list(c) for c in zip(*rows)])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_planes(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, mode: str = "byte", block: int = BLOCK) -> DataFrame:
    """Writes all documents and reads the files back; a row per document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_planes(write_token_planes(docs, shared_dir(docs.sparkSession, "token-planes"), tokenizer, end_id, mode, block))


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(table(spark, sf_dir, "documents"))
