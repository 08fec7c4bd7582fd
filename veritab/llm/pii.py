"""Operator 2: personal data by patterns, and by bootstrapped contextual extraction.

Base entities (email, ip, card, phone) come from fixed patterns with checks; they are the seeds. Candidates are what is written
in a usual form of an identifier (grouped digits, obfuscated addresses, IPv6) and isn't a seed. Every occurrence of a seed or a candidate has
lexical patterns: the one, two and three tokens before it, the one and two after it (tokens are runs of letters and digits, or
one other character, so that glued text makes no difference), its form (digits as 0, letters as a), and two tokens with the form.

Patterns that at least `support` different instances have make, with the instances, a graph, which Spark scores in rounds. A pattern is as good as
the share of all places it stands in that hold good instances; all texts are counted for that, so an ordinary word is no
pattern. A seed is good; a candidate is as good as its patterns together, where the pattern in question doesn't speak for
itself. A pattern counts when at least `support` good instances have it: seeds, or candidates accepted in a round before.
Candidates with a counting pattern of at least `confident` are found, under the pattern's kind; of overlapping ones the surest, then the longest. Base spans stay as they are.

A candidate has at most five groups of digits with 8 to 19 digits together, or is an address whose host follows a name of at most five parts of 64
characters (325 with the dots between them). The bitmap of patterns has 2**26 places; what it lets pass wrongly is only counted in vain.

Spans are in code points, end exclusive. Null and empty texts have none. Repeated rows get the same spans each. Null
doc_id is kept. An empty table gives no rows. Other columns don't matter. Texts of any length take linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import batch, table, written
from veritab.llm.wordhash import Words, bounded, mix, utf8

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can begin only where a run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), ascending."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- candidates -------------------------------------------------------------------------------------------------

_STRETCH = re.compile(r"\+?[(\[]?[0-9](?:[\x20.()\[\]/\u2010-\u2015-]{0,3}[0-9])+")
_TOKEN = re.compile(r"[^\x20]+")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
_B = r"[\x20\t]{0,3}"
_AT = re.compile(rf"{_B}(?:[\[({{<]{_B}(?:at|@){_B}[\])}}>]|@){_B}|[\x20\t]{{1,3}}at[\x20\t]{{1,3}}", re.IGNORECASE)
_DOT = rf"(?:\.|[\x20\t]{{1,3}}(?:dot|\.)[\x20\t]{{1,3}}|{_B}[\[({{<]{_B}(?:dot|\.){_B}[\])}}>]{_B})"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,6}}{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.IGNORECASE)
_LONE = re.compile(r"[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-])")  # after a marked at, the host can be one name
_NAME = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,4}}\Z", re.IGNORECASE)
_MOST_GROUPS = 5  # of digits in a number as it is usually written


def _numbers(text: str):
    """(start, end, digits) of runs of up to five groups that have 8 to 19 digits together."""
    for m in _STRETCH.finditer(text):
        if m.end() - m.start() < 8:
            continue
        groups = [(t.start() + m.start(), t.end() + m.start(), sum("0" <= c <= "9" for c in t[0])) for t in _TOKEN.finditer(m[0])]
        for i, (a, _, _) in enumerate(groups):
            digits = 0
            for _, e, n in groups[i : i + _MOST_GROUPS]:
                digits += n
                if digits > 19:
                    break
                if digits >= 8:
                    s = a
                    while text[s] in "([" and text.count(")", s, e) + text.count("]", s, e) < text.count("(", s, e) + text.count("[", s, e):
                        s += 1
                    while text[e - 1] in ")].-/" or "\u2010" <= text[e - 1] <= "\u2015":
                        e -= 1
                    if not (s and (text[s - 1].isalnum() or text[s - 1] in "+.") or text[e : e + 1].isalnum()):
                        yield s, e, digits


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what looks like an identifier and touches no base span."""
    out = []
    if "@" in text or " at " in text or "(at)" in text.lower() or "[at]" in text.lower():
        for m in _AT.finditer(text):
            host = _HOST.match(text, m.end()) or (_LONE.match(text, m.end()) if m[0].strip().lower() != "at" else None)
            name = host and _NAME.search(text[max(0, m.start() - 325) : m.start()])
            if name:
                out.append((m.start() - len(name[0]), 0, host.end()))
    if text.count(":") >= 3:
        out += ((m.start(), 1, m.end()) for m in _IPV6.finditer(text) if m[0].count(":") == 7 or "::" in m[0])
    if _DIGIT.search(text):
        for a, e, digits in _numbers(text):
            if digits >= 12:
                out.append((a, 2, e))
            if digits <= 15:
                out.append((a, 3, e))
    if out and spans:
        starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
        out = [c for c in out if not (k := bisect_left(starts, c[2])) or ends[k - 1] <= c[0]]
    return sorted(set(out))


def form(kind: int, found: str) -> str:
    """Digits as 0 (in an address: runs of them), runs of letters as a."""
    if kind < 2:
        return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9A-Fa-f]+" if kind else r"[0-9]+", "0", found))
    return re.sub(r"[0-9]", "0", found)


# --- lexical patterns --------------------------------------------------------------------------------------------

_CLASS = np.array([0 if i in (0x20, *range(0x09, 0x0E)) else 1 if i >= 128 or chr(i).isalnum() else 2 for i in range(256)], np.uint8)
_PLAIN = np.array([i + 32 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256)], np.uint8)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
GRAMS = 5  # slots: 1, 2, 3 tokens before, 1, 2 after; then the form, and two tokens with the form
_BITS = 26  # of the hash, that stand for it in the bitmap of patterns


def tokens(column: pa.Array) -> Words:
    """Runs of letters and digits, or one other character; in lower case, with all digits alike."""
    data, offsets = utf8(column)
    c = np.zeros(len(data) + 2, np.uint8)
    c[1:-1] = _CLASS[data]
    here = c[1:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero((here > 0) & ((here == 2) | (c[:-2] != 1) | edge[:-1]))
    ends = np.flatnonzero((here > 0) & ((here == 2) | (c[2:] != 1) | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return Words(_PLAIN[data], starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def grams(w: Words) -> list[np.ndarray]:
    """Hashes of each token, and of it with the one and the two after it; whether these are in its text is for the caller to see."""
    h = np.concatenate([w.hashes(), np.zeros(2, np.uint64)])
    two = mix(h[:-2] * _STEP + h[1:-1])
    return [mix(h[:-2]), two, mix(two * _STEP + h[2:])]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def patterns(texts: list[str], found: list[tuple[int, int, int, int]]) -> list[list[dict]]:
    """Patterns of each (text, start, kind, end); found is ascending by text."""
    w = tokens(pa.array(texts, pa.large_string()))
    _, offsets = utf8(pa.array(texts, pa.large_string()))
    start, end, last = np.empty(len(found), np.int64), np.empty(len(found), np.int64), -1
    for k, (t, s, _, e) in enumerate(found):
        if t != last:
            last, at = t, None
            if offsets[t + 1] - offsets[t] != len(texts[t]):
                raw = np.frombuffer(texts[t].encode(), np.uint8)
                at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        start[k], end[k] = offsets[t] + (s if at is None else at[s]), offsets[t] + (e if at is None else at[e])
    text = np.array([f[0] for f in found], np.int64)
    low, high = w.first[text], w.first[text + 1]
    i, j = np.searchsorted(w.ends, start, "right") - 1, np.searchsorted(w.starts, end)
    g = grams(w)
    forms = np.array([_hash(form(k, texts[t][s:e])) for t, s, k, e in found], np.uint64)
    none = np.uint64(0)
    pick = lambda k, at, fine: np.where(fine, g[k][np.clip(at, 0, max(0, len(g[k]) - 1))], none)
    slots = [pick(k, i - k, i - k >= low) for k in range(3)] + [pick(k, j, j + k < high) for k in range(2)] + [mix(forms)]
    slots.append(np.where(slots[1] != none, mix(slots[1] * _STEP + forms), none))
    columns = [s.view(np.int64).tolist() for s in slots]
    return [[{"slot": n, "pattern": c[k]} for n, c in enumerate(columns) if c[k]] for k in range(len(found))]


_BASE = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()),
                   ("places", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.struct([("slot", pa.int32()), ("pattern", pa.int64())])))])))])
_BASE_SQL = "doc_id long, hash long, n_email long, n_ip long, n_card long, n_phone long, base string, places array<struct<kind: int, start: long, end: long, seed: boolean, instance: string, patterns: array<struct<slot: int, pattern: long>>>>"


def _base(batches):
    for b in bounded(batches):
        rows, texts, found = [], [], []
        for doc_id, h, t in zip(*(c.to_pylist() for c in b.columns)):
            spans = base_spans(t)
            more = candidates(t, spans)
            n = Counter(k for _, k, _ in spans)
            places = [{"kind": k, "start": s, "end": e, "seed": seed, "instance": t[s:e].lower()} for seed, some in ((True, spans), (False, more)) for s, k, e in some]
            rows.append((doc_id, h, n[0], n[1], n[2], n[3], joined(spans), places))
            if places:
                found += ((len(texts), p["start"], p["kind"], p["end"], p) for p in places)
                texts.append(t)
        if found:
            for f, p in zip(found, patterns(texts, [f[:4] for f in found])):
                f[4]["patterns"] = p
        yield batch(_BASE, [list(c) for c in zip(*rows)])


def _bitmap(edges: DataFrame) -> np.ndarray:
    """A bit for each value that the low bits of a token pattern's hash take: 8 MB, however many patterns there are."""
    place = F.col("pattern").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    parts = edges.where(F.col("slot") < GRAMS).groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << (_BITS - 15), 4096), np.uint8)
    for r in parts.collect():  # at most 2,048 rows of 4 KB
        out[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


_COUNT = pa.schema([("pattern", pa.int64()), ("total", pa.int64())])


def gram_counts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(pattern, total): how often the token runs that the bitmap lets pass stand in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits, held = shared.value, []

        def summed():
            h, n = (np.concatenate(c) for c in zip(*held))
            h, place = np.unique(h, return_inverse=True)
            return h, np.bincount(place, n, len(h)).astype(np.int64)

        for b in bounded(batches):
            w = tokens(b.column(b.schema.get_field_index("text")))
            room = w.first[w.doc + 1] - np.arange(len(w.doc))
            for k, g in enumerate(grams(w)):
                low = (g & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                g = g[(room > k) & ((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1)]
                if len(g):
                    h, n = np.unique(g, return_counts=True)
                    held.append((h.view(np.int64), n))
            if sum(len(h) for h, _ in held) > 1_000_000:
                held[:] = [summed()]
                if len(held[0][0]) > 500_000:
                    yield batch(_COUNT, held.pop())
        if held:
            yield batch(_COUNT, summed())

    return docs.mapInArrow(run, "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))


def score_graph(edges: DataFrame, totals: DataFrame, support: int, confident: float, rounds: int) -> DataFrame:
    """(kind, slot, pattern, confidence) of the patterns that count after some rounds.

    edges: kind, slot, pattern, instance, n, seed; totals: pattern, total, of the patterns that are tokens.
    """
    key = ["kind", "slot", "pattern"]
    places = edges.groupBy(*key).agg(F.sum("n").alias("inside")).join(totals, "pattern", "left")
    places = places.select(*key, F.when(F.col("slot") < GRAMS, F.greatest("inside", F.coalesce("total", F.lit(0)))).otherwise(F.col("inside")).alias("total"))
    places = written(places, "pii-places")
    scored = edges.select("*", F.col("seed").cast("double").alias("score"), F.col("seed").alias("good"))
    for k in range(rounds):
        found = scored.groupBy(*key).agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count(F.when(F.col("good"), 1)).alias("held")).where(F.col("held") >= support)
        found = written(found.join(places, key).select(*key, (F.col("mass") / F.col("total")).alias("confidence")), "pii-patterns")
        if k + 1 == rounds:
            break
        against = F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("confidence", F.lit(0.0))))
        met = edges.join(found, key, "left").withColumn("against", against)
        instances = met.groupBy("kind", "instance").agg(F.sum("against").alias("all_against"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("best"))
        scored = met.join(instances, ["kind", "instance"])
        # a pattern doesn't speak for itself
        others = 1 - F.exp(F.col("all_against") - F.col("against"))
        scored = scored.select(*key, "instance", "n", F.when(F.col("seed"), 1.0).otherwise(others).alias("score"), (F.col("seed") | (F.col("best") >= confident)).alias("good"))
    return found


_DONE = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
_DONE_SQL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long"


def _finish(batches):
    """Base spans, and of the found ones that overlap the surest, then the longest."""
    for b in batches:
        rows = []
        for doc_id, *n, base, more in zip(*(c.to_pylist() for c in b.columns)):
            spans = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
            taken, starts = {}, []
            for m in sorted(more or (), key=lambda m: (-m["confidence"], m["start"] - m["end"], m["start"], m["kind"])):
                k = bisect_left(starts, m["start"])
                before = k and taken[starts[k - 1]][2] > m["start"]
                if not before and (k == len(starts) or starts[k] >= m["end"]):
                    starts.insert(k, m["start"])
                    taken[m["start"]] = (m["start"], m["kind"], m["end"])
            every = sorted(spans + list(taken.values()))
            rows.append((doc_id, *n, base, joined(every), len(every)))
        if rows:
            yield batch(_DONE, [list(c) for c in zip(*rows)])


def find_pii(docs: DataFrame, support: int = 5, confident: float = 0.8, rounds: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans), spans (base and contextual) and n_spans (how many)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    base = written(d.mapInArrow(_base, _BASE_SQL), "pii-base")
    # equal rows are one
    places = base.where(F.size("places") > 0).dropDuplicates(["doc_id", "hash", "base"]).select("doc_id", "hash", F.explode("places").alias("p")).select("doc_id", "hash", "p.*")
    each = places.withColumn("p", F.explode("patterns")).select("doc_id", "hash", "kind", "start", "end", "seed", F.xxhash64("instance").alias("instance"), "p.slot", "p.pattern")
    key = ["kind", "slot", "pattern"]
    edges = each.groupBy(*key, "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = written(edges, "pii-instances")
    held = edges.groupBy(*key).agg(F.count("*").alias("held")).where(F.col("held") >= support)
    edges = written(edges.join(held.select(key), key, "left_semi"), "pii-edges")
    good = score_graph(edges, gram_counts(d, _bitmap(edges)), support, confident, rounds).where(F.col("confidence") >= confident)
    found = each.where(~F.col("seed")).join(good, key).groupBy("doc_id", "hash", "kind", "start", "end").agg(F.max("confidence").alias("confidence"))
    found = found.groupBy(F.col("doc_id").alias("found_id"), F.col("hash").alias("found_hash")).agg(F.collect_list(F.struct("start", "kind", "end", "confidence")).alias("more"))
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("hash") == F.col("found_hash")), "left")
    both = both.select("doc_id", *(f"n_{k}" for k in KINDS), "base", "more")
    return both.mapInArrow(_finish, _DONE_SQL)


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).drop("base")


def base_sha256(text: str) -> str:
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()
