"""Keyword retrieval by an index: trigram postings prune sections and bound their scores, the texts of those left verify.

An index is a folder of two tables, both by batch: `sections`, numbered in the order they were written, and `postings`, which
has how often a section's column holds a run of three characters (fewer at its end), lower-cased: a row per run, column and slice of
sections, with the numbers of these and their counts. Tasks count their own sections, so nothing is exchanged. Postings are written last, so a batch whose
write failed is never a candidate and can be added again. Files of postings are sorted by run and those of sections by number: the
filters of a search reach the Parquet pages.

A word stands in a text at most as often as its rarest run does, so the runs of the words give each section a score it can't exceed. The
best by that bound are read first; then the sections whose bound reaches the k-th score found so far.
Results are those of text.best_sections: null texts hold no word, words count as often as they are given, repeated rows are sections each.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import keyword_score
from veritab.sources.staging import staged

RUN = 3
_BATCH, _ID = "index_batch", "index_id"


def runs(text: Column) -> Column:
    """The run of three characters that begins at each character, shorter at the end; lower-cased."""
    c = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda x: x != "")
    # the characters are bound to a variable, or they would be split again for each of them
    return F.get(F.transform(F.array(c), lambda x: F.transform(x, lambda _, i: F.concat(*(F.coalesce(F.get(x, i + k), F.lit("")) for k in range(RUN))))), F.lit(0))


_SLICE = 2_000_000  # characters that are counted at once, but at least one text
_POSTINGS = pa.schema([("run", pa.string()), ("column", pa.string()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])


def _posted(column: str, ids: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings of one slice of texts, as `runs` has them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(points):
        return
    alphabet, c = np.unique(points, return_inverse=True)
    base, docs = len(alphabet) + 1, len(texts)
    if base**RUN * docs >= 1 << 63:
        for i in range(docs):
            yield from _posted(column, ids[i : i + 1], texts[i : i + 1])
        return
    doc = np.repeat(np.arange(docs), sizes)
    end = np.cumsum(sizes)[doc]
    code, at = np.zeros(len(c), np.int64), np.arange(len(c))
    for k in range(RUN):
        here = at + k
        code = code * base + np.where(here < end, c[np.minimum(here, len(c) - 1)] + 1, 0)
    key = np.sort(code * docs + doc)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n, code, doc = np.diff(np.append(first, len(key))), key[first] // docs, key[first] % docs
    head = np.flatnonzero(np.diff(code, prepend=-1))
    names = ["", *map(chr, alphabet.tolist())]
    found = ["".join(names[x // base**k % base] for k in reversed(range(RUN))) for x in code[head].tolist()]
    offsets = pa.array(np.append(head, len(code)), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([column] * len(head)), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[doc], n))], schema=_POSTINGS)


def _postings(numbered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """run, column, ids, ns of numbered sections."""
    low = numbered.select(_ID, *(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"c{k}") for k, c in enumerate(columns)))
    names = list(columns)

    def count(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for k, name in enumerate(names, 1):
                texts = b.column(k).to_pylist()
                x = size = 0
                for y, t in enumerate(texts):
                    if y > x and size + len(t) > _SLICE:
                        yield from _posted(name, ids[x:y], texts[x:y])
                        x, size = y, 0
                    size += len(t)
                yield from _posted(name, ids[x:], texts[x:])

    return low.mapInArrow(count, "run string, column string, ids array<long>, ns array<long>")


@dataclass(frozen=True)
class SectionIndex:
    """Where an index lies, which columns it has postings of, and the column that orders ties."""

    path: str
    columns: tuple[str, ...]
    place: str

    def add(self, sections: DataFrame) -> SectionIndex:
        """Indexes more sections; what is there already isn't read."""
        if {c.lower() for c in sections.columns} & {_BATCH, _ID}:
            raise ValueError(f"{_BATCH} and {_ID} are the index's own columns")
        spark, name = sections.sparkSession, f"batch-{uuid.uuid4().hex}"
        sections.withColumn(_ID, F.monotonically_increasing_id()).write.parquet(f"{self.path}/sections/{_BATCH}={name}")
        numbered = spark.read.parquet(f"{self.path}/sections/{_BATCH}={name}")
        if numbered.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            numbered = numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _ID)
        _postings(numbered, self.columns).sortWithinPartitions("run", "column").write.parquet(f"{self.path}/postings/{_BATCH}={name}")
        return self

    def candidates(self, spark: SparkSession, words: Sequence[str], weights: Mapping[str, int]) -> DataFrame:
        """index_batch, index_id, bound: sections that may have a score above 0, and what their score can't exceed."""
        if not set(weights) <= set(self.columns):
            raise ValueError(f"not indexed: {sorted(set(weights) - set(self.columns))}")
        if not all(words):
            raise ValueError("an empty word")
        times = Counter(w.lower() for w in words)
        positive = {c: k for c, k in weights.items() if k > 0}
        postings = spark.read.parquet(f"{self.path}/postings").where(F.col("column").isin(list(positive)))
        each = lambda rows: rows.select(_BATCH, "run", "column", F.explode(F.arrays_zip("ids", "ns")).alias("p")).select(_BATCH, "run", "column", F.col("p.ids").alias(_ID), F.col("p.ns").alias("n"))
        asked = spark.createDataFrame(list(times.items()), "word string, times long")
        needed = asked.where(F.length("word") >= RUN).select("word", "times", F.explode(F.filter(runs(F.col("word")), lambda r: F.length(r) == RUN)).alias("run"))
        needed = needed.groupBy("word", "times", "run").agg(F.count("*").alias("within")).collect()  # a row for each run of the words
        found = []
        if needed:
            kinds = Counter(r.word for r in needed)
            table = spark.createDataFrame([(r.run, r.word, r.within, r.times, kinds[r.word]) for r in needed], "run string, word string, within long, times long, kinds long")
            met = each(postings.where(F.col("run").isin(sorted({r.run for r in needed})))).join(F.broadcast(table), "run")
            word = met.groupBy(_BATCH, _ID, "column", "word", "times", "kinds").agg(F.count("*").alias("met"), F.min(F.expr("n div within")).alias("most"))
            found.append(word.where("met = kinds").select(_BATCH, _ID, "column", (F.col("most") * F.col("times")).alias("most")))
        # a shorter word stands where a run begins with it
        short = [(w, n) for w, n in times.items() if len(w) < RUN]
        found += [each(postings.where(F.startswith("run", F.lit(w)))).select(_BATCH, _ID, "column", (F.col("n") * n).alias("most")) for w, n in short]
        if not found or not positive:
            return spark.createDataFrame([], f"{_BATCH} string, {_ID} long, bound long")
        weight = F.create_map(*(F.lit(x) for kv in positive.items() for x in kv))
        every = reduce(DataFrame.unionAll, found).groupBy(_BATCH, _ID).agg(F.sum(F.col("most") * weight[F.col("column")]).alias("bound"))
        return every.where("bound > 0")

    def best(self, spark: SparkSession, words: Sequence[str], weights: Mapping[str, int], k: int, first: int = 1_000) -> DataFrame:
        """The k sections with the highest score above 0, ties by place; reads the texts of candidates alone.

        The `first` best by bound (at least k) are known to the driver, and read by number; those whose bound reaches the k-th score of these are joined.
        """
        sections = spark.read.parquet(f"{self.path}/sections")
        columns = [c for c in sections.columns if c not in (_BATCH, _ID)]
        if not words or not weights:
            return sections.select(*(f"`{c}`" for c in columns), F.lit(0).cast("long").alias("score")).limit(0)
        bounds = staged(self.candidates(spark, words, weights))
        probe = bounds.orderBy(F.desc("bound"), _BATCH, _ID).limit(max(first, k)).collect()
        near = F.broadcast(spark.createDataFrame([(r[_BATCH], r[_ID]) for r in probe], f"{_BATCH} string, {_ID} long"))
        near = sections.where(F.col(_ID).isin([r[_ID] for r in probe])).join(near, [_BATCH, _ID], "left_semi")
        scored = near.withColumn("score", keyword_score(words, weights)).where("score > 0")
        if len(probe) == max(first, k):
            known = [r.score for r in scored.select("score").orderBy(F.desc("score")).limit(k).collect()]
            least, last = known[-1] if len(known) == k else 1, probe[-1]
            batch, after = F.col(_BATCH), F.col("bound") < last.bound
            after |= (F.col("bound") == last.bound) & ((batch > last[_BATCH]) | ((batch == last[_BATCH]) & (F.col(_ID) > last[_ID])))
            rest = bounds.where((F.col("bound") >= least) & after).select(_BATCH, _ID)
            more = sections.join(rest, [_BATCH, _ID], "left_semi").withColumn("score", keyword_score(words, weights))
            scored = scored.unionByName(more.where(F.col("score") >= least))
        return scored.orderBy(F.desc("score"), self.place).limit(k).select(*(f"`{c}`" for c in columns), "score")


def section_index(sections: DataFrame, columns: Sequence[str], place: str, path: str) -> SectionIndex:
    """A new index of the sections' text columns in the folder `path`."""
    return SectionIndex(path, tuple(columns), place).add(sections)
