"""Bounded samples of labelled documents, and counts of their features, for the two classifiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import batch, written
from veritab.llm.wordhash import bounded, shingles, words


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> DataFrame:
    """(label, text, cluster) of at most `most` labelled documents, those with the smallest hash of doc_id.

    Of several labels of one document the smallest counts; labels other than 0 and 1 don't. Of several rows of one
    sampled doc_id one text counts, that with the smallest hash. The sampled
    ids are at most `most` rows, so they are broadcast to the texts, which then needn't be shuffled.
    cluster: equal for copies and most near copies (smallest hash among the runs of three words).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(known), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("label", "text")
    schema = pa.schema([("label", pa.int32()), ("text", pa.string()), ("cluster", pa.int64())])

    def cluster(batches):
        for b in bounded(batches):
            w = words(b.column(1))
            h, d = shingles(w, w.hashes(True), 3)
            least = [0] * b.num_rows
            order = h.argsort()[::-1]
            for k, v in zip(d[order].tolist(), h[order].view("i8").tolist()):
                least[k] = v
            yield batch(schema, [b.column(0), b.column(1).cast(pa.string()), least])

    return written(picked.mapInArrow(cluster, "label int, text string, cluster long"), "labelled")


def feature_counts(sample: DataFrame, features: Callable[[bytes], Iterable[bytes]], least: int, most: int) -> list[tuple[bytes, int, int]]:
    """(feature, documents with label 0, documents with label 1) of the `most` commonest features in at least `least` documents."""
    schema = pa.schema([("feature", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())])

    def count(batches):
        n0, n1 = Counter(), Counter()

        def flush():
            names = list(n0.keys() | n1.keys())
            out = batch(schema, [names, [n0[k] for k in names], [n1[k] for k in names]])
            n0.clear()
            n1.clear()
            return out

        for b in bounded(batches):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (n1 if y else n0).update(set(features(t.encode())))
            if len(n0) + len(n1) > 500_000:
                yield flush()
        if n0 or n1:
            yield flush()

    rows = sample.select("label", "text").mapInArrow(count, "feature binary, n0 long, n1 long")
    rows = rows.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least)
    rows = rows.orderBy((F.col("n0") + F.col("n1")).desc(), "feature").limit(most)
    return [(bytes(r.feature), r.n0, r.n1) for r in rows.collect()]


def sparse_rows(sample: DataFrame, vector: Callable[[bytes], tuple[list[int], list[float]]]) -> list[tuple[int, list[int], list[float]]]:
    """(label, feature numbers, values) of the sample's rows, in a fixed order; as many rows as the sample has."""
    schema = pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])

    def rows(batches):
        for b in bounded(batches):
            made = [vector(t.encode()) for t in b.column(1).to_pylist()]
            yield batch(schema, [b.column(0), [m[0] for m in made], [m[1] for m in made]])

    out = sample.select("label", "text").mapInArrow(rows, "label int, at array<int>, value array<double>").toArrow()
    return sorted(zip(*(c.to_pylist() for c in out.columns)))
