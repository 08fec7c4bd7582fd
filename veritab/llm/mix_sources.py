"""Operator 3: mixing sources to target weights by pivotal dependent rounding.

A source's target is its share, by weight, of the size of all documents, but at most `limit` times its
own size; what is above goes to the others by weight until no source is above. Every document of a
source is wanted target / source size times: a whole number of copies and a fractional one. The
fractions are rounded in pairs: mass, in words, moves at random from one document to the other until
one of them has a whole number, so expectations hold and the words taken stay the same. A task pairs
the documents of its bucket and leaves one open document for each source; open ones are paired
again in a reduction tree, `fan_in` at a time, until a source has one, which is rounded on its own.

One document would leave a source off its target by up to its size, and the one that stays open is mostly a large one. So a source's large documents
are rounded first, those after them share what is then left of its target, and small ones come last (three stages). A stage's documents can
always take up what the larger ones leave, and in the end a source is off by at most a document of its last stage. As
what is left is as often too much as too little, expectations still hold.

Random numbers come from the documents and a seed, and buckets from doc_id, so reruns agree whatever the
layout of the input is. Null or empty texts have size 0 and are taken 0 times. A source of size 0 has target 0
and its weight goes to the others. Null source is a source of its own, last in order. Rows that repeat
(same doc_id, source and size) are interchangeable documents. Very long texts weigh as all their words. An empty table gives no row. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import batch, table, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weight: Column | None = None, limit: float = 3.0) -> DataFrame:
    """source, source_size, target from a row (source, source_size) per source.

    Sources in ascending order of limit * size / weight reach their limit one after the other; source k is at its
    limit if the rest, shared by weight among k and those after it, gives it more than that.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    by_fill = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    w = weight if weight is not None else (F.row_number().over(order) - 1) % 3 + 1
    s = sizes.withColumn("weight", w.cast("double")).withColumn("top", limit * F.col("source_size"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum("top").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.col("rest") / F.col("open_weight"))
    s = s.withColumn("full", F.col("weight") * F.col("level") > F.col("top"))
    # the first source that isn't full sets the level of all after it
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("top") / F.col("weight"), F.col("level"))))
                     .over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.coalesce(F.least("top", F.col("weight") * F.col("level")), F.col("top")).alias("target"))


def _unit(key: np.ndarray) -> np.ndarray:
    """Random numbers in [0, 1) from 64-bit keys."""
    from veritab.llm.wordhash import mix

    return (mix(mix(key)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def settle(size: list[float], part: list[float], chance: list[float]) -> tuple[list[int], int]:
    """Pairs documents in order. part: wanted fractions. Returns 1, 0 or -1 (open) for each, and which is open; part has its new fraction."""
    eps = 1e-9
    out = [0] * len(size)
    open_one = -1
    for i, p in enumerate(part):
        if p <= eps or p >= 1 - eps:
            out[i] = int(p > 0.5)
            continue
        if open_one < 0:
            open_one = i
            continue
        j, a, b = open_one, size[open_one], size[i]
        up = min((1 - part[j]) * a, p * b)  # words that can move to the open one
        down = min(part[j] * a, (1 - p) * b)  # words that can move from it
        move = up if chance[i] * (up + down) < down else -down
        pj, pi = part[j] + move / a, p - move / b
        open_one = -1
        for k, q in ((j, pj), (i, pi)):
            if q <= eps or q >= 1 - eps:
                out[k] = int(q > 0.5)
            else:
                open_one, part[k] = k, q
    if open_one >= 0:
        out[open_one] = -1
    return out, open_one


_ROW = pa.schema([("bucket", pa.int64()), ("source", pa.string()), ("key", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int64()), ("part", pa.float64()), ("state", pa.int32())])
_ROW_SQL = "bucket long, source string, key long, doc_id long, size long, source_size long, target double, whole long, part double, state int"
_SIZE, _PART, _STATE = _ROW.names.index("size"), _ROW.names.index("part"), _ROW.names.index("state")


def _settled(rows: DataFrame, seed: int, deal: list[str]) -> DataFrame:
    """Settles the rows of each bucket and source, dealt to tasks by some of the two; at most one of them stays open (state -1)."""

    def finish(run: list[list]) -> list[list]:
        part = [r[_PART] for r in run]
        chance = _unit(np.array([r[2] for r in run], np.int64).view(np.uint64) ^ np.uint64(seed)).tolist()
        states, _ = settle([r[_SIZE] for r in run], part, chance)
        for r, p, s in zip(run, part, states):
            r[_PART], r[_STATE] = p, s
        return run

    def run(batches):
        held: list[list] = []  # the open row of a run that may go on in the next batch
        for b in batches:
            rows, done, i = [list(r) for r in zip(*(c.to_pylist() for c in b.columns))], [], 0
            if held and rows and rows[0][:2] != held[0][:2]:
                done, held = held, []
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j][:2] == rows[i][:2]:
                    j += 1
                out, held = finish(held + rows[i:j]), []
                if j == len(rows):
                    held = [r for r in out if r[_STATE] < 0]
                    out = [r for r in out if r[_STATE] >= 0]
                done += out
                i = j
            if done:
                yield batch(_ROW, [list(x) for x in zip(*done)])
        if held:
            yield batch(_ROW, [list(x) for x in zip(*held)])

    ordered = rows.select(_ROW.names).repartition(*deal).sortWithinPartitions("bucket", "source", "key", "doc_id", "size")
    return ordered.mapInArrow(run, _ROW_SQL)


def document_key() -> Column:
    """Names a document by its id, source and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


_STAGES = 3


def _stages(d: DataFrame, sums: DataFrame, limit: float) -> DataFrame:
    """source, class (of sizes, by powers of two), class_size, stage: the classes up to the first that could take up the largest document come later."""
    classes = d.where("size > 0").groupBy("source", F.floor(F.log2("size")).alias("class")).agg(F.sum("size").alias("class_size"), F.max("size").alias("largest"))
    rate = F.col("target") / F.col("source_size")
    s = classes.alias("c").join(sums.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.*", F.least(rate, limit - rate).alias("room"))
    of = Window.partitionBy("source")
    s = s.withColumn("can", F.sum("class_size").over(of.orderBy("class")) * F.col("room")).withColumn("stage", F.lit(0))
    s = s.withColumn("last", F.max("class").over(of))
    for k in range(1, _STAGES):
        left = F.max(F.when(F.col("class") <= F.col("last"), F.col("largest"))).over(of)
        s = s.withColumn("need", left).withColumn("last", F.coalesce(F.min(F.when(F.col("can") >= F.col("need"), F.col("class"))).over(of), F.col("last")))
        s = s.withColumn("stage", F.when((F.col("class") <= F.col("last")) & (F.col("last") < F.max("class").over(of)), k).otherwise(F.col("stage")))
    return s.select("source", "class", "class_size", "stage")


def mix(docs: DataFrame, weight: Column | None = None, limit: float = 3.0, seed: int = 20240613, bucket_rows: int = 5_000, fan_in: int = 64) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every document.

    bucket_rows: documents of all sources that are paired in a row at first, about.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), document_key().alias("key"))
    d = written(d, "mix-sizes")
    sums = written(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weight, limit), "mix-targets")
    classes = written(_stages(d, sums, limit), "mix-classes")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    numbered = d.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size")))).alias("a").join(classes.alias("b"), same & (F.col("a.class") == F.col("b.class")), "left")
    d = written(numbered.select("a.*", F.coalesce("stage", F.lit(0)).alias("stage")).drop("class"), "mix-stages")
    counts = {r["stage"]: r["count"] for r in d.groupBy("stage").count().collect()}  # a row per stage
    done = None
    for stage in range(_STAGES):
        if not counts.get(stage):
            continue
        left = classes.where(F.col("stage") >= stage).groupBy("source").agg(F.sum("class_size").alias("left"))
        rates = sums.alias("a").join(left.alias("b"), same, "left").select("a.*", "left").withColumn("took", F.lit(0))
        if done is not None:
            took = done.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") + F.col("state"))).alias("took"))
            rates = rates.drop("took").alias("a").join(took.alias("b"), same, "left").select("a.*", F.coalesce("took", F.lit(0)).alias("took"))
        rates = rates.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.lit(limit), (F.col("target") - F.col("took")) / F.col("left"))))
        here = d.where(F.col("stage") == stage).alias("a").join(written(rates, "mix-rates").alias("b"), same).select("a.*", "source_size", "target", "rate")
        found = _rounded(here, max(1, -(-counts[stage] // bucket_rows)), fan_in, seed + stage)
        done = found if done is None else done.unionByName(found)
    if done is None:
        done = d.sparkSession.createDataFrame([], _ROW_SQL)
    copies = (F.col("whole") + F.col("state")).alias("copies")
    return done.select("doc_id", "source", "key", "size", "source_size", "target", copies, (F.col("size") * copies).alias("taken"))


def _rounded(d: DataFrame, buckets: int, fan_in: int, seed: int) -> DataFrame:
    """Rows of documents with their whole copies and the rounded rest (state), through the reduction tree."""
    wanted = F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0)
    d = d.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted")).withColumn("part", F.col("wanted") - F.col("whole"))
    # a source's documents are spread over all buckets
    rows = d.withColumn("bucket", F.pmod("key", F.lit(buckets))).withColumn("state", F.lit(-1))
    done = None
    while True:
        # at first by bucket alone, as sources differ in size; open rows are alike in number, and few buckets are left for them
        level = written(_settled(rows, seed + buckets, ["bucket"] if done is None else ["bucket", "source"]), "mix-level")
        if buckets == 1:
            last = F.xxhash64(F.lit(seed), "key") / F.lit(2.0**64) + 0.5
            level = level.withColumn("state", F.when(F.col("state") < 0, (last < F.col("part")).cast("int")).otherwise(F.col("state")))
        settled = level.where("state >= 0")
        done = settled if done is None else done.unionByName(settled)
        if buckets == 1:
            return done
        rows = level.where("state < 0").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        buckets = -(-buckets // fan_in)


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
