"""Operator 12: line dedup over levelled sorted runs of line hashes.

Lines that many documents share are dropped everywhere. Documents come in batches; what is known of their lines stands in runs, tables
of (key, docs) that are bucketed and sorted by the lines' 128-bit hashes:

1. A pass over the texts lists each document's different line keys with the places of their lines.
2. A batch's keys are counted. The batch merge-anti-joins the runs' keys that have enough documents already, as these need no more
   counting, and what is left becomes a run of level 0. As runs share their buckets, the merge joins need no shuffle.
3. When a level has `fan` runs, they are compacted to one run of the level above, counts added. So there are few runs at any time, and
   each count is rewritten once a level.
4. All runs together tell the common keys. Their places are gathered per document and cut out of its text.

A document is a row: repeated rows count as documents each. A null or empty text is one empty line; an empty key (of a blank line) is never common.
Null doc_ids are documents like others. Very long texts and lines are taken whole. An empty table gives no rows. Other columns are kept, whatever
their names. Results don't depend on how rows are dealt to batches.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import batch, fresh, shared_dir, table, written


class LineRuns:
    """Levelled sorted runs: how many documents have a line key, as far as `enough` of them."""

    def __init__(self, spark: SparkSession, enough: int, fan: int = 3):
        self.spark, self.enough, self.fan = spark, enough, fan
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _run(self, counts: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_dir(self.spark, name)
        counts.write.option("path", self.paths[name]).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)

    def _counts(self, runs: list[str]) -> DataFrame:
        # as plain files: Spark 4.1 takes a union of bucketed tables for one that needs no exchange, and leaves counts apart
        every = self.spark.read.schema("key binary, docs long").parquet(*(self.paths[r] for r in runs))
        return every.groupBy("key").agg(F.sum("docs").alias("docs"))

    def add(self, keys: DataFrame) -> None:
        """A batch: a row for each document and different key of it."""
        new = keys.groupBy("key").agg(F.count("*").alias("docs"))
        for run in (r for level in self.levels for r in level):
            new = new.join(self.spark.table(run).where(F.col("docs") >= self.enough).select("key").hint("merge"), "key", "left_anti")
        self._run(new, 0)
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan:
                runs, self.levels[k] = self.levels[k], []
                self._run(self._counts(runs), k + 1)
                self._drop(runs)

    def common(self) -> DataFrame:
        """Keys that enough documents have, over all batches. The runs are gone after that."""
        runs = [r for level in self.levels for r in level]
        out = written(self._counts(runs).where(F.col("docs") >= self.enough).select("key"), "common-lines")
        self._drop(runs)
        self.levels = []
        return out

    def _drop(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE {r}")


def line_keys(text: bytes | None, least_chars: int) -> dict[bytes, list[int]]:
    """Places of each different key of a text: lines without white space around them, A-Z lower-cased; keys of fewer code points left out."""
    places: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or b"").lower().split(b"\n")):
        key = line.strip()
        if len(key) >= least_chars and (least_chars < 2 or len(key.decode("utf-8", "replace")) >= least_chars):
            places.setdefault(key, []).append(i)
    return places


def _list_lines(least_chars: int):
    schema = pa.schema([("batch", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.binary()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for rb in batches:
            at, keys, places = [], [], []
            for i, text in enumerate(rb.column("text")):
                for key, where in line_keys(text.as_py(), least_chars).items():
                    at.append(i)
                    keys.append(xxhash.xxh3_128_digest(key))
                    places.append(where)
            named = [rb.column(c).take(pa.array(at, pa.int32())) for c in ("batch", "a", "b")]
            yield batch(schema, [*named, keys, places])

    return run


def _cut(text: str, schema: pa.Schema):
    """Cuts the lines out; adds how many lines there were and how many went."""

    def run(batches):
        for rb in batches:
            kept, lines, dropped = [], [], []
            for t, drop in zip(rb.column(text), rb.column(rb.num_columns - 1)):
                t, drop = t.as_py(), drop.as_py()
                parts = (t or "").split("\n")
                lines.append(len(parts))
                gone = {p for places in drop or () for p in places}
                dropped.append(len(gone))
                kept.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else t)
            columns = {n: rb.column(i) for i, n in enumerate(rb.schema.names[:-1])} | {text: kept}
            yield batch(schema, [*columns.values(), lines, dropped])

    return run


def line_dedup(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, batches: int = 4, fan: int = 3) -> DataFrame:
    """docs without the lines whose keys are in `least_docs` documents or more; with n_lines (before) and n_dropped besides.

    batches: in how many batches the rows come; a batch's counts are all that is sorted at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    text = F.col("text").cast("string")
    # a row's name: rows of one id and text fare alike
    name = {k: F.xxhash64(F.lit(salt), F.col("doc_id").cast("string"), text) for k, salt in (("a", 1), ("b", 2))}
    dealt = docs.select((F.spark_partition_id() % batches).alias("batch"), *(c.alias(k) for k, c in name.items()), text.cast("binary").alias("text"))
    path = shared_dir(spark, "lines")
    listed = dealt.mapInArrow(_list_lines(least_chars), "batch int, a long, b long, key binary, places array<int>")
    listed.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("a long, b long, key binary, places array<int>, batch int").parquet(path)
    runs = LineRuns(spark, least_docs, fan)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("key"))
    drop = lines.join(runs.common(), "key", "left_semi").groupBy("a", "b").agg(F.collect_set("places").alias("drop"))
    a, b, gone = fresh(docs, "line_a"), fresh(docs, "line_b"), fresh(docs, "line_drop")
    found = written(drop.select(F.col("a").alias(a), F.col("b").alias(b), F.col("drop").alias(gone)), "dropped-lines")
    named = docs.withColumn("text", text).withColumns({a: name["a"], b: name["b"]})
    joined = named.join(found, [a, b], "left").select(*(f"`{c}`" for c in docs.columns), gone)
    n, m = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    out = joined.drop(gone).withColumns({n: F.lit(0).cast("long"), m: F.lit(0).cast("long")}).schema
    return joined.mapInArrow(_cut("text", to_arrow_schema(out)), out)


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
