"""Event logs as streams: dedupe, latest state, and rule checks in time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.rules import Rule


def event_stream(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """History first, then what arrives: an append-only folder read from its beginning."""
    return spark.readStream.schema(schema).format(kind).load(path)


def once_each(events: DataFrame, key: str, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The first event of each key; with a time column, state is kept only as long as late events may come."""
    if time is None or not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_state(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.count("*").alias("n"))


def staged(events: DataFrame, stages: dict[str, str], column: str = "event_type", other: str = "other") -> DataFrame:
    pairs = [F.lit(x) for kv in stages.items() for x in kv]
    return events.withColumn("agent", F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(other)))


def windowed_violations(events: DataFrame, rules: Sequence[Rule], time: str, width: str, late: str = "10 minutes") -> DataFrame:
    """start, rule_id, n per time window; on a stream, windows close when the watermark passes them."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    broken = F.array_compact(F.array(*(F.when(~r.condition, F.lit(r.rule_id)) for r in rules)))
    rows = events.select(F.col(time), F.explode(broken).alias("rule_id"))
    return rows.groupBy(F.window(time, width).alias("w"), "rule_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "rule_id", "n")
