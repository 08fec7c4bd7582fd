"""Figures for reports, each set in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(df: DataFrame, period: str, amount: str, part: str) -> DataFrame:
    """total, mean_ratio (part / amount), first and last amount, growth per period (compound); null growth if the first is 0 or there is one period."""
    one = df.agg(F.sum(amount).alias("total"), F.avg(F.try_divide(F.col(part).cast("double"), F.col(amount).cast("double"))).alias("mean_ratio"), F.min_by(amount, period).alias("first"), F.max_by(amount, period).alias("last"), (F.max(period) - F.min(period)).alias("_steps"))
    growth = F.when(F.col("_steps") > 0, F.pow(F.try_divide(F.col("last").cast("double"), F.col("first").cast("double")), 1 / F.col("_steps")) - 1)
    return one.withColumn("growth", growth).drop("_steps")


def truth_hits(faults: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """hits and total: planted faults (keys) that were found."""
    seen = found.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return faults.join(seen, list(keys), "left").agg(F.count("_hit").alias("hits"), F.count("*").alias("total"))


def rule_counts(rules: DataFrame, enabled: str = "enabled", source: str = "source") -> DataFrame:
    """One row: total, enabled, learned, and manual, which is every source but "learned"."""
    learned = F.coalesce(F.col(source) == "learned", F.lit(False))
    return rules.agg(F.count("*").alias("total"), F.count_if(F.col(enabled)).alias("enabled"), F.count_if(learned).alias("learned"), F.count_if(~learned).alias("manual"))


def of_level(log: DataFrame, level: str, column: str = "level") -> DataFrame:
    """Entries of one level; "all" keeps every entry."""
    return log if level == "all" else log.where(F.col(column) == level)


def canonical_key(*cols: str) -> Column:
    """The columns as JSON, by name and with nulls: the same text in whatever order they are given."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(cols))), {"ignoreNullFields": "false"})


def content_key(*cols: str) -> Column:
    """SHA-256 of the columns' canonical key: a name for cached results."""
    return F.sha2(canonical_key(*cols).cast("binary"), 256)


def safe_name(c: Column) -> Column:
    """A file name with only letters, digits, dot, dash and underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def percent(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(c * 100, places), F.lit("%"))
