"""Results as files: rule sets, predicates, cached evidence."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule sets as JSON lines, or as one document with an array `rules`."""
    df = spark.read.json(path)
    if "rules" in df.columns or "_corrupt_record" in df.columns:
        df = spark.read.option("multiLine", True).json(path)
        df = df.select(F.inline("rules")) if "rules" in df.columns else df
    if "rule_id" not in df.columns:
        raise ValueError("rules have no rule_id")
    return df


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result kept as Parquet under a content key, made once."""
    path = f"{folder.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_run(spark: SparkSession, folder: str, dataset: str, grammar: str, notes: Mapping[str, object], tables: Mapping[str, DataFrame]) -> str:
    """A new folder named by time, dataset and grammar, with a JSON document for each note and JSON lines for each table; its path.

    The manifest names dataset and grammar and counts the rows of each table, as read back from what was written.
    """
    path = f"{folder.rstrip('/')}/{datetime.now():%Y%m%d-%H%M%S-%f}_{dataset}_{grammar}"
    counts = {}
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
        counts[name] = spark.read.schema(df.schema).json(f"{path}/{name}").count()
    for name, note in {**notes, "manifest": {"dataset": dataset, "grammar": grammar, "rows": counts}}.items():
        spark.createDataFrame([(json.dumps(note, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(f"{path}/{name}")
    return path


def loose_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of comma-separated lines that stand between other text (column value); lines without a comma are skipped."""
    one = lines.select(F.explode(F.split("value", r"\r?\n")).alias("line")).where(F.contains("line", F.lit(",")))
    return one.select(F.from_csv("line", schema).alias("r")).select("r.*").dropna("any")
