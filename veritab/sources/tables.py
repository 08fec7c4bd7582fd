"""Tables from files: delimited text, JSON, uploads with required columns."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import text

SUFFIXES = {".csv": "csv", ".txt": "csv", ".json": "json", ".parquet": "parquet", ".pcap": "capture", ".pcapng": "capture", ".cap": "capture"}


def source_type(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no source type for {suffix!r}")
    return SUFFIXES[suffix]


def delimiter(line: str) -> str:
    """Of comma, semicolon, tab and bar, the commonest in a first line."""
    return max(",;\t|", key=line.count)


def read_table(spark: SparkSession, path: str, limit: int | None = None, **options) -> DataFrame:
    """By suffix; `limit` counts raw rows, before any preparation."""
    kind = source_type(path)
    if kind == "capture":
        from veritab.sources.capture import read_capture

        df = read_capture(spark, path)
    elif kind == "json":
        df = spark.read.option("multiLine", True).options(**options).json(path)
        if df.columns == ["rows"]:
            df = df.select(F.inline("rows"))
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        if "sep" not in options:
            first = spark.read.text(path).limit(1).collect()
            options["sep"] = delimiter(first[0][0]) if first else ","
        df = spark.read.options(header=True, inferSchema=True, **options).csv(path)
    return df if limit is None else df.limit(limit)


def first_alias(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Logical columns, each from the first of its aliases that the table has (whatever the case), else null."""
    have = {c.lower(): c for c in df.columns}
    found = {k: next((have[a.lower()] for a in (k, *aliases) if a.lower() in have), None) for k, aliases in names.items()}
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()))


def required(df: DataFrame, numeric: Sequence[str] = (), others: Sequence[str] = ()) -> DataFrame:
    """Checks that columns are there; numeric ones are cast, and a bad number raises when rows are read."""
    if lost := [c for c in (*numeric, *others) if c not in df.columns]:
        raise ValueError(f"columns are missing: {lost}")
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in numeric})


def allowed_source(path: str, root: str, suffixes: Sequence[str]) -> str:
    """The path, if it is inside the root and has an allowed suffix."""
    full, base = os.path.normpath(path), os.path.normpath(root)
    if not full.startswith(base + os.sep) or os.path.splitext(full)[1].lower() not in suffixes:
        raise ValueError(f"not an allowed source: {path}")
    return full


def knowledge_sections(spark: SparkSession, path: str) -> DataFrame:
    """source, place, heading, body of Markdown files cut at second-level headings."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    parts = texts.select("source", F.posexplode(F.split("value", r"(?m)^## ")).alias("place", "part")).where("place > 0")
    lines = F.split("part", "\n", 2)
    bare = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return parts.select("source", "place", bare(lines[0]).alias("heading"), bare(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))).alias("body"))


def json_sections(spark: SparkSession, path: str) -> DataFrame:
    """source, place, title, heading, body, tags of JSON files: a list of records, an object with a list under sections, items, records or knowledge,
    or one record. Records that aren't objects or have no body are left out; what a record lacks comes from its file.
    """
    first = lambda m, *keys: F.coalesce(*(F.nullif(F.trim(m[k]), F.lit("")) for k in keys))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value"))
    files = files.withColumn("root", F.when(F.startswith("value", F.lit("{")), F.from_json("value", "map<string,string>")))
    root = F.col("root")
    listed = F.coalesce(*(F.when(F.startswith(root[k], F.lit("[")), root[k]) for k in ("sections", "items", "records", "knowledge")))
    one = first(root, "body", "content", "text", "summary").isNotNull()
    records = F.when(root.isNull(), F.from_json("value", "array<string>")).when(listed.isNotNull(), F.from_json(listed, "array<string>")).when(one, F.array("value"))
    r = files.select("file", "root", F.posexplode(records).alias("at", "record")).withColumn("record", F.from_json("record", "map<string,string>"))
    m, name = F.col("record"), F.regexp_replace("file", r"\.[^.]*$", "")
    place = F.col("at") + 1
    words = lambda t: F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>")).otherwise(text.tags(t))
    body = first(m, "body", "content", "text", "summary")
    lines = F.when(F.startswith(body, F.lit("[")), F.array_join(F.filter(F.transform(F.from_json(body, "array<string>"), lambda x: F.trim(x)), lambda x: x != ""), "\n"))
    return r.select(
        F.coalesce(first(m, "source", "url"), first(root, "source", "url"), "file").alias("source"), place.alias("place"),
        F.coalesce(first(m, "doc_title", "document", "doc"), first(root, "doc_title", "document", "title"), name).alias("title"),
        F.coalesce(first(m, "heading", "title", "name", "topic"), F.concat(F.lit("section-"), place)).alias("heading"),
        F.coalesce(lines, body).alias("body"),
        F.concat(words(F.coalesce(root["tags"], F.lit(""))), text.tags(F.replace(name, F.lit("_"), F.lit(" "))), words(F.coalesce(m["tags"], F.lit("")))).alias("tags"),
    ).where("body <> ''")


def write_csv(df: DataFrame, path: str, names: Mapping[str, str] | None = None, mark: bool = False) -> None:
    """names: other headings; mark: each file begins with a byte order mark, as spreadsheet programs want it."""
    out = df.withColumnsRenamed(dict(names or {}))
    if mark:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
