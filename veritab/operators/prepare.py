"""Preparation steps, each from DataFrame to DataFrame. Columns that a step names but a table lacks are skipped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def cast(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Under ANSI rules: a value that doesn't fit raises."""
    return df.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items() if c in df.columns})


def hex_number(c: Column) -> Column:
    """0x... in base 16, else base 10; blank, nan and none are null."""
    t = F.lower(F.trim(c.cast("string")))
    t = F.when(~t.isin("", "nan", "none"), t)
    plain = F.regexp_replace(t, r"\.0+$", "")
    return F.when(F.startswith(t, F.lit("0x")), F.conv(F.substring(t, 3, 64), 16, 10).cast("bigint")).otherwise(plain.try_cast("bigint"))


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def mapped(c: Column, values: Mapping) -> Column:
    """Values in the table are replaced; others stay."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c) if pairs else c


def by_rules(c: Column, kind: T.DataType, rules: Sequence[Mapping]) -> Column:
    """The first matching rule's value; else the last default's, else the column.

    A rule has `value` and one of: equals, in, prefix, regex, range (low, high, and open_low/open_high), default.
    """
    text, numeric, out, other = isinstance(kind, T.StringType), isinstance(kind, T.NumericType), [], c
    for r in rules:
        v = F.lit(r["value"])
        if r.get("default"):
            other = v
        elif "equals" in r:
            out.append((c == r["equals"] if text == isinstance(r["equals"], str) else F.lit(False), v))
        elif "in" in r:
            out.append((c.isin([x for x in r["in"] if text == isinstance(x, str)]), v))
        elif "prefix" in r:
            out.append((F.startswith(c, F.lit(r["prefix"])) if text else F.lit(False), v))
        elif "regex" in r:
            out.append((c.cast("string").rlike(r["regex"]), v))
        else:
            low, high = r["range"]
            x = c.cast("double") if numeric else c.try_cast("double")
            parts = [F.lit(True)]
            if low is not None:
                parts.append(x > low if r.get("open_low") else x >= low)
            if high is not None:
                parts.append(x < high if r.get("open_high") else x <= high)
            out.append((reduce(Column.__and__, parts), v))
    if not out:
        return other
    chain = reduce(lambda w, cv: w.when(cv[0], cv[1]), out[1:], F.when(*out[0]))
    return chain.otherwise(other)


def keep_equal(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(f"`{kv[0]}`") == F.lit(kv[1])) if kv[0] in d.columns else d, values.items(), df)


def keep_in(df: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(f"`{kv[0]}`").isin(list(kv[1]))) if kv[0] in d.columns else d, values.items(), df)


def present(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNotNull() & (F.trim(c) != "") if isinstance(df.schema[name].dataType, T.StringType) else c.isNotNull()


def keep_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return reduce(lambda d, c: d.where(present(d, c)) if c in d.columns else d, cols, df)


def incomplete_columns(df: DataFrame) -> DataFrame:
    """column, n_missing, n_blank for each column, in one pass."""
    text = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    one = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"m_{c}") for c in df.columns), *(F.count_if(F.trim(F.col(f"`{c}`")) == "").alias(f"b_{c}") for c in text))
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`m_{c}`").alias("n_missing"), (F.col(f"`b_{c}`") if c in text else F.lit(0).cast("long")).alias("n_blank")) for c in df.columns]
    return one.select(F.inline(F.array(*entries)))


def drop_incomplete(df: DataFrame, required: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Without columns that miss a value anywhere, and why each went."""
    gone = {r["column"]: "missing values" if r.n_missing else "blank values" for r in incomplete_columns(df).where("n_missing > 0 or n_blank > 0").collect()}
    if lost := [c for c in required if c in gone or c not in df.columns]:
        raise ValueError(f"required columns are incomplete or absent: {lost}")
    return df.drop(*gone), gone


def select_fields(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    if lost := [c for c in include or () if c not in df.columns]:
        raise ValueError(f"no such columns: {lost}")
    return df.select(*(f"`{c}`" for c in (include or df.columns) if c not in exclude))


def value_types(df: DataFrame, most: int = 32) -> DataFrame:
    """column, value_type: boolean, integer and real by type, else categorical up to `most` different values, else string."""
    kinds = {c: "boolean" if isinstance(t, T.BooleanType) else "integer" if isinstance(t, T.IntegralType) else "real" if isinstance(t, T.FractionalType) else None for c, t in ((f.name, f.dataType) for f in df.schema)}
    open_ones = [c for c, k in kinds.items() if k is None]
    one = df.agg(F.count("*").alias("rows"), *(F.count_distinct(F.col(f"`{c}`").cast("string")).alias(c) for c in open_ones))
    entries = [F.struct(F.lit(c).alias("column"), (F.lit(k) if k else F.when(F.col(f"`{c}`") <= most, "categorical").otherwise("string")).alias("value_type")) for c, k in kinds.items()]
    return one.select(F.inline(F.array(*entries)))
