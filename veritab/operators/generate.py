"""Synthetic rows: column chains counted in Spark, sampled by row, kept only where the rules hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.text import fixed_width, from_fixed_width
from veritab.operators.rules import Rule
from veritab.sources.staging import staged


def transitions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """step, before, value, n: how often a column's value follows the value of the column before it (null at step 0)."""
    steps = [F.struct(F.lit(k).alias("step"), (F.col(cols[k - 1]).cast("string") if k else F.lit(None).cast("string")).alias("before"), F.col(c).cast("string").alias("value")) for k, c in enumerate(cols)]
    return df.select(F.inline(F.array(*steps))).groupBy("step", "before", "value").agg(F.count("*").alias("n"))


def _unit(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def shaped(choices: Column, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, sample: bool = True) -> Column:
    """An array of (value, weight) from one of (value, n): n to the power of 1 / temperature, of the top_k weightiest, of those the fewest that
    hold top_p of the weight (one at least). Without sampling only the weightiest is left. Ties go to the smaller value.
    """
    weights = F.transform(choices, lambda x: F.struct((-F.pow(x["n"], F.lit(1 / max(temperature, 1e-5)))).alias("order"), x["value"].alias("value")))
    ranked = F.transform(F.array_sort(weights), lambda x: F.struct(x["value"].alias("value"), (-x["order"]).alias("weight")))
    keep = 1 if not sample else top_k
    if keep:
        ranked = F.slice(ranked, 1, keep)
    if top_p is not None and 0 < top_p < 1:
        total = F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x["weight"])
        start = F.struct(F.lit(0.0).alias("sum"), F.slice(ranked, 1, 0).alias("kept"))
        step = lambda s, x: F.when(s["sum"] > top_p * total, s).otherwise(F.struct((s["sum"] + x["weight"]).alias("sum"), F.concat(s["kept"], F.array(x)).alias("kept")))
        ranked = F.aggregate(ranked, start, step)["kept"]
    return ranked


def drawn(rows: DataFrame, counts: DataFrame, cols: Sequence[str], seed: int, begin: int = 0, **shape) -> DataFrame:
    """Adds the text columns cols[begin:] to rows (row and cols[:begin]), each value drawn given the one before; rows whose last value has no follower go.

    The same rows come for the same seed. Each column is a join on the value before, so rows and chains are both spread. shape: see shaped.
    """
    choices = counts.groupBy("step", F.col("before").alias("_before")).agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("_choices"))
    choices = choices.withColumn("_choices", shaped(F.col("_choices"), **shape)).withColumn("_total", F.aggregate("_choices", F.lit(0.0), lambda s, x: s + x["weight"]))
    out = rows
    for k, c in enumerate(cols[begin:], begin):
        step = choices.where(F.col("step") == k).drop("step")
        on = F.lit(None).cast("string") if k == 0 else out[cols[k - 1]].cast("string")
        out = out.join(step, on.eqNullSafe(step["_before"]))
        target = _unit(F.lit(seed), F.lit(k), "row") * F.col("_total")
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("done"))

        def walk(a: Column, x: Column) -> Column:
            upto = a["sum"] + x["weight"]
            return F.when(a["done"], a).otherwise(F.struct(upto.alias("sum"), x["value"].alias("value"), (upto > target).alias("done")))

        out = out.withColumn(c, F.aggregate("_choices", start, walk)["value"]).drop("_before", "_choices", "_total")
    return out


def generated(counts: DataFrame, cols: Sequence[str], rows: int, seed: int, **shape) -> DataFrame:
    """row and one text column per name."""
    return drawn(counts.sparkSession.range(rows).withColumnRenamed("id", "row"), counts, cols, seed, **shape)


def completed(prefixes: DataFrame, counts: DataFrame, cols: Sequence[str], samples: int = 1, seed: int = 7, **shape) -> DataFrame:
    """Each row of prefixes `samples` times, completed to all columns; the columns given must be the first of cols, in their order.

    row tells the results apart, those of repeated prefixes too; it is the same for prefixes in the same partitions. Rows that end in a value no row of the counted table had there give none.
    """
    given = prefixes.columns
    if given != list(cols[: len(given)]):
        raise ValueError(f"columns given must be the first of {list(cols)}, not {given}")
    rows = prefixes.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in given), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_sample"))
    # written once numbered, so a task that runs again finds the same ids
    rows = staged(rows.drop("_sample").withColumn("row", F.monotonically_increasing_id()))
    return drawn(rows, counts, cols, seed, begin=len(given), **shape)


def generated_under_rules(df: DataFrame, cols: Sequence[str], rules: Sequence[Rule], rows: int, seed: int = 7, over: int = 4, rounds: int = 8) -> DataFrame:
    """`rows` rows that obey the rules, by drawing `over` times as many until enough are good; fails after `rounds` doublings."""
    counts = staged(transitions(df, cols))
    for k in range(rounds):
        drawn = generated(counts, cols, rows * over << k, seed + k)
        typed = drawn.select("row", *(F.col(c).cast(df.schema[c].dataType).alias(c) for c in cols))
        for r in rules:
            typed = typed.where(r.condition)
        if typed.limit(rows).count() == rows:
            return typed.orderBy("row").limit(rows)
    raise ValueError("the rules leave too few of the drawn rows")


def row_tokens(numbers: Sequence[str], categories: Sequence[str], order: Sequence[str], digits: int, places: int = 0) -> Column:
    """A row as tokens: begin, then for each column its mark, its value (a category whole, a number digit by digit with its sign) and an end mark, then end."""
    parts = [F.array(F.lit("<BOS>"))]
    for c in order:
        if c not in numbers and c not in categories:
            raise ValueError(f"{c} is neither a number nor a category")
        value = F.split(fixed_width(F.col(f"`{c}`"), digits, places), "") if c in numbers else F.array(F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")))
        parts.append(F.concat(F.array(F.lit(f"<FIELD::{c}>")), value, F.array(F.lit("<END_FIELD>"))))
    return F.concat(*parts, F.array(F.lit("<EOS>")))


def from_row_tokens(tokens: Column, numbers: Sequence[str], order: Sequence[str], places: int = 0) -> dict[str, Column]:
    """The columns of a row from its tokens, by name; null where the row has no such column."""
    out = {}
    for c in order:
        begin = F.array_position(tokens, f"<FIELD::{c}>").cast("int")
        rest = F.slice(tokens, F.when(begin > 0, begin + 1).otherwise(1), F.size(tokens))
        value = F.array_join(F.slice(rest, 1, F.greatest(F.array_position(rest, "<END_FIELD>").cast("int") - 1, F.lit(0))), "")
        value = from_fixed_width(value, places) if c in numbers else F.substring(value, len(c) + 2, 1 << 30)
        out[c] = F.when(begin > 0, value)
    return out


def vocabulary(tokens: DataFrame, col: str) -> DataFrame:
    """token, token_id (0.. in the order of tokens): the different tokens of a table, as many as marks, digits and categories."""
    found = tokens.select(F.explode(col).alias("token")).distinct()
    return found.select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("token_id"))
