"""Rule sets over a table: satisfaction, violations, overrides, cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """condition: a Column that is never null (see veritab.functions.logic)."""

    rule_id: str
    condition: Column = field(compare=False)
    text: str = ""
    fields: tuple[str, ...] = ()
    enabled: bool = True


def enabled(rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if r.enabled]


def satisfaction(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule_id, satisfaction (share of the rows on which the rule holds), in one pass."""
    rules = enabled(rules)
    one = df.agg(*(F.avg(r.condition.cast("int")).alias(f"r{k}") for k, r in enumerate(rules)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"r{k}").alias("satisfaction")) for k, r in enumerate(rules)))))


def _broken(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*(F.when(~r.condition, F.lit(r.rule_id)) for r in enabled(rules))))


def violations(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """A row for each rule that a row breaks: keys, rule_id, observed (the rule's columns as text)."""
    observed = {r.rule_id: F.to_json(F.struct(*r.fields)) if r.fields else F.lit("{}") for r in rules}
    pairs = F.array_compact(F.array(*(F.when(~r.condition, F.struct(F.lit(r.rule_id).alias("rule_id"), observed[r.rule_id].alias("observed"))) for r in enabled(rules))))
    return df.select(*keys, F.explode(pairs).alias("v")).select(*keys, "v.*")


def sql_function(df: DataFrame, name: str, rules: Mapping[str, str], keys: Sequence[str]) -> None:
    """Makes the session's SQL table function name(rule): keys and rule_id of the rows of df that break the rule; of all rules for null.

    rules: SQL conditions by id; unknown counts as broken. The function is a query that Catalyst puts in its caller's place, so the caller's filters and columns
    reach the scan. The table stands as the temporary view {name}_rows.
    """
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    df.createOrReplaceTempView(f"{name}_rows")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    returned = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    broken = ", ".join(f"CASE WHEN NOT coalesce(CAST(({sql}) AS BOOLEAN), false) THEN {quoted(k)} END" for k, sql in rules.items())
    own = ", ".join(f"`{k}`" for k in keys)
    df.sparkSession.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(rule STRING) RETURNS TABLE({returned}, rule_id STRING)
        RETURN SELECT {own}, broken_rule FROM (SELECT {own}, explode(array_compact(array({broken}))) AS broken_rule FROM {name}_rows)
        WHERE {name}.rule IS NULL OR broken_rule = {name}.rule"""
    )


def violations_capped(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], order: Sequence[str], most: int = 50) -> DataFrame:
    """The first `most` violations of each rule (a report; counts come from violations_by_rule)."""
    w = Window.partitionBy("rule_id").orderBy(*order)
    return violations(df, rules, keys).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def violations_by_rule(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule_id and number of rows that break it, rules without violations included; one pass."""
    rules = enabled(rules)
    one = df.agg(*(F.count_if(~r.condition).alias(f"r{k}") for k, r in enumerate(rules)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"r{k}").alias("n")) for k, r in enumerate(rules)))))


def row_satisfaction(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """n_rows, n_bad (rows that break any rule), satisfaction = 1 - n_bad / n_rows."""
    bad = F.count_if(F.size(_broken(rules)) > 0)
    return df.agg(F.count("*").alias("n_rows"), bad.alias("n_bad")).withColumn("satisfaction", 1 - F.try_divide("n_bad", "n_rows"))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that break nothing, and the others with the ids of what they break."""
    marked = df.withColumn("broken", _broken(rules))
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def counterexamples(df: DataFrame, rules: Sequence[Rule], query: Column) -> DataFrame:
    """Rows that obey all rules and not the query: none means that on this table the rules entail it."""
    ok = df
    for r in enabled(rules):
        ok = ok.where(r.condition)
    return ok.where(~query)


def override(learned: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual rules replace learned ones of the same id."""
    return learned.join(manual, "rule_id", "left_anti").withColumn("origin", F.lit("learned")).unionByName(manual.withColumn("origin", F.lit("manual")))


def origins(rules: DataFrame, forced: str | None = None) -> DataFrame:
    """Adds origin: the forced one; else that in `source.origin`, if it is learned or manual; else learned where the source names a learner or predicates, and manual where not.

    source: a struct with any of the fields origin, learner, predicate_ids; null, an empty learner and an empty list count as absent.
    """
    have = set(rules.schema["source"].dataType.fieldNames())
    part = lambda name: F.col(f"source.{name}") if name in have else F.lit(None)
    named = F.coalesce(F.trim(part("learner").cast("string")) != "", F.lit(False))
    if "predicate_ids" in have:
        named = named | F.coalesce(F.size("source.predicate_ids") > 0, F.lit(False))
    told = part("origin").cast("string")
    found = F.when(told.isin("learned", "manual"), told).when(named, "learned").otherwise("manual")
    return rules.withColumn("origin", F.lit(forced) if forced else found)


def coincidences(rules: DataFrame, known: Sequence[float], least: float = 0.5, odd: float = 0.98) -> DataFrame:
    """Adds coincidence: little support, or an odd constant (over 10, not known) without nearly full support; manual rules are exempt.

    rules: rule_id, support, constants (array of numbers), origin.
    """
    strange = F.exists("constants", lambda c: ~c.isin(list(known)) & (F.abs(c) > 10))
    flag = (F.col("support") < least) | (strange & (F.col("support") < odd))
    return rules.withColumn("coincidence", (F.col("origin") != "manual") & flag)


def kind_of(formula: Column) -> Column:
    """Rule kind from a formula in JSON: by its node, comparisons by operator."""
    node, op = F.get_json_object(formula, "$.kind"), F.get_json_object(formula, "$.op")
    return F.when(node == "implies", "implication").when(node.isin("forall", "exists"), "quantified").when(node == "not", "exclusion").when(node == "compare", F.when(op == "=", "identity").when(op == "!=", "exclusion").otherwise("bound")).otherwise("composite")


def cards(rules: DataFrame, explained: DataFrame) -> DataFrame:
    """Rules with their cards: title and explanation fall back to the rule's own text, support is brought into 0..1."""
    both = rules.join(explained, "rule_id", "left")
    return both.select("rule_id", F.coalesce("title", "rule_id").alias("title"), F.coalesce("explanation", "text").alias("explanation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("support"))).alias("support"))
