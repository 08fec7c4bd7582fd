"""Queries over the driver's tables, one or more for each kind of operator, each with the same query in SQL."""

from __future__ import annotations

import itertools
import re
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions import logic, text
from veritab.operators import checks, flows, joins, mining, predicates, prepare, profile, report, retrieval, rules, windows
from veritab.operators.predicates import Field
from veritab.operators.rules import Rule
from veritab.sources.staging import shared_folder, staged
from veritab.streaming import events as stream
from veritab.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- preparation


@query("SELECT o_orderkey AS k, o_custkey, CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_orderstatus IS NOT NULL")
def preprocess_rename_drop_cast(spark, sf):
    d = prepare.keep_present(table(spark, sf, "orders"), ["o_orderstatus"])
    d = prepare.drop(prepare.rename(d, {"o_orderkey": "k"}), ["o_orderpriority", "o_orderstatus", "o_orderdate", "absent"])
    return prepare.rename(prepare.cast(d, {"o_totalprice": "bigint"}), {"o_totalprice": "price"})


@query("SELECT event_id, event_id AS parsed, CASE WHEN user_id % 2 = 0 THEN user_id END AS plain FROM events")
def preprocess_parse_hex(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("0x"), F.hex("event_id")).alias("h"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("nan").alias("p"))
    return e.select("event_id", prepare.hex_number(F.col("h")).alias("parsed"), prepare.hex_number(F.col("p")).alias("plain"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE coalesce(c_mktsegment, 'none') END AS segment, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0) AS balance FROM customer")
def preprocess_fill_map_values(spark, sf):
    c = table(spark, sf, "customer").withColumn("balance", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    c = prepare.fill(c, {"c_mktsegment": "none", "balance": 0.0})
    return c.select("c_custkey", prepare.mapped(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}).alias("segment"), "balance")


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' WHEN p_size IN (2, 3) THEN 'few' WHEN p_size >= 4 AND p_size < 25 THEN 'mid' ELSE 'large' END AS size_class FROM part")
def map_rules_range(spark, sf):
    r = [{"equals": 1, "value": "one"}, {"in": [2, 3], "value": "few"}, {"range": (4, 25), "open_high": True, "value": "mid"}, {"default": True, "value": "large"}]
    return table(spark, sf, "part").select("p_partkey", prepare.by_rules(F.col("p_size"), T.LongType(), r).alias("size_class"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'std' WHEN regexp_matches(p_type, 'BRASS|STEEL') THEN 'metal' ELSE p_type END AS class FROM part")
def map_rules_prefix_regex(spark, sf):
    r = [{"equals": 5, "value": "never"}, {"prefix": "STANDARD", "value": "std"}, {"regex": "BRASS|STEEL", "value": "metal"}]
    return table(spark, sf, "part").select("p_partkey", prepare.by_rules(F.col("p_type"), T.StringType(), r).alias("class"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND trim(o_orderpriority) <> ''")
def filter_equals_in_present(spark, sf):
    o = prepare.keep_equal(table(spark, sf, "orders"), {"o_orderstatus": "F", "absent": 1})
    o = prepare.keep_in(o, {"o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return prepare.keep_present(o, ["o_orderpriority"]).select("o_orderkey", "o_orderstatus")


@query("""SELECT * FROM (VALUES ('c_custkey'), ('c_acctbal'), ('segment'), ('name')) v("column") JOIN (
 SELECT 'c_custkey' AS "column", count_if(c_custkey IS NULL)::BIGINT AS n_missing, 0::BIGINT AS n_blank FROM customer
 UNION ALL SELECT 'c_acctbal', count_if(c_acctbal IS NULL)::BIGINT, 0 FROM customer
 UNION ALL SELECT 'segment', count_if(c_custkey % 7 = 0)::BIGINT, 0 FROM customer
 UNION ALL SELECT 'name', 0, count_if(c_custkey % 5 = 0)::BIGINT FROM customer) USING ("column")""")
def incomplete_columns(spark, sf):
    c = table(spark, sf, "customer")
    c = c.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    return prepare.incomplete_columns(c)


@query("""SELECT 'p_partkey' AS "column", 'integer' AS value_type UNION ALL SELECT 'p_size', 'integer' UNION ALL SELECT 'p_retailprice', 'real'
 UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) <= 32 THEN 'categorical' ELSE 'string' END FROM part
 UNION ALL SELECT 'p_brand', CASE WHEN count(DISTINCT p_brand) <= 32 THEN 'categorical' ELSE 'string' END FROM part
 UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT p_type) <= 32 THEN 'categorical' ELSE 'string' END FROM part""")
def infer_value_types(spark, sf):
    return prepare.value_types(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_name", "p_brand", "p_type"))


# ---- context windows and derived columns


def _event_windows(spark, sf, size=3, stride=1):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))
    return windows.context_windows(e, ["user_id"], ["us", "event_id"], size, stride)


_WINDOWS = "WITH w AS (SELECT user_id, event_id AS e0, lead(event_id) OVER k AS e1, lead(event_id, 2) OVER k AS e2, event_type AS t0, lead(event_type, 2) OVER k AS t2, epoch_us(ts) AS u0, lead(epoch_us(ts)) OVER k AS u1, lead(epoch_us(ts), 2) OVER k AS u2, row_number() OVER k AS rn FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)) "


@query(_WINDOWS + "SELECT user_id, e0, e1, e2, t0, t2 FROM w WHERE e2 IS NOT NULL")
def context_window_events(spark, sf):
    w = _event_windows(spark, sf)
    return w.select(F.col("user_id_ctx0").alias("user_id"), F.col("event_id_ctx0").alias("e0"), F.col("event_id_ctx1").alias("e1"), F.col("event_id_ctx2").alias("e2"), F.col("event_type_ctx0").alias("t0"), F.col("event_type_ctx2").alias("t2"))


@query(_WINDOWS + "SELECT user_id, e0, e2 FROM w WHERE e2 IS NOT NULL AND (rn - 1) % 2 = 0")
def context_window_stride(spark, sf):
    w = _event_windows(spark, sf, stride=2)
    return w.select(F.col("user_id_ctx0").alias("user_id"), F.col("event_id_ctx0").alias("e0"), F.col("event_id_ctx2").alias("e2"))


@query(_WINDOWS + "SELECT e0, u1 - u0 AS gap0, u2 - u1 AS gap1, round(abs((u1 - u0) - (u2 - u1)) / 2.0, 3) AS spread FROM w WHERE e2 IS NOT NULL")
def interarrival_derived(spark, sf):
    w = _event_windows(spark, sf).withColumns({"gap0": F.col("us_ctx1") - F.col("us_ctx0"), "gap1": F.col("us_ctx2") - F.col("us_ctx1")})
    return w.select(F.col("event_id_ctx0").alias("e0"), "gap0", "gap1", F.round(logic.row_std(F.col("gap0"), F.col("gap1")), 3).alias("spread"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS total, least(l_quantity, l_discount * 100) AS low, greatest(l_quantity, l_discount * 100) AS high,
 round((l_quantity + l_tax) / 2, 6) AS mean, l_extendedprice - l_quantity AS diff, round(l_quantity / nullif(l_discount, 0), 6) AS per_discount,
 (CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END + CASE WHEN l_tax <> 0 THEN 1 ELSE 0 END) AS n_set, l_discount <> 0 OR l_tax <> 0 AS any_set, l_discount <> 0 AND l_tax <> 0 AS all_set FROM lineitem""")
def derived_row_aggregates(spark, sf):
    q, d, t, p = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    n = logic.count_nonzero(d, t)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", logic.row_sum(q, t).alias("total"), logic.row_min(q, d * 100).alias("low"), logic.row_max(q, d * 100).alias("high"), F.round(logic.row_avg(q, t), 6).alias("mean"), (p - q).alias("diff"), F.round(logic.ratio(q, d), 6).alias("per_discount"), n.alias("n_set"), (n > 0).alias("any_set"), (n == 2).alias("all_set"))


@query(_WINDOWS + "SELECT e0 AS value FROM w WHERE e2 IS NOT NULL UNION ALL SELECT e1 FROM w WHERE e2 IS NOT NULL UNION ALL SELECT e2 FROM w WHERE e2 IS NOT NULL")
def union_all_family(spark, sf):
    w = _event_windows(spark, sf)
    return windows.family_values(w, windows.families(w.columns)["event_id"])


# ---- profiles


@query("""WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.9]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.9]) AS b FROM lineitem)
 SELECT c AS "column", l AS label, round(v, 6) AS "value" FROM (SELECT 'l_quantity' AS c, unnest(['p25', 'p50', 'p90']) AS l, unnest(a) AS v FROM q UNION ALL SELECT 'l_extendedprice', unnest(['p25', 'p50', 'p90']), unnest(b) FROM q)""")
def profile_quantiles(spark, sf):
    return profile.quantiles(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], [0.25, 0.5, 0.9]).withColumn("value", F.round("value", 6))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def profile_topk(spark, sf):
    return profile.top_values(table(spark, sf, "part"), "p_brand", 5)


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def profile_domain(spark, sf):
    return profile.domain(table(spark, sf, "orders"), "o_orderpriority")


@query("""SELECT 'c_acctbal' AS "column", bool_or(c_acctbal < 0) AS negative, max(length(split_part(CAST(round_even(abs(c_acctbal), 4) AS DECIMAL(18, 4))::VARCHAR, '.', 1)))::INTEGER AS digits, max(length(rtrim(split_part(CAST(round_even(abs(c_acctbal), 4) AS DECIMAL(18, 4))::VARCHAR, '.', 2), '0')))::INTEGER AS places FROM customer UNION ALL SELECT 'c_nationkey' AS "column", bool_or(c_nationkey < 0) AS negative, max(length(abs(c_nationkey)::VARCHAR))::INTEGER AS digits, 0 AS places FROM customer""")
def number_codecs(spark, sf):
    return profile.number_codecs(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])


@query("""SELECT 'c_acctbal' AS "column", bool_or(c_acctbal < 0) AS negative, max(length(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR)))::INTEGER AS digits, min(c_acctbal) AS least, max(c_acctbal) AS greatest FROM customer""")
def number_widths(spark, sf):
    return profile.number_widths(table(spark, sf, "customer"), ["c_acctbal"])


# ---- predicates and rules

LINE = [
    Field("l_quantity", "real", ("count",), constants=(10.0, 25.0, 50.0), scalars=(2000.0,), additions=(1.0,)),
    Field("l_extendedprice", "real", ("size",), constants=(1000.0,), additions=(100.0,)),
    Field("l_discount", "real", ("measurement", "size"), constants=(0.05,)),
    Field("l_tax", "real", ("size",), constants=(0.04,)),
    Field("l_returnflag", "categorical", (), constants=("R", "N")),
    Field("l_linestatus", "categorical", (), constants=("F",)),
]


def _line_predicates():
    return predicates.distinct(predicates.field_constant(LINE, ["<=", "="]))


def _support_sql(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name.replace(chr(39), chr(39) * 2)}' AS text, round(avg(CASE WHEN {sql} THEN 1.0 ELSE 0.0 END), 6) AS support FROM lineitem" for name, sql in parts.items())


def _supports(spark, sf, ps):
    d = table(spark, sf, "lineitem")
    sigs = mining.signatures(d, ps, keep_empty=True)
    return mining.supports(sigs, ps, d.count()).select("text", F.round("support", 6).alias("support"))


@query(_support_sql({p.text: " ".join(p.parts) for p in _line_predicates()}))
def predicate_support(spark, sf):
    return _supports(spark, sf, _line_predicates())


@query(_support_sql({p.text: p.text for p in predicates.distinct(predicates.field_field(LINE, ["<=", ">="]))}))
def field_field_predicates(spark, sf):
    return _supports(spark, sf, predicates.distinct(predicates.field_field(LINE, ["<=", ">="])))


MIXED = [*LINE, Field("l_linenumber", "integer", ("count",)), Field("l_comment_class", "string"), Field("l_late", "boolean")]
_SAME_KIND = [("l_extendedprice", "l_discount"), ("l_quantity", "l_tax"), ("l_returnflag", "l_linestatus"), ("l_returnflag", "l_comment_class")]


def _equalities():
    return predicates.distinct(p for p in predicates.field_field(MIXED, ["=", "!="]) if p.parts[::2] in _SAME_KIND or not {"l_late", "l_linenumber"}.isdisjoint(p.parts))


@query(" UNION ALL ".join(f"SELECT '{a} {op} {b}' AS text, round(avg(CASE WHEN {a} {sql} {b} THEN 1.0 ELSE 0.0 END), 6) AS support FROM (SELECT *, l_linestatus AS l_comment_class FROM lineitem)"
                          for a, b in _SAME_KIND for op, sql in ((o, o) for o in ("=", "!="))))
def field_field_equality(spark, sf):
    """Equality only between fields of one kind, or a category and a string: whole numbers and truth values meet no other field here."""
    d = table(spark, sf, "lineitem").withColumn("l_comment_class", F.col("l_linestatus")).withColumn("l_late", F.lit(True))
    sigs = mining.signatures(d, _equalities(), keep_empty=True)
    return mining.supports(sigs, _equalities(), d.count()).select("text", F.round("support", 6).alias("support"))


_PROFILED = """SELECT 'l_quantity <= p50' AS text, round(avg(CASE WHEN l_quantity <= (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem) THEN 1.0 ELSE 0.0 END), 6) AS support FROM lineitem
 UNION ALL SELECT 'l_quantity <= p90', round(avg(CASE WHEN l_quantity <= (SELECT quantile_cont(l_quantity, 0.9) FROM lineitem) THEN 1.0 ELSE 0.0 END), 6) FROM lineitem
 UNION ALL SELECT 'l_returnflag = top1', round(avg(CASE WHEN l_returnflag = (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) THEN 1.0 ELSE 0.0 END), 6) FROM lineitem"""


@query(_PROFILED)
def profiled_predicates(spark, sf):
    """Fields chosen by pattern and role, their constants taken from the table."""
    d = table(spark, sf, "lineitem")
    chosen = predicates.select_fields(LINE, pattern="l_q", roles=["count"]) + predicates.select_fields(LINE, names=["l_returnflag"])
    chosen = predicates.profiled(d, chosen, (0.5, 0.9))
    ps = predicates.distinct(predicates.field_constant(chosen[:1], ["<="]) + predicates.field_constant(chosen[1:], ["="]))
    return mining.supports(mining.signatures(d, ps, keep_empty=True), ps, d.count()).select("text", F.round("support", 6).alias("support"))


@query(_support_sql({p.text: p.text for p in predicates.distinct(predicates.scaled_field(LINE, [">="]) + predicates.summed_fields(LINE, ["<="]))}))
def scalar_addition_predicates(spark, sf):
    return _supports(spark, sf, predicates.distinct(predicates.scaled_field(LINE, [">="]) + predicates.summed_fields(LINE, ["<="])))


@query("""WITH w AS (SELECT p_partkey AS k0, lead(p_partkey) OVER o AS k1, lead(p_partkey, 2) OVER o AS k2, row_number() OVER o AS r FROM part WINDOW o AS (ORDER BY p_size, p_partkey))
 SELECT k0 AS p_partkey_ctx0, k1 AS p_partkey_ctx1, k2 AS p_partkey_ctx2 FROM w WHERE k2 IS NOT NULL AND (r - 1) % 2 = 0""")
def context_window_unkeyed(spark, sf):
    """The table as one run of rows, cut to blocks of 64 positions."""
    return windows.context_windows(table(spark, sf, "part"), [], ["p_size", "p_partkey"], 3, 2, ["p_partkey"], block_rows=64)


@query("""WITH w AS (SELECT p_brand, p_partkey AS k0, lead(p_partkey) OVER o AS k1 FROM (SELECT p_brand, p_partkey, nullif(p_size % 7, 3) AS s FROM part) WINDOW o AS (PARTITION BY p_brand ORDER BY s NULLS LAST, p_partkey))
 SELECT p_brand, k0 AS p_partkey_ctx0, k1 AS p_partkey_ctx1 FROM w WHERE k1 IS NOT NULL""")
def context_window_nulls(spark, sf):
    """Rows without an order key come last in their partition."""
    d = table(spark, sf, "part").select("p_brand", "p_partkey", F.nullif(F.col("p_size") % 7, F.lit(3)).alias("s"))
    return windows.context_windows(d, ["p_brand"], ["s", "p_partkey"], 2, cols=["p_partkey", "p_brand"]).select(F.col("p_brand_ctx0").alias("p_brand"), "p_partkey_ctx0", "p_partkey_ctx1")


@query("""WITH w AS (SELECT event_type AS kind, event_id AS e0, lead(event_id, 4) OVER o AS e4, row_number() OVER o AS r FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id))
 SELECT kind, e0, e4 FROM w WHERE e4 IS NOT NULL AND (r - 1) % 3 = 0""")
def context_window_hot_keys(spark, sf):
    """Few partition keys with many rows each: every partition is spread over blocks of 500 rows."""
    d = windows.context_windows(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 5, 3, ["event_type", "event_id"], block_rows=500)
    return d.select(F.col("event_type_ctx0").alias("kind"), F.col("event_id_ctx0").alias("e0"), F.col("event_id_ctx4").alias("e4"))


@query(_WINDOWS + "SELECT count(*)::BIGINT AS n, count_if(least(e0, e1, e2) >= 100)::BIGINT AS every, count_if(greatest(e0, e1, e2) >= 100)::BIGINT AS some, count_if(e0 <> 100 AND e1 <> 100 AND e2 <> 100)::BIGINT AS none_is FROM w WHERE e2 IS NOT NULL")
def quantifier_forall_exists(spark, sf):
    w = _event_windows(spark, sf)
    family = windows.families(w.columns)["event_id"]
    every, some, differ = (predicates.quantified(family, "event_id", [op], [100], e)[0].column for op, e in ((">=", True), (">=", False), ("!=", True)))
    return w.agg(F.count("*").alias("n"), F.count_if(every).alias("every"), F.count_if(some).alias("some"), F.count_if(differ).alias("none_is"))


@query("SELECT concat_ws(',', " + ", ".join(f"CASE WHEN {' '.join(p.parts)} THEN {i} END" for i, p in enumerate(_line_predicates())) + ") AS sig, count(*) AS w FROM lineitem GROUP BY 1 HAVING sig <> ''")
def evidence_signatures(spark, sf):
    sigs = mining.signatures(table(spark, sf, "lineitem"), _line_predicates())
    return sigs.select(F.array_join(F.transform("sig", lambda i: i.cast("string")), ",").alias("sig"), "w")


@query(ORACLE_SQL["evidence_signatures"])
def additive_signatures(spark, sf):
    """Evidence kept for each input file and merged: the second call reads no file again."""
    folder = f"{shared_folder(spark)}/evidence-{uuid.uuid4().hex}"
    for _ in range(2):
        sigs = mining.file_signatures(spark, f"{sf}/lineitem.parquet", _line_predicates(), folder)
    return sigs.select(F.array_join(F.transform("sig", lambda i: i.cast("string")), ",").alias("sig"), "w")


def _cover_sql(columns: str) -> str:
    """All clauses of up to three predicates that hold on every row with evidence, without those that have a smaller one inside."""
    ps = _line_predicates()
    n, name = len(ps), lambda c: " or ".join(ps[i].text.replace("'", "''") for i in c)
    flags = ", ".join(f"coalesce({' '.join(p.parts)}, false) AS f{i}" for i, p in enumerate(ps))
    clauses = [c for size in (1, 2, 3) for c in itertools.combinations(range(n), size)]
    holds = lambda c: "(" + " OR ".join(f"f{i}" for i in c) + ")"
    tried = ", ".join(f"bool_and({holds(c)}) FILTER (WHERE e) AS c{k}, avg({holds(c)}::INT) AS s{k}" for k, c in enumerate(clauses))
    # a clause counts if it covers and none of the clauses inside it does
    inside = {k: [clauses.index(x) for size in range(1, len(c)) for x in itertools.combinations(c, size)] for k, c in enumerate(clauses)}
    rows = ", ".join(f"('{name(c)}', c{k}{''.join(f' AND NOT c{x}' for x in inside[k])}, round(s{k}, 6))" for k, c in enumerate(clauses))
    return f"""WITH f AS (SELECT {flags} FROM lineitem), g AS (SELECT *, {' OR '.join(f'f{i}' for i in range(n))} AS e FROM f), t AS (SELECT {tried} FROM g)
 SELECT {columns} FROM t, LATERAL (VALUES {rows}) r(rule, ok, support) WHERE ok"""


@query(_cover_sql("rule"))
def hitting_set_rules(spark, sf):
    ps = _line_predicates()
    clauses = mining.minimal_covers(mining.signatures(table(spark, sf, "lineitem"), ps), 3)
    return mining.clause_text(clauses, ps).select("rule")


@query(_cover_sql("rule, support"))
def rule_support(spark, sf):
    """Covers with their support counted again over all rows, those without evidence included."""
    ps = _line_predicates()
    sigs = staged(mining.signatures(table(spark, sf, "lineitem"), ps, keep_empty=True))
    clauses = mining.without_tautologies(mining.minimal_covers(sigs.where(F.size("sig") > 0), 3), ps)
    rows = sigs.agg(F.sum("w")).first()[0] or 0
    found = mining.clause_support(clauses, sigs, rows)
    return mining.clause_text(found, ps).select("rule", F.round("support", 6).alias("support"))


def _wide_predicates():
    """93 predicates over columns of few values: thousands of signatures at any size of the table."""
    numbers = Field("l_linenumber", "integer", constants=tuple(range(1, 8)))
    discount = Field("l_discount", "real", constants=tuple(k / 100 for k in range(11)))
    tax, quantity = Field("l_tax", "real", constants=tuple(k / 100 for k in range(9))), Field("l_quantity", "real", constants=(15.0, 35.0))
    kinds = [Field("l_returnflag", "string", constants=("A", "N", "R")), Field("l_linestatus", "string", constants=("F", "O"))]
    middle = [replace(quantity, constants=(25.0,))]
    made = predicates.field_constant([numbers], ["=", "!=", "<=", ">"]) + predicates.field_constant([discount], ["=", "<=", ">"])
    made += predicates.field_constant([tax, quantity], ["<=", ">"]) + predicates.field_constant(kinds, ["=", "!="]) + predicates.field_constant(middle, ["="])
    return predicates.distinct(made)


def _pair_sql() -> str:
    """Predicates that hold on every row with evidence, and pairs of others of which one does."""
    ps = _wide_predicates()
    flags = ", ".join(f"coalesce({' '.join(p.parts)}, false) AS f{i}" for i, p in enumerate(ps))
    names = ", ".join(f"({i}, '{p.text.replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(ps))
    pairs = [(i, j) for i in range(len(ps)) for j in range(i, len(ps))]
    tried = ", ".join(f"bool_and(f{i} OR f{j})" for i, j in pairs)
    places = ", ".join(f"[{i}, {j}]" for i, j in pairs)
    return f"""WITH f AS (SELECT DISTINCT {flags} FROM lineitem), g AS (SELECT * FROM f WHERE {' OR '.join(f'f{i}' for i in range(len(ps)))}),
 t AS (SELECT unnest([{tried}]) AS ok, unnest([{places}]) AS pair FROM g), c AS (SELECT pair[1] AS i, pair[2] AS j FROM t WHERE ok), s AS (SELECT i FROM c WHERE i = j),
 n(k, name) AS (VALUES {names})
 SELECT CASE WHEN i = j THEN a.name ELSE a.name || ' or ' || b.name END AS rule FROM c JOIN n a ON a.k = i JOIN n b ON b.k = j
 WHERE i = j OR (i NOT IN (SELECT i FROM s) AND j NOT IN (SELECT i FROM s))"""


@query(_pair_sql())
def wide_pair_rules(spark, sf):
    """Covers of at most two of 93 predicates."""
    ps = _wide_predicates()
    return mining.clause_text(mining.minimal_covers(mining.signatures(table(spark, sf, "lineitem"), ps), 2), ps).select("rule")


@query()
def first_wide_rules(spark, sf):
    """The first 100 covers of at most ten of 93 predicates. Which are first is the search's order, so there is no SQL; each is minimal and holds."""
    ps = _wide_predicates()
    return mining.clause_text(mining.minimal_covers(mining.signatures(table(spark, sf, "lineitem"), ps), 10, first=100), ps).select("clause", "rule")


def _tree_sql(targets, depth: int, columns: str) -> str:
    """Trees level by level over the different rows of flags."""
    ps = _line_predicates()
    entropy = lambda n, k: f"{n} * (h({k} / {n}) + h(1 - {k} / {n}))"
    out = f"""WITH f AS (SELECT {', '.join(f"coalesce({' '.join(p.parts)}, false) AS f{i}" for i, p in enumerate(ps))} FROM lineitem),
 s AS (SELECT row_number() OVER () AS id, * FROM (SELECT *, count(*) AS w FROM f GROUP BY ALL)),
 e AS ({' UNION ALL '.join(f'SELECT id, {i} AS p FROM s WHERE f{i}' for i in range(len(ps)))}),
 r0 AS (SELECT t.target, '' AS path, id, w, ({' OR '.join(f'(t.target = {i} AND f{i})' for i in targets)})::INT AS y FROM s, (VALUES {', '.join(f'({i})' for i in targets)}) t(target))"""
    one = lambda x: f"(CASE WHEN {x} > 0 THEN -({x}) * log2({x}) ELSE 0.0 END)"
    for k in range(depth):
        after = f"{entropy('c.n1', 'c.k1')} + {entropy('(n.n - c.n1)', '(n.k - c.k1)')}"
        text = f""",
 n{k} AS (SELECT target, path, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS k FROM r{k} GROUP BY 1, 2),
 c{k} AS (SELECT target, path, p, sum(w)::DOUBLE AS n1, sum(w * y)::DOUBLE AS k1 FROM r{k} JOIN e USING (id) WHERE p <> target GROUP BY 1, 2, 3),
 g{k} AS (SELECT target, path, p, n.n, n.k, round({after}, 9) AS after FROM c{k} c JOIN n{k} n USING (target, path) WHERE n1 < n AND k > 0 AND k < n),
 b{k} AS (SELECT target, path, arg_min(p, (after, p)) AS p FROM g{k} WHERE after < {entropy('n', 'k')} - 1e-9 GROUP BY 1, 2),
 r{k + 1} AS (SELECT target, path || CASE WHEN path = '' THEN '' ELSE ',' END || CASE WHEN e.id IS NULL THEN -p - 1 ELSE p END AS path, r.id, w, y
   FROM (SELECT r.*, b.p FROM r{k} r JOIN b{k} b USING (target, path)) r LEFT JOIN e USING (id, p))"""
        out += re.sub(r"h\(([^()]*(?:\([^()]*\)[^()]*)*)\)", lambda m: one(m[1]), text)
    ends = [f"SELECT n.* FROM n{k} n ANTI JOIN b{k} b USING (target, path)" for k in range(depth)]
    ends.append(f"SELECT target, path, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS k FROM r{depth} GROUP BY 1, 2")
    return f"{out} SELECT {columns} FROM ({' UNION ALL '.join(ends)})"


_TREE_TARGET = next(i for i, p in enumerate(_line_predicates()) if p.text == "l_linestatus = 'F'")
_LEAF = "path, n::BIGINT AS w, round(k / n, 6) AS share"


def _leaf(leaves):
    return leaves.withColumn("path", F.array_join(F.transform("path", lambda i: i.cast("string")), ","))


@query(_tree_sql([_TREE_TARGET], 3, _LEAF))
def tree_rules(spark, sf):
    leaves = mining.entropy_tree(mining.signatures(table(spark, sf, "lineitem"), _line_predicates(), keep_empty=True), _TREE_TARGET, 3)
    return _leaf(leaves).select("path", "w", "share")


@query(_tree_sql(range(len(_line_predicates())), 2, "target, " + _LEAF))
def all_tree_rules(spark, sf):
    """A tree for each predicate, in one pass a level."""
    ps = _line_predicates()
    leaves = mining.entropy_trees(mining.signatures(table(spark, sf, "lineitem"), ps, keep_empty=True), range(len(ps)), 2)
    return _leaf(leaves).select("target", "path", "w", "share")


def _line_rules() -> list[Rule]:
    q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return [
        Rule("A1", logic.le(d, 0.05), "l_discount <= 0.05", ("l_discount",)),
        Rule("A2", logic.ge(p, q), "l_extendedprice >= l_quantity", ("l_extendedprice", "l_quantity")),
        Rule("A3", logic.le(t, 0.08), "l_tax <= 0.08", ("l_tax",)),
        Rule("A4", logic.implies(logic.eq(F.col("l_returnflag"), "R"), logic.eq(F.col("l_linestatus"), "F")), "l_returnflag = 'R' -> l_linestatus = 'F'", ("l_returnflag", "l_linestatus")),
        Rule("A5", logic.holds("l_quantity * 2000 >= l_extendedprice"), "l_quantity * 2000 >= l_extendedprice", ("l_quantity", "l_extendedprice")),
        Rule("A6", logic.eq(d, 99.0), "off", ("l_discount",), enabled=False),
    ]


_LINE_RULES = {"A1": "l_discount <= 0.05", "A2": "l_extendedprice >= l_quantity", "A3": "l_tax <= 0.08", "A4": "(l_returnflag <> 'R' OR l_linestatus = 'F')", "A5": "l_quantity * 2000 >= l_extendedprice"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule_id, round(avg(CASE WHEN {s} THEN 1.0 ELSE 0.0 END), 6) AS satisfaction FROM lineitem" for k, s in _LINE_RULES.items()))
def rule_validation(spark, sf):
    return rules.satisfaction(table(spark, sf, "lineitem"), _line_rules()).withColumn("satisfaction", F.round("satisfaction", 6))


@query(f"""SELECT o_orderpriority, 'A1' AS rule_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT ({_LINE_RULES['A1']}) GROUP BY ALL
 UNION ALL SELECT o_orderpriority, 'A4', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT {_LINE_RULES['A4']} GROUP BY ALL""")
def sql_rule_function(spark, sf):
    """Rules called as a table function from SQL, joined and grouped there."""
    rules.sql_function(table(spark, sf, "lineitem"), "broken_line_rules", _LINE_RULES, ["l_orderkey"])
    table(spark, sf, "orders").createOrReplaceTempView("orders_of_rules")
    return spark.sql("""SELECT o_orderpriority, rule_id, count(*) AS n FROM (SELECT * FROM broken_line_rules('A1') UNION ALL SELECT * FROM broken_line_rules(NULL) WHERE rule_id = 'A4')
 JOIN orders_of_rules ON l_orderkey = o_orderkey GROUP BY o_orderpriority, rule_id""")


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule_id, count_if(NOT ({s}))::BIGINT AS n FROM lineitem" for k, s in _LINE_RULES.items()))
def violations_by_rule(spark, sf):
    return rules.violations_by_rule(table(spark, sf, "lineitem"), _line_rules())


@query(f"SELECT count(*) AS n_rows, count_if(NOT ({' AND '.join(_LINE_RULES.values())}))::BIGINT AS n_bad, round(1 - count_if(NOT ({' AND '.join(_LINE_RULES.values())})) / count(*), 6) AS satisfaction FROM lineitem")
def satisfaction_rate_rows(spark, sf):
    return rules.row_satisfaction(table(spark, sf, "lineitem"), _line_rules()).withColumn("satisfaction", F.round("satisfaction", 6))


@query("""WITH v AS (SELECT o_orderkey, 'B1' AS rule_id FROM orders WHERE NOT (o_totalprice <= 200000) UNION ALL SELECT o_orderkey, 'B2' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT')
 SELECT o_orderkey, rule_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY o_orderkey) AS place FROM v) WHERE place <= 50""")
def rule_violations_capped(spark, sf):
    rs = [Rule("B1", logic.le(F.col("o_totalprice"), 200000), fields=("o_totalprice",)), Rule("B2", logic.implies(logic.eq(F.col("o_orderstatus"), "P"), logic.eq(F.col("o_orderpriority"), "1-URGENT")), fields=("o_orderstatus",))]
    return rules.violations_capped(table(spark, sf, "orders"), rs, ["o_orderkey"], ["o_orderkey"]).select("o_orderkey", "rule_id", "place")


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount <= 0.05 AND l_tax <= 0.04 AND NOT (l_discount + l_tax <= 0.08)")
def entailment_counterexamples(spark, sf):
    rs = [Rule("C1", logic.holds("l_discount <= 0.05")), Rule("C2", logic.holds("l_tax <= 0.04"))]
    return rules.counterexamples(table(spark, sf, "lineitem"), rs, logic.holds("l_discount + l_tax <= 0.08")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(x <> 1, true) AS ne, NOT coalesce(x = 1, false) AS not_eq, coalesce(x > 0, false) AS gt, NOT coalesce(x > 0, false) OR coalesce(x < 5, false) AS implied
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END AS x FROM customer)""")
def implication_negation_nulls(spark, sf):
    x = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 7)
    return table(spark, sf, "customer").select("c_custkey", logic.ne(x, 1).alias("ne"), (~logic.eq(x, 1)).alias("not_eq"), logic.gt(x, 0).alias("gt"), logic.implies(logic.gt(x, 0), logic.lt(x, 5)).alias("implied"))


@query("SELECT event_id, ((event_id - 50) % 4 + 4) % 4 AS m, CAST(NULL AS BIGINT) AS zero, CASE WHEN (event_id - 50) % 4 = 0 THEN 0 ELSE ((event_id - 50) % 4 + 4) % 4 - 4 END AS negative FROM events")
def mod_rule(spark, sf):
    x = F.col("event_id") - 50
    return table(spark, sf, "events").select("event_id", logic.floor_mod(x, F.lit(4)).alias("m"), logic.floor_mod(x, F.lit(0)).alias("zero"), logic.floor_mod(x, F.lit(-4)).alias("negative"))


# ---- checks over periods, bands and identities; repair


def _months(spark, sf):
    o = table(spark, sf, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return o.groupBy("o_custkey", month.alias("m")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


_MONTHS = "WITH c AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY ALL) "


@query(_MONTHS + "SELECT o_custkey, m, cents, CASE WHEN m - lag(m) OVER w = 1 THEN lag(cents) OVER w END AS before FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY m)")
def cross_period_lag_check(spark, sf):
    return _months(spark, sf).withColumn("before", windows.previous("cents", ["o_custkey"], "m"))


@query(_MONTHS + "SELECT c.o_custkey, c.m, c.cents, b.cents AS cents_before FROM c JOIN c b ON b.o_custkey = c.o_custkey AND b.m = c.m - 4 WHERE c.cents >= 2 * b.cents")
def yoy_divergence(spark, sf):
    d = windows.at_offset(_months(spark, sf), ["o_custkey"], "m", ["cents"], 4)
    return d.where(F.col("cents") >= 2 * F.col("cents_before"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, o_totalprice AS price FROM orders),
 l AS (SELECT o_custkey, m, arg_max(price, o_orderkey) AS price FROM o GROUP BY 1, 2)
 SELECT o.o_orderkey, l.price AS price_before FROM o LEFT JOIN l ON l.o_custkey = o.o_custkey AND l.m = o.m - 4""")
def repeated_period_lookup(spark, sf):
    """The value four months before; where a customer has several orders in that month, the last one's."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), F.col("o_totalprice").alias("price"))
    return windows.at_offset(o, ["o_custkey"], "m", ["price"], 4, last=["o_orderkey"]).select("o_orderkey", "price_before")


@query("WITH b AS (SELECT p_brand, quantile_cont(p_retailprice, 0.1) AS low, quantile_cont(p_retailprice, 0.9) AS high FROM part GROUP BY 1) SELECT p_partkey FROM part JOIN b USING (p_brand) WHERE NOT (p_retailprice BETWEEN low AND high)")
def band_check(spark, sf):
    p = table(spark, sf, "part")
    bands = p.groupBy("p_brand").agg(F.percentile("p_retailprice", 0.1).alias("low"), F.percentile("p_retailprice", 0.9).alias("high"))
    return p.join(bands, "p_brand").where(~(logic.ge(F.col("p_retailprice"), F.col("low")) & logic.le(F.col("p_retailprice"), F.col("high")))).select("p_partkey")


@query("""WITH b AS (SELECT p_brand, p_size % 5 AS band, min(p_retailprice) + 150 AS low, max(p_retailprice) - 150 AS high FROM part GROUP BY ALL)
 SELECT p_partkey, band, low <= high AS ok FROM part LEFT JOIN b ON b.p_brand = part.p_brand AND p_retailprice BETWEEN low AND high""")
def overlapping_bands(spark, sf):
    """Five bands a brand, which overlap: each part with all that hold its price, or with none; hot bins are split at 50 rows."""
    p = table(spark, sf, "part")
    bands = p.groupBy("p_brand", (F.col("p_size") % 5).alias("band")).agg((F.min("p_retailprice") + 150).alias("low"), (F.max("p_retailprice") - 150).alias("high"))
    found = joins.band_join(p.select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", bands, "low", "high", ["p_brand"], bins=8, most_rows=50, left=True)
    return found.select("p_partkey", "band", (F.col("low") <= F.col("high")).alias("ok"))


def _books(spark, sf):
    """Orders as small accounts, some of them with a wrong total."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice")).cast("long").alias("Revenue"))
    o = o.withColumn("COGS", F.floor(F.col("Revenue") / 3)).withColumn("GrossProfit", F.col("Revenue") - F.col("COGS") + F.when(F.col("id") % 11 == 0, 7).otherwise(0))
    return o.withColumn("TotalAssets", F.col("Revenue") * 2).withColumn("TotalEquity", F.col("Revenue")).withColumn("TotalLiabilities", F.col("Revenue") + F.when(F.col("id") % 13 == 0, 5).otherwise(0))


_BOOKS = "WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS r FROM orders) "


@query(_BOOKS + "SELECT id, 'R05' AS rule_id FROM o WHERE id % 11 = 0 UNION ALL SELECT id, 'R02' FROM o WHERE id % 13 = 0")
def identity_check(spark, sf):
    rs = [r for r in checks.identity_rules() if r.rule_id != "R01"]
    return rules.violations(_books(spark, sf), rs, ["id"]).select("id", "rule_id")


@query(_BOOKS + "SELECT id, 'GrossProfit' AS \"column\", CAST(r - r // 3 + 7 AS VARCHAR) AS old, CAST(r - r // 3 AS VARCHAR) AS new FROM o WHERE id % 11 = 0 UNION ALL SELECT id, 'TotalLiabilities', CAST(r + 5 AS VARCHAR), CAST(r AS VARCHAR) FROM o WHERE id % 13 = 0")
def repair_identity(spark, sf):
    b = _books(spark, sf).withColumns({"CompanyId": F.col("id"), "PeriodIndex": F.lit(1), "Purchases": F.col("COGS"), **{c: F.lit(0).cast("long") for c in ("Inventory_Begin", "Inventory_End", "Cash_Begin", "Cash_End", "AccountsReceivable")}})
    return checks.cell_changes(b, checks.repaired(b), ["id"], ["COGS", "GrossProfit", "TotalLiabilities", "Inventory_Begin", "Cash_Begin"])


@query("SELECT o_orderkey, c AS \"column\", old, new FROM (SELECT o_orderkey, 'o_orderstatus' AS c, o_orderstatus AS old, 'X' AS new FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'X' UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR) FROM orders WHERE o_orderkey % 15 = 0)")
def fault_injection_truth_diff(spark, sf):
    o = table(spark, sf, "orders")
    bad = o.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")), "o_custkey": F.when(F.col("o_orderkey") % 15 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))})
    return checks.cell_changes(o, bad, ["o_orderkey"], ["o_orderstatus", "o_custkey", "o_orderpriority"])


def _flows(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.when(i % 3 == 0, "UDP").otherwise("TCP").alias("Proto"), F.when(i % 17 != 0, F.concat(F.lit("10.0.0."), i % 250)).alias("SrcIpAddr"), (i % 100).cast("string").alias("SrcPt"), F.when(i % 5 == 0, "DNS").otherwise("10.1.1.1").alias("DstIpAddr"), F.when(i % 4 == 0, "53").when(i % 23 == 0, "x").otherwise("80").alias("DstPt"), (i % 7).alias("Packets"), (i % 900).alias("Bytes"), F.when(i % 2 == 0, "......").otherwise(".A..S.").alias("Flags"))


@query("""WITH f AS (SELECT event_id AS i, event_id % 17 = 0 AS gone, event_id % 4 <> 0 AND event_id % 23 = 0 AS bad FROM events)
 SELECT i AS event_id, 'N04' AS rule_id FROM f WHERE gone
 UNION ALL SELECT i, 'N01' FROM f WHERE NOT gone AND i % 3 = 0 AND i % 2 <> 0
 UNION ALL SELECT i, 'N02' FROM f WHERE NOT gone AND NOT bad AND i % 7 > 0 AND (i % 900 < 42 * (i % 7) OR i % 900 > 65535 * (i % 7))
 UNION ALL SELECT i, 'N03' FROM f WHERE NOT gone AND NOT bad AND CASE WHEN i % 4 = 0 THEN i % 5 <> 0 WHEN i % 100 = 53 THEN true ELSE false END""")
def netflow_checks(spark, sf):
    return rules.violations(_flows(spark, sf), checks.flow_rules(), ["event_id"]).select("event_id", "rule_id")


@query("SELECT count_if(NOT b)::BIGINT AS valid, count_if(b)::BIGINT AS rejected FROM (SELECT event_id % 17 = 0 OR (event_id % 3 = 0 AND event_id % 2 <> 0) AS b FROM events)")
def netflow_valid_split(spark, sf):
    good, bad = rules.split_valid(_flows(spark, sf), [r for r in checks.flow_rules() if r.rule_id in ("N01", "N04")])
    both = good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g")))
    return both.agg(F.count_if(F.col("g") == 1).alias("valid"), F.count_if(F.col("g") == 0).alias("rejected"))


# ---- rule sets


def _rule_list(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("rule_id"), (F.col("p_size") / 50).alias("support"), F.array((F.col("p_size") * 1.0)).alias("constants"), F.col("p_name").alias("text"))


@query("SELECT 'P' || p_partkey AS rule_id, CASE WHEN p_partkey % 10 = 0 THEN 'manual' ELSE 'learned' END AS origin FROM part UNION ALL SELECT 'M' || p_partkey, 'manual' FROM part WHERE p_partkey % 100 = 0")
def manual_override_merge(spark, sf):
    r = _rule_list(spark, sf).select("rule_id")
    n = F.substring("rule_id", 2, 20).cast("long")
    manual = r.where(n % 10 == 0).unionByName(r.where(n % 100 == 0).select(F.concat(F.lit("M"), n).alias("rule_id")))
    return rules.override(r, manual)


@query("SELECT 'P' || p_partkey AS rule_id, p_size / 50 < 0.5 OR (p_size NOT IN (20, 40) AND p_size > 10 AND p_size / 50 < 0.98) AS coincidence FROM part")
def coincidence_flag(spark, sf):
    return rules.coincidences(_rule_list(spark, sf).withColumn("origin", F.lit("learned")), [20.0, 40.0]).select("rule_id", "coincidence")


@query("SELECT 'P' || p_partkey AS rule_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'P' || p_partkey END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS explanation, greatest(0.0, least(1.0, p_size / 25)) AS support FROM part")
def card_rule_left_join(spark, sf):
    explained = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("rule_id"), F.col("p_brand").alias("title"), F.col("p_type").alias("explanation"))
    return rules.cards(_rule_list(spark, sf).withColumn("support", F.col("support") * 2), explained)


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'implication' WHEN 1 THEN 'identity' WHEN 2 THEN 'exclusion' WHEN 3 THEN 'bound' WHEN 4 THEN 'quantified' ELSE 'composite' END AS kind FROM events")
def classify_rule_kind(spark, sf):
    kinds = F.array(*(F.lit(x) for x in ('{"kind": "implies"}', '{"kind": "compare", "op": "="}', '{"kind": "compare", "op": "!="}', '{"kind": "compare", "op": "<="}', '{"kind": "forall"}', '{"kind": "or"}')))
    return table(spark, sf, "events").select("event_id", rules.kind_of(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int"))).alias("kind"))


# ---- text


@query()
def number_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.number_tokens(F.col("text")), "|").alias("numbers"))


@query()
def foreign_number_check(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(text.foreign_numbers(F.col("text"), F.array(F.lit("1"), F.lit("2"))), "|").alias("foreign"))


@query("SELECT doc_id, 3 * ((length(source) - length(replace(source, 'src1', ''))) // 4) + ((length(l) - length(replace(l, 'the', ''))) // 3) + ((length(l) - length(replace(l, 'of', ''))) // 2) + 3 * ((length(source) - length(replace(source, 'the', ''))) // 3) + 3 * ((length(source) - length(replace(source, 'of', ''))) // 2) + ((length(l) - length(replace(l, 'src1', ''))) // 4) AS score FROM (SELECT *, lower(text) AS l FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def keyword_score_topk(spark, sf):
    return text.best_sections(table(spark, sf, "documents"), ["src1", "the", "of"], {"source": 3, "text": 1}, "doc_id", 20).select("doc_id", "score")


@query(ORACLE_SQL["keyword_score_topk"])
def indexed_keyword_topk(spark, sf):
    index = retrieval.section_index(table(spark, sf, "documents"), ["source", "text"], "doc_id", f"{shared_folder(spark)}/sections-{uuid.uuid4().hex}")
    return index.best(spark, ["src1", "the", "of"], {"source": 3, "text": 1}, 20).select("doc_id", "score")


@query(r"""WITH p AS (SELECT page_id, lower(hex(encode(html))) AS h FROM pages),
 l AS (SELECT page_id, length(h) // 2 AS size, regexp_extract_all(substr(h, 1, 2048), '.{1,32}') AS lines FROM p),
 d AS (SELECT page_id, size, list_transform(lines, lambda x, i: lpad(lower(to_hex((i - 1) * 16)), 4, '0') || '  ' || rpad(rtrim(regexp_replace(x, '(..)', '\1 ', 'g')), 47, ' ') || '  '
  || list_aggregate(list_transform(regexp_extract_all(x, '..'), lambda y: CASE WHEN y BETWEEN '20' AND '7e' THEN chr(('0x' || y)::INTEGER) ELSE '.' END), 'string_agg', '')) AS lines FROM l)
 SELECT page_id, array_to_string(list_concat(lines, CASE WHEN size > 1024 THEN ['… (' || (size - 1024) || ' more bytes)'] ELSE [] END), chr(10)) AS dump FROM d""")
def page_hex_dump(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.hex_dump(F.col("html")).alias("dump"))


@query("""SELECT o_orderkey, '{"o_large":' || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'null' END || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS key,
 sha256('{"o_large":' || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'null' END || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS name FROM orders""")
def canonical_keys(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_large", F.when(F.col("o_totalprice") > 100000, True))
    cols = ["o_orderstatus", "o_large", "o_orderkey"]
    return o.select("o_orderkey", report.canonical_key(*cols).alias("key"), report.content_key(*reversed(cols)).alias("name"))


@query("""WITH c AS (SELECT doc_id, source, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents),
 k AS (SELECT doc_id, source, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END AS clipped FROM c)
 SELECT doc_id, clipped, used::BIGINT AS used FROM (SELECT *, sum(length(clipped)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM k) WHERE used <= 600""")
def text_clip_budget(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", text.clip(F.col("text"), 60).alias("clipped"))
    return text.within_budget(d, "clipped", "source", "doc_id", 600).select("doc_id", "clipped", "used")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(text), 'there') AND contains(lower(text), 'with')")
def text_search_filter(spark, sf):
    return table(spark, sf, "documents").where((F.col("lang") == "en") & text.contains_all(F.col("text"), "There WITH")).select("doc_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || lpad(CAST(CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS VARCHAR), 8, '0') AS code, round(c_acctbal, 2) AS back FROM customer")
def fixed_width_codec(spark, sf):
    code = text.fixed_width(F.col("c_acctbal"), 6, 2)
    return table(spark, sf, "customer").select("c_custkey", code.alias("code"), F.round(text.from_fixed_width(code, 2), 2).alias("back"))


@query("SELECT o_orderkey, CAST(rpad(substr(CAST(o_orderkey AS VARCHAR), 1, 2), 6, '0') AS BIGINT) AS low, CAST(rpad(substr(CAST(o_orderkey AS VARCHAR), 1, 2), 6, '9') AS BIGINT) AS high FROM orders")
def prefix_interval(spark, sf):
    low, high = text.prefix_interval(F.substring(F.col("o_orderkey").cast("string"), 1, 2), 6)
    return table(spark, sf, "orders").select("o_orderkey", low.alias("low"), high.alias("high"))


@query("SELECT c_custkey, 'Customer ' || c_name || ' has {{unknown}}' AS filled, 1 AS open_slots FROM customer")
def slot_fill(spark, sf):
    filled = text.fill_slots(F.lit("Customer {{name}} has {{unknown}}"), {"name": F.col("c_name")})
    return table(spark, sf, "customer").select("c_custkey", filled.alias("filled"), F.size(text.open_slots(filled)).alias("open_slots"))


# ---- generation, packets, events


@query("""SELECT 0 AS step, CAST(NULL AS VARCHAR) AS before, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
 UNION ALL SELECT 1, o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def token_ngram_counts(spark, sf):
    from veritab.operators.generate import transitions

    return transitions(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT 100::BIGINT AS n, 0::BIGINT AS broken, count(DISTINCT (l_returnflag, l_linestatus)) AS pairs, count(DISTINCT (l_linestatus, l_linenumber)) AS next_pairs FROM lineitem")
def constrained_rows(spark, sf):
    """A hundred rows that obey a rule; neighbours in them are neighbours in the table, so they add no pair to the table's."""
    from veritab.operators.generate import generated_under_rules

    rule = Rule("G1", logic.implies(logic.eq(F.col("l_returnflag"), "N"), logic.le(F.col("l_linenumber"), 5)))
    made = generated_under_rules(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [rule], 100)
    every = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").unionByName(made.select("l_returnflag", "l_linestatus", "l_linenumber"))
    pairs = every.agg(F.count_distinct("l_returnflag", "l_linestatus").alias("pairs"), F.count_distinct("l_linestatus", "l_linenumber").alias("next_pairs"))
    return made.agg(F.count("*").alias("n"), F.count_if(~rule.condition).alias("broken")).withColumns({c: pairs.select(c).scalar() for c in pairs.columns})


@query("SELECT count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents, (SELECT count(DISTINCT x) FROM (SELECT CAST(user_id AS VARCHAR) AS x FROM events UNION ALL SELECT event_type FROM events)) AS endpoints, max(epoch_us(ts)) - min(epoch_us(ts)) AS span_us FROM events")
def packet_stats(spark, sf):
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = e.select(F.explode(F.array(F.col("user_id").cast("string"), "event_type")).alias("x")).agg(F.count_distinct("x").alias("endpoints"))
    one = e.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), (F.max("us") - F.min("us")).alias("span_us"))
    return one.withColumn("endpoints", ends.scalar())


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def event_dedupe_latest(spark, sf):
    e = table(spark, sf, "events")
    return checks.latest(stream.once_each(e.unionByName(e), "event_id"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'ui' WHEN 'purchase' THEN 'shop' ELSE 'other' END AS agent, count(*) AS n FROM events GROUP BY ALL")
def stage_agent_map(spark, sf):
    return stream.staged(table(spark, sf, "events"), {"click": "ui", "purchase": "shop"}).groupBy("event_type", "agent").agg(F.count("*").alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, 'E1' AS rule_id, count(*) AS n FROM events WHERE NOT (value <= 50) GROUP BY 1")
def windowed_rule_violations(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.windowed_violations(e, [Rule("E1", logic.le(F.col("value"), 50.0))], "ts", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "rule_id", "n")


@query("SELECT user_id, count(DISTINCT CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END)::INTEGER AS others, list_has_any(list(event_type), ['purchase']) AS bought FROM events GROUP BY 1")
def except_roles(spark, sf):
    kinds = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", F.size(F.array_except("k", F.array(F.lit("click"), F.lit("view")))).alias("others"), F.arrays_overlap("k", F.array(F.lit("purchase"))).alias("bought"))


@query("""WITH f AS (SELECT event_id AS i, event_id % 3 AS k, CASE event_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 53 END AS made FROM events)
 SELECT i AS event_id, coalesce(made, NULL)::INTEGER AS "SrcPt", CASE WHEN made = 53 THEN 'DNS' WHEN i % 4 = 0 THEN '9.9.9.9' WHEN i % 2 = 0 THEN '10.0.0.' || (i % 254 + 1) ELSE '192.168.1.' || (i % 254 + 1) END AS "SrcIpAddr", 443 AS "DstPt", '10.0.0.' || (i % 254 + 1) AS "DstIpAddr" FROM f""")
def flow_backfill(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select(i, F.lit(None).cast("string").alias("SrcPt"), F.lit("443").alias("DstPt"), F.when(i % 4 == 0, "9.9.9.9").otherwise(" ").alias("SrcIpAddr"), F.lit(None).cast("string").alias("DstIpAddr"), (i % 3).alias("SrcPortClass"), F.lit(0).alias("DstPortClass"), (i % 2).alias("SrcSubnet"), F.lit(0).alias("DstSubnet"))
    return flows.backfilled(e, {0: 80, 1: 53}, {0: "10.0.0", 1: "192.168.1"}, "event_id").select("event_id", "SrcPt", "SrcIpAddr", "DstPt", "DstIpAddr")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 1000)::DOUBLE END AS amount, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN event_id / 2.0 ELSE event_id::DOUBLE END AS at FROM events")
def clean_numbers_times(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select(i, F.when(i % 3 == 0, "none").otherwise(F.concat(i.cast("string"), F.lit(",000 B"))).alias("a"), F.when(i % 3 == 0, F.col("ts").cast("string")).when(i % 3 == 1, (i / 2).cast("string")).otherwise("soon").alias("t"))
    return e.select("event_id", flows.to_number(F.col("a")).alias("amount"), flows.to_epoch(F.col("t"), i).alias("at"))


@query("SELECT event_id, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS relative, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS of_user FROM events")
def relative_time(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    both = flows.since_first(flows.since_first(e, "us", "user_id").withColumnRenamed("relative", "of_user"), "us")
    return both.select("event_id", "relative", "of_user")


@query(_MONTHS + ", t AS (SELECT m, sum(cents)::BIGINT AS c, min(cents)::BIGINT AS p FROM c GROUP BY 1) SELECT sum(c)::BIGINT AS total, round(avg(p / c), 6) AS mean_ratio, arg_min(c, m) AS first, arg_max(c, m) AS last, round(pow(arg_max(c, m) / arg_min(c, m), 1.0 / (max(m) - min(m))) - 1, 6) AS growth FROM t")
def report_slots(spark, sf):
    months = _months(spark, sf).groupBy("m").agg(F.sum("cents").alias("c"), F.min("cents").alias("p"))
    out = report.slots(months, "m", "c", "p")
    return out.withColumns({"mean_ratio": F.round("mean_ratio", 6), "growth": F.round("growth", 6)})


@query("SELECT count_if(o_totalprice > 1000)::BIGINT AS hits, count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def truth_table_hits(spark, sf):
    o = table(spark, sf, "orders")
    return report.truth_hits(o.where("o_orderstatus = 'F'").select("o_orderkey"), o.where("o_totalprice > 1000"), ["o_orderkey"])


@query("SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages")
def host_of_url(spark, sf):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return table(spark, sf, "pages").select("page_id", flows.host_part(F.concat(host, F.lit(":443"))).alias("host"))


#: orders as the books of companies (customers): a period for each order, whose identities, continuity and growth hold
_BOOK = """WITH o AS (SELECT o_custkey AS c, CAST(round(o_totalprice) AS BIGINT) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
 b AS (SELECT c, p, r AS Revenue, r * 6 // 10 AS COGS, 100 + r % 900 AS Inventory_End, 500 + r % 700 AS Cash_End, r * 18 // 100 AS AccountsReceivable, r * 3 + 10000 AS TotalAssets, (r * 3 + 10000) * 45 // 100 AS TotalEquity FROM o),
 book AS (SELECT *, coalesce(lag(Inventory_End) OVER w, 100) AS Inventory_Begin, coalesce(lag(Cash_End) OVER w, 50) AS Cash_Begin, COGS + Inventory_End - coalesce(lag(Inventory_End) OVER w, 100) AS Purchases,
  Revenue - COGS AS GrossProfit, TotalAssets - TotalEquity AS TotalLiabilities, lag(AccountsReceivable, 4) OVER w AS ar4, lag(Revenue, 4) OVER w AS revenue4 FROM b WINDOW w AS (PARTITION BY c ORDER BY p)) """


def _book(spark, sf):
    from veritab.sources import demo

    w = Window.partitionBy("CompanyId").orderBy("id")
    r = F.round("o_totalprice").cast("long")
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("CompanyId"), F.lit("trade").alias("Industry"), F.col("o_orderkey").alias("id"), r.alias("Revenue"))
    d = d.withColumns({"PeriodIndex": F.row_number().over(w), "COGS": F.expr("Revenue * 6 div 10"), "NetProfit": F.expr("Revenue div 10"), "Inventory_End": F.col("Revenue") % 900 + 100, "Cash_End": F.col("Revenue") % 700 + 500})
    d = d.withColumns({"AccountsReceivable": F.expr("Revenue * 18 div 100"), "TotalAssets": F.expr("Revenue * 3 + 10000"), "TotalEquity": F.expr("(Revenue * 3 + 10000) * 45 div 100")})
    d = d.withColumns({"Inventory_Begin": F.coalesce(F.lag("Inventory_End").over(w), F.lit(100)), "Cash_Begin": F.coalesce(F.lag("Cash_End").over(w), F.lit(50))})
    d = d.withColumn("Purchases", F.expr("COGS + Inventory_End - Inventory_Begin")).withColumns({c: make() for c, make in demo.DERIVED.items()})
    return d.select("CompanyId", "Industry", "PeriodIndex", *demo.AMOUNTS)


@query(_BOOK + """SELECT count(*) AS n, count(DISTINCT c) AS companies, (count_if(Inventory_End <> Inventory_Begin + Purchases - COGS) + count_if(TotalAssets <> TotalLiabilities + TotalEquity) + count_if(GrossProfit <> Revenue - COGS)
 + count_if((AccountsReceivable - ar4) / ar4 >= 1 AND (AccountsReceivable - ar4) / ar4 - (Revenue - revenue4) / revenue4 >= 1))::BIGINT AS violations, count_if(p = 3) AS with_fault FROM book""")
def company_identities(spark, sf):
    """Companies made of orders obey identities, continuity and growth; a fault in the third period is found in each that has one."""
    from veritab.sources.companies import with_faults

    d = _book(spark, sf)
    bands = spark.createDataFrame([("other", 0, 10000)], "Industry string, low_bp int, high_bp int")
    keys = ["CompanyId", "PeriodIndex"]
    bad = checks.finance_violations(d, bands, keys).agg(F.count("*"))
    faulty = checks.finance_violations(with_faults(d, {3: ("TotalAssets", 300)}), bands, keys).where("rule_id = 'R02' and PeriodIndex = 3").agg(F.count("*"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("CompanyId").alias("companies")).withColumns({"violations": bad.scalar(), "with_fault": faulty.scalar()})


# ---- words of rules and their counts


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_type || '，' || p_brand || '; x,', '[^,;，；\\s\\p{Z}]+'), '|') AS tags FROM part")
def tag_split(spark, sf):
    tagged = F.concat("p_type", F.lit("，"), "p_brand", F.lit("; x,"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.tags(tagged), "|").alias("tags"))


@query("""SELECT p_partkey, array_to_string(list_concat(regexp_extract_all(p_type || '-a-' || p_brand, '[0-9A-Za-z_一-鿿]{2,}'),
 CASE WHEN contains(lower(p_type || '-a-' || p_brand), 'brass') THEN ['黄铜'] ELSE [] END), '|') AS words FROM part""")
def keyword_extraction(spark, sf):
    blob = F.concat("p_type", F.lit("-a-"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.keywords(blob, {"Brass": "黄铜"}), "|").alias("words"))


@query("SELECT count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS enabled, count_if(o_orderpriority = '1-URGENT')::BIGINT AS learned, count_if(o_orderpriority <> '1-URGENT')::BIGINT AS manual FROM orders")
def rule_counts(spark, sf):
    o = table(spark, sf, "orders")
    made = o.select((F.col("o_orderstatus") == "F").alias("enabled"), F.when(F.col("o_orderpriority") == "1-URGENT", "learned").otherwise("manual").alias("source"))
    return report.rule_counts(made)


# ---- terms, tokens of rows, completion


def _terms():
    left = predicates.scaled_terms(LINE) + predicates.sum_terms(LINE)
    return predicates.distinct(predicates.term_term(left, predicates.field_terms(LINE) + predicates.constant_terms([30000.0]), ["<="]))


@query(_support_sql({p.text: p.text for p in _terms()}))
def term_predicates(spark, sf):
    return _supports(spark, sf, _terms())


@query("SELECT p_partkey, '<BOS> <FIELD::p_brand> p_brand=' || p_brand || ' <END_FIELD> <FIELD::p_size> + ' || substr(lpad(CAST(p_size AS VARCHAR), 3, '0'), 1, 1) || ' ' || substr(lpad(CAST(p_size AS VARCHAR), 3, '0'), 2, 1) || ' ' || substr(lpad(CAST(p_size AS VARCHAR), 3, '0'), 3, 1) || ' <END_FIELD> <EOS>' AS tokens, p_brand AS brand_back, p_size::DOUBLE AS size_back FROM part")
def row_tokens(spark, sf):
    from veritab.operators.generate import from_row_tokens
    from veritab.operators.generate import row_tokens as tokens_of

    tokens = table(spark, sf, "part").withColumn("tokens", tokens_of(["p_size"], ["p_brand"], ["p_brand", "p_size"], 3))
    back = from_row_tokens(F.col("tokens"), ["p_size"], ["p_brand", "p_size"])
    joined = F.array_join("tokens", " ").alias("tokens")
    return tokens.select("p_partkey", joined, back["p_brand"].alias("brand_back"), back["p_size"].cast("double").alias("size_back"))


@query("""WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL),
 b AS (SELECT s, p FROM c QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, p) = 1)
 SELECT o_orderstatus, p AS o_orderpriority, count(*) AS n FROM orders JOIN b ON s = o_orderstatus GROUP BY ALL""")
def completed_rows(spark, sf):
    """Every order's status, completed by the likeliest priority."""
    from veritab.operators.generate import completed, transitions

    o, cols = table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]
    made = completed(o.select("o_orderstatus"), transitions(o, cols), cols, sample=False)
    return made.groupBy(*cols).agg(F.count("*").alias("n"))


# ---- faults, periods, frames


def _share(part: str, whole: str) -> str:
    return f"CAST(round_even({part} / {whole} * 10000, 0) AS BIGINT)"


_OTHER = "TotalAssets - {} - {} - {}"
#: fault, rule, period, column, clean and wrong value
_FAULTY = [
    ("F1", "R01", 3, "COGS", "COGS", "COGS + 1000"), ("F1", "R01", 3, "GrossProfit", "GrossProfit", "Revenue - COGS - 1000"),
    ("F1", "R01", 3, "InventoryNetInflow", "Purchases - COGS", "Purchases - COGS - 1000"), ("F2a", "R04", 2, "Cash_Begin", "Cash_Begin", "Cash_Begin + 500"),
    ("F2b", "R02", 5, "Cash_End", "Cash_End", "Cash_End + 500"), ("F2b", "R02", 5, "TotalAssets", "TotalAssets", "TotalAssets + 500"),
    ("F2b", "R02", 5, "InventoryToAssetsBp", _share("Inventory_End", "TotalAssets"), _share("Inventory_End", "(TotalAssets + 500)")),
    ("F2b", "R02", 6, "Cash_Begin", "Cash_Begin", "Cash_Begin + 500"), ("F4", "R07", 7, "AccountsReceivable", "AccountsReceivable", "ar4 * 4"),
    ("F4", "R07", 7, "OtherAssets", _OTHER.format("Cash_End", "Inventory_End", "AccountsReceivable"), _OTHER.format("Cash_End", "Inventory_End", "ar4 * 4")),
    ("F4", "R07", 7, "ReceivableToRevenueBp", _share("AccountsReceivable", "Revenue"), _share("(ar4 * 4)", "Revenue")),
    ("F3", "R06", 8, "Inventory_End", "Inventory_End", "ie"), ("F3", "R06", 8, "Purchases", "Purchases", "ie - Inventory_Begin + COGS"),
    ("F3", "R06", 8, "OtherAssets", _OTHER.format("Cash_End", "Inventory_End", "AccountsReceivable"), _OTHER.format("Cash_End", "ie", "AccountsReceivable")),
    ("F3", "R06", 8, "InventoryNetInflow", "Purchases - COGS", "ie - Inventory_Begin"), ("F3", "R06", 8, "InventoryToAssetsBp", _share("Inventory_End", "TotalAssets"), _share("ie", "TotalAssets")),
]


@query(_BOOK + ", f AS (SELECT *, CAST(round_even(TotalAssets * 0.35::DOUBLE, 0) AS BIGINT) AS ie FROM book) " + " UNION ALL ".join(
    f"""SELECT '{f}' AS fault, '{r}' AS rule_id, c AS company, p AS period, '{k}' AS "column", CAST({old} AS VARCHAR) AS old, CAST({new} AS VARCHAR) AS new FROM f WHERE p = {p} AND {old} <> {new}""" for f, r, p, k, old, new in _FAULTY))
def named_faults(spark, sf):
    """The cells that each named fault changes in companies made of orders."""
    from veritab.sources import demo

    return demo.truth_table(_book(spark, sf)).select("fault", "rule_id", F.col("CompanyId").alias("company"), F.col("PeriodIndex").cast("long").alias("period"), "column", "old", "new")


@query(_BOOK + """SELECT c AS company, p AS period, CASE p WHEN 3 THEN 'R01' WHEN 2 THEN 'R04' WHEN 5 THEN 'R02' WHEN 7 THEN 'R07' END AS rule_id FROM book
 WHERE p IN (2, 3, 5) OR (p = 7 AND 3 - (Revenue - revenue4) / revenue4 >= 1)
 UNION ALL SELECT c, p, 'R06' FROM book WHERE round_even(Inventory_End / TotalAssets * 10000, 0) NOT BETWEEN 0 AND 2000 AND p <> 8
 UNION ALL SELECT c, p, 'R06' FROM book WHERE p = 8
 UNION ALL SELECT c, p, 'R07' FROM (SELECT *, (AccountsReceivable - CASE p WHEN 11 THEN 4 * lag(AccountsReceivable, 8) OVER w ELSE ar4 END) AS d, CASE p WHEN 11 THEN 4 * lag(AccountsReceivable, 8) OVER w ELSE ar4 END AS base FROM book WINDOW w AS (PARTITION BY c ORDER BY p))
 WHERE p <> 7 AND d / base >= 1 AND d / base - (Revenue - revenue4) / revenue4 >= 1
 UNION ALL SELECT c, p, 'R03' FROM book WHERE p = 9""")
def named_faults_found(spark, sf):
    """Each named fault is found in companies made of orders, and what it does to the next period or to the growth four periods later."""
    from veritab.sources import demo

    bands = spark.createDataFrame([("trade", 0, 2000)], "Industry string, low_bp int, high_bp int")
    found = checks.finance_violations(demo.injected("finance_v1", _book(spark, sf)), bands, ["CompanyId", "PeriodIndex"])
    return found.select(F.col("CompanyId").alias("company"), F.col("PeriodIndex").cast("long").alias("period"), "rule_id")


@query("""WITH f AS (SELECT event_id AS i, event_id % 17 = 0 AS gone, event_id % 4 <> 0 AND event_id % 23 = 0 AS bad, CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS proto FROM events),
 v AS (SELECT proto, 'N04' AS rule_id FROM f WHERE gone UNION ALL SELECT proto, 'N01' FROM f WHERE NOT gone AND i % 3 = 0 AND i % 2 <> 0
 UNION ALL SELECT proto, 'N02' FROM f WHERE NOT gone AND NOT bad AND i % 7 > 0 AND (i % 900 < 42 * (i % 7) OR i % 900 > 65535 * (i % 7))
 UNION ALL SELECT proto, 'N03' FROM f WHERE NOT gone AND NOT bad AND CASE WHEN i % 4 = 0 THEN i % 5 <> 0 ELSE i % 100 = 53 END)
 SELECT proto, rule_id, count(*) AS n FROM v GROUP BY ALL""")
def sample_flows_checked(spark, sf):
    """How many flows break which rule, by protocol."""
    found = rules.violations(_flows(spark, sf), checks.flow_rules(), ["event_id", "Proto"])
    return found.groupBy(F.col("Proto").alias("proto"), "rule_id").agg(F.count("*").alias("n"))


_PERIODS = """WITH o AS (SELECT o_custkey AS c, o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
 e AS (SELECT *, coalesce(lag(r % 1000) OVER w, 100) AS ib, r % 1000 AS ie, coalesce(lag(r % 500) OVER w, 50) AS cb, p > 1 AS later FROM o WINDOW w AS (PARTITION BY c ORDER BY p)) """


def _periods(spark, sf):
    """Orders as a customer's periods: every 11th has a wrong cost, every 7th a wrong opening."""
    w = Window.partitionBy("CompanyId").orderBy("id")
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("CompanyId"), F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("Revenue"))
    d = d.withColumns({"PeriodIndex": F.row_number().over(w), "Inventory_End": F.col("Revenue") % 1000, "Cash_End": F.col("Revenue") % 500, "Purchases": F.lit(10).cast("long"), "AccountsReceivable": F.lit(1).cast("long")})
    d = d.withColumns({"Inventory_Begin": F.coalesce(F.lag("Inventory_End").over(w), F.lit(100)), "Cash_Begin": F.coalesce(F.lag("Cash_End").over(w), F.lit(50)) + F.when(F.col("id") % 7 == 0, 9).otherwise(0)})
    d = d.withColumn("COGS", F.expr("Inventory_Begin + Purchases - Inventory_End") + F.when(F.col("id") % 11 == 0, 5).otherwise(0))
    return d.withColumn("GrossProfit", F.expr("Revenue - COGS")).withColumns({"TotalAssets": F.col("Revenue") * 2, "TotalLiabilities": F.col("Revenue"), "TotalEquity": F.col("Revenue")})


@query(_PERIODS + "SELECT id, 'R01' AS rule_id FROM e WHERE id % 11 = 0 UNION ALL SELECT id, 'R04' FROM e WHERE id % 7 = 0 AND later")
def period_rules(spark, sf):
    rs = [r for r in checks.finance_rules() if r.rule_id in ("R01", "R02", "R03", "R04", "R05")]
    return rules.violations(checks.with_history(_periods(spark, sf)), rs, ["id"]).select("id", "rule_id")


@query(_PERIODS + """SELECT id, 'COGS' AS "column", CAST(ib + 10 - ie + 5 AS VARCHAR) AS old, CAST(ib + 10 - ie AS VARCHAR) AS new FROM e WHERE id % 11 = 0
 UNION ALL SELECT id, 'GrossProfit', CAST(r - (ib + 10 - ie + 5) AS VARCHAR), CAST(r - (ib + 10 - ie) AS VARCHAR) FROM e WHERE id % 11 = 0
 UNION ALL SELECT id, 'Cash_Begin', CAST(cb + 9 AS VARCHAR), CAST(cb AS VARCHAR) FROM e WHERE id % 7 = 0 AND later""")
def repair_periods(spark, sf):
    """Costs, profits and openings set right over a customer's periods."""
    d = _periods(spark, sf)
    return checks.cell_changes(d, checks.repaired(d), ["id"], ["COGS", "GrossProfit", "TotalLiabilities", "Inventory_Begin", "Cash_Begin"])


def _event_frame():
    """A frame for each event: a DNS question, a request or a handshake."""
    i, kind = F.col("event_id"), F.col("event_id") % 3
    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    port = F.when(kind == 0, 53).when(kind == 1, 80).otherwise(443)
    body = F.when(kind == 0, F.concat(hexed(i % 65536, 4), F.lit("01000001000000000000" + "02616201630000010001"))).when(kind == 1, F.hex(F.concat(F.lit("GET /"), i.cast("string"), F.lit(" HTTP/1.1\r\nHost: x\r\n")).cast("binary"))).otherwise("160301000501")
    ip = F.concat(F.lit("4500000000010000" + "40"), F.when(kind == 0, "11").otherwise("06"), F.lit("0000" + "0A00"), hexed(F.col("user_id") % 65536, 4), F.lit("0A000001"))
    l4 = F.concat(hexed(i % 50000 + 10000, 4), hexed(port, 4), F.when(kind == 0, "00000000").otherwise("0000000100000000" + "5018" + "0200" + "00000000"))
    return F.unhex(F.concat(F.lit("00" * 12 + "0800"), ip, l4, body))


@query("""SELECT event_id, '10.0.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS ip_src, 10000 + event_id % 50000 AS src_port, CASE event_id % 3 WHEN 0 THEN 53 WHEN 1 THEN 80 ELSE 443 END::BIGINT AS dst_port,
 CASE event_id % 3 WHEN 0 THEN 'DNS' WHEN 1 THEN 'HTTP' ELSE 'TLS' END AS protocol,
 CASE event_id % 3 WHEN 0 THEN 'Standard query 0x' || lpad(printf('%x', event_id % 65536), 4, '0') || ' ab.c' WHEN 1 THEN 'GET /' || event_id || ' HTTP/1.1' ELSE 'TLS Client Hello' END AS app_line FROM events""")
def frame_decode(spark, sf):
    """A frame for each event, decoded: a DNS question, a request or a handshake."""
    from veritab.sources.capture import decode

    made = table(spark, sf, "events").select("event_id", F.lit(1).alias("link"), _event_frame().alias("data"))
    return decode(made).select("event_id", "ip_src", "src_port", "dst_port", "protocol", "app_line")


@query("""SELECT epoch_us(ts) AS us, '10.0.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS ip_src, 10000 + event_id % 50000 AS src_port, CASE event_id % 3 WHEN 0 THEN 'UDP' ELSE 'TCP' END AS protocol FROM events""")
def capture_ranges(spark, sf):
    """Captures written from events, read back in ranges of 16 KB, as named columns."""
    from veritab.sources import capture

    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    capture.write_frames(table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), _event_frame().alias("data")), folder)
    found = capture.capture_columns(capture.read_frames(spark, f"{folder}/*.pcap", range_bytes=16 << 10))
    port = F.coalesce("`tcp.srcport`", "`udp.srcport`").alias("src_port")
    return found.select(F.round(F.col("`frame.time_epoch`") * 1_000_000).cast("long").alias("us"), F.col("`ip.src`").alias("ip_src"), port, F.col("`_ws.col.protocol`").alias("protocol"))



@query("""WITH p AS (SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || lpad(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR), 6, '0') || '.')[1:1 + c_custkey % 8] AS p FROM customer),
 f AS (SELECT c_custkey, p, p || (CASE WHEN p[1] = '-' THEN '-999999.99' ELSE '-000000.00' END)[length(p) + 1:] AS low, p || (CASE WHEN p[1] = '-' THEN '+000000.00' ELSE '+999999.99' END)[length(p) + 1:] AS high FROM p)
 SELECT c_custkey, CAST(low AS DECIMAL(8, 2))::DOUBLE AS low, CAST(high AS DECIMAL(8, 2))::DOUBLE AS high, c_custkey % 3 <> 0 AS fits FROM f""")
def signed_prefix_intervals(spark, sf):
    """Intervals of signed amounts with two decimals, by the first signs of their code; every third text has a letter at its end."""
    # the sign is the amount's own: whole numbers have no minus zero
    code = F.concat(F.when(F.col("c_acctbal") < 0, F.lit("-")).otherwise(F.lit("+")), F.substring(text.fixed_width(F.floor(F.abs("c_acctbal")), 6, 0), 2, 6))
    d = table(spark, sf, "customer").withColumn("p", F.substring(F.concat(code, F.lit(".")), F.lit(1), (F.col("c_custkey") % 8 + 1).cast("int")))
    low, high = text.prefix_interval(F.col("p"), 6, 2, True)
    spoilt = F.when(F.col("c_custkey") % 3 == 0, F.concat("p", F.lit("x"))).otherwise(F.col("p"))
    return d.select("c_custkey", low.cast("double").alias("low"), high.cast("double").alias("high"), text.prefix_fits(spoilt, 6, 2, True).alias("fits"))


@query(_BOOK + """, h AS (SELECT c, p, Inventory_End, TotalAssets FROM book WHERE round_even(Inventory_End / TotalAssets * 10000, 0) NOT BETWEEN 0 AND 100)
 SELECT c AS company, p AS period, 'R06' AS rule_id, 'Inventory_End' AS "column", CAST(Inventory_End AS VARCHAR) AS value FROM h UNION ALL SELECT c, p, 'R06', 'TotalAssets', CAST(TotalAssets AS VARCHAR) FROM h
 UNION ALL SELECT c, p, 'R07', unnest(['AccountsReceivable', 'Revenue']), unnest([CAST(AccountsReceivable AS VARCHAR), CAST(Revenue AS VARCHAR)]) FROM book
 WHERE (AccountsReceivable - ar4) / nullif(ar4, 0) >= 1 AND (AccountsReceivable - ar4) / nullif(ar4, 0) - (Revenue - revenue4) / nullif(revenue4, 0) >= 1""")
def repair_hints(spark, sf):
    """Shares outside of the band, and receivables that outgrow revenue, are told, not changed."""
    bands = spark.createDataFrame([("trade", 0, 100)], "Industry string, low_bp int, high_bp int")
    found = checks.hints(_book(spark, sf), bands, ["CompanyId", "PeriodIndex"])
    return found.select(F.col("CompanyId").alias("company"), F.col("PeriodIndex").cast("long").alias("period"), "rule_id", "column", "value")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'learned' ELSE CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 'learned' ELSE 'manual' END END AS origin FROM part""")
def rule_origins(spark, sf):
    """Where rules come from: what they say, or else whether a learner or predicates are named."""
    size = F.col("p_size")
    told = F.when(size % 4 == 0, "manual").when(size % 4 == 1, "learned").when(size % 4 == 2, "other")
    source = F.struct(told.alias("origin"), F.when(size % 3 == 0, "trees").otherwise("").alias("learner"), F.when(size % 5 == 0, F.array(F.lit(1))).alias("predicate_ids"))
    return rules.origins(table(spark, sf, "part").select("p_partkey", source.alias("source"))).select("p_partkey", "origin")


# ---- state by key

_RANKED = "WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL), "


@query(_RANKED + """w AS (SELECT key, n, event_id, event_type = 'error' AS ended, us, CASE WHEN event_type <> 'error' THEN us END AS began, false AS reused FROM e WHERE n = 1
 UNION ALL SELECT e.key, e.n, e.event_id, e.event_type = 'error', e.us, CASE WHEN e.event_type = 'error' THEN NULL WHEN e.us - w.began <= 28800000000 THEN w.began ELSE e.us END,
 coalesce(e.event_type <> 'error' AND e.us - w.began <= 28800000000, false) FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
 SELECT key, event_id AS event, began AS job_at, reused FROM w WHERE NOT ended""")
def reused_user_jobs(spark, sf):
    """A user's events ask for a job, which is reused for eight hours; an error ends it."""
    e = table(spark, sf, "events").withColumn("ended", F.col("event_type") == "error")
    return jobs.reused_jobs(e, "user_id", "ts", "event_id", "ended", 8 * 3600)


_STATUS = {"click": "pending", "view": "running", "purchase": "done", "error": "failed"}
_NEXT = {None: frozenset({"pending", "running"}), "pending": frozenset({"running", "failed"}), "running": frozenset({"done", "failed"}), "done": frozenset({"pending"}), "failed": frozenset({"pending"})}


@query(_RANKED + f"""s AS (SELECT key, event_id, n, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} ELSE 'other' END AS status FROM e),
 l(a, b) AS (VALUES {', '.join(f"('{a or '-'}', '{b}')" for a, bs in _NEXT.items() for b in sorted(bs))}),
 w AS (SELECT key, n, event_id, NULL::VARCHAR AS before, status, EXISTS (FROM l WHERE a = '-' AND b = status) AS legal FROM s WHERE n = 1
 UNION ALL SELECT s.key, s.n, s.event_id, CASE WHEN w.legal THEN w.status ELSE w.before END, s.status, coalesce(CASE WHEN w.legal THEN w.status ELSE w.before END, '-') || '>' || s.status IN (SELECT a || '>' || b FROM l)
 FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1)
 SELECT key, event_id AS event, before, status, legal FROM w""")
def user_job_statuses(spark, sf):
    """Events as changes of a user's job, legal or not."""
    pairs = [F.lit(x) for kv in _STATUS.items() for x in kv]
    e = table(spark, sf, "events").withColumn("status", F.coalesce(F.create_map(*pairs)[F.col("event_type")], F.lit("other")))
    return jobs.job_statuses(e, "user_id", "ts", "event_id", "status", _NEXT)
