"""Fixed checks: company periods (identities, continuity, bands, growth) and network flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import logic
from veritab.operators.rules import Rule, violations
from veritab.operators.windows import at_offset, previous

GROWTH_LIMIT = 1.0
IDENTITIES = {
    "R01": ("Inventory_End", "Inventory_Begin + Purchases - COGS"),
    "R02": ("TotalAssets", "TotalLiabilities + TotalEquity"),
    "R05": ("GrossProfit", "Revenue - COGS"),
}
CARRIED = {"R03": ("Inventory_Begin", "Inventory_End"), "R04": ("Cash_Begin", "Cash_End")}


def identity_rules() -> list[Rule]:
    return [Rule(k, logic.eq(F.col(a), F.expr(b)), f"{a} = {b}", (a,)) for k, (a, b) in IDENTITIES.items()]


def with_history(df: DataFrame, company: str = "CompanyId", period: str = "PeriodIndex") -> DataFrame:
    """Adds what the cross-period rules compare with: the previous ends and the values four periods ago."""
    df = df.withColumns({f"{begin}_expected": previous(end, [company], period) for begin, end in CARRIED.values()})
    return at_offset(df, [company], period, ["AccountsReceivable", "Revenue"], 4)


def finance_rules() -> list[Rule]:
    """Over with_history() joined to bands (Industry, low_bp, high_bp)."""
    carried = [Rule(k, F.col(f"{b}_expected").isNull() | logic.eq(F.col(b), F.col(f"{b}_expected")), f"{b} = previous {e}", (b,)) for k, (b, e) in CARRIED.items()]
    bp = F.bround(logic.ratio(F.col("Inventory_End"), F.col("TotalAssets")) * 10000)
    band = Rule("R06", F.col("low_bp").isNull() | ~logic.gt(F.col("TotalAssets"), 0) | (logic.ge(bp, F.col("low_bp")) & logic.le(bp, F.col("high_bp"))), "inventory share within the industry's band", ("Inventory_End", "TotalAssets"))
    grown = {c: logic.ratio(F.col(c) - F.col(f"{c}_before"), F.col(f"{c}_before")) for c in ("AccountsReceivable", "Revenue")}
    growth = Rule("R07", ~(logic.ge(grown["AccountsReceivable"], GROWTH_LIMIT) & logic.ge(grown["AccountsReceivable"] - grown["Revenue"], GROWTH_LIMIT)), "receivables don't outgrow revenue", ("AccountsReceivable", "Revenue"))
    return [*identity_rules(), *carried, band, growth]


def finance_violations(df: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """One exchange by company serves continuity and growth; bands is a row per industry."""
    return violations(with_history(df).join(bands, "Industry", "left"), finance_rules(), keys)


def repaired(df: DataFrame) -> DataFrame:
    """The smallest change that makes identities and continuity hold: one column each, in a fixed order; others aren't touched.

    Continuity goes by the ends as they were given. Share and growth findings are hints, not changed.
    """
    df = with_history(df)
    out = df.withColumn("COGS", F.when(~logic.eq(F.col("Inventory_End"), F.expr("Inventory_Begin + Purchases - COGS")), F.expr("Inventory_Begin + Purchases - Inventory_End")).otherwise(F.col("COGS")))
    out = out.withColumn("GrossProfit", F.when(~logic.eq(F.col("GrossProfit"), F.expr("Revenue - COGS")), F.expr("Revenue - COGS")).otherwise(F.col("GrossProfit")))
    out = out.withColumn("TotalLiabilities", F.when(~logic.eq(F.col("TotalAssets"), F.expr("TotalLiabilities + TotalEquity")), F.expr("TotalAssets - TotalEquity")).otherwise(F.col("TotalLiabilities")))
    for begin, _ in CARRIED.values():
        out = out.withColumn(begin, F.coalesce(f"{begin}_expected", begin))
    return out.select([c for c in df.columns if not c.endswith(("_expected", "_before"))])


def hints(df: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule_id, column, value: what repair leaves as it is but tells, a row for each column of a share outside its band or of growth that outruns revenue's."""
    told = [r for r in finance_rules() if r.rule_id in ("R06", "R07")]
    cells = F.array_compact(F.array(*(F.when(~r.condition, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for r in told for c in r.fields)))
    return with_history(df).join(bands, "Industry", "left").select(*keys, F.explode(cells).alias("h")).select(*keys, "h.*")


def cell_changes(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys, column, old, new of every cell that differs (missing and missing are equal)."""
    a = before.select(*keys, *(F.col(c).cast("string").alias(f"o_{c}") for c in cols))
    b = after.select(*keys, *(F.col(c).cast("string").alias(f"n_{c}") for c in cols))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in cols))
    changed = F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return a.join(b, keys).select(*keys, F.explode(changed).alias("x")).select(*keys, "x.*")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def flow_rules() -> list[Rule]:
    """For flows with Proto, SrcIpAddr, SrcPt, DstIpAddr, DstPt, Packets, Bytes, Flags; a row without an end breaks only N04."""
    numbers = ["SrcPt", "DstPt", "Packets", "Bytes"]
    invalid = logic.any_of([~blank(F.col(c)) & F.col(c).cast("string").try_cast("bigint").isNull() for c in numbers])
    n = {c: F.when(invalid, 0).otherwise(F.coalesce(F.col(c).cast("string").try_cast("bigint"), F.lit(0))) for c in numbers}
    whole = ~logic.any_of([blank(F.col(c)) for c in ("SrcIpAddr", "SrcPt", "DstIpAddr", "DstPt")])
    udp = logic.eq(F.upper(F.col("Proto")), "UDP") & ~blank(F.col("Flags")) & logic.ne(F.trim(F.col("Flags")), "......")
    volume = (n["Packets"] > 0) & ((n["Bytes"] < 42 * n["Packets"]) | (n["Bytes"] > 65535 * n["Packets"]))
    dns = F.when(n["DstPt"] == 53, logic.ne(F.col("DstIpAddr"), "DNS")).when(n["SrcPt"] == 53, logic.ne(F.col("SrcIpAddr"), "DNS")).otherwise(F.lit(False))
    rule = lambda k, bad, text, *cols: Rule(k, ~(whole & bad), text, cols)
    return [rule("N01", udp, "UDP flows have no flags", "Proto", "Flags"), rule("N02", volume, "42 to 65535 bytes a packet", "Packets", "Bytes"), rule("N03", dns, "port 53 is DNS", "SrcPt", "DstPt"), Rule("N04", whole, "both ends are there", ("SrcIpAddr", "SrcPt", "DstIpAddr", "DstPt"))]


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
