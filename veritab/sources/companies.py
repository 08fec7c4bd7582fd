"""Synthetic company periods whose identities hold exactly; each row is a function of its numbers and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _between(low, high, *parts) -> Column:
    """A whole number drawn by hash."""
    return (F.lit(low) + F.pmod(F.xxhash64(*parts), F.lit(high - low + 1))).cast("long")


def company_rows(spark: SparkSession, industries: list[str], companies: int = 40, periods: int = 8, seed: int = 42) -> DataFrame:
    """A row per company and period. Openings are the period before's ends; assets are liabilities plus equity."""
    n, s = len(industries), F.lit(seed)
    d = spark.range(n * companies * periods).select((F.col("id") / periods).cast("long").alias("c"), (F.col("id") % periods + 1).cast("int").alias("PeriodIndex"))
    names = F.array(*map(F.lit, industries))
    d = d.select(F.format_string("C%04d", F.col("c")).alias("CompanyId"), F.element_at(names, (F.col("c") % n + 1).cast("int")).alias("Industry"), "PeriodIndex", "c")
    p = F.col("PeriodIndex")
    revenue = (_between(5_000, 50_000, s, "c") * (100 + p * _between(0, 6, s, F.lit(2), "c")) / 100).cast("long")
    d = d.withColumn("Revenue", revenue).withColumn("COGS", (F.col("Revenue") * _between(50, 75, s, F.lit(3), "c", p) / 100).cast("long"))
    d = d.withColumn("GrossProfit", F.col("Revenue") - F.col("COGS")).withColumn("NetProfit", (F.col("GrossProfit") * 4 / 10).cast("long"))
    d = d.withColumn("Purchases", F.col("COGS") + _between(-200, 400, s, F.lit(4), "c", p))
    upto = Window.partitionBy("c").orderBy("PeriodIndex").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("Inventory_End", 3_000 + F.sum(F.col("Purchases") - F.col("COGS")).over(upto)).withColumn("Inventory_Begin", F.col("Inventory_End") - F.col("Purchases") + F.col("COGS"))
    d = d.withColumn("Cash_End", 1_000 + F.sum("NetProfit").over(upto)).withColumn("Cash_Begin", F.col("Cash_End") - F.col("NetProfit"))
    d = d.withColumn("AccountsReceivable", (F.col("Revenue") * 18 / 100).cast("long")).withColumn("OtherAssets", F.col("Revenue") * 2)
    d = d.withColumn("TotalAssets", F.col("Inventory_End") + F.col("Cash_End") + F.col("AccountsReceivable") + F.col("OtherAssets"))
    d = d.withColumn("TotalLiabilities", (F.col("TotalAssets") * 45 / 100).cast("long")).withColumn("TotalEquity", F.col("TotalAssets") - F.col("TotalLiabilities"))
    return d.withColumn("InventoryToAssetsBp", F.bround(F.col("Inventory_End") / F.col("TotalAssets") * 10_000).cast("long")).withColumn("ReceivableToRevenueBp", F.bround(F.col("AccountsReceivable") / F.col("Revenue") * 10_000).cast("long")).drop("c")


def with_faults(df: DataFrame, amounts: dict[int, tuple[str, int]]) -> DataFrame:
    """Adds an amount to a column in given periods."""
    for period, (c, amount) in amounts.items():
        df = df.withColumn(c, F.when(F.col("PeriodIndex") == period, F.col(c) + amount).otherwise(F.col(c)))
    return df
