"""Small fixed tables: a company's eight clean periods with its named faults, and flows of which three are wrong."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.checks import cell_changes

# The clean company, a number for each period 1 to 8.
REVENUE = [80000, 82000, 84000, 86000, 88000, 90000, 96600, 98000]
COGS = [2000, 2200, 2000, 2400, 2500, 2600, 2800, 3000]
NET_PROFIT = [23400, 24000, 24600, 25100, 25700, 26200, 28100, 28500]
CASH_END = [8000, 8600, 9200, 9800, 10400, 11000, 11600, 12200]
INVENTORY_END = [9500, 10000, 12000, 11500, 11800, 12000, 12200, 12400]
RECEIVABLE = [20000, 20500, 21000, 21500, 22000, 22500, 24150, 24500]
ASSETS = [800000, 808000, 816000, 824000, 832000, 840000, 848000, 856000]
EQUITY = [440000, 444400, 448800, 453200, 457600, 462000, 466400, 470800]
CASH_BEFORE, INVENTORY_BEFORE = 7500, 9000
# Fixed values end.

PERIOD = ["CompanyId", "PeriodIndex"]
AMOUNTS = [
    "Revenue", "COGS", "GrossProfit", "NetProfit", "Purchases", "Cash_Begin", "Cash_End", "Inventory_Begin", "Inventory_End", "AccountsReceivable",
    "OtherAssets", "TotalAssets", "TotalLiabilities", "TotalEquity", "InventoryNetInflow", "InventoryToAssetsBp", "ReceivableToRevenueBp",
]


def _bp(part: str, whole: str) -> Column:
    return F.bround(F.col(part) / F.col(whole) * 10_000).cast("long")


#: columns that follow from others
DERIVED: dict[str, Callable[[], Column]] = {
    "GrossProfit": lambda: F.expr("Revenue - COGS"),
    "TotalLiabilities": lambda: F.expr("TotalAssets - TotalEquity"),
    "OtherAssets": lambda: F.expr("TotalAssets - Cash_End - Inventory_End - AccountsReceivable"),
    "InventoryNetInflow": lambda: F.expr("Purchases - COGS"),
    "InventoryToAssetsBp": lambda: _bp("Inventory_End", "TotalAssets"),
    "ReceivableToRevenueBp": lambda: _bp("AccountsReceivable", "Revenue"),
}


def clean_package(spark: SparkSession, company: str = "C0001", industry: str = "consulting") -> DataFrame:
    """The clean company: eight periods that obey all identities and continuity."""
    given = zip(REVENUE, COGS, NET_PROFIT, CASH_END, INVENTORY_END, RECEIVABLE, ASSETS, EQUITY, [CASH_BEFORE, *CASH_END], [INVENTORY_BEFORE, *INVENTORY_END])
    names = "Revenue long, COGS long, NetProfit long, Cash_End long, Inventory_End long, AccountsReceivable long, TotalAssets long, TotalEquity long, Cash_Begin long, Inventory_Begin long"
    d = spark.createDataFrame([(company, industry, k, *row) for k, row in enumerate(given, 1)], f"CompanyId string, Industry string, PeriodIndex int, {names}")
    d = d.withColumn("Purchases", F.expr("COGS + Inventory_End - Inventory_Begin")).withColumns({c: make() for c, make in DERIVED.items()})
    return d.select("CompanyId", "Industry", "PeriodIndex", *AMOUNTS)


def _inflated(c: str, by: int) -> Column:
    return F.col(c) + by


#: name: (rule that finds it, [(period, {column: wrong value})], columns that follow in the first of the periods). Each list is applied in order; a later step
#: sees the columns as the step before left them; {column}_base is the clean value four periods ago.
FAULTS: dict[str, tuple[str, list[tuple[int, Mapping[str, Callable[[], Column]]]], tuple[str, ...]]] = {
    "F1": ("R01", [(3, {"COGS": lambda: _inflated("COGS", 1000)})], ("GrossProfit", "InventoryNetInflow")),
    "F2a": ("R04", [(2, {"Cash_Begin": lambda: _inflated("Cash_Begin", 500)})], ()),
    "F2b": ("R02", [(5, {"Cash_End": lambda: _inflated("Cash_End", 500), "TotalAssets": lambda: _inflated("TotalAssets", 500)}), (6, {"Cash_Begin": lambda: _inflated("Cash_Begin", 500)})], ("InventoryToAssetsBp",)),
    "F4": ("R07", [(7, {"AccountsReceivable": lambda: F.col("AccountsReceivable_base") * 4})], ("OtherAssets", "ReceivableToRevenueBp")),
    "F3": ("R06", [(8, {"Inventory_End": lambda: F.bround(F.col("TotalAssets") * 0.35).cast("long")}), (8, {"Purchases": lambda: F.expr("Inventory_End - Inventory_Begin + COGS")})], ("OtherAssets", "InventoryNetInflow", "InventoryToAssetsBp")),
}


def with_named_faults(clean: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Companies of eight periods with the named faults (all by default); each company's four-periods-ago value comes by a join on its own rows."""
    base = clean.select("CompanyId", (F.col("PeriodIndex") + 4).alias("PeriodIndex"), F.col("AccountsReceivable").alias("AccountsReceivable_base"))
    d = clean.join(base, PERIOD, "left")
    for name in names or list(FAULTS):
        _, steps, follow = FAULTS[name]
        for period, wrong in steps:
            d = d.withColumns({c: F.when(F.col("PeriodIndex") == period, make()).otherwise(F.col(c)) for c, make in wrong.items()})
        d = d.withColumns({c: F.when(F.col("PeriodIndex") == steps[0][0], DERIVED[c]()).otherwise(F.col(c)) for c in follow})
    return d.select(clean.columns)


def truth_table(clean: DataFrame) -> DataFrame:
    """fault, rule_id, CompanyId, PeriodIndex, column, old (right), new (wrong): every cell that a fault alone changes."""
    cells = None
    for name, (rule, *_) in FAULTS.items():
        changed = cell_changes(clean, with_named_faults(clean, [name]), PERIOD, AMOUNTS).select(F.lit(name).alias("fault"), F.lit(rule).alias("rule_id"), "*")
        cells = changed if cells is None else cells.unionByName(changed)
    return cells


#: scenarios that faults can be put into
SCENARIOS: dict[str, Callable[[DataFrame], DataFrame]] = {"finance_v1": with_named_faults}


def injected(scenario: str, clean: DataFrame) -> DataFrame:
    if scenario not in SCENARIOS:
        raise NotImplementedError(f"no faults for scenario {scenario!r}; there are {sorted(SCENARIOS)}")
    return SCENARIOS[scenario](clean)


def write_package(clean: DataFrame, folder: str) -> dict[str, str]:
    """Clean and faulty tables as CSV and the truth table as JSON lines, in three folders; their paths."""
    paths = {k: os.path.join(folder, k) for k in ("clean", "faulty", "truth_table")}
    clean.write.csv(paths["clean"], header=True)
    with_named_faults(clean).write.csv(paths["faulty"], header=True)
    truth_table(clean).write.json(paths["truth_table"])
    return paths


# Ten flows; the second has flags on UDP, the fifth too many bytes a packet, the eighth port 53 without DNS.
_FLOWS = [
    ("2017-03-24 10:00:01.000", 0.0, "TCP", "192.168.220.7", 37320, "10081_164", 80, 1, 66, ".A...."),
    ("2017-03-24 10:00:02.300", 0.002, "UDP", "192.168.220.8", 34358, "DNS", 53, 2, 164, ".AP.SF"),
    ("2017-03-24 10:00:03.110", 0.21, "TCP", "192.168.220.16", 37922, "10082_43", 443, 5, 1100, ".AP.SF"),
    ("2017-03-24 10:00:04.870", 0.0, "TCP", "192.168.220.4", 57656, "10056_105", 443, 1, 66, ".A...."),
    ("2017-03-24 10:00:05.420", 0.05, "TCP", "192.168.220.12", 51413, "192.168.100.3", 8000, 1, 180000, ".AP.SF"),
    ("2017-03-24 10:00:06.001", 1.4, "TCP", "192.168.220.5", 49152, "192.168.100.3", 8000, 10, 5200, ".AP.SF"),
    ("2017-03-24 10:00:07.640", 0.0, "UDP", "192.168.220.9", 137, "192.168.220.255", 137, 1, 92, "......"),
    ("2017-03-24 10:00:08.220", 0.01, "TCP", "192.168.220.14", 41608, "192.168.220.3", 53, 2, 178, ".AP.SF"),
    ("2017-03-24 10:00:09.508", 0.33, "TCP", "192.168.210.5", 445, "192.168.220.15", 52174, 8, 3664, ".AP.SF"),
    ("2017-03-24 10:00:10.090", 0.0, "UDP", "192.168.220.6", 38844, "DNS", 53, 2, 196, "......"),
]
# Fixed values end.


def flow_rows(spark: SparkSession, n: int = 10) -> DataFrame:
    """The first n of the ten flows."""
    names = "DateFirstSeen string, Duration double, Proto string, SrcIpAddr string, SrcPt long, DstIpAddr string, DstPt long, Packets long, Bytes long, Flags string"
    return spark.createDataFrame(_FLOWS[:n], names).select("*", F.lit(1).alias("Flows"), F.lit(0).alias("Tos"))
