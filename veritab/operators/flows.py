"""Flow records: cleaning of numbers and times, and readable ends from port and subnet classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """A number out of text such as '1,234 B'; null if nothing numeric is left."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.eE+-]", "").try_cast("double")


def to_epoch(c: Column, other: Column) -> Column:
    """Seconds since 1970: a time stamp's text, else a number, else `other`."""
    t = c.cast("string")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(t)) / F.lit(1e6), t.try_cast("double"), other.cast("double"))


def since_first(df: DataFrame, time: str, *groups: str) -> DataFrame:
    """Adds relative: time since the first row (of each group, if any). The first times are a row per group, joined back."""
    if not groups:
        return df.withColumn("relative", F.col(time) - df.agg(F.min(time)).scalar())
    first = df.groupBy(*groups).agg(F.min(time).alias("_first"))
    return df.join(first, list(groups)).withColumn("relative", F.col(time) - F.col("_first")).drop("_first")


def backfilled(df: DataFrame, ports: Mapping[int, int], subnets: Mapping[int, str], order: str) -> DataFrame:
    """Ends of flows that only have classes: SrcPt and DstPt from port classes, addresses from subnet classes.

    Present values stay; a side with port 53 is DNS even over an address. The last part of a made address is order mod 254 + 1.
    """
    port_of = F.create_map(*(F.lit(x) for kv in ports.items() for x in kv))
    net_of = F.create_map(*(F.lit(x) for kv in subnets.items() for x in kv))
    for side in ("Src", "Dst"):
        port = F.coalesce(F.col(f"{side}Pt").cast("string").try_cast("int"), port_of[F.col(f"{side}PortClass").cast("int")])
        made = F.concat(net_of[F.col(f"{side}Subnet").cast("int")], F.lit("."), (F.col(order) % 254 + 1).cast("string"))
        address = F.when(F.trim(F.col(f"{side}IpAddr")) != "", F.col(f"{side}IpAddr"))
        df = df.withColumn(f"{side}Pt", port).withColumn(f"{side}IpAddr", F.when(F.col(f"{side}Pt") == 53, "DNS").otherwise(F.coalesce(address, made)))
    return df


def host_part(c: Column) -> Column:
    """host of host:port; an address with more than one colon is kept."""
    return F.when(F.length(c) - F.length(F.replace(c, F.lit(":"), F.lit(""))) == 1, F.substring_index(c, ":", 1)).otherwise(c)


def mac_text(c: Column) -> Column:
    """Bytes as aa:bb:cc:..."""
    return F.regexp_replace(F.lower(F.hex(c)), "(..)(?!$)", "$1:")
