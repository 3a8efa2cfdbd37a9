"""Fetch windows: tiling a date range and skipping what a ledger holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 5


def tile(ranges: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Contiguous windows of at most ``days`` days over each closed range ``start``..``end``."""
    step = F.expr(f"interval {int(days)} days")
    return (ranges.withColumn("window_start", F.explode(F.sequence("start", "end", step)))
            .withColumn("window_start", F.to_date("window_start"))
            .withColumn("span", F.least(F.lit(days), F.date_diff("end", "window_start") + 1).cast("bigint")))


def year_ranges(years: DataFrame) -> DataFrame:
    """One range per calendar year in ``year``."""
    return years.select("*", F.make_date("year", F.lit(1), F.lit(1)).alias("start"),
                        F.make_date("year", F.lit(12), F.lit(31)).alias("end"))


def missing(windows: DataFrame, ledger: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Windows the ledger does not hold."""
    return windows.join(ledger, [*keys, "window_start"], "left_anti")
