"""The driver's tables seen as detection exports.

The tables hold no detections, so ``lineitem`` stands in: plain arithmetic on its keys gives
every line item a place, a time, a confidence and a source. The first source has the rows of status F
and all from before 1998, the second the others. A few percent have bad confidence codes, out-of-range
latitudes or missing tracks on purpose, and fall out in harmonisation like any other unusable row. No line item is
left out of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventcal.operators import record as R
from eventcal.session import finer_scans, stored, tune

BREAK_YEAR, OVERLAP_TO = 1998, 2001

# Both engines read this text; {text} is the engine's string type and {first} says that a row is of the first source.
FIRST = "l_linestatus = 'F' OR l_shipdate < TIMESTAMP '1998-01-01 00:00:00'"
RAW_SELECT = """
SELECT
 concat('fire_', CASE WHEN l_suppkey % 5 = 0 THEN 'nrt' ELSE 'archive' END, '_',
        CASE WHEN {first} THEN 'M-C61' ELSE 'SV-C2' END, '_',
        CAST(l_suppkey % 10 AS {text}), '.csv') AS src_file,
 CASE WHEN l_orderkey % 97 = 0 THEN 999e0
      ELSE -38e0 + ((l_suppkey % 24) * 62 % 80) + ((l_orderkey * 7 + l_partkey * 13) % 21 - 10) / 2000e0
 END AS latitude,
 -124e0 + ((l_suppkey % 24) * 202 % 270) + ((l_orderkey * 11 + l_partkey * 5) % 21 - 10) / 2000e0 AS longitude,
 CAST(CAST(l_shipdate AS DATE) AS {text}) AS acq_date,
 CAST((l_partkey % 24) * 100 + (l_orderkey % 60) AS {text}) AS acq_time,
 CASE WHEN {first} THEN CAST(28 + (l_partkey * 7 + l_orderkey) % 73 AS {text})
      WHEN l_orderkey % 47 = 0 THEN 'l' WHEN l_orderkey % 53 = 0 THEN '?'
      ELSE CASE l_orderkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'h' WHEN 2 THEN 'nominal' ELSE 'HIGH ' END
 END AS confidence,
 CASE WHEN {first} THEN 290e0 + l_quantity END AS brightness,
 CASE WHEN NOT ({first}) THEN 300e0 + l_quantity END AS bright_ti4,
 CASE WHEN {first} THEN 1e0 + (l_partkey % 39) / 10e0
      ELSE 0.375e0 + (l_partkey % 80) / 100e0 END AS scan,
 CASE WHEN l_orderkey % 50 = 0 THEN NULL
      WHEN {first} THEN 1e0 + (l_partkey % 11) / 10e0
      ELSE 0.375e0 + (l_orderkey % 80) / 100e0 END AS track,
 l_extendedprice / 1000e0 AS frp,
 CASE WHEN {first} THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Terra' ELSE 'Aqua' END
      ELSE CASE l_suppkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'N20' ELSE 'N21' END END AS satellite,
 CASE WHEN {first} THEN 'MODIS'
      ELSE CASE l_suppkey % 3 WHEN 0 THEN 'SNPP' WHEN 1 THEN 'VIIRS' ELSE NULL END END AS instrument
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _columns(select: str) -> list[str]:
    """Split the select list at its top-level commas."""
    body, parts, depth, start = select.strip()[len("SELECT"):], [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, body[start:]]]


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a row of a raw export."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_columns(RAW_SELECT.format(text="STRING", first=FIRST)))


_RECORDS: dict[tuple[str, str], DataFrame] = {}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harmonised, de-duplicated record, written once for each session and folder, by time.

    Every analysis starts from it; its size is then known to the planner, and date filters skip row groups.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RECORDS:
        record = R.deduped(R.parsed(raw_detections(spark, sf_dir)))
        with finer_scans(spark):
            _RECORDS[key] = stored(record.sortWithinPartitions("time"), "record")
    return _RECORDS[key]


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one-source events, keyed by priority."""
    return table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.to_date("o_orderdate").alias("date"), F.lit("ORDERS").alias("sensor"),
        (F.col("o_totalprice") / 1000).alias("frp"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the region of their customer."""
    customers = (table(spark, sf_dir, "customer")
                 .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                 .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
                 .select("c_custkey", "r_name"))
    return (table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select("r_name", F.to_date("o_orderdate").alias("date"), F.lit("ORDERS").alias("sensor"),
                    (F.col("o_totalprice") / 1000).alias("frp")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
