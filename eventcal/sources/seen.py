"""The set of keys that a growing record holds.

Keys are stored beside the record, dealt to parts by a hash of the key and, where keys have a day, by month; a batch of rows
touches some of them and reads no others. A batch is written to parts of its own, so writing it again replaces what it wrote
before. Whether a row is new is asked in two steps: which stored keys of the touched parts are also in the batch, and which rows of
the batch are not among those. The first join has the batch as its small side, so as long as Spark finds it small enough to
broadcast, stored keys are scanned where they lie and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventcal.session import stored

#: Parts of a month, or of all where keys have no day; more for records of very many rows a month.
PARTS = 4


def _part(key: list[str], parts: int) -> Column:
    """Of equal keys equal, whatever their types are called; nulls too."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key], *[F.col(k).isNull() for k in key]), F.lit(parts)).cast("int")


def _placed(rows: DataFrame, key: list[str], day: str | None, parts: int) -> DataFrame:
    when = F.to_date(day) if day else F.lit(None).cast("date")
    return rows.withColumns({"_month": F.coalesce(F.date_format(when, "yyyy-MM"), F.lit("none")), "_part": _part(key, parts)})


def seen(spark: SparkSession, path: str) -> DataFrame | None:
    """All keys of the store with their ``_month``, ``_part`` and ``_batch``, or None where there is none."""
    from eventcal.sources.export import read_record

    try:
        found = read_record(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = None                                         # a folder without files: batches so far had no rows
    return found.withColumns({"_month": F.col("_month").cast("string"), "_batch": F.col("_batch").cast("string")}) if found is not None else None


def union(spark: SparkSession, path: str, key: list[str]) -> DataFrame | None:
    """U4: every key that any batch brought, once."""
    found = seen(spark, path)
    return found.select(*key).distinct() if found is not None else None


def touched(rows: DataFrame, key: list[str], day: str | None = None, parts: int = PARTS) -> list[tuple[str, int]]:
    """The (month, part) that the rows fall into: at most ``parts`` for each of their months."""
    placed = _placed(rows, key, day, parts).select("_month", "_part").distinct()
    return sorted((r["_month"], r["_part"]) for r in placed.collect())


def held(rows: DataFrame, path: str, key: list[str], day: str | None = None, parts: int = PARTS, batch: object = None) -> DataFrame | None:
    """Keys of the rows that the store holds already, from the parts that the rows touch; those of ``batch`` do not count."""
    known = seen(rows.sparkSession, path)
    if known is None:
        return None
    # Written, the batch's keys have a known size: few are broadcast, and only many make Spark shuffle both sides.
    asked = stored(rows.select(*key).distinct(), "asked")
    places = touched(asked, key, day, parts)
    known = known.filter(F.col("_month").isin(sorted({d for d, _ in places})) & F.col("_part").isin(sorted({p for _, p in places})))
    if batch is not None:
        known = known.filter(F.col("_batch") != str(batch))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return known.alias("s").join(asked.alias("r"), same, "left_semi").select(*[F.col(f"s.{k}").alias(k) for k in key])


def unseen(rows: DataFrame, path: str, key: list[str], day: str | None = None, parts: int = PARTS, batch: object = None) -> DataFrame:
    """The rows whose key the store does not hold; of rows that repeat a key one. Null keys are equal to each other."""
    rows = rows.dropDuplicates(key)
    old = held(rows, path, key, day, parts, batch)
    if old is None:
        return rows
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    return rows.alias("n").join(old.distinct().alias("o"), same, "left_anti").select("n.*")


def remember(rows: DataFrame, path: str, key: list[str], batch: object, day: str | None = None, parts: int = PARTS) -> None:
    """Add the keys of a batch; the same batch again replaces its own. Always give a store the same ``key``, ``day`` and ``parts``."""
    placed = _placed(rows, key, day, parts).select(*key, "_month", "_part", F.lit(str(batch)).alias("_batch"))
    (placed.repartition("_month", "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_month", "_part", "_batch").parquet(path))
