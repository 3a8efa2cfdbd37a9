"""Bounded picks from unbounded groups.

Picking the first n rows of a group that may hold a third of all rows must not sort that
group in one task. The operators here count rows per coarse bucket first (an aggregate that
collapses before its shuffle), decide from those counts which buckets matter, and only then
rank the few rows that are left. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventcal.operators.series import over
from eventcal.session import stored

#: Rows for one task that sorts them.
TASK_ROWS = 500_000


def sample_key(seed: int = 0) -> Column:
    """T4: a reproducible pseudo-random order of record rows.

    A digest of the seed and the identity key, at 1e-5 degree; engines agree on it.
    """
    micro = lambda c: F.round(F.col(c) * 100000).cast("bigint").cast("string")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), micro("lat"), micro("lon"),
                             F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.col("sensor")))


def smallest(df: DataFrame, n: int | str, order: list[Column], bucket: Column, keys: list[str] = ()) -> DataFrame:
    """The ``n`` first rows of each group in ``order``; ``n`` may be a column of the group.

    ``bucket`` must never decrease along ``order``. Only rows up to the bucket in which the
    n-th row falls are ranked.
    """
    quota = F.col(n) if isinstance(n, str) else F.lit(n)
    extra = [n] if isinstance(n, str) else []
    tagged = df.withColumn("_bucket", bucket)
    filled = tagged.groupBy(*keys, *extra, "_bucket").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(over(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    cut = (filled.withColumn("_before", F.coalesce(running, F.lit(0)))
           .filter(F.col("_before") < quota)
           .groupBy(*keys).agg(F.max("_bucket").alias("_cut")))
    if keys:
        left = tagged.join(cut, list(keys)).filter(F.col("_bucket") <= F.col("_cut"))
    else:
        left = tagged.join(cut, F.col("_bucket") <= F.col("_cut"))
    # Rank inside buckets first, so that a full bucket does not meet the others in one task.
    ranked = left.withColumn("_in", F.row_number().over(over(*keys, "_bucket").orderBy(*order)))
    ranked = ranked.filter(F.col("_in") <= quota)
    ranked = ranked.withColumn("rank", F.row_number().over(over(*keys).orderBy("_bucket", "_in")))
    return ranked.filter(F.col("rank") <= quota).drop("_bucket", "_cut", "_in")


def sample(record: DataFrame, limit: int = 6000, seed: int = 0) -> DataFrame:
    """T4: a uniform sample of ``limit`` rows, or all if there are fewer; the top of each partition, then of those."""
    if limit < 1:
        raise ValueError("limit: one row or more")
    return record.withColumn("_key", sample_key(seed)).orderBy("_key").limit(limit).drop("_key")


def hour() -> Column:
    """Hours since the epoch: the bucket for picks in time order."""
    return F.floor(F.unix_seconds("time") / 3600)


def head(record: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` rows by time, with ``capped`` telling whether more existed."""
    total = record.agg(F.count("*").alias("_total"))
    picked = record.orderBy(*order).limit(limit)
    return picked.join(total, F.lit(True)).withColumn("capped", F.col("_total") > limit).drop("_total")


def newest(record: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The last ``limit`` rows by time."""
    return record.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def global_rank(df: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """Row number over the whole frame without sorting it in one task.

    ``levels`` are columns, coarse to fine, that never decrease along ``order``. Each level's
    offset comes from counts; only rows of the finest bucket are sorted together.
    """
    offsets = counts = stored(df.groupBy(*levels).agg(F.count("*").alias("_n")), "counts")
    for depth in range(len(levels)):
        by = levels[:depth + 1]
        before = over(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        level = counts.groupBy(*by).agg(F.sum("_n").alias("_s"))
        level = level.select(*by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(f"_o{depth}"))
        offsets = offsets.join(level, by)
    total = sum((F.col(f"_o{depth}") for depth in range(1, len(levels))), F.col("_o0"))
    offsets = offsets.select(*levels, total.alias("_offset"))
    # Rows like these are packed so well that Spark, by their bytes alone, would put millions into one task to sort.
    rows = counts.agg(F.sum("_n")).first()[0] or 0
    # Of fewer parts than a shuffle has by default Spark would make that many, by one more shuffle.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return (df.repartition(parts, *levels).join(offsets.repartition(parts, *levels).hint("shuffle_merge"), levels)
            .withColumn("row", F.row_number().over(over(*levels).orderBy(*order)) + F.col("_offset"))
            .drop("_offset"))


def stride(record: DataFrame, every: int, order: tuple = ("time", "lat", "lon", "sensor")) -> DataFrame:
    """Every ``every``-th row of the time order, over the whole span."""
    tagged = (record.withColumn("_l1", F.unix_date("date")).withColumn("_l2", F.unix_seconds("time"))
              .withColumn("_l3", F.floor((F.col("lat") + 90) * 16)))
    ranked = global_rank(tagged, ["_l1", "_l2", "_l3"], ["time", "lat", "lon", "sensor"])
    return ranked.filter((F.col("row") - 1) % every == 0).drop("_l1", "_l2", "_l3", "row")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Top-k of an already aggregated frame."""
    return df.orderBy(*order).limit(n)


def every_kth(df: DataFrame, k: int, order: str, keys: list[str] = ()) -> DataFrame:
    """Every k-th row of each (day-grain) series, starting with its first."""
    numbered = df.withColumn("_i", F.row_number().over(over(*keys).orderBy(order)) - 1)
    return numbered.filter(F.col("_i") % k == 0).drop("_i")


def share(value: str, keys: list[str] = ()) -> Column:
    """W14."""
    return F.col(value) / F.sum(value).over(over(*keys))
