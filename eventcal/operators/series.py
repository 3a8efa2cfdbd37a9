"""Daily series: counts, overlap factors, contiguous calendars, day-of-year curves.

All operators take ``keys``, the columns that name a series. One series is the case of no key.
A window here always runs over rows already reduced to days, so the longest partition is a
calendar, whatever the number of detections behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.functions import scalars as X

MIN_OVERLAP_DAYS = 5


def over(*by) -> Window:
    """A partitioned window; with nothing to partition by, the whole (day-grain) frame."""
    return Window.partitionBy(*(by or (F.lit(0),)))


def daily_counts(record: DataFrame, keys: list[str] = (), weights: bool = False) -> DataFrame:
    """A3: detections and radiative power per day and sensor. The one shuffle of raw rows."""
    extra = [F.sum("esfp").alias("esfp"), F.sum(F.col("frp") * F.col("esfp")).alias("hfi")] if weights else []
    return record.groupBy(*keys, "date", "sensor").agg(
        F.count("*").alias("n"), F.sum("frp").alias("frp"), *extra)


def with_factors(counts: DataFrame, keys: list[str] = (), min_days: int = MIN_OVERLAP_DAYS) -> DataFrame:
    """A4: the multiplier that puts each sensor on the best-covered sensor's scale.

    The reference sensor has the most non-zero days (first by name on a tie). A sensor that
    shares fewer than ``min_days`` days with it keeps 1.
    """
    by_key, by_sensor = over(*keys), over(*keys, "sensor")
    both = (F.col("n") > 0) & (F.col("_ref_n") > 0)
    overlap = F.count_if(both).over(by_sensor)
    ratio = (F.sum(F.when(both, F.col("_ref_n"))).over(by_sensor)
             / F.sum(F.when(both, F.col("n"))).over(by_sensor))
    return (
        counts
        .withColumn("_active", F.count_if(F.col("n") > 0).over(by_sensor))
        .withColumn("_ref", F.min(F.struct(-F.col("_active"), F.col("sensor").alias("name"))).over(by_key)["name"])
        .withColumn("_ref_n", F.max(F.when(F.col("sensor") == F.col("_ref"), F.col("n"))).over(over(*keys, "date")))
        .withColumn("overlap_days", overlap)
        .withColumn("factor", F.when((F.col("sensor") != F.col("_ref")) & (overlap >= min_days), ratio)
                    .otherwise(F.lit(1.0)))
        .withColumnRenamed("_ref", "reference")
        .drop("_active", "_ref_n")
    )


def sensor_factors(counts: DataFrame, keys: list[str] = (), min_days: int = MIN_OVERLAP_DAYS) -> DataFrame:
    """A4 as a table: one row per series and sensor."""
    return with_factors(counts, keys, min_days).groupBy(*keys, "sensor").agg(
        F.first("reference").alias("reference"),
        F.first("overlap_days").alias("overlap_days"),
        F.first("factor").alias("factor"))


def fill_days(df: DataFrame, keys: list[str], zero: list[str], date: str = "date") -> DataFrame:
    """Every day between a series' first and last, the listed columns 0 on a new day.

    Each row is stretched over the gap to its successor, so the spine needs no join. ``present``
    tells an observed day from a filled one.
    """
    order = over(*keys).orderBy(date)
    gap_end = F.coalesce(F.date_sub(F.lead(date).over(order), 1), F.col(date))
    spread = df.withColumn("_end", gap_end).withColumn(
        "_day", F.explode(F.sequence(F.col(date), F.col("_end"))))
    present = F.col("_day") == F.col(date)
    rest = [c for c in df.columns if c not in (*keys, *zero, date)]
    return spread.select(
        *keys, F.col("_day").alias(date),
        *[F.when(present, F.col(c)).otherwise(F.lit(0)).cast(df.schema[c].dataType).alias(c) for c in zero],
        *[F.when(present, F.col(c)).alias(c) for c in rest],
        present.alias("present"))


def combine_sensors(counts: DataFrame, keys: list[str] = (), min_days: int = MIN_OVERLAP_DAYS) -> DataFrame:
    """A5 before the spine: factor-scaled count, raw count and power per observed day."""
    scaled = with_factors(counts, keys, min_days)
    return scaled.groupBy(*keys, "date").agg(
        F.sum(F.col("n") * F.col("factor")).alias("count"),
        F.sum("n").alias("raw"),
        F.sum("frp").alias("frp"))


def harmonized_daily(counts: DataFrame, keys: list[str] = (), min_days: int = MIN_OVERLAP_DAYS) -> DataFrame:
    """A5: the comparable daily series on a contiguous calendar."""
    return fill_days(combine_sensors(counts, keys, min_days), list(keys), ["count", "raw", "frp"])


def daily(record: DataFrame, keys: list[str] = ()) -> DataFrame:
    return harmonized_daily(daily_counts(record, keys), keys)


def at_least_days(series: DataFrame, days: int, keys: list[str] = ()) -> DataFrame:
    """Series shorter than ``days`` answer with no rows."""
    return (series.withColumn("_days", F.count("*").over(over(*keys)))
            .filter(F.col("_days") >= days).drop("_days"))


def calendar_parts(date: str = "date") -> list[Column]:
    return [F.year(date).alias("year"), F.month(date).alias("month"), F.dayofyear(date).alias("doy")]


# ------------------------------------------------------------------ row windows
def rolling_quantiles(series: DataFrame, value: str, window: int, quantiles: dict[str, float],
                      keys: list[str] = (), min_rows: int = 3) -> DataFrame:
    """Centred rolling quantiles; null where the frame holds fewer than ``min_rows``."""
    frame = over(*keys).orderBy("date").rowsBetween(-(window // 2), (window - 1) // 2)
    probs = F.array(*[F.lit(q) for q in quantiles.values()])
    df = series.withColumn("_q", F.percentile(F.col(value), probs).over(frame)).withColumn(
        "_rows", F.count(value).over(frame))
    picked = [F.when(F.col("_rows") >= min_rows, F.col("_q")[i]).alias(name)
              for i, name in enumerate(quantiles)]
    return df.select(*series.columns, *picked)


def rolling_mean(value: str, order: Window, before: int, after: int) -> Column:
    """W2/W3."""
    return F.avg(value).over(order.rowsBetween(-before, after))


def lagged(value: str, order: Window, k: int) -> Column:
    """W4."""
    return F.lag(value, k).over(order)


def step_sizes(value: str, order: Window) -> Column:
    """Absolute day-to-day change."""
    return F.abs(F.col(value) - F.lag(value, 1).over(order))


def islands(df: DataFrame, date: str, keys: list[str] = (), max_gap: int = 2) -> DataFrame:
    """Number the runs of dates whose successive gaps are at most ``max_gap`` days."""
    order = over(*keys).orderBy(date)
    opens = F.coalesce((F.date_diff(F.col(date), F.lag(date).over(order)) > max_gap).cast("int"), F.lit(0))
    return (df.withColumn("_opens", opens)
            .withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("_opens"))


def value_runs(series: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Contiguous runs of days that carry a value."""
    runs = islands(series.filter(F.col(value).isNotNull()), "date", keys, max_gap=1)
    return runs.groupBy(*keys, "island").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"))


def day_spans(days: DataFrame, day: str, keys: list[str] = ()) -> DataFrame:
    """P30: "1–2 · 5" out of the days 1, 2 and 5."""
    order = over(*keys).orderBy(day)
    opened = F.coalesce((F.col(day) - F.lag(day).over(order) > 1).cast("int"), F.lit(0))
    numbered = days.withColumn("_o", opened).withColumn(
        "_run", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*keys, "_run").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(
        F.concat_ws("–", F.col("a").cast("string"), F.col("b").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("a"), text.alias("t"))))
    return spans.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda s: s["t"]), " · ").alias("spans"))


# ------------------------------------------------------------------ filling
def fill_linear(df: DataFrame, keys: list[str], x: str, y: str, low: int, high: int) -> DataFrame:
    """``y`` at every integer ``x`` in [low, high], linear between known points.

    Before the first and after the last known point the nearest value holds.
    """
    order = over(*keys).orderBy(x)
    known = (df.filter(F.col(y).isNotNull()).select(*keys, F.col(x).cast("int").alias(x), y)
             .withColumn("_nx", F.lead(x).over(order)).withColumn("_ny", F.lead(y).over(order))
             .withColumn("_px", F.lag(x).over(order)))
    first = F.when(F.col("_px").isNull(), F.lit(low)).otherwise(F.col(x))
    last = F.coalesce(F.col("_nx") - 1, F.lit(high))
    at = F.col("_at")
    slope = (F.col("_ny") - F.col(y)) / (F.col("_nx") - F.col(x))
    value = F.when((at <= F.col(x)) | F.col("_nx").isNull(), F.col(y)).otherwise(
        F.col(y) + slope * (at - F.col(x)))
    return (known.withColumn("_lo", first).withColumn("_hi", last)
            .withColumn("_at", F.explode(F.sequence(F.col("_lo"), F.col("_hi"))))
            .select(*keys, at.alias(x), value.alias(y)))


def doy_means(series: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """A10."""
    return series.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(F.avg(value).alias(value))


def doy_curve(series: DataFrame, value: str, keys: list[str] = (), smooth: int = 15) -> DataFrame:
    """F1/F3 curve: day-of-year means, missing days interpolated, then a centred mean.

    Not circular at the year end: 366 exists in leap years only, and 1 and 366 are ends.
    """
    filled = fill_linear(doy_means(series, value, keys), list(keys), "doy", value, 1, S.DOY_BINS)
    return smooth_doy(filled, value, keys, smooth)


def smooth_doy(curve: DataFrame, value: str, keys: list[str] = (), smooth: int = 15) -> DataFrame:
    order = over(*keys).orderBy("doy")
    return curve.withColumn(value, rolling_mean(value, order, smooth // 2, (smooth - 1) // 2))


def doy_matrix(series: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """The values of each day of year, oldest first."""
    listed = F.sort_array(F.collect_list(F.struct(F.year("date").alias("year"), F.col(value).alias("v"))))
    return series.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(
        F.transform(listed, lambda e: e["v"]).alias("values"))


def year_lists(series: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """The daily values of each year in date order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("date"), F.col(value).alias("v"))))
    return series.groupBy(*keys, F.year("date").alias("year")).agg(
        F.transform(listed, lambda e: e["v"]).alias("values"))


# ------------------------------------------------------------------ climatology (Q5)
ENVELOPE = {"p10": 0.10, "p50": 0.50, "p90": 0.90, "p95": 0.95}


def doy_envelope(series: DataFrame, window: int = 15, keys: list[str] = ()) -> DataFrame:
    """W1 + A10: rolling quantiles of the series averaged per day of year."""
    window = min(max(window, 3), 45)
    rolled = rolling_quantiles(series, "count", window, ENVELOPE, keys)
    return rolled.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(
        *[F.avg(name).alias(name) for name in ENVELOPE], F.avg("count").alias("mean"))


def envelope_steps(envelope: DataFrame, step: int = 5) -> DataFrame:
    """Every ``step``-th day of year, 1..365."""
    step = min(max(step, 1), 30)
    return envelope.filter((F.col("doy") <= 365) & ((F.col("doy") - 1) % step == 0) & F.col("p50").isNotNull())


def season_summary(series: DataFrame, window: int = 15, keys: list[str] = ()) -> DataFrame:
    """Peak, onset and cessation of the season from the p95 curve."""
    window = min(max(window, 3), 45)
    rolled = rolling_quantiles(series, "count", window, {"p95": 0.95}, keys)
    rolled = rolled.withColumn("_median", F.percentile("count", F.lit(0.5)).over(over(*keys)))
    curve = rolled.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(
        F.avg("p95").alias("p95"), F.avg("count").alias("mean"), F.max("_median").alias("_median"))
    curve = curve.withColumn("_peak", F.max("p95").over(over(*keys)))
    high = (F.col("p95") >= 0.5 * F.col("_peak")) & (F.col("doy") <= 365)
    # The first day of year holds the maximum when several share it.
    first_max = lambda c: F.max(F.struct(F.col(c), -F.col("doy")))
    agg = curve.groupBy(*keys).agg(
        first_max("p95").alias("_p"), F.max("p95").alias("peak_p95"),
        F.min(F.when(high, F.col("doy"))).alias("onset_doy"),
        F.max(F.when(high, F.col("doy"))).alias("cessation_doy"),
        F.max("_median").alias("median_daily"), first_max("mean").alias("_m"))
    return agg.select(*keys, (-F.col("_p.col2")).alias("peak_doy"), "peak_p95", "onset_doy", "cessation_doy",
                      "median_daily", (-F.col("_m.col2")).alias("max_mean_doy"))


# ------------------------------------------------------------------ calendar views
def heat_levels(series: DataFrame, keys: list[str] = (), per_year: bool = False) -> DataFrame:
    """P26 against the peak of the record, or of each year."""
    by = [*keys, F.year("date")] if per_year else list(keys)
    return series.withColumn("level", X.heat_level(F.col("count"), F.max("count").over(over(*by))))


def year_summary(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Total, first peak day and active days of each year."""
    peak = F.max(F.struct(F.col("count").alias("c"), (-F.unix_date("date")).alias("d")))
    out = series.groupBy(*keys, F.year("date").alias("year")).agg(
        F.sum("count").alias("total"), peak.alias("_p"),
        F.count_if(F.col("count") > 0).alias("active_days"), F.count("*").alias("days"))
    return out.select(*keys, "year", "total", F.date_from_unix_date(-F.col("_p.d")).alias("peak_date"),
                      F.col("_p.c").alias("peak_count"), "active_days", "days")


def log_level(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean and population spread of log1p of the series."""
    return series.groupBy(*keys).agg(
        F.avg(F.log1p("count")).alias("mu"), F.stddev_pop(F.log1p("count")).alias("sd"),
        F.count("*").alias("days"))
