"""Anomalies, season bands, streaks and threat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.operators import series as Q
from eventcal.operators.ranking import top
from eventcal.operators.series import over

MIN_LEVEL = 5.0
STREAK_LEVEL = 3.0
MAD_TO_SIGMA = 1.4826


def _scores(df: DataFrame, n: Column, s: Column, ss: Column, v: Column, centre: Column | None = None) -> DataFrame:
    """Mean, population spread and z of ``v`` against n values with sum s and squares ss."""
    mean = s / n
    sd = F.when(n > 1, F.sqrt(F.greatest(ss / n - mean * mean, F.lit(0.0))))
    shift = F.lit(0.0) if centre is None else centre
    return (df.withColumn("n", n).withColumn("mu", F.when(n > 0, mean + shift))
            .withColumn("sd", sd)
            .withColumn("z", F.when((n > 1) & (sd > 1e-9), (v - shift - mean) / sd)))


def zscore_doy_window(series: DataFrame, keys: list[str] = (), reach: int = 7) -> DataFrame:
    """Each day against the ±``reach`` days of year of all other years.

    Sums per (day of year, year) minus the year's own part give the other years' moments, so the
    work grows with days and not with pairs of years. Values are centred on the series mean first,
    which keeps the subtraction exact enough.
    """
    centred = (series.select(*keys, "date", F.col("count").alias("v"))
               .withColumn("_c", F.avg("v").over(over(*keys)))
               .withColumn("_x", F.col("v") - F.col("_c")))
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    spread = centred.withColumn("_off", F.explode(offsets)).withColumn(
        "doy", F.pmod(F.dayofyear("date") - 1 + F.col("_off"), F.lit(S.DOY_BINS)) + 1)
    own = F.col("_off") == 0
    per_year = spread.groupBy(*keys, "doy", F.year("date").alias("year")).agg(
        F.count("*").alias("_n"), F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_ss"),
        F.max(F.when(own, F.col("date"))).alias("date"), F.max(F.when(own, F.col("v"))).alias("v"),
        F.max("_c").alias("_c"))
    others = over(*keys, "doy")
    rest = lambda c: F.sum(c).over(others) - F.col(c)
    summed = per_year.withColumn("_on", rest("_n")).withColumn("_os", rest("_s")).withColumn("_oss", rest("_ss"))
    days = summed.filter(F.col("date").isNotNull())
    scored = _scores(days, F.col("_on"), F.col("_os"), F.col("_oss"), F.col("v"), F.col("_c"))
    return scored.select(*keys, "date", "v", "mu", "sd", "z", "n")


def zscore_boundary(series: DataFrame, keys: list[str] = (), reach: int = 7) -> DataFrame:
    """The shifted-series form, in which only days near a year boundary get a score.

    A value ``off`` rows back counts when the date ``off`` days *ahead* lies in another year.
    ``series`` must be contiguous.
    """
    order = over(*keys).orderBy("date")
    n, s, ss = F.lit(0), F.lit(0.0), F.lit(0.0)
    df = series.select(*keys, "date", F.col("count").alias("v"))
    for off in [o for o in range(-reach, reach + 1) if o]:
        name = f"_{'b' if off > 0 else 'f'}{abs(off)}"
        df = df.withColumn(name, F.lag("v", off).over(order))
        kept = (F.year(F.date_add("date", off)) != F.year("date")) & F.col(name).isNotNull()
        value = F.when(kept, F.col(name)).otherwise(0.0)
        n, s, ss = n + kept.cast("int"), s + value, ss + value * value
    return _scores(df, n, s, ss, F.col("v")).select(*keys, "date", "v", "mu", "sd", "z", "n")


def top_anomalies(scored: DataFrame, z: float = 2.0, limit: int = 50) -> DataFrame:
    """T1."""
    z = min(max(z, 0.5), 10.0)
    hot = scored.filter((F.col("z") > z) & (F.col("v") >= MIN_LEVEL))
    return top(hot, limit, F.col("z").desc(), F.col("date"))


def month_profile(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Twelve months' means, the mean + 1 sd line and which months reach it.

    A month the record never saw is 0 in this pooled profile and is not part of the threshold.
    """
    means = series.groupBy(*keys, F.month("date").alias("month")).agg(F.avg("count").alias("avg"))
    line = means.groupBy(*keys).agg(
        (F.avg("avg") + F.stddev_samp("avg")).alias("threshold"),
        F.map_from_entries(F.collect_list(F.struct("month", "avg"))).alias("_m"))
    months = line.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    seen = F.try_element_at("_m", F.col("month"))
    return months.select(*keys, "month", F.coalesce(seen, F.lit(0.0)).alias("avg"), "threshold",
                         F.coalesce(seen >= F.col("threshold"), F.lit(False)).alias("critical"))


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(ordered)
    # Position 1 of an empty list is null.
    low = F.try_element_at(ordered, F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int")))
    high = F.try_element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
    return (low + high) / 2


def season_bands(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Every year's months against the same month of the *other* years.

    Only fully covered months have a mean or judge another. The band needs two other years; the
    list of a month's yearly means is as long as the record has years.
    """
    monthly = series.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.avg("count").alias("mean"), F.count("*").alias("days"),
        (F.count("*") == F.max(F.dayofmonth(F.last_day("date")))).alias("full"))
    entry = F.struct("month", F.struct("mean", "days", "full").alias("m"))
    spine = (monthly.groupBy(*keys, "year")
             .agg(F.map_from_entries(F.collect_list(entry)).alias("_months"))
             .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
             .withColumn("_m", F.try_element_at("_months", F.col("month"))))
    full = F.coalesce(F.col("_m.full"), F.lit(False))
    others = F.filter(
        F.collect_list(F.when(full, F.struct("year", F.col("_m.mean").alias("v")))).over(over(*keys, "month")),
        lambda e: e["year"] != F.col("year"))
    df = (spine.select(*keys, "year", "month", F.when(full, F.col("_m.mean")).alias("avg"),
                       F.coalesce(F.col("_m.days"), F.lit(0)).alias("days"), full.alias("_full"),
                       F.transform(others, lambda e: e["v"]).alias("_o"))
          .withColumn("n", F.size("_o"))
          .withColumn("_mean", F.try_divide(F.aggregate("_o", F.lit(0.0), lambda a, x: a + x), F.col("n")))
          .withColumn("_median", _median(F.col("_o"))))
    squares = F.aggregate("_o", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    mad = _median(F.transform("_o", lambda x: F.abs(x - F.col("_median"))))
    df = df.withColumn("_sd", F.sqrt(F.try_divide(squares, F.col("n") - 1))).withColumn("_mad", mad * MAD_TO_SIGMA)
    band, single = F.col("n") >= 2, F.col("n") == 1
    floor0 = lambda c: F.greatest(c, F.lit(0.0))
    scorable = band & F.col("_full") & (F.col("_sd") > 1e-9) & (F.greatest("avg", "_mean") >= MIN_LEVEL)
    return df.select(
        *keys, "year", "month", "avg", "days",
        F.when(band, F.col("_mean")).alias("normal"),
        F.when(band, floor0(F.col("_mean") - F.col("_sd"))).alias("low"),
        F.when(band, F.col("_mean") + F.col("_sd")).alias("high"),
        F.when(band | single, F.col("_median")).alias("normal_mad"),
        F.when(band, floor0(F.col("_median") - F.col("_mad"))).when(single, F.col("_median")).alias("low_mad"),
        F.when(band, F.col("_median") + F.col("_mad")).when(single, F.col("_median")).alias("high_mad"),
        F.when(scorable, (F.col("avg") - F.col("_mean")) / F.col("_sd")).alias("z"),
        "n")


def streaks(scored: DataFrame, z: float = 2.0, keys: list[str] = ()) -> DataFrame:
    """Runs of hot days with gaps of at most two days."""
    hot = scored.filter((F.col("z") >= z) & (F.col("v") >= STREAK_LEVEL))
    return Q.islands(hot, "date", keys, max_gap=2).groupBy(*keys, "island").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"),
        F.round(F.max("z"), 1).alias("max_z"), F.sum("v").alias("total")).drop("island")


def leading_streaks(runs: DataFrame, min_days: int = 2, limit: int = 10, keys: list[str] = ()) -> DataFrame:
    """The ten strongest first, and only then those of at least ``min_days``."""
    min_days = min(max(min_days, 1), 14)
    ranked = runs.withColumn("rank", F.row_number().over(over(*keys).orderBy(F.col("max_z").desc(), "start")))
    return ranked.filter((F.col("rank") <= limit) & (F.col("days") >= min_days))


def recent_and_record(series: DataFrame, keys: list[str] = (), days: int = 30) -> DataFrame:
    """The last ``days`` days of the calendar beside the whole record."""
    last = F.max("date").over(over(*keys))
    recent = F.when(F.date_diff(F.col("_last"), F.col("date")) < days, F.col("count"))
    return series.withColumn("_last", last).groupBy(*keys).agg(
        F.avg(recent).alias("recent_mean"), F.max(recent).alias("recent_max"),
        F.avg("count").alias("record_mean"), F.count("*").alias("record_days"))


def threat(leading: DataFrame, recent: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Threat level from the leading streaks and the recent level."""
    found = leading.groupBy(*keys).agg(
        F.max("max_z").alias("_top"), F.sum("days").alias("_days"), F.count("*").alias("streaks"))
    df = recent.join(found, list(keys), "left") if keys else recent.join(found, F.lit(True), "left")
    score = F.col("_top") + 0.5 * F.col("_days") + F.least(F.lit(2.0), F.col("recent_mean") / 25)
    quiet = (F.coalesce("streaks", F.lit(0)) == 0) | (F.col("recent_mean") <= 0)
    level = (F.when(quiet, "Low").when(score >= 6, "Critical").when(score >= 3.5, "Elevated").otherwise("Watch"))
    return df.select(*recent.columns, F.coalesce("streaks", F.lit(0)).alias("streaks"), level.alias("level"),
                     F.when(quiet, F.lit(1.0)).otherwise(score).alias("score"))
