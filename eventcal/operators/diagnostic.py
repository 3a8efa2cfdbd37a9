"""Source-transition diagnostic.

Detections of a new source look like growth. The calibration era measures how many detections
of one source a detection of the other is worth, and each day then keeps the larger of the two
counts on that common scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcal.operators import series as Q
from eventcal.operators.series import over

BREAK_YEAR, OVERLAP_TO = 2012, 2015
MIN_PAIRED_DAYS = 10


def paired_days(counts: DataFrame, keys: list[str] = (), first: str = "MODIS", second: str = "VIIRS") -> DataFrame:
    """One row per observed day with both sources' counts side by side; absent is null.

    ``counts`` must carry ``esfp`` (``daily_counts(..., weights=True)``). The factor-scaled count
    of the day rides along for series that cannot be calibrated.
    """
    scaled = Q.with_factors(counts, keys)
    of = lambda name, value: F.sum(F.when(F.col("sensor") == name, F.col(value)))
    return scaled.groupBy(*keys, "date").agg(
        of(first, "n").alias("m"), of(second, "n").alias("v"),
        of(first, "frp").alias("m_frp"), of(second, "frp").alias("v_frp"),
        of(first, "esfp").alias("m_esfp"), of(second, "esfp").alias("v_esfp"),
        F.sum("n").alias("raw"), F.sum("frp").alias("frp"),
        F.sum("esfp").alias("esfp"), F.sum("hfi").alias("hfi"),
        F.sum(F.col("n") * F.col("factor")).alias("scaled"))


def _calibration_columns(agg, overlap_to: int) -> dict[str, Column]:
    """A7 as expressions over whatever ``agg`` turns a per-day column into (group or window)."""
    era = F.year("date") <= overlap_to
    pair = era & F.col("m").isNotNull() & F.col("v").isNotNull()
    total = lambda c, where=era: agg(F.sum(F.when(where, c)))
    m, v = F.col("m").cast("double"), F.col("v").cast("double")
    n_m, n_v = total(m), total(v)
    pairs = agg(F.count_if(pair))
    sm, sv = total(m, pair), total(v, pair)
    smm, smv, svv = total(m * m, pair), total(m * v, pair), total(v * v, pair)
    spread = svv - sv * sv / pairs
    measured = (pairs >= MIN_PAIRED_DAYS) & (spread > 0)
    k = F.when(measured, sm / F.greatest(sv, F.lit(1.0)))
    r = agg(F.corr(F.when(pair, m), F.when(pair, v)))
    r2 = F.when(measured & ~F.isnan(r), r * r)
    rmse = F.when(measured, F.sqrt(F.greatest((smm - 2 * k * smv + k * k * svv) / pairs, F.lit(0.0))))
    frp_ratio = (total(F.col("v_frp")) / n_v) / F.greatest(total(F.col("m_frp")) / n_m, F.lit(1e-9))
    esfp_ratio = (total(F.col("v_esfp")) / n_v) / F.greatest(total(F.col("m_esfp")) / n_m, F.lit(1e-9))
    return {"matched": F.least(n_m, n_v).cast("bigint"), "frp_ratio": frp_ratio, "esfp_ratio": esfp_ratio,
            "paired_days": pairs, "r2": r2, "rmse_daily": rmse, "k": k}


def _both_eras(agg, break_year: int, overlap_to: int) -> Column:
    year = F.year("date")
    return ((agg(F.count_if(year < break_year)) > 0)
            & (agg(F.count_if((year >= break_year) & (year <= overlap_to))) > 0))


def calibration(days: DataFrame, keys: list[str] = (), break_year: int = BREAK_YEAR,
                overlap_to: int = OVERLAP_TO) -> DataFrame:
    """Ratios and fit of the overlap era; null where the era cannot be measured."""
    same = lambda c: c
    columns = _calibration_columns(same, overlap_to)
    out = days.groupBy(*keys).agg(
        _both_eras(same, break_year, overlap_to).alias("_ok"), *[c.alias(n) for n, c in columns.items()])
    usable = F.col("_ok") & F.col("matched").isNotNull()
    return out.select(*keys, *[F.when(usable, F.col(n)).alias(n) for n in columns])


def comparable_days(days: DataFrame, keys: list[str] = (), break_year: int = BREAK_YEAR,
                    overlap_to: int = OVERLAP_TO) -> DataFrame:
    """Each day's larger count on the first source's scale.

    The ratio is used as reported, to three decimals. A series without one falls back on the
    factor-scaled count over the contiguous calendar.
    """
    every = lambda c: c.over(over(*keys))
    k = F.round(_calibration_columns(every, overlap_to)["k"], 3)
    ok = _both_eras(every, break_year, overlap_to)
    known = days.withColumn("k", F.when(ok & (k != 0), k))
    filled = Q.fill_days(known, list(keys), ["raw", "scaled"])
    filled = filled.withColumn("_k", F.max("k").over(over(*keys)))
    larger = F.greatest(F.coalesce(F.col("m"), F.lit(0)).cast("double"),
                        F.coalesce(F.col("v"), F.lit(0)) * F.col("_k"))
    return (filled.filter(F.col("present") | F.col("_k").isNull())
            .withColumn("comparable", F.when(F.col("_k").isNull(), F.col("scaled")).otherwise(larger))
            .drop("k").withColumnRenamed("_k", "k"))


def yearly(comparable: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Raw counts per source, their total, and the comparable total of each year."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return comparable.groupBy(*keys, F.year("date").alias("year")).agg(
        zero("m").alias("first_source"), zero("v").alias("second_source"),
        (zero("m") + zero("v")).alias("raw_total"), F.sum("comparable").alias("adjusted"))


def growth(comparable: DataFrame, keys: list[str] = (), break_year: int = BREAK_YEAR,
           overlap_to: int = OVERLAP_TO) -> DataFrame:
    """Era means and what of the growth is the new source's doing.

    Means run over days present in the record. ``pre_rows`` and ``overlap_rows`` count
    detections.
    """
    year = F.year("date")
    eras = {"pre": year < break_year, "post": (year >= break_year) & (year <= overlap_to)}
    aggs = []
    for era, where in eras.items():
        aggs += [
            F.coalesce(F.sum(F.when(where, F.col("raw"))), F.lit(0)).alias(f"{era}_rows"),
            F.coalesce(F.avg(F.when(where & F.col("present"), F.col("raw"))), F.lit(0.0)).alias(f"{era}_raw"),
            F.coalesce(F.avg(F.when(where, F.col("comparable"))), F.lit(0.0)).alias(f"{era}_cmp"),
            F.coalesce(F.sum(F.when(where, F.col("frp"))) / F.sum(F.when(where & F.col("present"), F.col("raw"))),
                       F.lit(0.0)).alias(f"{era}_frp"),
        ]
    g = comparable.groupBy(*keys).agg(*aggs, F.sum("hfi").alias("hfi"), F.sum("esfp").alias("esfp"),
                                      F.sum("raw").alias("pixels"))
    # A share over zero stays null, as does every figure built on it.
    pct = lambda a, b: F.when(b > 0, (F.try_divide(a, b) - 1) * 100)
    raw, adj = pct(F.col("post_raw"), F.col("pre_raw")), pct(F.col("post_cmp"), F.col("pre_cmp"))
    return g.select(
        *keys, F.col("pre_rows"), F.col("post_rows").alias("overlap_rows"),
        F.col("pre_raw").alias("pre_mean_daily"), F.col("post_raw").alias("post_mean_daily"),
        F.col("pre_frp").alias("pre_mean_frp"), F.col("post_frp").alias("post_mean_frp"),
        raw.alias("observed_growth_pct"), adj.alias("adjusted_growth_pct"),
        (raw - adj).alias("artifact_pct"),
        F.when(F.col("post_cmp") > 0, F.try_divide(F.col("post_raw"), F.col("post_cmp"))).alias("scaling"),
        "hfi", "esfp", "pixels")
