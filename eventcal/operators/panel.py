"""Cell × day panel, seasonal prior and features.

Panels are long frames of (cell, date, v). Windows run within a cell, so the widest partition is
one cell's calendar. The same functions serve any key in place of ``cell``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.functions import scalars as X
from eventcal.operators import series as Q
from eventcal.operators.series import over

MIN_CELL_DAYS = 5
MIN_ACTIVE_DOY = 25
COVERAGE_DROP, COVERAGE_WINDOW, COVERAGE_MIN_DAYS = 50.0, 30, 180


def cell_day_counts(record: DataFrame) -> DataFrame:
    """Detections per (cell, date, sensor)."""
    return record.groupBy(X.cell_id().alias("cell"), "date", "sensor").agg(F.count("*").alias("n"))


def cell_days(counts: DataFrame) -> DataFrame:
    """Factor-scaled count per observed (cell, date); factors come from the whole archive (A4)."""
    per_day = counts.groupBy("date", "sensor").agg(F.sum("n").alias("n"))
    factors = Q.sensor_factors(per_day).select("sensor", "factor")
    return (counts.join(factors, "sensor").groupBy("cell", "date")
            .agg(F.sum(F.col("n") * F.col("factor")).alias("v")))


def panel(counts: DataFrame, min_cell_days: int = MIN_CELL_DAYS) -> DataFrame:
    """The zero-filled panel of cells active on at least ``min_cell_days`` days."""
    days = cell_days(counts).withColumn("_active", F.count_if(F.col("v") > 0).over(over("cell")))
    # The calendar is the archive's, so its ends come before quiet cells are left out.
    full = days.withColumn("_keep", F.col("_active") >= min_cell_days)
    ends = full.agg(F.min("date").alias("_first"), F.max("date").alias("_last")).withColumn("_one", F.lit(1))
    return _on_calendar(full.filter("_keep").select("cell", "date", "v"), ends)


def _on_calendar(days: DataFrame, ends: DataFrame) -> DataFrame:
    """Every cell on one calendar, 0 where nothing was seen.

    ``ends`` is one row, met by equality on a constant. Each row is stretched to its successor.
    """
    order = over("cell").orderBy("date")
    marked = (days.withColumn("_next", F.lead("date").over(order)).withColumn("_prev", F.lag("date").over(order))
              .withColumn("_one", F.lit(1)).join(ends, "_one"))
    start = F.when(F.col("_prev").isNull(), F.col("_first")).otherwise(F.col("date"))
    stop = F.coalesce(F.date_sub("_next", 1), F.col("_last"))
    spread = (marked.withColumn("_start", start).withColumn("_stop", stop)
              .withColumn("_day", F.explode(F.sequence("_start", "_stop"))))
    return spread.select("cell", F.col("_day").alias("date"),
                         F.when(F.col("_day") == F.col("date"), F.col("v")).otherwise(0.0).alias("v"))


def serving_series(counts: DataFrame, known: DataFrame | None = None, max_cells: int | None = None) -> DataFrame:
    """The area's cells as the model knows them; with ``max_cells``, only so many of the busiest."""
    days = cell_days(counts)
    if known is not None:
        days = days.join(known.select("cell").distinct(), "cell", "left_semi")
    ends = days.agg(F.min("date").alias("_first"), F.max("date").alias("_last")).withColumn("_one", F.lit(1))
    if max_cells is not None:
        busiest = days.groupBy("cell").agg(F.sum("v").alias("_t")).orderBy(F.col("_t").desc(), "cell").limit(max_cells)
        days = days.join(busiest.select("cell"), "cell", "left_semi")
    return _on_calendar(days, ends)


# ------------------------------------------------------------------ seasonal prior
def cell_doy_counts(record: DataFrame) -> DataFrame:
    """A21."""
    return record.groupBy(X.cell_id().alias("cell"), F.dayofyear("date").alias("doy")).agg(F.count("*").alias("n"))


def prior_shapes(grid: DataFrame, min_active_doy: int = MIN_ACTIVE_DOY) -> DataFrame:
    """Shapes of mean 1 over 366 days, and the mean level, of cells with enough days of year."""
    total = F.sum("n").over(over("cell"))
    return (grid.withColumn("_t", total).withColumn("_active", F.count("*").over(over("cell")))
            .filter(F.col("_active") >= min_active_doy)
            .select("cell", "doy", (F.col("n") * S.DOY_BINS / F.col("_t")).alias("shape"),
                    (F.col("_t") / S.DOY_BINS).alias("level")))


def prior_levels(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("cell").agg(F.max("level").alias("level"))


def prior_for_boxes(shapes: DataFrame, boxes: DataFrame, key: str = "region") -> DataFrame:
    """Mean shape per day of year over the known cells each box touches.

    A day of year without detections counts as 0, so sums are divided by the number of cells.
    Boxes that hold no known cell are absent.
    """
    from eventcal.operators.spatial import cells_touched

    inside = cells_touched(boxes).select(key, "cell").join(shapes, "cell")
    per_cell = inside.groupBy(key, "cell").agg(F.max("level").alias("level"))
    size = per_cell.groupBy(key).agg(F.count("*").alias("cells"), F.avg("level").alias("level"))
    sums = inside.groupBy(key, "doy").agg(F.sum("shape").alias("_s"))
    spine = size.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(S.DOY_BINS))))
    return spine.join(sums, [key, "doy"], "left").select(
        key, "doy", (F.coalesce("_s", F.lit(0.0)) / F.col("cells")).alias("shape"), "cells", "level")


def floored_profile(shape: DataFrame, floor: float = 0.0) -> DataFrame:
    """P34."""
    return shape.withColumn("shape", F.greatest("shape", F.lit(floor)))


# ------------------------------------------------------------------ climatology and features
def climo_table(rows: DataFrame, train: Column | None = None, keys: list[str] = ("cell",)) -> DataFrame:
    """log1p day-of-year means of the training rows only, missing days interpolated."""
    picked = rows if train is None else rows.filter(train)
    means = Q.doy_means(picked, "v", list(keys))
    filled = Q.fill_linear(means, list(keys), "doy", "v", 1, S.DOY_BINS)
    return filled.select(*keys, "doy", F.log1p("v").alias("climo"))


def _place_and_season(df: DataFrame, climo: DataFrame, target: str) -> DataFrame:
    """Angles, cell centre and climatology at the target day."""
    doy = F.dayofyear(target)
    return (df.withColumn("doy", doy).join(climo, ["cell", "doy"])
            .withColumn("doy_sin", X.doy_sin(F.col("doy"))).withColumn("doy_cos", X.doy_cos(F.col("doy")))
            .withColumn("lat", X.cell_lat()).withColumn("lon", X.cell_lon()))


def training_features(rows: DataFrame, climo: DataFrame, causal: bool = True) -> DataFrame:
    """one row per cell and day from the 29th on, features as of the day before.

    ``causal=False`` lets the rolling means end on the day they explain.
    """
    order = over("cell").orderBy("date")
    back = 1 if causal else 0
    df = rows.withColumn("_i", F.row_number().over(order))
    for k in S.LAGS:
        df = df.withColumn(f"lag_{k}", F.log1p(Q.lagged("v", order, k)))
    for k in S.ROLLS:
        frame = order.rowsBetween(-(k - 1) - back, -back)
        df = df.withColumn(f"roll_{k}", F.log1p(F.avg("v").over(frame)))
    df = _place_and_season(df.filter(F.col("_i") > max(S.LAGS)), climo, "date")
    return df.select("cell", "date", "v", *S.FEATURES)


def path_features(rows: DataFrame, climo: DataFrame, horizons: list[int], origin: Column | None = None) -> DataFrame:
    """features for every origin and horizon, lags and rolls frozen at the origin.

    A row's history ends on its own day; ``origin`` selects the days to forecast from (the last
    one by default). ``h`` days ahead share the origin's lags: lag k is the value k-1 days before
    the origin day, 0 where the history is shorter.
    """
    order = over("cell").orderBy("date")
    df = rows.withColumn("_n", F.row_number().over(order)).withColumn("_last", F.max("date").over(over("cell")))
    for k in S.LAGS:
        df = df.withColumn(f"lag_{k}", F.log1p(F.coalesce(F.lag("v", k - 1).over(order), F.lit(0.0))))
    for k in S.ROLLS:
        df = df.withColumn(f"_r{k}", F.avg("v").over(order.rowsBetween(-(k - 1), 0)))
    df = df.withColumn("_all", F.avg("v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Both means use the whole history until it is as long as the longer of them.
    enough = F.col("_n") >= max(S.ROLLS)
    for k in S.ROLLS:
        df = df.withColumn(f"roll_{k}", F.log1p(F.when(enough, F.col(f"_r{k}")).otherwise(F.col("_all"))))
    df = df.filter(F.col("date") == F.col("_last") if origin is None else origin)
    df = (df.withColumnRenamed("date", "origin")
          .withColumn("h", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
          .withColumn("target", F.date_add("origin", F.col("h"))))
    return _place_and_season(df, climo, "target").select("cell", "origin", "h", "target", *S.FEATURES)


# ------------------------------------------------------------------ coverage seam
def totals(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "date").agg(F.sum("v").alias("v"))


def coverage_seam(series: DataFrame, keys: list[str] = (), drop: float = COVERAGE_DROP,
                  window: int = COVERAGE_WINDOW, min_days: int = COVERAGE_MIN_DAYS) -> DataFrame:
    """The last day to keep of each series, null where nothing is to be cut.

    A tail whose forward 30-day level stays ``drop`` times below the record's busy level (its 90th
    percentile) to the very end is a smaller export window, not a quiet season.
    """
    order, whole = over(*keys).orderBy("date"), over(*keys)
    ahead = order.rowsBetween(0, window - 1)
    df = (series.withColumn("_lead", F.when(F.count("v").over(ahead) == window, F.avg("v").over(ahead)))
          .withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(whole)))
    carried = F.last("_lead", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_level", carried).withColumn("_busy", F.percentile("_level", F.lit(0.9)).over(whole))
    df = df.withColumn("_low", F.col("_level") < F.col("_busy") / drop)
    summary = df.groupBy(*keys).agg(
        F.max("_n").alias("days"), F.max("_busy").alias("busy"),
        F.max(F.when(~F.col("_low"), F.col("_i"))).alias("kept_days"),
        F.max_by("date", F.when(~F.col("_low"), F.col("_i"))).alias("_keep_to"),
        F.max(F.when(F.col("_low"), F.col("_i"))).alias("_last_low"),
        F.max("date").alias("last_day"))
    cut = ((F.col("days") > window) & (F.col("_last_low") == F.col("days"))
           & (F.col("days") - F.col("kept_days") >= window) & (F.col("kept_days") >= min_days))
    return summary.select(*keys, "days", "busy",
                          F.when(cut, F.col("_keep_to")).alias("keep_to"),
                          F.when(cut, F.col("days") - F.col("kept_days")).alias("dropped_days"))


def trim_seam(rows: DataFrame, seam: DataFrame) -> DataFrame:
    """F11 applied to a panel: rows up to the seam."""
    return rows.join(seam.select("keep_to"), F.lit(True)).filter(
        F.col("keep_to").isNull() | (F.col("date") <= F.col("keep_to"))).drop("keep_to")
