"""Forecasts, backtests, conformal bands and the serving gate.

Backtests are plans, not loops: every fold, origin and horizon is a row, and the training-only
curve of each fold is the total minus the fold's own year. Only model fits are driven per fold,
one MLlib fit each.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.functions import scalars as X
from eventcal.operators import panel as P
from eventcal.operators import series as Q
from eventcal.operators import spatial as G
from eventcal.operators.series import over

MIN_DAYS = 120
RECENT = 30
VALIDATION_DAYS = 90
SPATIAL_BLOCK_DEG = 30.0


# ------------------------------------------------------------------ seasonal prior (F1, F2)
def own_curve(series: DataFrame, keys: list[str] = (), prior: DataFrame | None = None) -> DataFrame:
    """the series' day-of-year means blended in log space with the archive prior.

    ``prior`` has the keys (or none), ``doy`` and ``shape``. Its weight falls from 1 to 0 over three
    years of own record; a day the record never saw takes the prior.
    """
    own = Q.doy_means(series, "count", keys)
    if prior is None:
        return own
    years = series.groupBy(*keys).agg(F.count_distinct(F.year("date")).alias("_years"))
    shape = prior.select(*keys, "doy", "shape")
    base = shape.join(years, list(keys)) if keys else shape.join(years, F.lit(True))
    alpha = F.least(F.lit(1.0), F.col("_years") / 3.0)
    mixed = alpha * F.log1p(F.coalesce("count", "shape")) + (1 - alpha) * F.log1p("shape")
    return base.join(own, [*keys, "doy"], "left").select(*keys, "doy", F.expm1(mixed).alias("count"))


def seasonal_forecast(series: DataFrame, horizon: int = 30, keys: list[str] = (),
                      prior: DataFrame | None = None) -> DataFrame:
    """the smoothed curve scaled to the recent level, from the day after the record.

    Series of fewer than 120 days have no forecast.
    """
    horizon = min(max(horizon, 1), 90)
    series = Q.at_least_days(series, MIN_DAYS, keys)
    curve = own_curve(series, keys, prior)
    filled = Q.fill_linear(curve, list(keys), "doy", "count", 1, S.DOY_BINS)
    smooth = Q.smooth_doy(filled, "count", keys).withColumnRenamed("count", "c")
    last = F.max("date").over(over(*keys))
    recent = (series.withColumn("_last", last).filter(F.date_diff("_last", "date") < RECENT)
              .withColumn("doy", F.dayofyear("date")))
    level = recent.join(smooth, [*keys, "doy"]).groupBy(*keys).agg(
        ((F.avg("count") + 1) / (F.avg("c") + 1)).alias("scale"), F.max("_last").alias("_last"))
    ahead = (level.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
             .withColumn("date", F.date_add("_last", F.col("h"))).withColumn("doy", F.dayofyear("date")))
    return ahead.join(smooth, [*keys, "doy"]).select(
        *keys, "h", "date", (F.col("c") * F.col("scale")).alias("count"))


def seasonal_naive(series: DataFrame, horizon: int = 30, keys: list[str] = (), period: int = 364) -> DataFrame:
    """The value ``period`` days before the target, 0 where the record has none."""
    last = series.groupBy(*keys).agg(F.max("date").alias("_last"))
    ahead = (last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
             .withColumn("target", F.date_add("_last", F.col("h")))
             .withColumn("date", F.date_sub("target", period)))
    return ahead.join(series.select(*keys, "date", "count"), [*keys, "date"], "left").select(
        *keys, "h", F.col("target").alias("date"), F.coalesce("count", F.lit(0.0)).alias("count"))


# ------------------------------------------------------------------ groups and folds
def group_cells(cells: DataFrame) -> DataFrame:
    """(cell, group): every cell in 'overall' and in each preset that holds its centre."""
    centred = cells.select("cell").distinct().withColumn("lat", X.cell_lat()).withColumn("lon", X.cell_lon())
    named = G.in_regions(centred).select("cell", F.col("region").alias("group"))
    return centred.select("cell", F.lit("overall").alias("group")).unionByName(named)


def group_series(rows: DataFrame) -> DataFrame:
    """Daily totals of each group of cells."""
    return rows.join(group_cells(rows), "cell").groupBy("group", "date").agg(F.sum("v").alias("v"))


def time_folds(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """F8: one fold per calendar year, given a second year to train on."""
    years = series.select(*keys, F.year("date").alias("fold")).distinct()
    return (years.withColumn("_n", F.count("*").over(over(*keys))).filter(F.col("_n") > 1).drop("_n"))


def spatial_folds(rows: DataFrame) -> DataFrame:
    """(cell, fold): presets that hold some but not all cells, else 30° tiles.

    Tiles are used when fewer than two presets qualify, and only if there are two of them.
    """
    cells = rows.select("cell").distinct().withColumn("lat", X.cell_lat()).withColumn("lon", X.cell_lon())
    total = cells.agg(F.count("*").alias("_all"))
    presets = G.in_regions(cells).select("cell", F.col("region").alias("fold"))
    tile = (F.floor((F.col("lat") + 90) / SPATIAL_BLOCK_DEG) * 1000 + F.floor((F.col("lon") + 180) / SPATIAL_BLOCK_DEG))
    tiles = cells.select("cell", tile.cast("string").alias("fold"))

    def proper(folds: DataFrame, least: int) -> DataFrame:
        sized = folds.groupBy("fold").agg(F.count("*").alias("held_out")).join(total, F.lit(True))
        sized = sized.filter(F.col("held_out") < F.col("_all")).withColumn("_n", F.count("*").over(over()))
        return sized.filter(F.col("_n") >= least).select("fold", "held_out")

    named, tiled = proper(presets, 2), proper(tiles, 1)
    use_tiles = named.agg((F.count("*") == 0).alias("_t"))
    chosen = presets.join(named, "fold").unionByName(
        tiles.join(tiled, "fold").join(use_tiles, F.col("_t")).drop("_t"))
    return chosen


def fold_curves(series: DataFrame, keys: list[str] = (), smooth: int = 15) -> DataFrame:
    """each fold's smoothed day-of-year curve from the other years only."""
    yearly = series.groupBy(*keys, F.dayofyear("date").alias("doy"), F.year("date").alias("year")).agg(
        F.sum("v").alias("s"), F.count("*").alias("n"))
    folds = time_folds(series, keys)
    joined = yearly.join(folds, list(keys)) if keys else yearly.join(folds, F.lit(True))
    trained = joined.filter(F.col("year") != F.col("fold"))
    means = trained.groupBy(*keys, "fold", "doy").agg((F.sum("s") / F.sum("n")).alias("c"))
    by = [*keys, "fold"]
    return Q.smooth_doy(Q.fill_linear(means, by, "doy", "c", 1, S.DOY_BINS), "c", by, smooth)


def naive_scale(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean absolute daily change over the first fold's training days, at least 1e-9."""
    order = over(*keys).orderBy("date")
    df = (series.withColumn("_d", Q.step_sizes("v", order))
          .withColumn("_first", F.min(F.year("date")).over(over(*keys)))
          .filter(F.year("date") != F.col("_first")))
    return df.groupBy(*keys).agg(F.greatest(F.avg("_d"), F.lit(1e-9)).alias("scale"))


def baseline_errors(series: DataFrame, keys: list[str] = (), horizons: tuple = S.HORIZONS,
                    step: int = 7, first_only: Column | None = None) -> DataFrame:
    """Prior and naive forecasts beside the actual value for every fold, origin and horizon.

    Everything is a lead, lag or trailing mean within one fold's calendar, so there is no join on
    dates. An origin needs 30 days of history and the longest horizon ahead of it.
    """
    curves = fold_curves(series, keys)
    by = [*keys, "fold"]
    dated = series.withColumn("doy", F.dayofyear("date"))
    dated = dated.join(curves, [*keys, "doy"])
    order = over(*by).orderBy("date")
    recent = order.rowsBetween(-RECENT, -1)
    in_fold = F.year("date") == F.col("fold")
    df = (dated.withColumn("_pos", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(over(*by)))
          .withColumn("_scale", (F.avg("v").over(recent) + 1) / (F.avg("c").over(recent) + 1))
          .withColumn("_k", F.sum(in_fold.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    rows = []
    for h in horizons:
        df = df.withColumn(f"_a{h}", F.lead("v", h - 1).over(order)).withColumn(
            f"_c{h}", F.lead("c", h - 1).over(order)).withColumn(
            f"_p{h}", F.coalesce(F.lag("v", 365 - h).over(order), F.lit(0.0)))
        rows.append(F.struct(F.lit(h).alias("h"), F.col(f"_a{h}").alias("actual"),
                             (F.col(f"_c{h}") * F.col("_scale")).alias("prior"), F.col(f"_p{h}").alias("naive")))
    chosen = (in_fold & (F.col("_k") % step == 0) & (F.col("_pos") >= RECENT)
              & (F.col("_pos") + max(horizons) <= F.col("_n")))
    return (df.filter(chosen).withColumn("_row", F.explode(F.array(*rows)))
            .select(*by, F.col("date").alias("origin"), "_row.*"))


def mase(errors: DataFrame, scales: DataFrame, methods: list[str], keys: list[str] = ("group",)) -> DataFrame:
    """Mean absolute error of each method over the naive scale, per horizon."""
    sums = errors.groupBy(*keys, "h").agg(
        *[F.avg(F.abs(F.col(m) - F.col("actual"))).alias(m) for m in methods], F.count("*").alias("n"))
    joined = sums.join(scales, list(keys)) if keys else sums.join(scales, F.lit(True))
    return joined.select(*keys, "h", *[(F.col(m) / F.col("scale")).alias(m) for m in methods], "n")


# ------------------------------------------------------------------ learned model
def tweedie_pipeline(max_iter: int = 25) -> Pipeline:
    """a log-link Tweedie count model (power 1.5) on the eleven features."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(S.FEATURES), outputCol="features"),
        GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="v",
                                    regParam=1e-3, maxIter=max_iter, predictionCol="yhat")])


#: The most rounds of boosting; the validated tail stops earlier.
MOST_ROUNDS = 600


def boosted_pipeline(rounds: int = MOST_ROUNDS, depth: int = 5, validated: bool = False, seed: int = 0) -> Pipeline:
    """boosted trees on log1p of the count; ``validated`` stops on the marked tail.

    MLlib trees have no Tweedie loss, so the squared error is taken in log space.
    """
    trees = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="ylog", maxIter=rounds,
                         maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    if validated:
        trees = trees.setValidationIndicatorCol("held")
    return Pipeline(stages=[VectorAssembler(inputCols=list(S.FEATURES), outputCol="features"), trees])


def fit_boosted(features: DataFrame, rounds: int = MOST_ROUNDS, depth: int = 5):
    """rounds chosen on the last 90 days of the training rows, then refitted on all of them."""
    ends = features.agg(F.max("date").alias("_last"))
    marked = (features.join(ends, F.lit(True)).withColumn("y", F.log1p("v"))
              .withColumn("held", F.date_diff("_last", "date") <= VALIDATION_DAYS).drop("_last")).persist()
    first = boosted_pipeline(rounds, depth, validated=True).fit(marked)
    chosen = max(first.stages[-1].getNumTrees, 1)
    model = boosted_pipeline(chosen, depth).fit(marked)
    marked.unpersist()
    return model, chosen


def fit_tweedie(features: DataFrame):
    """one pass over the features per reweighting round, so they are kept for the fit."""
    kept = features.persist()
    model = tweedie_pipeline().fit(kept)
    kept.unpersist()
    return model


def predict(model, features: DataFrame) -> DataFrame:
    """Non-negative expected counts, whichever model it is."""
    out = model.transform(features)
    value = F.expm1("ylog") if "ylog" in out.columns else F.col("yhat")
    return out.withColumn("pred", F.greatest(value, F.lit(0.0))).drop("features", "ylog", "yhat")


def enough_history(series: DataFrame) -> None:
    """a record shorter than the longest lag cannot be learned from, and says so."""
    days = series.select("date").distinct().count()
    if days <= max(S.LAGS):
        raise ValueError(f"record has {days} day(s); at least {max(S.LAGS) + 1} are needed to build lags")


def model_errors(rows: DataFrame, fit=fit_tweedie, horizons: tuple = S.HORIZONS, step: int = 7) -> DataFrame:
    """the model's forecast per (group, fold, origin, h), every fold fitted without its year.

    ``rows`` is a panel. One fit per calendar year; scoring is one plan per fold.
    """
    years = [r.fold for r in time_folds(rows).orderBy("fold").collect()]
    groups = group_cells(rows)
    scored = []
    for year in years:
        train = F.year("date") != year
        climo = P.climo_table(rows, train)
        features = P.training_features(rows, climo).filter(train)
        model = fit(features)
        model = model[0] if isinstance(model, tuple) else model
        first_day = F.make_date(F.lit(year), F.lit(1), F.lit(1))
        # History up to the day before the origin; the origin is every ``step``-th day of the year.
        after = F.date_diff(F.date_add("date", 1), F.greatest(first_day, F.col("_begin")))
        begun = rows.withColumn("_begin", F.min("date").over(over("cell")))
        at = (F.year(F.date_add("date", 1)) == year) & (after % step == 0)
        path = predict(model, P.path_features(begun, climo, list(horizons), at))
        summed = path.join(groups, "cell").groupBy(
            "group", F.date_add("origin", 1).alias("origin"), "h").agg(F.sum("pred").alias("model"))
        scored.append(summed.withColumn("fold", F.lit(year)))
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    return out


def backtest(rows: DataFrame, fit=fit_tweedie, horizons: tuple = S.HORIZONS, step: int = 7) -> DataFrame:
    """MASE of model, prior and naive per group and horizon, leaving one year out."""
    series = group_series(rows)
    base = baseline_errors(series, ["group"], horizons, step)
    model = model_errors(rows, fit, horizons, step).select("group", "fold", "origin", "h", "model")
    errors = base.join(model, ["group", "fold", "origin", "h"])
    return mase(errors, naive_scale(series, ["group"]), ["model", "prior", "naive"])


def spatial_backtest(rows: DataFrame, fit=fit_tweedie, horizons: tuple = S.HORIZONS, step: int = 14,
                     max_blocks: int | None = None) -> DataFrame:
    """Fit without a block of ground, score on it over the record's last year.

    The held-out cells' climatology and baselines come from dates before that year. ``max_blocks`` scores only the
    largest blocks.
    """
    folds = spatial_folds(rows)
    sized = folds.groupBy("fold").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "fold")
    sized = sized if max_blocks is None else sized.limit(max_blocks)
    end = rows.agg(F.max("date").alias("e")).first().e
    pre = F.col("date") < F.date_sub(F.lit(end), 365)
    out = []
    for block in [r.fold for r in sized.collect()]:
        held = folds.filter(F.col("fold") == block).select("cell")
        inside = rows.join(held, "cell", "left_semi")
        outside = rows.join(held, "cell", "left_anti")
        model = fit(P.training_features(outside, P.climo_table(outside)))
        model = model[0] if isinstance(model, tuple) else model
        series = P.totals(inside)
        order = over().orderBy("date")
        curve = Q.doy_curve(series.filter(pre).withColumnRenamed("v", "count"), "count").withColumnRenamed("count", "c")
        recent = order.rowsBetween(-RECENT, -1)
        dated = (series.withColumn("doy", F.dayofyear("date")).join(curve, "doy")
                 .withColumn("_pos", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(over()))
                 .withColumn("_s", (F.avg("v").over(recent) + 1) / (F.avg("c").over(recent) + 1))
                 .withColumn("_k", F.sum((~pre).cast("int")).over(
                     order.rowsBetween(Window.unboundedPreceding, 0)) - 1))
        options = []
        for h in horizons:
            dated = (dated.withColumn(f"_a{h}", F.lead("v", h - 1).over(order))
                     .withColumn(f"_c{h}", F.lead("c", h - 1).over(order))
                     .withColumn(f"_p{h}", F.coalesce(F.lag("v", 365 - h).over(order), F.lit(0.0))))
            options.append(F.struct(F.lit(h).alias("h"), F.col(f"_a{h}").alias("actual"),
                                    (F.col(f"_c{h}") * F.col("_s")).alias("prior"), F.col(f"_p{h}").alias("naive")))
        picked = (~pre) & (F.col("_k") % step == 0) & (F.col("_pos") >= RECENT) & (F.col("_pos") + max(horizons) <= F.col("_n"))
        base = dated.filter(picked).withColumn("_r", F.explode(F.array(*options))).select(
            F.col("date").alias("origin"), "_r.*")
        after = F.date_diff(F.date_add("date", 1), F.date_sub(F.lit(end), 365))
        at = (after >= 0) & (after % step == 0)
        path = predict(model, P.path_features(inside, P.climo_table(inside, pre), list(horizons), at))
        mine = path.groupBy(F.date_add("origin", 1).alias("origin"), "h").agg(F.sum("pred").alias("model"))
        scale = series.withColumn("_d", Q.step_sizes("v", order)).filter(pre).agg(
            F.greatest(F.avg("_d"), F.lit(1e-9)).alias("scale"))
        scored = mase(base.join(mine, ["origin", "h"]), scale, ["model", "prior", "naive"], [])
        out.append(scored.select(F.lit(block).alias("block"), "*"))
    result = out[0] if out else None
    for more in out[1:]:
        result = result.unionByName(more)
    return result


# ------------------------------------------------------------------ conformal bands
def blocks(cal_days: int = 365, test_days: int = 365) -> Column:
    """train, calibration and test, in that order; ``_end`` is the record's last day."""
    back = F.date_diff("_end", "date")
    return F.when(back <= test_days, "test").when(back <= test_days + cal_days, "calibration").otherwise("train")


def log_residual(actual: str | Column, predicted: str | Column) -> Column:
    return F.abs(F.log1p(X.col(actual)) - F.log1p(F.greatest(X.col(predicted), F.lit(0.0))))


def conformal_quantiles(residuals: DataFrame, alpha: float = 0.1, value: str = "r", by: str = "h") -> DataFrame:
    """The ceil((n+1)(1-alpha))-th smallest residual of each horizon, clamped to what exists."""
    order = over(by).orderBy(value)
    ranked = residuals.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(over(by)))
    rank = F.least(F.greatest(F.ceil((F.col("_n") + 1) * (1.0 - alpha) - 1e-12), F.lit(1)), F.col("_n"))
    return ranked.filter(F.col("_k") == rank).select(by, F.col(value).alias("q"), F.col("_n").alias("n"))


def empirical_coverage(residuals: DataFrame, quantiles: DataFrame, keys: list[str] = ("group",)) -> DataFrame:
    """The share of residuals inside the calibrated width."""
    return residuals.join(quantiles.select("h", "q"), "h").groupBy(*keys, "h").agg(
        F.avg((F.col("r") <= F.col("q")).cast("double")).alias("covered"), F.count("*").alias("n"))


def coverage_verdict(covered: DataFrame, nominal: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Whether the worst horizon is within the tolerance."""
    worst = F.max(F.abs(F.col("covered") - nominal))
    return covered.agg(worst.alias("max_deviation"), (worst <= tolerance + 1e-9).alias("within_tolerance"))


def half_widths(quantiles: DataFrame, horizon: int) -> DataFrame:
    """a width for every day 1..horizon; days without one take the longest calibrated horizon's."""
    last = quantiles.agg(F.max_by("q", "h").alias("_last"))
    days = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return days.join(quantiles.select("h", "q"), "h", "left").select("h", F.coalesce("q", "_last").alias("q"))


def with_band(forecast: DataFrame, widths: DataFrame, value: str = "count") -> DataFrame:
    """expm1(log1p(y) ± q), never below zero."""
    level = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    return forecast.join(widths, "h").withColumns({
        "lower": F.expm1(F.greatest(level - F.col("q"), F.lit(0.0))), "upper": F.expm1(level + F.col("q"))}).drop("q")


def conformal_applies(rows: DataFrame, cal_days: int = 365, test_days: int = 365, horizon: int = 30,
                      least: int = 60) -> bool:
    """is there a training stretch of at least ``cal_days``, and ``least`` origins to calibrate and to test on?"""
    days = rows.select("date").distinct().count()
    train = days - cal_days - test_days
    return train >= cal_days and min(cal_days, test_days) - horizon >= least


def model_residuals(rows: DataFrame, alpha: float = 0.1, fit=fit_tweedie, horizon: int = 30, cal_days: int = 365,
                    test_days: int = 365, step: int = 2) -> tuple[DataFrame, DataFrame]:
    """quantiles from the calibration block, coverage on the later test block."""
    end = rows.agg(F.max("date").alias("e")).first().e
    marked = rows.withColumn("_end", F.lit(end))
    train = blocks(cal_days, test_days) == "train"
    climo = P.climo_table(marked, train)
    model = fit(P.training_features(rows, climo).withColumn("_end", F.lit(end)).filter(train))
    model = model[0] if isinstance(model, tuple) else model
    next_day = rows.withColumn("_end", F.lit(end)).withColumn("_d", F.date_add("date", 1))
    offset = F.date_diff("_end", "_d")
    # Every ``step``-th day counted from the first day of its block.
    into = F.when(offset <= test_days, test_days - offset).otherwise(cal_days + test_days - offset)
    at = (F.col("_n") > max(S.LAGS)) & (into >= 0) & (into % step == 0) & (offset >= horizon - 1)
    path = predict(model, P.path_features(next_day, climo, list(range(1, horizon + 1)), at))
    groups = group_cells(rows)
    guessed = path.join(groups, "cell").groupBy("group", "origin", "h", "target").agg(F.sum("pred").alias("p"))
    actual = group_series(rows).select("group", F.col("date").alias("target"), "v")
    residuals = guessed.join(actual, ["group", "target"]).select(
        "group", "h", log_residual("v", "p").alias("r"),
        F.when(F.date_diff(F.lit(end), F.date_add("origin", 1)) <= test_days, "test").otherwise("calibration").alias("block"))
    quantiles = conformal_quantiles(residuals.filter(F.col("block") == "calibration"), alpha)
    return quantiles, empirical_coverage(residuals.filter(F.col("block") == "test"), quantiles)


# ------------------------------------------------------------------ gate
def gate(scores: DataFrame, candidate: str = "model", baseline: str = "prior") -> DataFrame:
    """per scope and horizon, whether the candidate is strictly better.

    A region is judged by its own complete row and by the global one where it has none; a regional
    loss stays a loss. ``scores`` has group, h and one column per method; 'overall' is global.
    """
    complete = F.col(candidate).isNotNull() & F.col(baseline).isNotNull()
    glob = scores.filter(F.col("group") == "overall").select("h", F.col(candidate).alias("_gc"), F.col(baseline).alias("_gb"))
    scopes = scores.select("group").distinct()
    scored = scores.agg(F.array_sort(F.collect_set("h")).alias("_h")).withColumn("_one", F.lit(1))
    grid = scopes.withColumn("_one", F.lit(1)).join(scored, "_one").select("group", F.explode("_h").alias("h"))
    own = scores.filter(complete).select("group", "h", F.col(candidate).alias("_c"), F.col(baseline).alias("_b"))
    df = grid.join(own, ["group", "h"], "left").join(glob, "h", "left")
    regional = F.col("_c").isNotNull()
    c, b = F.coalesce("_c", "_gc"), F.when(regional, F.col("_b")).otherwise(F.col("_gb"))
    return df.select("group", "h", F.coalesce(c < b, F.lit(False)).alias("serve"),
                     F.when(regional, F.col("group")).otherwise("overall").alias("scope"))


def earned_days(verdicts: DataFrame, horizon: int, key: str = "group") -> DataFrame:
    """each day judged by the nearest scored horizon at least as long; beyond the last, no."""
    days = verdicts.select(key).distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    later = verdicts.select(F.col(key).alias("_k"), F.col("h").alias("_h"), F.col("serve").alias("_s"))
    near = days.join(later, (F.col(key) == F.col("_k")) & (F.col("_h") >= F.col("day")), "left")
    return near.groupBy(key, "day").agg(F.coalesce(F.min_by("_s", "_h"), F.lit(False)).alias("earned"))


def serve(prior: DataFrame, model: DataFrame, earned: DataFrame) -> DataFrame:
    """The model's value on the days it earned, the prior's elsewhere, method per row.

    ``prior`` and ``model``: h, date, count; ``earned``: day, earned. They meet by date: the model's last day of data may be
    another than the area's. A day is earned by how far ahead of the area's last day it is.
    """
    won = earned.filter("earned").select(F.col("day").alias("h"))
    kept = model.select("date", F.col("count").alias("_m"))
    days = prior.join(won.withColumn("_won", F.lit(True)), "h", "left").join(kept, "date", "left")
    days = days.withColumn("_m", F.when(F.col("_won"), F.col("_m")))
    return days.select(
        "h", "date", F.coalesce("_m", "count").alias("count"),
        F.when(F.col("_m").isNotNull(), "model").otherwise("prior").alias("method"))


def model_forecast(rows: DataFrame, climo: DataFrame, model, horizon: int) -> DataFrame:
    """the area's expected total per day ahead."""
    path = predict(model, P.path_features(rows, climo, list(range(1, horizon + 1))))
    return path.groupBy("h", F.col("target").alias("date")).agg(F.sum("pred").alias("count"))


def observed_and_forecast(series: DataFrame, forecast: DataFrame, days: int = 365) -> DataFrame:
    """The last ``days`` observed days followed by the forecast, each row with its kind."""
    last = F.max("date").over(over())
    seen = series.withColumn("_l", last).filter(F.date_diff("_l", "date") < days).select(
        "date", "count", F.lit("observed").alias("kind"))
    return seen.unionByName(forecast.select("date", "count", F.lit("forecast").alias("kind")))
