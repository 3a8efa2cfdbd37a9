import datetime as dt
import math

import numpy as np
import pytest

from eventcal import schema as S
from eventcal.operators import forecast as FC
from eventcal.operators import panel as P
from eventcal.operators import series as Q
from eventcal.plans import analyses as AN
from eventcal.sources import export as E
from helpers import DAY, day, days, record, series
from pyspark.sql import functions as F

CELLS = (8280, 8281)


def panel(spark, start="2021-01-01", end="2022-12-31", cells=CELLS):
    rows = []
    for d in days(start, end):
        base = 5 + 8 * math.exp(-(((d.timetuple().tm_yday - 75) / 25) ** 2))
        rows += [(c, d, base + (d.day % 3) * 0.5 + i) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, "cell long, date date, v double").repartition(4, "cell")


def test_lag_and_roll_use_yesterday(spark):
    rows = panel(spark)
    f = P.training_features(rows, P.climo_table(rows)).filter("cell = 8280").orderBy("date").collect()
    v = [r.v for r in rows.filter("cell = 8280").orderBy("date").collect()]
    assert len(f) == len(v) - 28
    r = f[100 - 28]
    assert r.lag_1 == pytest.approx(math.log1p(v[99])) and r.lag_28 == pytest.approx(math.log1p(v[72]))
    assert r.roll_7 == pytest.approx(math.log1p(np.mean(v[93:100])))
    parity = P.training_features(rows, P.climo_table(rows), causal=False).filter("cell = 8280").orderBy("date").collect()
    assert parity[100 - 28].roll_7 == pytest.approx(math.log1p(np.mean(v[94:101])))


def test_path_freezes_lags_at_the_origin(spark):
    rows = panel(spark)
    got = P.path_features(rows, P.climo_table(rows), [1, 30]).filter("cell = 8281").orderBy("h").collect()
    v = [r.v for r in rows.filter("cell = 8281").orderBy("date").collect()]
    assert [str(r.target) for r in got] == ["2023-01-01", "2023-01-30"]
    assert got[0].lag_1 == got[1].lag_1 == pytest.approx(math.log1p(v[-1]))
    assert got[0].roll_28 == pytest.approx(math.log1p(np.mean(v[-28:])))


def test_climatology_ignores_the_held_out_year(spark):
    rows = panel(spark).withColumn("v", F.when(F.year("date") == 2022, F.lit(1000.0)).otherwise(F.col("v")))
    assert P.climo_table(rows, F.year("date") != 2022).agg(F.max("climo")).first()[0] < 4
    assert P.climo_table(rows.filter("month(date) > 6")).filter("cell = 8280").count() == 366


def seam(spark, values, start="2021-01-01"):
    d0 = day(start)
    rows = [(d0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(values)]
    return P.coverage_seam(spark.createDataFrame(rows, "date date, v double")).first()


def test_seam(spark):
    base = [10.0 + i % 5 for i in range(700)]
    cut = seam(spark, base + [0.05] * 60)
    assert str(cut.keep_to) == str(day("2021-01-01") + dt.timedelta(days=699)) and cut.dropped_days == 60
    assert seam(spark, base).keep_to is None
    assert seam(spark, base[:500] + [x * 0.2 for x in base[500:]]).keep_to is None
    assert seam(spark, base[:120] + [0.05] * 60).keep_to is None


def test_conformal_rank_and_widths(spark):
    r = spark.createDataFrame([(1, float(x)) for x in (4, 1, 3, 2)], "h int, r double")
    assert FC.conformal_quantiles(r, 0.25).first().q == 4.0
    q = spark.createDataFrame([(1, .2), (7, .5)], "h int, q double")
    assert {x.h: x.q for x in FC.half_widths(q, 8).collect()} == {1: .2, 7: .5, **dict.fromkeys((2, 3, 4, 5, 6, 8), .5)}
    band = FC.with_band(spark.createDataFrame([(1, 9.0), (2, 0.0)], "h int, count double"), FC.half_widths(q, 2)).orderBy("h").collect()
    assert band[0].lower == pytest.approx(math.expm1(math.log(10) - .2)) and band[1].lower == 0.0
    good = spark.createDataFrame([(1, .88), (2, .92)], "h int, covered double")
    assert FC.coverage_verdict(good).first().within_tolerance
    assert not FC.coverage_verdict(spark.createDataFrame([(1, .9), (2, .74)], "h int, covered double")).first().within_tolerance


def scores(spark, rows):
    return spark.createDataFrame(rows, "`group` string, h int, model double, prior double")


def test_gate_scopes_and_fallback(spark):
    s = scores(spark, [("overall", 7, 1.0, 2.0), ("california", 7, 3.0, 2.0), ("amazon", 7, 1.0, 2.0), ("punjab_crop", 7, None, 2.0)])
    got = {r.group: (r.serve, r.scope) for r in FC.gate(s).collect()}
    assert got == {"overall": (True, "overall"), "california": (False, "california"), "amazon": (True, "amazon"),
                   "punjab_crop": (True, "overall")}
    tie = FC.gate(scores(spark, [("overall", 1, 2.0, 2.0)])).first()
    assert tie.serve is False


def test_earned_days(spark):
    s = scores(spark, [("overall", 1, 2., 1.), ("overall", 7, 1., 2.), ("overall", 14, 1., 2.), ("overall", 30, 2., 1.)])
    got = [r.earned for r in FC.earned_days(FC.gate(s), 31).orderBy("day").collect()]
    assert got == [False] + [True] * 13 + [False] * 17


def test_missing_days_of_year_leave_no_hole(spark):
    d = days("2023-10-01", "2024-04-17")
    out = FC.seasonal_forecast(series(spark, [(x, 1.0) for x in d]), 30).collect()
    assert len(out) == 30 and all(r["count"] is not None and r["count"] >= 0 for r in out)
    assert FC.seasonal_forecast(series(spark, [(x, 1.0) for x in d[:100]]), 30).count() == 0


def test_prior_shapes_and_blend(spark):
    t = dt.datetime(2024, 3, 1)
    rec = record(spark, [(18.5, 99.5, t + dt.timedelta(days=i), "MODIS") for i in range(40)] + [(50.0, 0.0, t, "MODIS")])
    shapes = P.prior_shapes(P.cell_doy_counts(rec))
    assert shapes.select("cell").distinct().count() == 1
    assert shapes.agg(F.sum("shape")).first()[0] == pytest.approx(366)
    boxes = spark.createDataFrame([("here", 17., 98., 20., 101.), ("far", -40., -70., -35., -65.)],
                                  "region string, minlat double, minlon double, maxlat double, maxlon double")
    got = P.prior_for_boxes(shapes, boxes)
    assert got.filter("region = 'here'").count() == 366 and got.filter("region = 'far'").count() == 0
    short = series(spark, [(x, 4.0) for x in days("2024-01-01", "2024-12-31")])
    mixed = {r.doy: r["count"] for r in FC.own_curve(short, prior=got.filter("region = 'here'").drop("region")).collect()}
    assert mixed[1] == pytest.approx(math.expm1(math.log1p(4.0) / 3)) and mixed[70] != pytest.approx(4.0)


def test_panel_from_counts(spark):
    d = days("2024-01-01", "2024-01-20")
    rows = [(1, x, "MODIS", 2) for x in d[2:12]] + [(2, d[0], "MODIS", 1), (2, d[19], "MODIS", 1)]
    got = P.panel(spark.createDataFrame(rows, "cell long, date date, sensor string, n long"))
    assert got.count() == 20 and got.agg(F.sum("v")).first()[0] == 20.0
    assert got.select("cell").distinct().first().cell == 1


def test_folds_and_short_record(spark):
    rows = panel(spark)
    assert [r.fold for r in FC.time_folds(rows).orderBy("fold").collect()] == [2021, 2022]
    assert FC.spatial_folds(rows).count() == 0
    apart = panel(spark, "2021-01-01", "2021-02-10", cells=(8280, 100))
    assert {r.held_out for r in FC.spatial_folds(apart).collect()} == {1}
    with pytest.raises(ValueError, match="at least 29"):
        FC.enough_history(panel(spark, "2021-01-01", "2021-01-20"))


def test_fit_store_and_serve(spark, tmp_path):
    rows = panel(spark)
    climo = P.climo_table(rows)
    model = FC.fit_tweedie(P.training_features(rows, climo))
    s = scores(spark, [("overall", 7, 1.0, 2.0), ("overall", 30, 3.0, 2.0)])
    path = str(tmp_path / "m")
    E.save_model(path, model, climo, s)
    back = E.load_model(spark, path)
    assert back["climo"].count() == 2 * 366 and E.load_model(spark, str(tmp_path / "none")) is None
    lat, lon = 2 * (8280 // 180) - 89.0, 2 * (8280 % 180) - 179.0
    t0 = dt.datetime(2022, 1, 1)
    rec = record(spark, [(lat, lon + (i % 5) * 0.1, t0 + dt.timedelta(days=i // 5, hours=i % 5), "MODIS") for i in range(2000)])
    out = AN.forecast(rec, None, 10, model=back)["forecast"].orderBy("h").collect()
    assert [r.method for r in out] == ["model"] * 7 + ["prior"] * 3 and all(r["count"] >= 0 for r in out)
    empty = AN.forecast(rec.limit(3), None, 10)
    assert empty["forecast"].count() == 0 and "120" in empty["status"].first().note


def test_backtest_scores_every_method(spark):
    got = FC.backtest(panel(spark), step=60).collect()
    assert {r.h for r in got} == set(S.HORIZONS)
    assert all(r.model >= 0 and r.prior >= 0 and r.naive >= 0 and r.n > 0 for r in got)


def test_doy_curve_keyed(spark):
    s = series(spark, [("a", x, 1.0) for x in days("2024-01-01", "2024-02-10")], ["k"])
    assert Q.doy_curve(s, "count", ["k"]).count() == 366


def test_model_meets_prior_by_date(spark):
    """A path whose cells end early lands on its own dates, not on its own step numbers."""
    prior = spark.createDataFrame([(h, day("2020-02-10") + h * DAY, 1.0) for h in range(1, 11)], "h int, date date, count double")
    model = spark.createDataFrame([(h, day("2020-01-31") + h * DAY, 100.0 + h) for h in range(1, 16)], "h int, date date, count double")
    earned = spark.createDataFrame([(d, d <= 7) for d in range(1, 11)], "day int, earned boolean")
    got = {r.h: (r.count_, r.method) for r in FC.serve(prior, model, earned).withColumnRenamed("count", "count_").collect()}
    assert got == {h: ((110.0 + h, "model") if h <= 5 else (1.0, "prior")) for h in range(1, 11)}


def test_conformal_needs_a_long_record(spark):
    rows = lambda n: spark.range(n).select(F.date_add(F.lit("2015-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    assert not FC.conformal_applies(rows(900)) and FC.conformal_applies(rows(1095))
    assert not FC.conformal_applies(rows(1095), test_days=80)


def test_a_run_saves_what_the_forecast_serves(spark, tmp_path):
    from eventcal.plans import analyses, training
    from eventcal.sources import export

    rng = np.random.default_rng(1)
    start = dt.datetime(2018, 1, 1)
    rec = record(spark, [(10.5 + 2 * (k % 2), 20.5, start + dt.timedelta(days=int(d), minutes=k), "MODIS")
                         for d in range(800) for k in range(int(3 + 2 * np.sin(d / 58) + rng.integers(0, 3)))])
    told = training.train(P.cell_day_counts(rec), str(tmp_path), step=60).first()
    assert (told.cells, told.days, told.conformal) == (2, 800, False) and told.rows == 1600
    model = export.load_model(spark, str(tmp_path))
    assert model is not None and "quantiles" not in model
    widths = spark.createDataFrame([(h, 0.5) for h in (1, 7, 14, 30)], "h int, q double")
    scores = spark.createDataFrame([("overall", h, 1.0, 2.0, 3.0) for h in (1, 7, 14)], "group string, h int, model double, prior double, naive double")
    export.save_model(str(tmp_path / "b"), model["model"], model["climo"], scores, quantiles=widths, coverage=widths.withColumnRenamed("q", "covered"))
    served = analyses.forecast(rec, horizon=20, model=export.load_model(spark, str(tmp_path / "b")))
    rows = {r.h: r for r in served["forecast"].collect()}
    assert {h for h, r in rows.items() if r.method == "model"} == set(range(1, 15))
    assert all((rows[h].lower is not None) == (h <= 14) for h in rows) and served["coverage"].count() == 4
