import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from eventcal.operators import series as Q
from helpers import day, days, series

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def counts(spark, table):
    rows = [(d, s, n, 0.0) for s, column in table.items() for d, n in column if n]
    return spark.createDataFrame(rows, "date date, sensor string, n long, frp double")


def test_four_overlap_days_are_no_measurement(spark):
    d = days("2024-01-01", "2024-01-05")
    c = counts(spark, {"MODIS": list(zip(d, [10, 20, 30, 0, 5])), "VIIRS": list(zip(d, [40, 80, 120, 0, 20]))})
    got = {r.sensor: r.factor for r in Q.sensor_factors(c).collect()}
    assert got == {"MODIS": 1.0, "VIIRS": 1.0}
    d = days("2024-01-01", "2024-01-06")
    c = counts(spark, {"MODIS": list(zip(d, [10, 20, 30, 0, 5, 5])), "VIIRS": list(zip(d, [40, 80, 120, 0, 20, 20]))})
    got = {r.sensor: r.factor for r in Q.sensor_factors(c).collect()}
    assert got["MODIS"] == 1.0 and got["VIIRS"] == pytest.approx(0.25)


def test_daily_is_contiguous(spark):
    d = [day("2024-02-27"), day("2024-03-02")]
    out = Q.harmonized_daily(counts(spark, {"A": [(d[0], 2), (d[1], 3)]})).orderBy("date").collect()
    assert [(str(r.date), r["count"], r.raw) for r in out] == [
        ("2024-02-27", 2.0, 2), ("2024-02-28", 0.0, 0), ("2024-02-29", 0.0, 0), ("2024-03-01", 0.0, 0), ("2024-03-02", 3.0, 3)]


@SLOW
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12, unique=True))
def test_spine_property(spark, offsets):
    base = pd.Timestamp("2023-12-20")
    rows = [((base + pd.Timedelta(days=o)).date(), float(o + 1)) for o in offsets]
    got = {r.date: r["count"] for r in Q.fill_days(series(spark, rows), [], ["count"]).collect()}
    want = pd.Series(dict(rows)).sort_index()
    want = want.reindex(pd.date_range(want.index.min(), want.index.max()).date, fill_value=0.0)
    assert got == want.to_dict()


@SLOW
@given(st.dictionaries(st.integers(1, 366), st.floats(0, 100), min_size=1, max_size=10))
def test_interpolation_property(spark, known):
    df = spark.createDataFrame([(int(k), float(v)) for k, v in known.items()], "doy int, v double")
    got = {r.doy: r.v for r in Q.fill_linear(df, [], "doy", "v", 1, 366).collect()}
    x = np.array(sorted(known))
    want = np.interp(np.arange(1, 367), x, [known[k] for k in x])
    assert len(got) == 366
    np.testing.assert_allclose([got[i] for i in range(1, 367)], want, atol=1e-9)


def test_rolling_quantiles_match_pandas(spark):
    rng = np.random.default_rng(0)
    v = rng.poisson(5, 80).astype(float)
    d = days("2024-01-01", "2024-03-20")
    for window in (3, 4, 15):
        got = Q.rolling_quantiles(series(spark, list(zip(d, v.tolist()))), "count", window, {"p50": 0.5, "p95": 0.95})
        got = got.orderBy("date").toPandas()
        roll = pd.Series(v).rolling(window, center=True, min_periods=3)
        np.testing.assert_allclose(got.p50.astype(float), roll.quantile(0.5), equal_nan=True)
        np.testing.assert_allclose(got.p95.astype(float), roll.quantile(0.95), equal_nan=True)


def test_islands_and_spans(spark):
    d = [day(x) for x in ("2024-01-01", "2024-01-03", "2024-01-06", "2024-01-07")]
    got = Q.islands(series(spark, [(x, 1.0) for x in d]), "date").orderBy("date").collect()
    assert [r.island for r in got] == [0, 0, 1, 1]
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 7)], "k string, day int")
    assert {r.k: r.spans for r in Q.day_spans(frame, "day", ["k"]).collect()} == {"a": "1–2 · 5", "b": "7"}
    runs = Q.value_runs(spark.createDataFrame([(x, None if i == 1 else 1.0) for i, x in enumerate(days("2024-01-01", "2024-01-04"))],
                                              "date date, v double"), "v").orderBy("start").collect()
    assert [r.days for r in runs] == [1, 2]


def test_keys_keep_series_apart(spark):
    rows = [("a", day("2024-01-01"), 1.0), ("a", day("2024-01-03"), 1.0), ("b", day("2024-01-02"), 1.0)]
    got = Q.fill_days(series(spark, rows, ["k"]), ["k"], ["count"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {"a": 3, "b": 1}


def test_season_summary_orders(spark):
    d = days("2019-01-01", "2022-12-31")
    v = [5 + 20 * np.exp(-(((x.timetuple().tm_yday - 100) / 20) ** 2)) for x in d]
    s = Q.season_summary(series(spark, list(zip(d, map(float, v))))).first()
    # A 15-day p95 is nearly flat while its window holds the peak, so its first maximum lies within
    # half a window of it; the plain mean has the peak itself.
    assert s.onset_doy <= s.peak_doy <= s.cessation_doy and abs(s.peak_doy - 100) <= 7
    assert s.max_mean_doy == 100
    env = Q.envelope_steps(Q.doy_envelope(series(spark, list(zip(d, map(float, v)))))).collect()
    assert len(env) == 73 and all(r.p10 <= r.p50 <= r.p90 <= r.p95 for r in env)
