import numpy as np
import pytest

from eventcal.operators import anomalies as A
from eventcal.operators import diagnostic as D
from helpers import day, days, series

START, END = "2019-01-01", "2023-12-31"


def bands(spark, values, start=START, end=END):
    d = days(start, end)
    rows = A.season_bands(series(spark, list(zip(d, [float(x) for x in values])))).collect()
    return {(r.year, r.month): r for r in rows}


def months(base, month, by_year):
    return [by_year.get(d.year, base) if d.month == month else base for d in days(START, END)]


def test_a_record_month_is_judged_by_the_other_years(spark):
    b = bands(spark, months(10, 8, {2019: 8, 2020: 10, 2021: 12, 2022: 9, 2023: 60}))
    aug = b[(2023, 8)]
    assert aug.avg == 60 and aug.days == 31 and aug.n == 4 and aug.normal == pytest.approx(9.75)
    assert 7 < aug.low and aug.high < 12 and aug.z > 20 and len(b) == 60
    assert aug.normal_mad == pytest.approx(9.5)


def test_quiet_and_flat_months_have_no_z(spark):
    b = bands(spark, months(10, 10, {2019: .7, 2020: .8, 2021: .9, 2022: .6, 2023: .1}))
    assert b[(2023, 10)].normal is not None and b[(2023, 10)].z is None
    flat = bands(spark, [6.0] * len(days(START, END)))
    assert all(r.z is None and r.normal == r.low == r.high == 6.0 for r in flat.values())


def test_partial_month_and_two_years(spark):
    part = bands(spark, [5.0] * len(days("2019-01-15", "2020-03-31")), "2019-01-15", "2020-03-31")
    jan = part[(2019, 1)]
    assert jan.avg is None and jan.days == 17 and jan.low is None
    two = bands(spark, [5.0] * len(days("2019-01-01", "2020-12-31")), "2019-01-01", "2020-12-31")
    assert two[(2019, 1)].normal is None and two[(2019, 1)].low_mad == 5.0


def test_z_against_brute_force(spark):
    rng = np.random.default_rng(3)
    d = days("2019-03-05", "2022-10-20")
    v = rng.poisson(6, len(d)).astype(float)
    got = {r.date: r for r in A.zscore_doy_window(series(spark, list(zip(d, v.tolist())))).collect()}
    doy = np.array([x.timetuple().tm_yday for x in d])
    year = np.array([x.year for x in d])
    for i in range(0, len(d), 37):
        gap = np.abs(doy - doy[i])
        other = v[(np.minimum(gap, 366 - gap) <= 7) & (year != year[i])]
        r = got[d[i]]
        assert r.n == len(other) and r.mu == pytest.approx(other.mean())
        assert r.z == pytest.approx((v[i] - other.mean()) / other.std())


def test_boundary_form_scores_only_the_year_ends(spark):
    d = days("2019-01-01", "2021-12-31")
    v = np.arange(len(d)) % 11
    got = [r for r in A.zscore_boundary(series(spark, list(zip(d, v.astype(float).tolist())))).collect() if r.z is not None]
    assert {(r.date.month, r.date.day) for r in got} <= ({(1, i) for i in range(1, 7)} | {(12, i) for i in range(26, 32)})
    assert got


def test_streaks_and_threat(spark):
    rows = [("2024-01-01", 10.0, 3.0), ("2024-01-03", 8.0, 4.0), ("2024-01-06", 9.0, 2.5), ("2024-01-07", 2.0, 9.0)]
    scored = spark.createDataFrame([(day(a), v, z) for a, v, z in rows], "date date, v double, z double")
    runs = A.streaks(scored, 2.0).orderBy("start").collect()
    assert [(str(r.start), str(r.end), r.days, r.max_z, r.total) for r in runs] == [
        ("2024-01-01", "2024-01-03", 2, 4.0, 18.0), ("2024-01-06", "2024-01-06", 1, 2.5, 9.0)]
    lead = A.leading_streaks(A.streaks(scored, 2.0), 2)
    recent = spark.createDataFrame([(50.0, 60.0, 5.0, 100)], "recent_mean double, recent_max double, record_mean double, record_days long")
    t = A.threat(lead, recent).first()
    assert (t.level, t.score) == ("Critical", 4.0 + 1.0 + 2.0)
    none = A.threat(lead.filter("false"), recent).first()
    assert (none.level, none.score) == ("Low", 1.0)


def test_threat_per_key(spark):
    recent = spark.createDataFrame([("a", 50.0, 1.0), ("b", 0.0, 1.0)], "k string, recent_mean double, recent_max double")
    lead = spark.createDataFrame([("a", 2.0, 1)], "k string, max_z double, days long")
    got = {r.k: r.level for r in A.threat(lead, recent, ["k"]).collect()}
    assert got == {"a": "Elevated", "b": "Low"}


def test_transition_artifact_is_removed(spark):
    """A second source arrives in 2012 and sees three detections for each of the first's."""
    rng = np.random.default_rng(1)
    rows = []
    for d in days("2009-01-01", "2015-12-31"):
        m = int(rng.poisson(10)) + 1
        rows.append((d, "MODIS", m, float(m), float(m), float(m)))
        if d.year >= 2012:
            rows.append((d, "VIIRS", 3 * m + int(rng.integers(0, 3)), float(m), 3.0 * m, 3.0 * m))
    counts = spark.createDataFrame(rows, "date date, sensor string, n long, frp double, esfp double, hfi double")
    paired = D.paired_days(counts)
    g = D.growth(D.comparable_days(paired)).first()
    assert g.observed_growth_pct > 100 and abs(g.adjusted_growth_pct) < 25
    assert g.artifact_pct > 0 and g.scaling > 1
    c = D.calibration(paired).first()
    assert c.r2 > 0.9 and 0.28 < c.k < 0.34 and 0.8 < c.esfp_ratio < 1.25
    late = counts.filter("year(date) >= 2012")
    g = D.growth(D.comparable_days(D.paired_days(late))).first()
    assert g.observed_growth_pct is None and g.artifact_pct is None
    assert D.calibration(D.paired_days(late)).first().k is None
    assert D.yearly(D.comparable_days(D.paired_days(late))).count() == 4


def test_uncalibrated_record_falls_back_on_the_scaled_calendar(spark):
    rows = [(day("2020-01-01"), "MODIS", 4, 1.0, 4.0, 4.0), (day("2020-01-04"), "MODIS", 2, 1.0, 2.0, 2.0)]
    counts = spark.createDataFrame(rows, "date date, sensor string, n long, frp double, esfp double, hfi double")
    got = D.comparable_days(D.paired_days(counts)).orderBy("date").collect()
    assert [r.comparable for r in got] == [4.0, 0.0, 0.0, 2.0]
