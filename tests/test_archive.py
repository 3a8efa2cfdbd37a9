import datetime as dt

import pytest

from eventcal.operators import ranking as K
from eventcal.operators import spatial as G
from eventcal.sources import archive as V
from eventcal.sources import export as E
from eventcal.sources import windows as W
from helpers import day, record
from pyspark.sql import functions as F


def budget(spark, sizes, limit):
    df = spark.createDataFrame([(f"f{i}", b) for i, b in enumerate(sizes)], "src_file string, bytes long")
    return [r.budget for r in V.allocate(df, limit).orderBy("src_file").collect()]


def test_budget(spark):
    assert budget(spark, [1, 99], 1000) == [10, 990]
    assert budget(spark, [0, 0], 100) == [50, 50]
    assert budget(spark, [1, 10_000], 100) == [1, 99]


def test_windows_tile_a_year(spark):
    span = spark.createDataFrame([(day("2022-09-30"), day("2023-09-29"))], "start date, end date")
    got = W.tile(span).orderBy("window_start").collect()
    assert len(got) == 73 and sum(r.span for r in got) == 365
    last = got[-1]
    assert str(last.window_start + dt.timedelta(days=last.span - 1)) == "2023-09-29"
    ledger = W.tile(span).limit(3).select("window_start")
    assert W.missing(W.tile(span), ledger).count() == 70
    years = W.year_ranges(spark.createDataFrame([(2024,)], "year int"))
    assert W.tile(years).agg(F.sum("span")).first()[0] == 366


def long_record(spark, n=4000, days=400):
    t0 = dt.datetime(2023, 1, 1)
    return record(spark, [(10.0 + i % 7, 20.0, t0 + dt.timedelta(minutes=i * days * 1440 // n), "MODIS") for i in range(n)])


def test_spread_covers_the_span_and_head_does_not(spark):
    rec = long_record(spark)
    spread = V.spread_slice(rec, 400)
    ends = spread.agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert (ends[1] - ends[0]).days >= 350 and ends[2] == 400
    head = K.head(rec, 200, ["time", "lat", "lon", "sensor"])
    ends = head.agg(F.min("date"), F.max("date"), F.count("*"), F.bool_and("capped")).first()
    assert (ends[1] - ends[0]).days < 30 and ends[2] == 200 and ends[3]
    assert V.spread_slice(rec, 5000).count() == 4000
    few = V.spread_slice(rec, 5).agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert (few[1] - few[0]).days >= 250 and few[2] == 5


def test_bins_that_run_out_leave_their_share_to_the_others(spark):
    t0 = dt.datetime(2023, 1, 1)
    crowded = [(1.0, float(i), t0 + dt.timedelta(minutes=i), "MODIS") for i in range(100)]
    thin = [(2.0, float(d), t0 + dt.timedelta(days=d), "MODIS") for d in range(10, 240, 10)]
    spread = V.spread_slice(record(spark, crowded + thin), 60)
    assert spread.count() == 60 and spread.filter("lat = 2").count() == len(thin)


def test_opening_is_whole_unless_a_budget_is_given(spark):
    from eventcal.plans import analyses

    rec = long_record(spark, 3000, 1000).withColumn("src_file", F.lit("a.csv"))
    files = spark.createDataFrame([("a.csv", 1000)], "src_file string, bytes long")
    year = rec.filter(F.year("date") == 2024).count()
    assert analyses.open_record(rec, files, year=2024)["record"].count() == year
    assert analyses.open_record(rec, files)["record"].count() == 3000
    part = analyses.open_record(rec, files, limit=50, year=2024)["record"].agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert part[2] == 50 and part[0].year == part[1].year == 2024 and (part[1] - part[0]).days > 300


def test_picks_are_exact_with_ties(spark):
    t0 = dt.datetime(2023, 1, 1)
    rec = record(spark, [(float(i % 50), float(i // 50), t0, "MODIS") for i in range(1000)])
    got = K.head(rec, 37, ["time", "lat", "lon", "sensor"]).collect()
    assert sorted((r.lat, r.lon) for r in got) == sorted((float(i % 50), float(i // 50)) for i in range(1000))[:37]
    assert K.sample(rec, 100).count() == 100 and K.sample(rec, 50_000).count() == 1000
    with pytest.raises(ValueError):
        K.sample(rec, 0)
    assert sorted(K.sample(rec, 100).collect()) == sorted(K.sample(rec.repartition(7), 100).collect())
    assert K.stride(rec, 3).count() == 334


def test_global_rank(spark):
    rec = long_record(spark, 500, 3).withColumn("l1", F.unix_date("date")).withColumn("l2", F.unix_seconds("time"))
    got = K.global_rank(rec, ["l1", "l2"], ["time", "lat"]).orderBy("row").collect()
    assert [r.row for r in got] == list(range(1, 501)) and got == sorted(got, key=lambda r: (r.time, r.lat))


def coverage_rows(spark):
    rows = [("global.csv", float(la), float(lo), day(f"{y}-02-01")) for y in (2023, 2024)
            for la in (-60, -20, 20, 60) for lo in (-150, -50, 50, 150)]
    rows += [("state.csv", 36.0 + i % 7, -122.0 + i % 9, day("2024-03-01")) for i in range(40)]
    rows += [("broken.csv", None, 1.0, day("2024-03-01"))]
    return spark.createDataFrame(rows, "src_file string, lat double, lon double, date date")


def test_thin_year_is_named_and_opened_last(spark):
    judged = V.judge_coverage(V.coverage(coverage_rows(spark)))
    thin = {(r.src_file, r.year): r.thin for r in judged.collect()}
    assert thin == {("global.csv", 2023): False, ("global.csv", 2024): False, ("state.csv", 2024): True}
    notes = {r.src_file: r for r in V.coverage_notes(judged).collect()}
    assert notes["state.csv"].thin_years == [2024] and notes["state.csv"].note.startswith("regional window: 2024 (6° × 8°")
    assert notes["global.csv"].note is None
    assert [tuple(r) for r in V.files_holding(judged, 2024).collect()] == [("global.csv", False)]
    only = judged.filter("src_file = 'state.csv'")
    assert [tuple(r) for r in V.files_holding(only, 2024).collect()] == [("state.csv", True)]
    years = {r.year: (r.files, r["global"]) for r in V.years_available(judged).collect()}
    assert years == {2023: (1, True), 2024: (2, True)}


def test_coverage_is_recomputed_for_changed_files_only(spark):
    t = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", 1, t), ("b", 3, t)], "path string, bytes long, modified timestamp")
    stored = spark.createDataFrame([("a", 1, t, 10), ("b", 2, t, 20)], "path string, bytes long, modified timestamp, rows long")
    stale = V.stale_files(files, stored)
    assert [r.path for r in stale.collect()] == ["b"]
    fresh = stale.withColumn("rows", F.lit(21).cast("long"))
    assert {r.path: r.rows for r in V.refresh_coverage(files, stored, fresh).collect()} == {"a": 10, "b": 21}


def test_inventory(spark, tmp_path):
    sub = tmp_path / "down"
    sub.mkdir()
    (sub / "fire_nrt_J1V-C2_9.csv").write_text("x")
    (tmp_path / "fire_archive_M-C61_1.parquet").write_text("xyz")
    (tmp_path / "readme.txt").write_text("x")
    got = V.inventory(spark, str(tmp_path), str(sub)).collect()
    assert [r.src_file for r in got] == ["fire_nrt_J1V-C2_9.csv", "fire_archive_M-C61_1.parquet"]
    assert got[0].label == "VIIRS NOAA-20 · near-real-time · 9" and got[0].folder == "down"
    assert V.total_bytes(V.inventory(spark, str(tmp_path))).first()[:] == (2, 4)


def test_regions(spark):
    boxes = G.region_boxes(spark)
    half = boxes.select(F.col("region").alias("want"), (F.col("minlat") + .5).alias("minlat"), (F.col("minlon") + .5).alias("minlon"),
                        (F.col("maxlat") - .5).alias("maxlat"), (F.col("maxlon") - .5).alias("maxlon"))
    assert all(r.want == r.region for r in G.containing_region(half).collect())
    world = G.region_boxes(spark, world=True).filter("region = 'world'").drop("region")
    assert G.containing_region(world).first().region is None
    assert G.region_box("world") == (-90.0, -180.0, 90.0, 180.0) and G.region_box("nowhere") is None
    touched = G.cells_touched(spark.createDataFrame([(-90.0, -180.0, 90.0, 180.0)], "minlat double, minlon double, maxlat double, maxlon double"))
    assert touched.select("cell").distinct().count() == 16200


@pytest.fixture
def raw(spark):
    rows = [(str(10 + i), "20", f"2024-01-{i + 1:02d}", "1200", "80", "300", "MODIS") for i in range(10)]
    return spark.createDataFrame(rows, "latitude string, longitude string, acq_date string, acq_time string, "
                                       "confidence string, brightness string, instrument string")


def test_export_resumes_without_copies(spark, raw, tmp_path):
    path = str(tmp_path / "out")
    assert E.export_window(raw, path, "2024-01-01", "2024-01-05").count() == 5
    assert E.export_window(raw, path, "2024-01-03", "2024-01-08").count() == 8
    assert E.export_window(raw, path, "2024-01-03", "2024-01-08").count() == 8
    whole = E.compact(spark, [path], str(tmp_path / "one"))
    assert whole.count() == 8 and [f.dataType for f in whole.schema] == [f.dataType for f in E.pinned(whole).schema]
    m = E.manifest(whole, "2024-01-01", "2024-01-08", 10).first()
    assert (m.rows, m.sensors, m.rows_scanned) == (8, ["MODIS"], 10)


def test_stores_refuse_other_schemas(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, 1.0)], "cell long, doy int, shape double")
    lv = spark.createDataFrame([(1, 1.0)], "cell long, level double")
    path = str(tmp_path / "prior")
    assert E.load_prior(spark, path) is None
    E.save_prior(path, t, lv, {"days": 10})
    got = E.load_prior(spark, path)
    assert got["shapes"].count() == 1 and got["meta"]["days"] == 10
    E.save_tables(path, 99, {"shapes": t, "levels": lv})
    assert E.load_prior(spark, path) is None


def test_append_clips_and_counts_once(spark):
    t = dt.datetime(2025, 1, 1)
    store = record(spark, [(37.0, -120.0, t, "MODIS")])
    more = record(spark, [(37.0, -120.0, t, "MODIS"), (38.0, -120.0, t, "MODIS"), (13.0, 100.0, t, "MODIS")])
    assert E.append_window(store, more, (32.5, -124.4, 42.0, -114.1)).count() == 2
    assert E.append_window(store, more, (32.5, -124.4, 42.0, -114.1), replace=True).count() == 2


# ------------------------------------------------------------------ row groups
T0 = dt.datetime(2020, 1, 1)

@pytest.fixture
def grouped(spark, tmp_path):
    """Files of many row groups in order of time, one of them without times at all, and the rows in them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    t0, rows = dt.datetime(2020, 1, 1), []
    for f in range(3):
        times = [t0 + dt.timedelta(hours=f * 5000 + i * 5) for i in range(1000)]
        table = pa.table({"time": pa.array(times, pa.timestamp("us", "UTC")), "n": list(range(f * 1000, f * 1000 + 1000))})
        pq.write_table(table, tmp_path / f"part{f}.parquet", row_group_size=50)
        rows += list(zip(times, range(f * 1000, f * 1000 + 1000)))
    return spark.createDataFrame([(f"file:{p}",) for p in sorted(tmp_path.iterdir())], "path string"), rows


def scanned(df):
    """Rows that the scans of the data gave, by the metrics of the executed plan."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if name.startswith("Scan parquet") and " n#" in plan.output().mkString(" ", ",", "").replace(",", " ") else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_footers_tell_row_groups(grouped, spark):
    files, rows = grouped
    groups = V.row_groups(files).orderBy("path", "row_group").collect()
    assert len(groups) == 60 and all(g.n_rows == 50 for g in groups) and [g.first_row for g in groups[:3]] == [0, 50, 100]
    assert groups[1].lo == rows[50][0] and groups[1].hi == rows[99][0]


def test_only_row_groups_of_the_stretch_are_read(grouped, spark):
    files, rows = grouped
    lo, hi = dt.datetime(2020, 3, 1), dt.datetime(2020, 3, 20)
    held = V.groups_between(V.row_groups(files), lo, hi)
    df = V.read_row_groups(spark, held)
    want = {n for t, n in rows if lo <= t <= hi}
    got = {r.n for r in df.collect()}
    assert want <= got and len(got) == 50 * held.count() < 200
    assert 0 < scanned(df) <= 50 * held.count()


def test_spread_over_time_and_by_position(grouped, spark):
    files, rows = grouped
    groups = V.row_groups(files)
    picked = V.spread_groups(groups, 5).orderBy("path", "step").collect()
    assert len(picked) == 15 and [r.row_group for r in picked[:5]] == [0, 4, 8, 12, 16]
    df = V.read_row_groups(spark, V.spread_groups(groups, 5))
    assert df.count() == 15 * 50 and 0 < scanned(df) < 3000
    blind = groups.withColumn("lo", F.when(F.col("row_group") != 3, F.col("lo")))
    assert [r.row_group for r in V.spread_groups(blind, 5).orderBy("path", "step").collect()[:5]] == [0, 4, 8, 12, 16]
    assert V.read_row_groups(spark, V.spread_groups(blind, 20)).count() == 3000
    uneven = spark.createDataFrame([("p", g, 0, 1, T0 + dt.timedelta(days=d), T0 + dt.timedelta(days=d + 1)) for g, d in enumerate((0, 1, 2, 3, 90, 99))], V.ROW_GROUPS)
    assert sorted(r.row_group for r in V.spread_groups(uneven, 3).collect()) == [0, 1, 4]


def test_many_stretches_read_all_between_them(grouped, spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_STRETCHES", 2)
    files, _ = grouped
    chosen = V.row_groups(files).filter("row_group % 4 = 1")
    assert V.read_row_groups(spark, chosen).count() == 15 * 50
    with pytest.raises(ValueError, match="no row group"):
        V.read_row_groups(spark, chosen.limit(0))


def test_no_statistics_at_all(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"time": pa.array([T0, None], pa.timestamp("us", "UTC")), "n": [1, 2]}), tmp_path / "a.parquet", write_statistics=False)
    groups = V.row_groups(spark.createDataFrame([(f"file:{tmp_path}/a.parquet",)], "path string"))
    assert groups.first().lo is None and V.groups_between(groups, T0, T0).count() == 1
    assert V.read_row_groups(spark, groups).count() == 2


def test_times_as_spark_writes_them_by_default(spark, tmp_path):
    """INT96 has statistics only where all times of a row group are equal, and those cannot be read."""
    path = str(tmp_path / "a")
    spark.createDataFrame([(T0, 1), (T0, 2)], "time timestamp, n int").coalesce(1).write.option("compression", "none").parquet(path)
    groups = V.row_groups(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path))
    assert [(g.n_rows, g.lo, g.hi) for g in groups.collect()] == [(2, None, None)]
    assert V.read_row_groups(spark, V.groups_between(groups, T0, T0)).count() == 2


def test_the_footers_of_the_archive_tell_times(spark, sf):
    from eventcal.plans import registry

    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    groups = V.row_groups(registry._archive_files(spark, sf))
    held = V.groups_between(groups, dt.datetime(1999, 1, 1), dt.datetime(1999, 12, 31, 23, 59, 59, 999999))
    assert groups.filter("lo IS NULL OR hi IS NULL").isEmpty() and 0 < held.count() < groups.count() / 2
    assert spark.conf.get(name) == before


def test_all_sinks_of_a_scan_from_one_frame(spark):
    from helpers import record

    rows = [(10.0, 20.0, T0 + dt.timedelta(days=i % 3), "MODIS" if i % 2 else "VIIRS") for i in range(12)]
    sinks = V.archive_scan(record(spark, rows))
    assert sinks["days"].agg(F.sum("n")).first()[0] == sinks["cell_doy"].agg(F.sum("n")).first()[0] == 12
    assert {(r.sensor, r.n) for r in sinks["sensors"].collect()} == {("MODIS", 6), ("VIIRS", 6)} and sinks["cell_days"].count() == 6


def test_a_row_meets_few_row_groups_of_its_file(grouped, spark):
    """Rows and groups are joined by their place in the file too, not by the file alone."""
    import re

    files = grouped[0] if isinstance(grouped, tuple) else grouped
    df = V.read_row_groups(spark, V.row_groups(files))
    assert df.count() == 3000
    joins = re.findall(r"Join \[(.*?)\], \[(.*?)\], Inner", df._jdf.queryExecution().executedPlan().toString())
    assert joins and all(left.count("#") >= 2 and "_bin" in right + left for left, right in joins)


def test_ranked_rows_are_dealt_by_number(spark, monkeypatch):
    """Well-packed rows are few bytes: by these Spark would sort all of them in one task."""
    monkeypatch.setattr(K, "TASK_ROWS", 1000)
    rec = spark.range(20_000).select((F.col("id") % 50).alias("l1"), (F.col("id") % 2500).alias("l2"), "id")
    got = K.global_rank(rec, ["l1", "l2"], ["id"])
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3000
    want = sorted(range(20_000), key=lambda i: (i % 50, i % 2500, i))
    assert {r.id: r.row for r in got.collect()} == {i: n for n, i in enumerate(want, 1)}


def test_the_rows_of_a_year_are_not_shuffled_by_file(spark, capsys):
    rec = spark.createDataFrame([("a", dt.date(1999, 5, 1)), ("b", dt.date(1999, 6, 1)), ("a", dt.date(2000, 6, 1))], "src_file string, date date")
    judged = spark.createDataFrame([("a", 1999, False), ("b", 1999, True)], "src_file string, year int, thin boolean")
    chosen = V.open_year(rec, judged, 1999)
    chosen.explain()
    plan = capsys.readouterr().out
    assert [r.src_file for r in chosen.collect()] == ["a"] and "hashpartitioning" not in plan and "Window" not in plan
