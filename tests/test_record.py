import datetime as dt

import pytest

from eventcal import schema as S
from eventcal.functions import scalars as X
from eventcal.operators import record as R
from eventcal.sources import readers
from pyspark.sql import functions as F

MODIS = ("latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,confidence,version,bright_t31,frp,daynight\n"
         "-13.60052,49.60114,301.4,1.43,1.18,2026-10-04,0033,A,38,6.1NRT,288.65,8.77,N\n"
         "32.24827,51.42755,311.08,1.5,1.21,2026-10-04,0020,A,82,6.1NRT,278.94,23.82,N\n")
SNPP = ("latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,version,bright_ti5,frp,daynight\n"
        "-29.78994,27.11075,299.44,0.5,0.49,2026-10-04,0001,N,nominal,2.0NRT,279.07,0.68,N\n"
        "65.02583,56.72539,305.3,0.47,0.64,2026-10-04,0111,N,nominal,2.0NRT,266.75,0.97,N\n")
AREA = "latitude,longitude,acq_date,acq_time,confidence,frp,brightness,satellite\n"


def raw(spark, rows, names="latitude longitude acq_date acq_time confidence brightness instrument frp scan track"):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def files(spark, folder):
    return spark.createDataFrame([(f"file:{p}",) for p in sorted(folder.iterdir())], "path string")


def test_confidence_codes_floor_and_range(spark):
    df = R.harmonize(raw(spark, [
        ("37", "-121", "2025-09-30", "1740", "69", "315.9", "MODIS", "9.2", "1", "1"),
        ("39.5", "-122", "2025-09-30", "1809", "n", "300.7", "VIIRS", "0.4", ".49", ".4"),
        ("39.5", "-122", "2025-10-01", "1019", " H ", "297.4", "VIIRS", "0.5", ".45", ".47"),
        ("40", "-123", "2025-10-01", "1200", "l", "296", "VIIRS", "1", ".4", ".4"),
        ("41", "-123", "2025-10-01", "1200", "nan", "296", "VIIRS", "1", ".4", ".4"),
        ("999", "0", "2025-10-01", "1200", "80", "310", "MODIS", "2", "1", "1")]))
    assert sorted(r.conf for r in df.collect()) == [60.0, 69.0, 90.0]
    assert tuple(df.columns) == S.RECORD_COLUMNS


def test_lean_and_full_rows_agree(spark):
    frame = raw(spark, [("37", "-121", "2025-09-30", "1740", "69", "315.9", "MODIS", "9.2", "1", "1")])
    lean, full = R.harmonize(frame, geometry=False), R.harmonize(frame)
    assert tuple(lean.columns) == S.LEAN_COLUMNS
    assert lean.collect() == full.select(*S.LEAN_COLUMNS).collect()


def test_clock_rolls_over_and_bad_clock_drops(spark):
    df = R.harmonize(raw(spark, [
        ("1", "2", "2025-01-01", "1345.0", "80", "300", None, None, None, None),
        ("1", "2", "2025-01-01", "0175", "80", "300", None, "x", None, None),
        ("1", "2", "2025-01-01", None, "80", "300", None, "1", None, None),
        ("1", "2", "not a day", "0100", "80", "300", None, "1", None, None)]))
    got = sorted((r.time, r.frp, r.scan, r.sat) for r in df.collect())
    assert got == [(dt.datetime(2025, 1, 1, 2, 15), 0.0, 1.0, "MODIS"),
                   (dt.datetime(2025, 1, 1, 13, 45), 0.0, 1.0, "MODIS")]


def test_sensor_aliases(spark):
    labels = ["SNPP", "viirs", " N20 ", "MODIS", "SLSTR", "SUOMI-NPP", "VIIRS NOAA-20", "Terra", None]
    df = spark.createDataFrame([(v,) for v in labels], "v string").select(X.sensor_of("v", F.lit("dflt")).alias("s"))
    assert [r.s for r in df.collect()] == ["VIIRS", "VIIRS", "VIIRS", "MODIS", "SLSTR", "VIIRS", "VIIRS", "MODIS", "dflt"]


@pytest.mark.parametrize("scan,track,sensor,want", [
    (0.1, 0.1, "VIIRS", 1.0), (0.375, 0.375, "VIIRS", 1.0), (1.166, 1.166, "VIIRS", 9.67), (1.0, 1.0, "MODIS", 1.0)])
def test_standard_pixels(spark, scan, track, sensor, want):
    got = spark.range(1).select(X.standard_pixels(F.lit(scan * track), F.lit(sensor)).alias("e")).first().e
    assert got == pytest.approx(want, rel=0.02)


def test_dedupe_keeps_one_deterministic_row(spark):
    rows = [("37", "-121", "2025-09-30", "1740", c, "315.9", "MODIS", f, "1", "1") for c, f in
            [("69", "9"), ("50", "3"), ("80", "1")]]
    one = R.dedupe(R.harmonize(raw(spark, rows))).collect()
    two = R.dedupe(R.harmonize(raw(spark, rows[::-1]))).collect()
    assert len(one) == 1 and one == two


def test_record_is_deduplicated_by_time_without_what_follows_from_it(spark):
    """As ``dedupe`` of ``harmonize``; few rows share a time, so the sorts compare little, and none is added for the stored order."""
    rows = [("37", f"-{120 + i % 3}", "2025-09-30", f"17{i % 4:02d}", "69", "315.9", "MODIS", str(i % 5), "1.5", f"1.{i % 7}") for i in range(60)]
    df = raw(spark, rows)
    got = R.deduped(R.parsed(df))
    want = R.dedupe(R.harmonize(df))
    assert got.columns == want.columns and 0 < got.count() < 60
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got.sortWithinPartitions("time")._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert len(sorts) == 2 and all("Sort [time" in line for line in sorts)
    assert "esfp" not in plan.split("SortAggregate", 1)[1]


def test_scans_of_the_record_build_are_finer_and_only_those(spark, tmp_path):
    from eventcal.session import finer_scans

    spark.range(4_000_000).selectExpr("xxhash64(id) AS a", "xxhash64(id + 1) AS b").repartition(1).write.option(
        "parquet.block.size", 1 << 20).parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with finer_scans(spark):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
        assert spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions() > 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_header_contract_names_what_is_missing(spark):
    with pytest.raises(R.MissingColumns, match="acq_date, acq_time"):
        R.harmonize(spark.createDataFrame([("1", "2", "3")], "latitude string, longitude string, confidence string"))


def test_record_passes_through_unharmonised(spark):
    frame = R.harmonize(raw(spark, [("37", "-121", "2025-09-30", "1740", "69", "315.9", "MODIS", "9.2", "1", "1")]))
    text = frame.withColumn("time", F.col("time").cast("string")).withColumn("date", F.col("date").cast("string"))
    assert R.ensure_harmonized(text).collect() == frame.collect()


def test_two_headers_of_equal_width_keep_their_names(spark, tmp_path):
    put(tmp_path, "fire_nrt_M-C61_1.csv", MODIS)
    put(tmp_path, "fire_nrt_SV-C2_2.csv", SNPP)
    record, report = readers.ingest(spark, files(spark, tmp_path))
    rows = {(r.sensor, str(r.time)): r for r in record.collect()}
    assert len(rows) == 4 and {k[0] for k in rows} == {"MODIS", "VIIRS"}
    m = rows[("MODIS", "2026-10-04 00:33:00")]
    assert (m.conf, m.bt, m.sat) == (38.0, 301.4, "A") and m.esfp == pytest.approx(1.43 * 1.18)
    v = rows[("VIIRS", "2026-10-04 00:01:00")]
    assert (v.conf, v.bt) == (60.0, 299.44) and v.esfp == pytest.approx(0.5 * 0.49 / 0.140625)
    assert {r.status for r in report.collect()} == {"accepted"}


def test_encodings_and_report(spark, tmp_path):
    put(tmp_path, "cp.csv", (AREA + "3.0,4.0,2022-02-02,0900,80,12.5,340,é-AQUA\n").encode("cp1252"))
    put(tmp_path, "latin.csv", (AREA + "3.5,4.0,2022-02-02,0900,80,12.5,340,\x81\n").encode("latin-1"))
    put(tmp_path, "bom.csv", b"\xef\xbb\xbf" + (AREA + "4.5,4.0,2022-02-02,0900,80,12.5,340,ü\n").encode())
    put(tmp_path, "utf16.csv", (AREA + "5.0,6.0,2022-03-03,1015,70,9.5,320,NOAA-20\n").encode("utf-16"))
    put(tmp_path, "quiet.csv", AREA + "7.5,8.5,2022-04-04,1200,10,11.0,335,x\n")
    put(tmp_path, "junk.csv", "a,b,c\n1,2,3\n")
    record, report = readers.ingest(spark, files(spark, tmp_path))
    sats = {r.lat: r.sat for r in record.collect()}
    assert sats[3.0] == "é-AQUA" and sats[4.5] == "ü" and sats[5.0] == "NOAA-20" and len(sats) == 4
    by = {r.src_file: r for r in report.collect()}
    assert len(by) == 6 and by["cp.csv"].status == "accepted"
    assert by["quiet.csv"].status == "rejected" and "confidence" in by["quiet.csv"].reason
    assert by["junk.csv"].status == "rejected" and "missing required columns" in by["junk.csv"].reason
    encodings = {r.path.rsplit("/", 1)[-1]: r.encoding for r in readers.signatures(spark, files(spark, tmp_path)).collect()}
    assert encodings["cp.csv"] == "windows-1252" and encodings["latin.csv"] == "ISO-8859-1"
    assert encodings["bom.csv"] == "UTF-8" and encodings["utf16.csv"] == "UTF-16"


def test_nothing_accepted_is_an_error(spark, tmp_path):
    put(tmp_path, "quiet.csv", AREA + "7.5,8.5,2022-04-04,1200,10,11.0,335,x\n")
    with pytest.raises(ValueError, match="quiet.csv.*usable rows"):
        readers.ingest(spark, files(spark, tmp_path))


def test_box_text():
    assert X.parse_box("45,60,-20,-130") == (-20.0, -130.0, 45.0, 60.0)
    assert X.parse_box(None) is None
    for bad in ("1,2,3", "999,0,999,1", "a,b,c,d"):
        with pytest.raises(ValueError):
            X.parse_box(bad)


def test_area_clip(spark):
    from helpers import record

    t = dt.datetime(2025, 1, 1)
    rec = record(spark, [(37.0, -120.0, t, "MODIS"), (37.5, -119.0, t, "MODIS"), (13.7, 100.5, t, "MODIS")])
    assert R.subset(rec, (32.5, -124.4, 42.0, -114.1)).count() == 2
    assert R.subset(rec, None, "2025-01-01", "2025-01-01").count() == 3
    assert R.subset(rec, None, "2025-01-02").count() == 0


def test_swing_and_heat(spark):
    got = spark.createDataFrame([(14.1, 10.0), (8.8, 10.0), (10.0, 10.0), (1.0, 0.0), (None, 1.0)], "a double, b double").select(
        X.swing_label(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == ["+41%", "−12%", "−0%", "—", "—"]
    heat = spark.createDataFrame([(0.0,), (0.01,), (100.0,), (25.0,)], "c double").select(
        X.heat_level(F.col("c"), F.lit(100.0)).alias("h")).collect()
    assert [r.h for r in heat] == [0, 1, 5, 3]


# ------------------------------------------------------------------ one scan
def wide_rows(n, sat="NOAA-20"):
    return "".join(f"{(i % 160) - 80}.5,{i % 170}.25,2022-03-{1 + i % 28:02d},{i % 24:02d}15,80,{i}.5,320,{sat}\r\n" for i in range(n))


@pytest.mark.parametrize("order", ["utf-16-le", "utf-16-be"])
def test_utf16_files_split(spark, tmp_path, order):
    """A file far larger than a split, of characters whose halves look like line feeds, gives each row once."""
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}[order]
    put(tmp_path, "wide.csv", mark + (AREA.replace("\n", "\r\n") + wide_rows(3000, "Ċഊ\U0001f525")).encode(order))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20001")
        rows, _ = readers.read_exports(spark, files(spark, tmp_path))
        got = rows.select("frp", "sat", "conf").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.frp for r in got) == [i + 0.5 for i in range(3000)]
    assert {r.sat for r in got} == {"Ċഊ\U0001f525"} and {r.conf for r in got} == {80.0}


def test_lines_that_are_no_utf16_are_rows_without_use(spark, tmp_path):
    put(tmp_path, "broken.csv", b"\xff\xfe" + (AREA + wide_rows(2)).encode("utf-16-le") + b"\x00\xd8\n\x00" + wide_rows(1).encode("utf-16-le"))
    record, report = readers.ingest(spark, files(spark, tmp_path))
    assert report.first().rows == 4 and report.first().kept == 3 and record.count() == 2


def test_an_encoding_is_that_of_the_whole_file(spark, tmp_path):
    """One line is also valid UTF-8; another line of the same file says that it is not UTF-8."""
    head = AREA.encode()
    put(tmp_path, "mixed.csv", head + "1.0,2.0,2022-02-02,0900,80,1,340,Ã©\n".encode("cp1252") + "2.0,2.0,2022-02-02,0900,80,1,340,\xe9\n".encode("cp1252"))
    put(tmp_path, "utf8.csv", head + "3.0,2.0,2022-02-02,0900,80,1,340,é\n".encode())
    put(tmp_path, "eight.csv", AREA.replace("satellite", "satellité").encode("latin-1") + b"4.0,2.0,2022-02-02,0900,80,1,340,\x81\n")
    record, report = readers.ingest(spark, files(spark, tmp_path))
    assert {r.lat: r.sat for r in record.collect()} == {1.0: "Ã©", 2.0: "é", 3.0: "é", 4.0: "MODIS"}
    assert {r.src_file: (r.rows, r.kept) for r in report.collect()} == {"mixed.csv": (2, 2), "utf8.csv": (1, 1), "eight.csv": (1, 1)}


def test_blank_lines_repeated_headers_names_and_clashing_columns(spark, tmp_path):
    head = AREA.strip() + ",raw,utf8,group\n"
    put(tmp_path, "a.csv", head + "\n1.0,2.0,2022-02-02,0900,80,1,340,A,x,y,z\n\n" + head + "2.0,2.0,2022-02-02,0900,80,1,340,\"B, C\",x\n" + head)
    put(tmp_path, "only.csv", head)
    named = files(spark, tmp_path).withColumn("src_file", F.concat(F.lit("named-"), F.element_at(F.split("path", "/"), -1)))
    record, report = readers.ingest(spark, named)
    assert {r.lat: (r.sat, r.src_file) for r in record.collect()} == {1.0: ("A", "named-a.csv"), 2.0: ("B, C", "named-a.csv")}
    assert {r.src_file: (r.rows, r.kept, r.reason) for r in report.collect()} == {
        "named-a.csv": (4, 2, None), "named-only.csv": (0, 0, "no rows read")}


def test_files_that_go_by_one_name_have_each_a_header_and_an_encoding(spark, tmp_path):
    """What a writer of several tasks leaves of one export."""
    put(tmp_path, "a.csv", AREA.encode() + "1.0,2.0,2022-02-02,0900,80,1,340,é\n".encode())
    put(tmp_path, "b.csv", AREA.encode() + "2.0,2.0,2022-02-02,0900,80,1,340,é\n".encode("cp1252") + AREA.encode())
    put(tmp_path, "c.csv", AREA.encode())
    record, report = readers.ingest(spark, files(spark, tmp_path).withColumn("src_file", F.lit("one")))
    assert {r.lat: r.sat for r in record.collect()} == {1.0: "é", 2.0: "é"}
    assert [(r.src_file, r.rows, r.kept, r.status) for r in report.collect()] == [("one", 3, 2, "accepted")]


def test_the_scan_stands_once_in_the_plan(spark, tmp_path):
    put(tmp_path, "m.csv", MODIS)
    record, report = readers.ingest(spark, files(spark, tmp_path))
    for df in (record, report):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Format: Text" not in plan and "Format: CSV" not in plan and "FileScan text" not in plan and "FileScan csv" not in plan


def test_read_any(spark, tmp_path):
    put(tmp_path, "m.csv", MODIS)
    put(tmp_path, "junk.csv", "a,b,c\n1,2,3\n")
    rows = readers.read_any(spark, str(tmp_path / "m.csv"))
    assert rows.count() == 2 and set(S.RECORD_COLUMNS) <= set(rows.columns)
    rows.write.parquet(f"{tmp_path}/record.parquet")
    assert readers.read_any(spark, f"{tmp_path}/record.parquet").count() == 2
    spark.createDataFrame([("1.5", "2.5", "2022-02-02", "0900", "80", "340")], "latitude string, longitude string, acq_date string, acq_time string, confidence string, brightness string").write.parquet(f"{tmp_path}/raw.parquet")
    assert readers.read_any(spark, f"{tmp_path}/raw.parquet").first().lat == 1.5
    with pytest.raises(R.MissingColumns, match="latitude"):
        readers.read_any(spark, str(tmp_path / "junk.csv"))


@pytest.mark.parametrize("rows", [1, 4, 7, 1000])
def test_de_duplicated_by_stretches_of_time(spark, monkeypatch, rows):
    """Each stretch is written by itself: rows at its ends, copies, many rows of one moment and rows without a time are there once."""
    from helpers import record

    monkeypatch.setattr(R, "STRETCH_ROWS", rows)
    written, whole = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, label, *more: written.append(1 + len(more)) or whole(df, label, *more))
    t = dt.datetime(2024, 3, 1)
    df = record(spark, [(10.0 + i % 5, 20.0, t + dt.timedelta(minutes=i // 3), "MODIS") for i in range(18)] + [(float(i), 1.0, t, "VIIRS") for i in range(6)])
    twice = R.union_records(df, df.withColumn("src_file", F.lit("again")), df.limit(2).withColumn("time", F.lit(None).cast("timestamp")))
    lines = lambda d: sorted(map(repr, d.collect()))
    assert lines(R.dedupe_stored(twice, "live")) == lines(R.dedupe(twice)) and (written[0] > 1) == (rows < 1000)


def test_the_live_record_is_de_duplicated_by_stretches(spark, monkeypatch):
    from eventcal.plans import analyses
    from helpers import record

    seen, whole = [], R.dedupe
    monkeypatch.setattr(R, "STRETCH_ROWS", 3)
    monkeypatch.setattr(R, "dedupe", lambda *a: seen.append(1) or whole(*a))
    df = record(spark, [(10.0, 20.0, dt.datetime(2024, 3, 1, i), "MODIS") for i in range(8)])
    assert analyses.live_snapshot(R.union_records(df, df))["rows"].count() == 8 and len(seen) > 2
