import datetime as dt
import os

import pytest

from eventcal.streaming import streams as ST
from pyspark.sql import functions as F

HEAD = "latitude,longitude,acq_date,acq_time,confidence,brightness\n"


@pytest.fixture
def folder(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=7 * i), i % 3, "ab"[i % 2], 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return tmp_path


def closed(batch, folder, spark):
    top = spark.read.parquet(str(folder / "events.parquet")).agg(F.max("ts")).first()[0]
    return {tuple(r) for r in batch.collect() if r.end <= top - dt.timedelta(days=1)}


def stream(spark, folder):
    schema = spark.read.parquet(str(folder / "events.parquet")).schema
    return spark.readStream.schema(schema).parquet(str(folder / "events.parquet"))


@pytest.mark.parametrize("operator,keys", [(ST.tumbling, ["event_type"]), (ST.sliding, ["event_type"]), (ST.bursts, ["user_id"])])
def test_stream_equals_closed_batch(spark, folder, operator, keys):
    batch = operator(spark.read.parquet(str(folder / "events.parquet")), keys, "ts", value="value")
    got = ST.drain(operator(stream(spark, folder), keys, "ts", value="value"), "t")
    assert {tuple(r) for r in got.collect()} == closed(batch, folder, spark)


@pytest.mark.parametrize("operator,keys,files,parts", [
    (ST.tumbling, ["event_type"], 1, 1), (ST.tumbling, ["event_type"], 8, 3), (ST.sliding, ["event_type"], 8, 3),
    (ST.bursts, ["user_id"], 8, 3)])
def test_replay_loses_nothing(spark, folder, tmp_path, files, parts, operator, keys):
    table = spark.read.parquet(str(folder / "events.parquet")).repartition(files, F.rand(3))
    table.write.parquet(str(tmp_path / "many.parquet"))
    table = spark.read.parquet(str(tmp_path / "many.parquet"))
    s, delay, last = ST.replay(table, "ts", parts)
    got = ST.drain(operator(s, keys, "ts", value="value", delay=delay), "t").filter(F.col("start") <= F.lit(last))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in operator(table, keys, "ts", value="value").collect()}


def test_late_rows_are_an_error(spark, tmp_path):
    path = str(tmp_path / "late.parquet")
    for day in (20, 25, 1):
        spark.createDataFrame([(dt.datetime(2024, 1, day), "a", 1.0)], "ts timestamp, event_type string, value double").coalesce(
            1).write.mode("append").parquet(path)
    late = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(RuntimeError):
        ST.drain(ST.tumbling(late, ["event_type"], "ts", value="value"), "t")


def test_empty_replay(spark, folder):
    nothing = spark.read.parquet(str(folder / "events.parquet")).limit(0)
    s, delay, _ = ST.replay(nothing, "ts")
    assert ST.drain(ST.tumbling(s, ["event_type"], "ts", value="value", delay=delay), "t").count() == 0


def test_dedupe_and_append_are_idempotent(spark, folder, tmp_path):
    twice = stream(spark, folder).unionByName(stream(spark, folder))
    assert ST.drain(ST.dedupe_stream(twice, ["event_id"], "ts"), "t").count() == 60
    out = str(tmp_path / "store")
    for marks in ("m1", "m2"):
        ST.append_once(stream(spark, folder), out, str(tmp_path / marks), ["event_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 60


def test_streaks_close_by_gap_and_by_watermark(spark, tmp_path):
    rows, n = [], 0
    for d in (0, 1, 3, 8, 9, 20):
        for k in range(3):
            rows.append((n, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=k), 1))
            n += 1
    rows.append((n, dt.datetime(2024, 2, 20), 2))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    got = ST.drain(ST.streaks(stream(spark, tmp_path), "user_id"), "t").orderBy("start").collect()
    assert [(r.key, str(r.start), str(r.end), r.days, r.total) for r in got] == [
        ("1", "2024-01-01", "2024-01-04", 3, 9.0), ("1", "2024-01-09", "2024-01-10", 2, 6.0),
        ("1", "2024-01-21", "2024-01-21", 1, 3.0)]


def test_file_drop_splits_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "1.0,2.0,2024-01-01,1200,80,300\n1.0,2.0,2024-01-01\n")
    (tmp_path / "b.csv").write_text(HEAD + "3.0,2.0,2024-01-02,1200,n,300\n3.5,2.0,2024-01-02,1200,l,300\n")
    lines = ST.file_drop(spark, str(tmp_path), HEAD.strip().split(","))
    _, bad = ST.split_corrupt(lines)
    assert {r.lat for r in ST.drain(ST.record_stream(lines), "t").collect()} == {1.0, 3.0}
    rejected = ST.drain(bad, "t").collect()
    assert [(r.src_file, r.line, r.fields) for r in rejected] == [("a.csv", "1.0,2.0,2024-01-01", 3)]


# ------------------------------------------------------------------ many batches, and the store of keys
def test_a_late_row_in_an_early_batch_of_many_is_told(spark, tmp_path):
    """More batches than a query remembers; only the second brings a row too late."""
    src = tmp_path / "in"
    src.mkdir()
    t0 = dt.datetime(2024, 1, 1)
    for i in range(112):
        times = [t0 + dt.timedelta(hours=6 * i)] + ([t0 - dt.timedelta(days=40)] if i == 2 else [])
        (src / f"{i:04d}.json").write_text("\n".join('{"time": "%s", "k": "a"}' % t.isoformat() for t in times))
        os.utime(src / f"{i:04d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("time timestamp, k string").option("maxFilesPerTrigger", 1).json(str(src))
    out = stream.withWatermark("time", "1 day").groupBy(F.window("time", "1 day"), "k").count()
    with pytest.raises(RuntimeError, match="1 rows came later"):
        ST.drain(out.select("window.start", "k", "count"), "late")


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, at timestamp, v int")


def test_keys_of_batches_and_their_union(spark, tmp_path):
    from eventcal.sources import seen

    path, t0 = str(tmp_path / "keys"), dt.datetime(2024, 1, 5)
    first = rows_of(spark, [("a", t0, 1), ("b", t0, 2), (None, t0, 3), ("a", None, 4)])
    assert seen.seen(spark, path) is None and seen.union(spark, path, ["k", "at"]) is None and seen.unseen(first, path, ["k", "at"], "at").count() == 4
    for _ in range(2):                                       # a batch written twice counts once
        seen.remember(first, path, ["k", "at"], 0, "at")
    assert seen.seen(spark, path).count() == 4
    again = rows_of(spark, [("a", t0, 9), ("c", t0, 9), (None, t0, 9), (None, t0, 8), ("a", None, 9), ("a", t0 + dt.timedelta(days=60), 9)])
    new = seen.unseen(again, path, ["k", "at"], "at")
    assert sorted((r.k, r.at) for r in new.collect()) == [("a", t0 + dt.timedelta(days=60)), ("c", t0)]
    seen.remember(new, path, ["k", "at"], 1, "at")
    assert seen.union(spark, path, ["k", "at"]).count() == 6
    assert seen.unseen(again, path, ["k", "at"], "at", batch=1).count() == 2      # its own batch does not count
    assert seen.unseen(again.limit(0), path, ["k", "at"], "at").count() == 0


def test_a_batch_reads_the_parts_it_touches_and_shuffles_no_stored_key(spark, tmp_path):
    from eventcal.sources import seen

    path, t0 = str(tmp_path / "keys"), dt.datetime(2024, 1, 5)
    seen.remember(rows_of(spark, [(str(i), t0 + dt.timedelta(days=i), i) for i in range(400)]), path, ["k", "at"], 0, "at")
    batch = rows_of(spark, [("7", t0 + dt.timedelta(days=7), 0), ("x", t0, 0)])
    old = seen.held(batch, path, ["k", "at"], "at")
    assert [r.k for r in old.collect()] == ["7"]
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01" in plan and "BroadcastHashJoin" in plan
    assert " Exchange " not in plan and "SortMergeJoin" not in plan

    def files(node):                                         # read by the scan, by its own count
        if node.nodeName() == "AdaptiveSparkPlan":
            return files(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return files(node.plan())
        own = node.metrics().apply("numFiles").value() if node.nodeName().startswith("Scan parquet") and "PartitionFilters: [" in node.toString() else 0
        return own + sum(files(node.children().apply(i)) for i in range(node.children().size()))

    assert 0 < files(old._jdf.queryExecution().executedPlan()) <= 2 * seen.PARTS + 8 < 57


def test_a_record_without_its_store_of_keys_gets_it(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "record")
    src.mkdir()
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(f"{out}/batch=99")
    (src / "0.json").write_text('{"k": "a", "v": 5}\n{"k": "b", "v": 6}')
    stream = spark.readStream.schema("k string, v int").json(str(src))
    ST.append_once(stream, out, str(tmp_path / "marks-a"), ["k"]).awaitTermination()
    (src / "1.json").write_text('{"k": "b", "v": 7}\n{"k": "c", "v": 8}')
    ST.append_once(stream, out, str(tmp_path / "marks-a"), ["k"]).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 6), ("c", 8)]


def test_alerts_are_held_against_the_same_season_of_other_years(spark):
    day = lambda y, m, d: dt.datetime(y, m, d)
    past = [("a", day(y, 6, d), 10 + (d % 3)) for y in (2020, 2021, 2022) for d in range(1, 20)] + [("a", day(2022, 6, 10), 500), ("a", day(2022, 12, 31), 7)]
    frame = spark.createDataFrame(past, "k string, start timestamp, n long")
    stats = ST.day_statistics(frame, ["k"])
    new = spark.createDataFrame([("a", day(2022, 6, 10), 500), ("a", day(2023, 6, 12), 11), ("a", day(2023, 12, 31), 900), ("b", day(2023, 6, 10), 900)],
                                "k string, start timestamp, n long")
    got = {(r.k, r.start): r for r in ST.alerts_by_day_of_year(new, stats, ["k"]).collect()}
    assert set(got) == {("a", day(2022, 6, 10))}             # its own 500 is left out of what it is held against
    others = [n for k, t, n in past if t.year != 2022 and 3 <= t.day <= 17]
    mean = sum(others) / len(others)
    assert got[("a", day(2022, 6, 10))].mu == pytest.approx(mean)


def test_a_first_batch_without_rows_leaves_a_store_to_go_on_with(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "record")
    src.mkdir()
    for i, text in enumerate(("", '{"k": "a", "v": 5}', '{"k": "a", "v": 6}\n{"k": "b", "v": 6}')):
        (src / f"{i}.json").write_text(text)
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).json(str(src))
    for marks in ("marks-a", "marks-b"):
        ST.append_once(stream, out, str(tmp_path / marks), ["k"]).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", 5), ("b", 6)]


def test_a_replay_has_a_batch_for_each_stretch_however_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "FILE_ROWS", 30)
    t0 = dt.datetime(2024, 1, 1)
    table = spark.range(400).select((F.lit(t0) + F.make_dt_interval(F.lit(0), "id")).alias("ts"), F.lit("a").alias("k"), "id").repartition(16)
    s, delay, last = ST.replay(table, "ts")
    query = (ST.tumbling(s, ["k"], "ts", value="id", delay=delay).writeStream.format("memory").queryName("stretches")
             .option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start())
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) == 5 and max(read) < 120 and sum(read) == 401
