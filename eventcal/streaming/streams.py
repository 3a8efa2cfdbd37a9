"""Structured Streaming forms of ingest, windows, bursts, alerts and streaks.

Each operator is an ordinary DataFrame transformation, so the same function serves a stream and
its batch twin. State is bounded by watermarks; results leave in append mode, once, when the
watermark has passed them. Checkpoints take the place of a progress ledger.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from eventcal import schema as S
from eventcal.operators import record as R
from eventcal.session import scratch_path, tune
from eventcal.sources import seen
from eventcal.sources.export import read_record

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ------------------------------------------------------------------ sources
def file_drop(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int = 100) -> DataFrame:
    """Exports of one header dropped into a folder, every column as text.

    A line that does not fit the header keeps its text in ``_corrupt_record``.
    """
    fields = [T.StructField(c, T.StringType()) for c in (*columns, "_corrupt_record")]
    return (tune(spark).readStream.schema(T.StructType(fields)).option("header", "true")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("maxFilesPerTrigger", files_per_trigger).csv(path)
            .withColumn("src_file", F.col("_metadata.file_name")))


def split_corrupt(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable rows, rejected lines with their file and the number of fields they had)."""
    bad = F.col("_corrupt_record").isNotNull()
    columns = [c for c in lines.columns if c not in ("_corrupt_record", "src_file")]
    fields = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return (lines.filter(~bad).drop("_corrupt_record"),
            lines.filter(bad).select("src_file", F.col("_corrupt_record").alias("line"), fields.alias("fields")))


def record_stream(lines: DataFrame) -> DataFrame:
    """Readable lines harmonised in the stream."""
    good, _ = split_corrupt(lines)
    return R.harmonize(good)


class Replay(NamedTuple):
    """A stored table as a stream in time order."""

    stream: DataFrame
    delay: str           # the watermark delay under which no row is late
    last: dt.datetime    # the newest time of the table


#: Rows for one file of a replay.
FILE_ROWS = 250_000


def replay(table: DataFrame, time: str, parts: int = 4, files_per_trigger: int | None = None) -> Replay:
    """A table, one file or many in any order, as a stream that no watermark cuts.

    The table is written again as ``parts`` stretches of time, one after the other; a file source reads older files first.
    A batch reads the files of one stretch, unless told otherwise, so there are as many batches however large the table is.
    Inside a stretch rows come in any order, so the delay is the longest stretch. After the last one comes a row
    of a time far beyond, which lets every window and timer close; ``drain`` leaves out what it opens.
    A table without rows gives a stream without rows.
    """
    spark = tune(table.sparkSession)
    table = table.withColumn(time, F.col(time).cast("timestamp"))
    path = scratch_path(spark, "replay")
    marks = [F.percentile_approx(F.unix_micros(time), [k / parts for k in range(1, parts)], 10_000)] if parts > 1 else [F.array()]
    ends = table.agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count("*").alias("n"), *[m.alias("cuts") for m in marks]).first()
    schema = table.schema
    if ends["a"] is None:
        table.limit(0).write.parquet(path)
        return Replay(spark.readStream.schema(schema).parquet(path), "1 day", dt.datetime(1970, 1, 1))
    micros = F.unix_micros(time)
    cuts = sorted(set(ends["cuts"]))
    low = None
    edges = [(ends["b"] - ends["a"]).total_seconds()]
    if cuts:
        first, final = table.select(F.unix_micros(F.lit(ends["a"])).alias("a"), F.unix_micros(F.lit(ends["b"])).alias("b")).first()
        marks = [first, *cuts, final]
        edges = [(b - a) / 1e6 for a, b in zip(marks, marks[1:])]
    longest = int(max(edges)) + 1
    files = max(1, -(-ends["n"] // (parts * FILE_ROWS)))
    for high in [*cuts, None]:
        part = table if low is None and high is None else table.filter(
            micros < high if low is None else micros >= low if high is None else (micros >= low) & (micros < high))
        part.repartition(files).write.mode("append").parquet(path)
        low = high
    beyond = ends["b"] + dt.timedelta(seconds=longest) + BEYOND
    # Its other columns are -1 where they can be: a null would fall to a filter that a join pushes below the watermark.
    nothing = [(F.lit(beyond) if f.name == time else F.lit("-1").try_cast(f.dataType)).alias(f.name) for f in schema]
    spark.range(1).select(*nothing).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger or files).parquet(path)
    return Replay(stream, f"{longest} seconds", ends["b"])


#: How far after the newest row the closing row of a replay lies: longer than any window or gap here.
BEYOND = dt.timedelta(days=400)


# ------------------------------------------------------------------ operators
def dedupe_stream(stream: DataFrame, key: list[str] = list(S.IDENTITY), time: str = "time",
                  delay: str = "1 day") -> DataFrame:
    """R2: copies that arrive within the watermark's delay of each other leave once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def _late(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    return df.withWatermark(time, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, keys: list[str], time: str = "time", size: str = "1 day", value: str = "frp",
             delay: str | None = "1 day") -> DataFrame:
    """Counts per day and key."""
    out = _late(df, time, delay).groupBy(F.window(time, size), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(df: DataFrame, keys: list[str], time: str = "time", size: str = "7 days", slide: str = "1 day",
            value: str = "frp", delay: str | None = "1 day") -> DataFrame:
    """Rolling sums, one per slide."""
    out = _late(df, time, delay).groupBy(F.window(time, size, slide), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def bursts(df: DataFrame, keys: list[str], time: str = "time", gap: str = "12 hours", value: str = "frp",
           delay: str | None = "1 day") -> DataFrame:
    """Bursts of a key, a new one after a pause of ``gap``."""
    out = _late(df, time, delay).groupBy(F.session_window(time, gap), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"),
                      *keys, "n", "total")


def alerts(days: DataFrame, stats: DataFrame, keys: list[str], z: float = 2.0) -> DataFrame:
    """Finished days joined with stored statistics (keys, mu, sd), those above ``z`` kept."""
    scored = days.join(stats, keys).withColumn("z", (F.col("n") - F.col("mu")) / F.col("sd"))
    return scored.filter((F.col("sd") > 1e-9) & (F.col("z") >= z))


def day_statistics(days: DataFrame, keys: list[str], reach: int = 7, time: str = "start", value: str = "n") -> DataFrame:
    """What ``alerts_by_day_of_year`` is held against: (keys, doy, year, days, sum, squares) of past days, a row for each year.

    A day counts for the days of year up to ``reach`` around its own.
    """
    around = days.select(*keys, F.col(time).alias("_t"), F.col(value).cast("double").alias("_v")).withColumn(
        "_off", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    doy = F.pmod(F.dayofyear("_t") - 1 + F.col("_off"), F.lit(S.DOY_BINS)) + 1
    return around.groupBy(*keys, doy.alias("doy"), F.year("_t").alias("year")).agg(
        F.count("*").alias("days"), F.sum("_v").alias("sum"), F.sum(F.col("_v") * F.col("_v")).alias("squares"))


def alerts_by_day_of_year(days: DataFrame, stats: DataFrame, keys: list[str], z: float = 2.0, time: str = "start", value: str = "n") -> DataFrame:
    """Finished days far above the days around the same day of other years, from stored ``day_statistics``.

    The statistics are a static side of the stream: all years of a day of year in one row, from which a day takes those that are not
    its own. Days with fewer than two others, or others without spread, raise no alert.
    """
    years = stats.groupBy(*keys, "doy").agg(F.collect_list(F.struct("year", "days", "sum", "squares")).alias("_years"))
    joined = days.withColumn("doy", F.dayofyear(time)).join(years, [*keys, "doy"])
    others = F.filter("_years", lambda y: y["year"] != F.year(time))
    total = lambda c: F.aggregate(others, F.lit(0.0), lambda a, y: a + y[c])
    joined = joined.withColumns({"_n": total("days"), "_s": total("sum"), "_q": total("squares")}).filter(F.col("_n") > 1)
    mean = F.col("_s") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    scored = joined.withColumns({"mu": mean, "sd": spread}).withColumn("z", F.when(F.col("sd") > 1e-9, (F.col(value) - F.col("mu")) / F.col("sd")))
    return scored.filter(F.col("z") >= z).drop("_years", "_n", "_s", "_q", "doy")


# ------------------------------------------------------------------ streaks
STREAK = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("start", T.DateType()), T.StructField("end", T.DateType()),
    T.StructField("days", T.LongType()), T.StructField("total", T.DoubleType())])
DAY_MS = 86_400_000


class StreakTracker(StatefulProcessor):
    """The open streak of a key: first and last hot day, days and total.

    Input is one row per finished hot day, so a key's state and work are bounded by its days. A
    gap of more than two days closes a streak, and so does a watermark three days past its end.
    """

    def __init__(self, max_gap: int = 2):
        self.max_gap = max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("streak", "start long, last long, days long, total double, timer long")

    def _out(self, key, s) -> tuple:
        day = lambda d: pd.Timestamp(d * DAY_MS, unit="ms").date()
        return (str(key[0]), day(s[0]), day(s[1]), s[2], s[3])

    def handleInputRows(self, key, rows, timerValues):
        days = {}
        for batch in rows:
            for d, v in zip(batch["day"], batch["v"]):
                days[int(d)] = days.get(int(d), 0.0) + float(v)
        state = tuple(self.open.get()) if self.open.exists() else None
        timer = state[4] if state else None
        closed = []
        for d in sorted(days):
            if state and d - state[1] <= self.max_gap:
                state = (min(state[0], d), max(state[1], d), state[2] + 1, state[3] + days[d], timer)
            else:
                closed += [self._out(key, state)] if state else []
                state = (d, d, 1, days[d], timer)
        due = (state[1] + self.max_gap + 1) * DAY_MS
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.open.update((*state[:4], due))
        yield pd.DataFrame(closed, columns=STREAK.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        closed = []
        if self.open.exists():
            closed.append(self._out(key, tuple(self.open.get())))
            self.open.clear()
        yield pd.DataFrame(closed, columns=STREAK.fieldNames())

    def close(self) -> None:
        pass


def streaks(stream: DataFrame, key: str, time: str = "ts", level: int = 3, delay: str = "1 day") -> DataFrame:
    """Closed streaks of days on which a key counted at least ``level``.

    Days are counted by a window aggregate first, which combines before its shuffle; only finished
    hot days reach the per-key state. The session must use the RocksDB state store.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    days = (stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), F.col(key).cast("string").alias("key"))
            .agg(F.count("*").alias("v")).filter(F.col("v") >= level)
            .select("key", F.unix_date(F.to_date("window.start")).cast("long").alias("day"),
                    F.col("v").cast("double").alias("v"), F.window_time("window").alias("at")))
    return days.groupBy("key").transformWithStateInPandas(
        StreakTracker(), outputStructType=STREAK, outputMode="Append", timeMode="EventTime")


# ------------------------------------------------------------------ sinks
def append_once(stream: DataFrame, path: str, checkpoint: str, key: list[str] = list(S.IDENTITY), day: str | None = None):
    """Append each batch's unseen rows to a parquet record; a replayed batch adds nothing.

    Each batch is written to its own folder by batch id and overwritten on replay, so a batch that
    failed half-way leaves no copies. What the record holds is asked of a store of its keys (``sources.seen``), of which a
    batch reads the parts it touches; a column ``day`` of the key narrows these to the batch's months. A record without that
    store gets it with the first batch.
    """
    keys = f"{path}/_keys"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if seen.seen(spark, keys) is None and (before := read_record(spark, path)) is not None:
            for (number,) in before.select("batch").distinct().collect():
                seen.remember(before.filter(F.col("batch") == number), keys, key, number, day)
        batch = batch.persist()
        try:
            seen.unseen(batch, keys, key, day, batch=batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            seen.remember(spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}"), keys, key, batch_id, day)
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class _Dropped(StreamingQueryListener):
    """Rows that the watermark dropped, over all batches of each run; a query itself remembers its last batches only."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def watch(self, run: str) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        run, states = str(event.progress.runId), event.progress.stateOperators
        self.rows[run] = self.rows.get(run, 0) + sum(s.numRowsDroppedByWatermark for s in states)

    def onQueryTerminated(self, event):
        self.watch(event.runId).set()


#: Seconds that the news of a query's end may take after it.
NEWS = 60


def drain(stream: DataFrame, label: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now into parquet on the shared folder, and read it back.

    A row that came too late for the watermark, in whatever batch, would be missing from the result, so it is an error.
    """
    spark = stream.sparkSession
    out, marks = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-marks")
    dropped = _Dropped()
    spark.streams.addListener(dropped)
    try:
        query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
                 .option("checkpointLocation", marks).trigger(availableNow=True).start())
        query.awaitTermination()
        if not dropped.watch(query.runId).wait(NEWS):
            raise RuntimeError("the stream's progress was not told to the end")
    finally:
        spark.streams.removeListener(dropped)
    if late := dropped.rows.get(str(query.runId), 0):
        raise RuntimeError(f"{late} rows came later than the watermark allows")
    result = spark.read.schema(stream.schema).parquet(out)
    return then(result) if then else result
