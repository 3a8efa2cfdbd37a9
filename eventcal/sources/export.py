"""Writers and stored results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventcal import schema as S
from eventcal.operators import record as R


# ------------------------------------------------------------------ record export
def pinned(record: DataFrame) -> DataFrame:
    """The record's columns with their fixed types, in order."""
    return record.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.RECORD if f.name in record.columns])


def not_exported(record: DataFrame, exported: DataFrame) -> DataFrame:
    """Rows whose identity no earlier shard holds."""
    return record.join(exported.select(*S.IDENTITY), list(S.IDENTITY), "left_anti")


def write_record(record: DataFrame, path: str, mode: str = "append") -> None:
    """Zstd parquet, ranged by day so that row-group statistics prune date filters.

    Range bounds include the time, so a day that holds a third of the record is cut as well.
    """
    (pinned(record).repartitionByRange("date", "time", "lat", "lon").sortWithinPartitions("date", "time")
     .write.mode(mode).option("compression", "zstd").parquet(path))


def absent(error: AnalysisException) -> bool:
    """Is the error that there is no such path? Anything else about a store is a fault, not an empty store."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_record(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if absent(error):
            return None
        raise


def export_window(raw: DataFrame, path: str, start: str, end: str) -> DataFrame:
    """Harmonise one window of a raw export and append what is not there yet.

    The anti-join on identity makes a repeated run add nothing.
    """
    record = R.dedupe(R.harmonize(R.acquired_between(raw, start, end)))
    stored = read_record(raw.sparkSession, path)
    if stored is not None:                       # only the window's days can hold the same rows
        stored = stored.filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    write_record(record if stored is None else not_exported(record, stored), path)
    return raw.sparkSession.read.parquet(path)


def compact(spark: SparkSession, shards: list[str], path: str) -> DataFrame:
    """Many shards into one data set of one schema, each detection once."""
    frames = [pinned(spark.read.parquet(s)) for s in shards]
    write_record(R.dedupe(R.union_records(*frames)), path, mode="overwrite")
    return spark.read.parquet(path)


def manifest(record: DataFrame, start: str, end: str, rows_scanned: int | None = None) -> DataFrame:
    """One row that describes an export, measured from the data itself."""
    return record.agg(
        F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.array_sort(F.collect_set("sensor")).alias("sensors")).select(
        "*", F.lit(start).alias("window_from"), F.lit(end).alias("window_to"),
        F.lit(rows_scanned).cast("bigint").alias("rows_scanned"),
        F.array(*[F.lit(c) for c in S.IDENTITY]).alias("dedupe"), F.lit("parquet+zstd").alias("format"))


def append_window(store: DataFrame | None, fetched: DataFrame, box: tuple, replace: bool = False) -> DataFrame:
    """A fetched window clipped to its area and appended to the record, each row once."""
    clipped = R.subset(fetched, box)
    if replace or store is None:
        return R.dedupe(clipped)
    return R.dedupe(R.union_records(store, clipped))


# ------------------------------------------------------------------ stored tables with a schema number
def save_tables(path: str, schema: int, tables: dict[str, DataFrame], meta: dict | None = None) -> None:
    """Named parquet tables plus a one-row meta table, written last.

    A half-written store has no meta row and reads as absent.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    stamp = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    row = {"schema": schema, "generated": stamp, **(meta or {})}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_tables(spark: SparkSession, path: str, schema: int, *names: str, **expected) -> dict | None:
    """The tables of a store, or None when it is absent, broken or of another schema."""
    try:
        meta = spark.read.json(f"{path}/meta").first()
        if meta is None or meta["schema"] != schema:
            return None
        if any(list(meta[k]) != list(v) for k, v in expected.items()):
            return None
        return {"meta": meta.asDict(recursive=True), **{n: spark.read.parquet(f"{path}/{n}") for n in names}}
    except (AnalysisException, KeyError, ValueError, TypeError):
        return None


def save_prior(path: str, shapes: DataFrame, levels: DataFrame, meta: dict | None = None) -> None:
    """S27."""
    save_tables(path, S.PRIOR_SCHEMA, {"shapes": shapes, "levels": levels}, meta)


def load_prior(spark: SparkSession, path: str) -> dict | None:
    return load_tables(spark, path, S.PRIOR_SCHEMA, "shapes", "levels")


def save_model(path: str, model, climo: DataFrame, scores: DataFrame, meta: dict | None = None,
               quantiles: DataFrame | None = None, coverage: DataFrame | None = None) -> None:
    """Fitted pipeline, climatology, scores and, where calibrated, widths and their coverage.

    The feature list is checked on load.
    """
    model.write().overwrite().save(f"{path}/model")
    tables = {"climo": climo, "scores": scores, "quantiles": quantiles, "coverage": coverage}
    tables = {n: t for n, t in tables.items() if t is not None}
    save_tables(path, S.MODEL_SCHEMA, tables, {"features": list(S.FEATURES), "tables": sorted(tables), **(meta or {})})


def load_model(spark: SparkSession, path: str) -> dict | None:
    from pyspark.ml import PipelineModel

    stored = load_tables(spark, path, S.MODEL_SCHEMA, "climo", "scores", features=S.FEATURES)
    if stored is None:
        return None
    for extra in ("quantiles", "coverage"):
        if extra in (stored["meta"].get("tables") or ()):
            stored[extra] = spark.read.parquet(f"{path}/{extra}")
    try:
        return {**stored, "model": PipelineModel.load(f"{path}/model")}
    except Exception:  # a broken artifact is no artifact
        return None


# ------------------------------------------------------------------ text
def write_text(lines: DataFrame, path: str) -> None:
    """One text column to text files."""
    lines.select("text").coalesce(1).write.mode("overwrite").text(path)


def point_features(points: DataFrame) -> DataFrame:
    """One GeoJSON feature per point."""
    props = F.struct(F.when(F.col("sensor") == "VIIRS", "VIIRS").otherwise("MODIS").alias("kind"), F.col("frp"))
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))).alias("text"))


def cluster_features(clusters: DataFrame, kind: str = "CLUSTER") -> DataFrame:
    """A closed ring from three distinct vertices on, a line from two, else nothing."""
    ring = F.transform("hull", lambda p: F.array(p["lon"], p["lat"]))
    distinct = F.size(F.array_distinct(ring))
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    closed = F.when(first != last, F.concat(ring, F.array(first))).otherwise(ring)
    props = F.struct(F.lit(kind).alias("kind"), F.col("n").alias("count"), F.col("frp"))
    feature = lambda shape: F.to_json(F.struct(
        F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry")))
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    line = F.struct(F.lit("LineString").alias("type"), ring.alias("coordinates"))
    return clusters.select(F.when(distinct >= 3, feature(polygon)).when(F.size(ring) > 1, feature(line))
                           .alias("text")).filter(F.col("text").isNotNull())
