"""Harmonisation, de-duplication and record-level views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.functions import scalars as X
from eventcal.session import stored

#: Rows of a stretch of time that are de-duplicated at once.
STRETCH_ROWS = 40_000_000


class MissingColumns(ValueError):
    """S3: the frame does not honour the header contract."""

    def __init__(self, missing):
        self.missing = sorted(missing)
        super().__init__(f"missing required columns: {', '.join(self.missing)}")


def require_columns(columns, required=S.REQUIRED) -> None:
    missing = set(required) - {c.strip().lower() for c in columns}
    if missing:
        raise MissingColumns(missing)


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def typed(raw: DataFrame, geometry: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """Parse a raw export into record columns without dropping anything.

    ``carried`` names columns that go along as they are. Every row is labelled from its own ``instrument``, so a frame that mixes products is
    labelled correctly; a missing label falls back on which brightness column is filled.
    """
    return derived(parsed(raw, geometry, carried), geometry)


def parsed(raw: DataFrame, geometry: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """``typed`` without the columns that follow from its others."""
    df = X.clean_headers(raw)
    require_columns(df.columns)
    if "bright_ti4" in df.columns and "brightness" in df.columns:
        default = F.when(F.col("bright_ti4").isNotNull(), "VIIRS").otherwise("MODIS")
    else:
        default = F.lit("VIIRS" if "bright_ti4" in df.columns else "MODIS")
    # In steps, so that what later columns build on is computed once per row and the generated
    # code of each step stays small enough to be compiled.
    named = {c: F.col(c) for c in ("src_file", *carried) if c in df.columns}
    out = df.select(
        X.lenient_double("latitude").alias("lat"),
        X.lenient_double("longitude").alias("lon"),
        X.acquired_at("acq_date", "acq_time").alias("time"),
        X.sensor_of(_or_null(df, "instrument"), default).alias("sensor"),
        _or_null(df, "satellite").cast("string").alias("sat"),
        X.confidence("confidence").alias("conf"),
        X.number_or(_or_null(df, "frp"), 0.0).alias("frp"),
        F.coalesce(X.lenient_double(_or_null(df, "bright_ti4")),
                   X.lenient_double(_or_null(df, "brightness"))).alias("bt"),
        *([X.footprint_side(_or_null(df, c)).alias(c) for c in ("scan", "track")] if geometry else []),
        F.coalesce(_or_null(df, "daynight").cast("string"), F.lit("0")).alias("daynight"),
        *named.values())
    return out.withColumn("sat", F.coalesce("sat", "sensor"))


def derived(rows: DataFrame, geometry: bool = True) -> DataFrame:
    """Rows of ``parsed`` with date and footprint, in the record's order of columns."""
    order = S.RECORD_COLUMNS if geometry else S.LEAN_COLUMNS
    out = {c: F.col(c) for c in rows.columns} | {"date": F.to_date("time")}
    if geometry:
        area = F.col("scan") * F.col("track")
        out |= {"pixel_km2": area, "esfp": X.standard_pixels(area, F.col("sensor"))}
    return rows.select(*[out[c].alias(c) for c in (*order, *[c for c in rows.columns if c not in order])])


def countable() -> Column:
    """Complete, on the map, and at or above the confidence floor.

    A null or NaN fails every comparison made here (NaN sorts above infinity).
    """
    infinity = F.lit(float("inf"))
    return (X.in_box(S.WORLD_BOX) & (F.col("conf") >= S.CONFIDENCE_FLOOR) & (F.col("conf") < infinity)
            & F.col("time").isNotNull() & (F.col("bt") < infinity))


def harmonize(raw: DataFrame, geometry: bool = True) -> DataFrame:
    """Raw export to record (``geometry=False`` leaves the footprint columns out, P15)."""
    return typed(raw, geometry).filter(countable())


def ensure_harmonized(frame: DataFrame) -> DataFrame:
    """Pass a record through with its times typed, harmonise anything else."""
    names = {c.strip().lower() for c in frame.columns}
    if not set(S.RECORD_MARKERS) <= names:
        return harmonize(frame)
    df = X.clean_headers(frame)
    return df.withColumn("time", F.to_timestamp("time")).withColumn("date", F.to_date("date"))


def acquired_between(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Window a raw export on its own date text, before any parsing, so the scan can prune."""
    return raw.filter(F.col("acq_date").cast("string").between(start, end))


def union_records(*frames: DataFrame) -> DataFrame:
    """Union of frames whose columns differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe(record: DataFrame, key: tuple = S.IDENTITY) -> DataFrame:
    """A2: one row per identity, always the same one.

    The least row by provenance and content is kept, as an aggregate and not a sorted window:
    copies collapse before the shuffle, so a key that holds a third of the record is not sent
    to one task row by row. The aggregate sorts, by the time first where the key has one: few rows share it, so hardly any
    two are compared by all of the key, and the result is in the order of time.
    """
    by = sorted(key, key=lambda c: c != "time")
    rest = [c for c in record.columns if c not in key]
    front = [c for c in ("src_file",) if c in rest]
    order = front + [c for c in rest if c not in front]
    kept = record.groupBy(*by).agg(F.min(F.struct(*order)).alias("_kept"))
    return kept.select(*[F.col(c) if c in key else F.col(f"_kept.{c}").alias(c) for c in record.columns])


def dedupe_stored(record: DataFrame, label: str) -> DataFrame:
    """``dedupe``, written; of a large record one stretch of time after another, so that only the rows of one are shuffled at a time."""
    stretches = -(-record.count() // STRETCH_ROWS)
    if stretches < 2:
        return stored(dedupe(record), label)
    shares = [i / stretches for i in range(1, stretches)]
    found = record.agg(F.percentile_approx(F.unix_micros("time"), shares, 10_000)).first()[0] or []
    edges = [F.timestamp_micros(F.lit(e)) for e in sorted(set(found))]
    time = F.col("time")
    within = [(time >= lo if lo is not None else F.lit(True)) & (time < hi if hi is not None else F.lit(True)) for lo, hi in zip([None, *edges], [*edges, None])]
    parts = [dedupe(record.filter(w)) for w in (*within, time.isNull())] if edges else [dedupe(record)]
    return stored(parts[0], label, *parts[1:])


def deduped(rows: DataFrame) -> DataFrame:
    """``dedupe`` of the usable rows of ``parsed`` or ``typed``: what follows from other columns is not shuffled but worked out after it."""
    return derived(dedupe(rows.filter(countable()).drop("date", "pixel_km2", "esfp")))


def subset(record: DataFrame, box: tuple | str | None = None, start: str | None = None,
           end: str | None = None) -> DataFrame:
    """Area and date filter, all ends inclusive."""
    if isinstance(box, str):
        box = X.parse_box(box)
    if box:
        record = record.filter(X.in_box(box))
    if start:
        record = record.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        record = record.filter(F.col("date") <= F.lit(end).cast("date"))
    return record


def summary(record: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1: size, span, bounds and the two footprint sums, in one pass."""
    return record.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.min("lat").alias("minlat"),
        F.min("lon").alias("minlon"),
        F.max("lat").alias("maxlat"),
        F.max("lon").alias("maxlon"),
        F.sum(F.col("frp") * F.col("esfp")).alias("hfi"),
        F.sum("esfp").alias("esfp"),
    )


def sensor_counts(record: DataFrame) -> DataFrame:
    return record.groupBy("sensor").agg(F.count("*").alias("n"))


def platform_counts(record: DataFrame) -> DataFrame:
    """Detections per family and platform, with subtotals and the grand total."""
    return record.rollup("sensor", "sat").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def file_report(raw: DataFrame) -> DataFrame:
    """What each file contributed, or why it contributed nothing."""
    return counted_by_file(typed(raw, geometry=False))


def counted_by_file(rows: DataFrame) -> DataFrame:
    """The same of rows that are typed already."""
    rows = rows.withColumn("_kept", F.coalesce(countable(), F.lit(False)))
    counted = rows.groupBy("src_file").agg(
        F.count("*").alias("rows"), F.count_if(F.col("_kept")).alias("kept"))
    return counted.select(
        "src_file", "rows", "kept",
        F.when(F.col("kept") > 0, "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("kept") == 0,
               F.lit("no usable rows: every row was low-confidence, out of range or incomplete")).alias("reason"))
