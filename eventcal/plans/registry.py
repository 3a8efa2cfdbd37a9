"""Query registry: one entry per implemented query, over the whole of its tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventcal.functions import scalars as X
from eventcal.plans import analyses as AN
from eventcal.plans import training as TR
from eventcal.session import scratch_path, stored, times_with_statistics
from eventcal.operators import anomalies as A
from eventcal.operators import clusters as C
from eventcal.operators import diagnostic as D
from eventcal.operators import forecast as FC
from eventcal.operators import panel as P
from eventcal.operators import ranking as K
from eventcal.operators import record as R
from eventcal.operators import series as Q
from eventcal.operators import spatial as G
from eventcal.sources import archive as V
from eventcal.sources import driver_tables as T
from eventcal.sources import export as E
from eventcal.sources import readers as RD
from eventcal.sources import seen as SN
from eventcal.sources import windows as WN
from eventcal.streaming import streams as ST

_REGISTRY: dict = {}


def query(fn):
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict:
    return dict(_REGISTRY)


# ------------------------------------------------------------------ shaping for display
def text(c: str, alias: str | None = None):
    """Dates and times leave as ISO text."""
    return F.col(c).cast("string").alias(alias or c)


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded steadily, integers widened, dates as text."""
    out = []
    for field in df.schema:
        kind = field.dataType.simpleString()
        c = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            c = X.steady_round(c, digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


# ------------------------------------------------------------------ record
@query
def harmonize_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P14 over the raw export, before de-duplication."""
    return shown(R.harmonize(T.raw_detections(spark, sf_dir)))


@query
def dedupe_record(spark, sf_dir):
    """The record united with a re-delivered copy of itself."""
    record = R.harmonize(T.raw_detections(spark, sf_dir))
    again = record.drop("daynight").withColumn("src_file", F.concat(F.lit("z_"), "src_file"))
    return shown(R.dedupe(R.union_records(record, again)).drop("daynight"))


@query
def record_summary(spark, sf_dir):
    return shown(R.summary(T.detections(spark, sf_dir)), 3)


@query
def sensor_counts(spark, sf_dir):
    return R.sensor_counts(T.detections(spark, sf_dir))


@query
def sensor_platform_counts(spark, sf_dir):
    return R.platform_counts(T.detections(spark, sf_dir))


@query
def file_report(spark, sf_dir):
    """S2/A33."""
    return R.file_report(T.raw_detections(spark, sf_dir))


_EXPORTS: dict[tuple[str, str], DataFrame] = {}


def _export_files(spark, sf_dir):
    """The stand-in exports written as CSV files, one product with a header of its own and some in UTF-16; (path, src_file) of each."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EXPORTS:
        raw, root = T.raw_detections(spark, sf_dir), scratch_path(spark, "exports")
        options = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        first = F.col("src_file").contains("M-C61")
        for part, dropped, encoding in ((first, "bright_ti4", "UTF-8"), (~first & ~F.col("src_file").contains("_nrt_"), "brightness", "UTF-16"),
                                        (~first & F.col("src_file").contains("_nrt_"), "brightness", "UTF-8")):
            raw.filter(part).drop(dropped).write.mode("append").partitionBy("src_file").options(**options, encoding=encoding).csv(root)
        listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(root).select("path", "src_file")
        _EXPORTS[key] = stored(listing, "exports")
    return _EXPORTS[key]


@query
def ingest_csv(spark, sf_dir):
    """The record from export files of two headers and two encodings, read once."""
    record, _ = RD.ingest(spark, _export_files(spark, sf_dir))
    return shown(record.drop("daynight"))


@query
def ingest_report(spark, sf_dir):
    """What each export file contributed, by the same scan."""
    return RD.ingest(spark, _export_files(spark, sf_dir))[1]


# ------------------------------------------------------------------ calendars
@query
def calendar_daily(spark, sf_dir):
    """Q2."""
    return shown(Q.daily(T.detections(spark, sf_dir)).drop("present"))


@query
def sensor_factors(spark, sf_dir):
    return shown(Q.sensor_factors(Q.daily_counts(T.detections(spark, sf_dir))))


_DAILY: dict = {}


def _daily(spark, sf_dir):
    """The record's calendar, written once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DAILY:
        _DAILY[key] = stored(Q.daily(T.detections(spark, sf_dir)), "daily")
    return _DAILY[key]


@query
def calendar_levels(spark, sf_dir):
    """Heat levels against the record's peak and against each year's."""
    s = _daily(spark, sf_dir)
    whole = Q.heat_levels(s).withColumnRenamed("level", "level_record")
    both = Q.heat_levels(whole, per_year=True).withColumnRenamed("level", "level_year")
    return shown(both.select("date", "level_record", "level_year"))


@query
def calendar_year_summary(spark, sf_dir):
    return shown(Q.year_summary(_daily(spark, sf_dir)))


@query
def month_bounds(spark, sf_dir):
    """Month start, end and length of every calendar day."""
    s = _daily(spark, sf_dir)
    return shown(s.select("date", X.month_start("date").alias("first_day"), X.month_end("date").alias("last_day"),
                          X.days_in_month("date").alias("days_in_month"), *Q.calendar_parts()))


@query
def log_level(spark, sf_dir):
    """A31."""
    return shown(Q.log_level(_daily(spark, sf_dir)))


# ------------------------------------------------------------------ climatology
@query
def rolling_percentiles(spark, sf_dir):
    """W1."""
    return shown(Q.rolling_quantiles(_daily(spark, sf_dir), "count", 15, Q.ENVELOPE).select("date", *Q.ENVELOPE))


@query
def climatology_envelope(spark, sf_dir):
    """Q5: the envelope at every fifth day of year."""
    s = Q.at_least_days(_daily(spark, sf_dir), 60)
    return shown(Q.envelope_steps(Q.doy_envelope(s)).drop("mean"))


@query
def climatology_summary(spark, sf_dir):
    return shown(Q.season_summary(Q.at_least_days(_daily(spark, sf_dir), 60)))


@query
def doy_matrix(spark, sf_dir):
    """Each day of year's values over the years, as text."""
    m = Q.doy_matrix(_daily(spark, sf_dir).withColumn("count", X.steady_round("count", 2)), "count")
    listed = F.transform("values", lambda v: F.format_string("%.2f", v))
    return m.select(F.col("doy").cast("bigint").alias("doy"), F.array_join(listed, ",").alias("values"))


@query
def doy_curve(spark, sf_dir):
    """Interpolated and smoothed day-of-year means."""
    return shown(Q.doy_curve(_daily(spark, sf_dir), "count"))


# ------------------------------------------------------------------ transition
def _paired(spark, sf_dir):
    return D.paired_days(Q.daily_counts(T.detections(spark, sf_dir), weights=True))


ERA = {"break_year": T.BREAK_YEAR, "overlap_to": T.OVERLAP_TO}


@query
def transition_calibration(spark, sf_dir):
    return shown(D.calibration(_paired(spark, sf_dir), **ERA))


@query
def transition_yearly(spark, sf_dir):
    return shown(D.yearly(D.comparable_days(_paired(spark, sf_dir), **ERA)))


@query
def transition_growth(spark, sf_dir):
    return shown(D.growth(D.comparable_days(_paired(spark, sf_dir), **ERA), **ERA), 4)


# ------------------------------------------------------------------ anomalies
@query
def zscore_doy_window(spark, sf_dir):
    return shown(A.zscore_doy_window(_daily(spark, sf_dir)))


@query
def zscore_boundary(spark, sf_dir):
    return shown(A.zscore_boundary(_daily(spark, sf_dir)))


@query
def top_anomalies(spark, sf_dir):
    s = Q.at_least_days(_daily(spark, sf_dir), 400)
    return shown(A.top_anomalies(A.zscore_doy_window(s)))


@query
def month_profile(spark, sf_dir):
    return shown(A.month_profile(_daily(spark, sf_dir)))


@query
def season_bands(spark, sf_dir):
    bands = A.season_bands(_daily(spark, sf_dir))
    return shown(bands.withColumn("verdict", X.month_verdict(F.col("z"))))


@query
def streaks(spark, sf_dir):
    return shown(A.streaks(A.zscore_doy_window(_daily(spark, sf_dir)), z=1.0))


@query
def leading_streaks(spark, sf_dir):
    runs = A.streaks(A.zscore_doy_window(_daily(spark, sf_dir)), z=1.0)
    return shown(A.leading_streaks(runs))


@query
def recent_vs_record(spark, sf_dir):
    out = A.recent_and_record(_daily(spark, sf_dir))
    return shown(out.withColumn("swing", X.swing_label(F.col("recent_mean"), F.col("record_mean"))))


@query
def threat_level(spark, sf_dir):
    s = _daily(spark, sf_dir)
    lead = A.leading_streaks(A.streaks(A.zscore_doy_window(s), z=1.0))
    return shown(A.threat(lead, A.recent_and_record(s)))


# ------------------------------------------------------------------ keyed series
@query
def orders_calendar(spark, sf_dir):
    s = Q.daily(T.orders_series(spark, sf_dir), ["o_orderpriority"])
    return shown(s.drop("present"), 4)


@query
def orders_season_bands(spark, sf_dir):
    s = Q.daily(T.orders_series(spark, sf_dir), ["o_orderpriority"])
    return shown(A.season_bands(s, ["o_orderpriority"]))


@query
def orders_streaks(spark, sf_dir):
    s = Q.daily(T.orders_series(spark, sf_dir), ["o_orderpriority"])
    key = ["o_orderpriority"]
    return shown(A.streaks(A.zscore_doy_window(s, key), z=1.5, keys=key), 4)


@query
def customer_region_daily(spark, sf_dir):
    return shown(Q.daily(T.customer_orders(spark, sf_dir), ["r_name"]).drop("present"), 4)


# ------------------------------------------------------------------ areas and points
SAMPLE_BOX = (-20.0, -130.0, 45.0, 60.0)


@query
def calendar_for_box(spark, sf_dir):
    """A calendar of one area and date range, all ends inclusive."""
    box = X.parse_box("45,60,-20,-130")
    picked = R.subset(T.detections(spark, sf_dir), box, "1997-03-01", "2000-10-31")
    return shown(Q.daily(picked).drop("present"))


@query
def points_sample(spark, sf_dir):
    """Q3: a reproducible uniform sample of points, coordinates to four decimals."""
    picked = K.sample(R.subset(T.detections(spark, sf_dir), SAMPLE_BOX), 2000)
    return shown(picked.select("lat", "lon", "frp", "sensor"), 4)


@query
def stride_sample(spark, sf_dir):
    """Every fifth detection of the time order."""
    picked = K.stride(T.detections(spark, sf_dir), 5)
    return shown(picked.select("lat", "lon", "time", "sensor"))


@query
def newest_rows(spark, sf_dir):
    """T7."""
    order = ["time", "lat", "lon", "sensor"]
    return shown(K.newest(T.detections(spark, sf_dir), 1500, order).select("lat", "lon", "time", "sensor"))


@query
def head_slice(spark, sf_dir):
    """S7."""
    order = ["time", "lat", "lon", "sensor"]
    return shown(K.head(T.detections(spark, sf_dir), 1500, order).select("lat", "lon", "time", "sensor", "capped"))


@query
def cell_density(spark, sf_dir):
    """P19/P20/C4."""
    return shown(G.cell_centres(G.cell_density(T.detections(spark, sf_dir))), 4)


@query
def calendar_by_region(spark, sf_dir):
    """One calendar per region preset."""
    return shown(Q.daily(G.in_regions(T.detections(spark, sf_dir)), ["region"]).drop("present"))


@query
def region_of_cell_box(spark, sf_dir):
    """The preset that wholly contains the box of each cell's detections."""
    cells = G.with_cell(T.detections(spark, sf_dir)).groupBy("cell").agg(
        F.min("lat").alias("minlat"), F.min("lon").alias("minlon"),
        F.max("lat").alias("maxlat"), F.max("lon").alias("maxlon"))
    return shown(G.containing_region(cells))


@query
def region_cells(spark, sf_dir):
    """Per preset, the record's cells it touches and those centred inside."""
    cells = G.with_cell(T.detections(spark, sf_dir)).groupBy("cell").agg(F.count("*").alias("n"))
    touched = G.cells_touched(G.region_boxes(spark)).select("region", "cell", "minlat", "minlon", "maxlat", "maxlon")
    centred = (X.cell_lat().between(F.col("minlat"), F.col("maxlat"))
               & X.cell_lon().between(F.col("minlon"), F.col("maxlon")))
    return cells.join(touched, "cell").select("region", "cell", "n", centred.alias("centred"))


# ------------------------------------------------------------------ archives
def _files(spark, sf_dir):
    """The stand-in exports as an inventory: their bytes are the lengths of their text columns."""
    raw = T.raw_detections(spark, sf_dir)
    size = sum((F.length(c) for c in ("acq_time", "confidence", "satellite")), F.length("acq_date"))
    return raw.groupBy("src_file").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


@query
def archive_inventory(spark, sf_dir):
    """The files under the data folder. Sizes are the file system's, so there is no SQL twin."""
    return shown(V.inventory(spark, sf_dir).drop("path", "modified", "folder"))


@query
def file_names_decoded(spark, sf_dir):
    """S6."""
    return V.decode_names(_files(spark, sf_dir)).drop("bytes", "rows")


@query
def budget_allocation(spark, sf_dir):
    """S10/W14."""
    files = V.allocate(_files(spark, sf_dir), 4000).withColumn("share", K.share("bytes"))
    return shown(files)


def _coverage(spark, sf_dir):
    """Coverage per file; near-real-time files of source sites in the far north-west are regional."""
    return V.judge_coverage(V.coverage(T.detections(spark, sf_dir)))


@query
def coverage_by_year(spark, sf_dir):
    """S13/S14."""
    return shown(_coverage(spark, sf_dir), 4)


@query
def coverage_notes(spark, sf_dir):
    """Thin years and note, with sites as files so that some cover little ground."""
    sites = T.detections(spark, sf_dir).withColumn("src_file", F.concat(F.lit("site_"), F.floor(F.col("lat") / 40)))
    notes = V.coverage_notes(V.judge_coverage(V.coverage(sites)))
    return notes.select("src_file", "years", F.array_join(F.col("thin_years").cast("array<string>"), ",").alias("thin_years"),
                        "note")


@query
def years_available(spark, sf_dir):
    """S16."""
    return V.years_available(_coverage(spark, sf_dir)).withColumn("year", F.col("year").cast("bigint"))


@query
def open_year(spark, sf_dir):
    """S12/J17."""
    record = T.detections(spark, sf_dir)
    return shown(R.summary(V.open_year(record, _coverage(spark, sf_dir), 1999), ["src_file"]), 3)


@query
def spread_slice(spark, sf_dir):
    """S8/S9."""
    picked = V.spread_slice(T.detections(spark, sf_dir), 4800)
    return shown(picked.select("step", "lat", "lon", "time", "sensor"))


@query
def merge_budgeted(spark, sf_dir):
    """S11."""
    picked = V.merge_budgeted(T.detections(spark, sf_dir), _files(spark, sf_dir), 4000)
    return shown(picked.select("src_file", "lat", "lon", "time", "sensor"))


@query
def merge_report(spark, sf_dir):
    files = _files(spark, sf_dir)
    return V.merge_report(files, V.merge_budgeted(T.detections(spark, sf_dir), files, 4000), 4000)


@query
def archive_scan_cells(spark, sf_dir):
    """S17/S18."""
    return shown(V.archive_scan(T.detections(spark, sf_dir))["cell_days"])


@query
def archive_scan_days(spark, sf_dir):
    """S17."""
    return shown(V.archive_scan(T.detections(spark, sf_dir))["days"])


@query
def archive_scan_doy(spark, sf_dir):
    """S17."""
    return shown(V.archive_scan(T.detections(spark, sf_dir))["cell_doy"])


@query
def archive_scan_sensors(spark, sf_dir):
    """S17."""
    return shown(V.archive_scan(T.detections(spark, sf_dir))["sensors"])


def _archive_files(spark, sf_dir):
    """The record as an archive by time: files of many row groups."""
    root = scratch_path(spark, "archive")
    record = T.detections(spark, sf_dir)
    # More files for more rows, so that no task writes a share of the table that grows with it.
    files = max(4, -(-record.count() // 500_000))
    with times_with_statistics(spark):
        record.repartitionByRange(files, "time").sortWithinPartitions("time").write.option("parquet.block.size", 64 * 1024).option(
            "parquet.page.size", 16 * 1024).option("parquet.page.row.count.limit", 500).parquet(root)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(root).select("path")


@query
def year_from_row_groups(spark, sf_dir):
    """One year of an archive, from the row groups whose footers say that they may hold some of it."""
    groups = V.row_groups(_archive_files(spark, sf_dir))
    held = V.groups_between(groups, dt.datetime(1999, 1, 1), dt.datetime(1999, 12, 31, 23, 59, 59, 999999))
    return shown(V.of_year(V.read_row_groups(spark, held), 1999).select("lat", "lon", "time", "sensor", "frp"))


@query
def export_resume(spark, sf_dir):
    """What a second export run still has to write after one window is stored."""
    record = T.detections(spark, sf_dir)
    stored = R.subset(record, None, "1996-01-01", "1998-12-31")
    return shown(E.not_exported(record, stored).select("lat", "lon", "time", "sensor"))


@query
def seen_keys(spark, sf_dir):
    """U4: the union of the keys that three overlapping windows brought, the last of them twice."""
    record, path, key = T.detections(spark, sf_dir), scratch_path(spark, "keys"), ["lat", "lon", "time", "sensor"]
    for number, (start, end) in enumerate((("1995-01-01", "1996-06-30"), ("1996-01-01", "1997-12-31"), ("1997-12-01", "1998-03-31"))):
        rows = R.subset(record, None, start, end)
        for _ in range(1 + (number == 2)):
            SN.remember(SN.unseen(rows, path, key, "time", batch=number), path, key, number, "time")
    return shown(SN.seen(spark, path).select(*key))


@query
def export_manifest(spark, sf_dir):
    """S22."""
    m = E.manifest(E.pinned(T.detections(spark, sf_dir)), "1995-01-01", "2001-12-31")
    return shown(m.select("rows", "first_day", "last_day", F.array_join("sensors", ",").alias("sensors"),
                          F.array_join("dedupe", ",").alias("dedupe"), "window_from", "window_to"))


@query
def missing_windows(spark, sf_dir):
    """Per cell, five-day windows of its span in which nothing was recorded."""
    days = G.with_cell(T.detections(spark, sf_dir)).groupBy("cell", "date").agg(F.count("*").alias("n"))
    spans = days.groupBy("cell").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    windows = WN.tile(spans)
    seen = days.join(spans, "cell").select(
        "cell", F.date_add("start", (F.floor(F.date_diff("date", "start") / 5) * 5).cast("int")).alias("window_start"))
    return shown(WN.missing(windows, seen.distinct(), ["cell"]).select("cell", "window_start", "span"))


@query
def window_tiling(spark, sf_dir):
    """All windows of each source's span."""
    spans = T.detections(spark, sf_dir).groupBy("sensor").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return shown(WN.tile(spans).select("sensor", "window_start", "span"))


@query
def point_features(spark, sf_dir):
    """Every detection as a GeoJSON feature."""
    return E.point_features(T.detections(spark, sf_dir).select(
        *[X.steady_round(c, 4).alias(c) for c in ("lat", "lon", "frp")], "sensor"))


# ------------------------------------------------------------------ clusters
def _cluster_text(c: str = "cluster"):
    return F.concat_ws("|", F.date_format(f"{c}.time", "yyyy-MM-dd HH:mm:ss"),
                       F.format_string("%.4f|%.4f", F.col(f"{c}.lat"), F.col(f"{c}.lon")))


@query
def dbscan_members(spark, sf_dir):
    """Cluster and role of every clustered detection of the whole record."""
    m = C.dbscan(T.detections(spark, sf_dir).select("lat", "lon", "time", "sensor"), eps=550, min_pts=3, hours=48)
    return shown(m.select("lat", "lon", "time", "sensor", "core", _cluster_text().alias("cluster")))


@query
def cluster_summary(spark, sf_dir):
    """A19."""
    record = T.detections(spark, sf_dir).select("lat", "lon", "time", "frp", "sensor")
    s = C.cluster_summary(C.dbscan(record, eps=550, min_pts=3, hours=48))
    return shown(s.withColumn("cluster", _cluster_text()).withColumn("sensors", F.array_join("sensors", ",")))


@query
def clusters_with_hulls(spark, sf_dir):
    """The largest clusters and the corners of their hulls."""
    c = C.clusters(T.detections(spark, sf_dir), eps=550, min_pts=3, hours=48)
    corner = lambda p: F.format_string('{"lat":%.4f,"lon":%.4f}', p["lat"], p["lon"])
    hull = F.concat(F.lit("["), F.array_join(F.transform("hull", corner), ","), F.lit("]"))
    return shown(c.withColumn("cluster", _cluster_text()).withColumn("sensors", F.array_join("sensors", ","))
                 .withColumn("hull", hull), 4)


@query
def cluster_features(spark, sf_dir):
    """Clusters as GeoJSON rings and lines."""
    c = C.clusters(T.detections(spark, sf_dir), eps=550, min_pts=3, hours=48)
    return E.cluster_features(c.withColumn("frp", X.steady_round("frp", 4)))


@query
def kmeans_strata(spark, sf_dir):
    """Rows only, since the starting centres are random."""
    return shown(C.kmeans_strata(T.detections(spark, sf_dir), restarts=10))


@query
def strata_assignment(spark, sf_dir):
    """How many rows have a stratum, and how many of them stand nearer to the centre of another."""
    m = C.strata_members(T.detections(spark, sf_dir), restarts=10)
    own = F.get("gaps", F.col("prediction"))
    return m.agg(F.count("*").alias("rows"), F.count_if(own > F.array_min("gaps")).alias("misplaced"),
                 F.count_distinct("prediction").alias("strata"))


# ------------------------------------------------------------------ prior and panel
@query
def cell_doy_grid(spark, sf_dir):
    """A21."""
    return shown(P.cell_doy_counts(T.detections(spark, sf_dir)))


def _shapes(spark, sf_dir):
    return P.prior_shapes(P.cell_doy_counts(T.detections(spark, sf_dir)))


@query
def prior_shapes(spark, sf_dir):
    """A22."""
    return shown(_shapes(spark, sf_dir))


@query
def prior_for_boxes(spark, sf_dir):
    """The prior curve of each region preset, and of the whole world."""
    boxes = G.region_boxes(spark, world=True)
    return shown(P.floored_profile(P.prior_for_boxes(_shapes(spark, sf_dir), boxes)))


def _cell_days(spark, sf_dir):
    """(cell, date, sensor) counts, from which everything about the panel follows."""
    return stored(P.cell_day_counts(T.detections(spark, sf_dir)), "cell-days")


def _panel(spark, sf_dir):
    return P.panel(_cell_days(spark, sf_dir))


def _stored_panel(spark, sf_dir):
    """The panel written once and read back, for plans that fit models on it."""
    return stored(_panel(spark, sf_dir).repartition("cell"), "panel")


@query
def cell_panel(spark, sf_dir):
    """The zero-filled panel, told per cell and month."""
    monthly = _panel(spark, sf_dir).groupBy("cell", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("v").alias("total"), F.count("*").alias("days"), F.count_if(F.col("v") > 0).alias("active"))
    return shown(monthly)


@query
def serving_series(spark, sf_dir):
    """Cells the prior knows, the busiest twenty."""
    counts = _cell_days(spark, sf_dir)
    s = P.serving_series(counts, _shapes(spark, sf_dir), max_cells=20)
    return shown(s.groupBy("cell").agg(F.sum("v").alias("total"), F.count("*").alias("days")))


@query
def cell_climatology(spark, sf_dir):
    """A27, from the years before 2001 only."""
    return shown(P.climo_table(_panel(spark, sf_dir), F.year("date") < 2001))


@query
def panel_features(spark, sf_dir):
    """Training features, averaged per cell and year."""
    rows = _panel(spark, sf_dir)
    f = P.training_features(rows, P.climo_table(rows))
    names = [c for c in f.columns if c not in ("cell", "date")]
    return shown(f.groupBy("cell", F.year("date").alias("year")).agg(
        F.count("*").alias("rows"), *[F.avg(c).alias(c) for c in names]))


@query
def path_features(spark, sf_dir):
    """serving features of every cell at the scored horizons."""
    rows = _panel(spark, sf_dir)
    return shown(P.path_features(rows, P.climo_table(rows), [1, 7, 14, 30]))


@query
def coverage_seam(spark, sf_dir):
    """The record followed by 60 days of a much smaller window."""
    whole = P.totals(_panel(spark, sf_dir))
    last = whole.agg(F.max("date").alias("_last"))
    tail = F.date_diff("_last", "date") < 60
    cliff = whole.join(last, F.lit(True)).withColumn("v", F.when(tail, F.col("v") / 1000).otherwise(F.col("v")))
    kinds = cliff.select(F.lit("cliff").alias("kind"), "date", "v").unionByName(
        whole.select(F.lit("whole").alias("kind"), "date", "v"))
    return shown(P.coverage_seam(kinds, ["kind"]))


# ------------------------------------------------------------------ forecasts
@query
def forecast_prior(spark, sf_dir):
    """F1."""
    return shown(FC.seasonal_forecast(_daily(spark, sf_dir), 30))


@query
def forecast_prior_by_region(spark, sf_dir):
    """F1 with one series per preset."""
    s = Q.daily(G.in_regions(T.detections(spark, sf_dir)), ["region"])
    return shown(FC.seasonal_forecast(s, 30, ["region"]))


@query
def forecast_prior_blended(spark, sf_dir):
    """the last two years' own curve blended with the archive's."""
    record = T.detections(spark, sf_dir)
    own = Q.daily(R.subset(record, None, "2000-01-01"))
    prior = P.prior_for_boxes(_shapes(spark, sf_dir), G.region_boxes(spark, world=True).filter("region = 'world'"))
    return shown(FC.seasonal_forecast(own, 30, prior=prior))


@query
def forecast_naive(spark, sf_dir):
    """F4."""
    return shown(FC.seasonal_naive(_daily(spark, sf_dir), 30))


@query
def observed_and_forecast(spark, sf_dir):
    """U7."""
    s = _daily(spark, sf_dir)
    return shown(FC.observed_and_forecast(s, FC.seasonal_forecast(s, 30)))


def _baselines(spark, sf_dir):
    series = stored(FC.group_series(P.panel(_cell_days(spark, sf_dir))), "groups")
    return series, FC.baseline_errors(series, ["group"])


def _scores(spark, sf_dir):
    series, errors = _baselines(spark, sf_dir)
    return stored(FC.mase(errors, FC.naive_scale(series, ["group"]), ["prior", "naive"]), "scores")


@query
def backtest_paths(spark, sf_dir):
    """Every fold's origins with prior, naive and actual."""
    return shown(_baselines(spark, sf_dir)[1])


@query
def backtest_mase_baselines(spark, sf_dir):
    """A28."""
    return shown(_scores(spark, sf_dir))


@query
def spatial_fold_cells(spark, sf_dir):
    """F9."""
    return FC.spatial_folds(_panel(spark, sf_dir)).select("fold", "cell", "held_out")


def _prior_conformal(spark, sf_dir):
    """Residuals of the prior: calibrated on 2000, tested on the later 2001."""
    errors = stored(_baselines(spark, sf_dir)[1].withColumn("r", FC.log_residual("actual", "prior")), "errors")
    return FC.conformal_quantiles(errors.filter("fold = 2000")), errors.filter("fold = 2001")


@query
def conformal_quantiles(spark, sf_dir):
    """A29."""
    return shown(_prior_conformal(spark, sf_dir)[0])


@query
def conformal_coverage(spark, sf_dir):
    """A30."""
    q, test = _prior_conformal(spark, sf_dir)
    return shown(FC.empirical_coverage(test, q))


@query
def conformal_verdict(spark, sf_dir):
    """A30."""
    q, test = _prior_conformal(spark, sf_dir)
    return shown(FC.coverage_verdict(FC.empirical_coverage(test, q).filter(F.col("group") == "overall")))


@query
def forecast_band(spark, sf_dir):
    """F13."""
    q, _ = _prior_conformal(spark, sf_dir)
    return shown(FC.with_band(FC.seasonal_forecast(_daily(spark, sf_dir), 40), FC.half_widths(q, 40)))


def _verdicts(spark, sf_dir):
    return stored(FC.gate(_scores(spark, sf_dir), candidate="naive", baseline="prior"), "verdicts")


@query
def gate_verdicts(spark, sf_dir):
    """F14, judging the naive forecast against the prior."""
    return shown(_verdicts(spark, sf_dir))


@query
def gate_days(spark, sf_dir):
    """F15."""
    return shown(FC.earned_days(_verdicts(spark, sf_dir), 40))


@query
def gate_day_spans(spark, sf_dir):
    """Each scope's earned days as spans."""
    days = FC.earned_days(_verdicts(spark, sf_dir), 40).filter("earned")
    return Q.day_spans(days, "day", ["group"])


@query
def forecast_blend(spark, sf_dir):
    """Naive days where the gate grants them, the prior elsewhere."""
    s = _daily(spark, sf_dir)
    won = FC.earned_days(_verdicts(spark, sf_dir).filter(F.col("group") == "overall"), 30)
    return shown(FC.serve(FC.seasonal_forecast(s, 30), FC.seasonal_naive(s, 30), won))


@query
def forecast_model(spark, sf_dir):
    """the fitted count model's path; rows only, since the fit is iterative."""
    rows = _stored_panel(spark, sf_dir)
    climo = P.climo_table(rows)
    model = FC.fit_tweedie(P.training_features(rows, climo))
    return shown(FC.model_forecast(rows, climo, model, 30), 3)


@query
def training_panel(spark, sf_dir):
    """What a training run learns from, told by cell."""
    rows, seam = TR.training_panel(_cell_days(spark, sf_dir))
    told = rows.groupBy("cell").agg(F.count("*").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                                    F.sum("v").alias("total"))
    return shown(told.join(seam.select(F.coalesce("dropped_days", F.lit(0)).alias("dropped_days")), F.lit(True)), 3)


@query
def served_by_date(spark, sf_dir):
    """A path that began ten days before the record's last day, served by date on the days its scores earn."""
    base = FC.seasonal_forecast(_daily(spark, sf_dir), 30)
    early = base.select((F.col("h") - 10).alias("h"), F.date_sub("date", 10).alias("date"), (F.col("count") * 2.0).alias("count"))
    earned = spark.range(1, 31).select(F.col("id").cast("int").alias("day"), (F.col("id") <= 14).alias("earned"))
    return shown(FC.serve(base, early, earned))


@query
def forecast_boosted(spark, sf_dir):
    """F7 with boosted trees; rows only."""
    rows = _stored_panel(spark, sf_dir)
    climo = P.climo_table(rows)
    model, _ = FC.fit_boosted(P.training_features(rows, climo))
    return shown(FC.model_forecast(rows, climo, model, 30), 3)


@query
def backtest_mase_model(spark, sf_dir):
    """F10/A28 with the count model; rows only."""
    return shown(FC.backtest(_stored_panel(spark, sf_dir)), 4)


@query
def backtest_spatial(spark, sf_dir):
    """held-out ground; rows only."""
    return shown(FC.spatial_backtest(_stored_panel(spark, sf_dir)), 4)


@query
def conformal_model(spark, sf_dir):
    """widths of the count model and their coverage; rows only."""
    q, covered = FC.model_residuals(_stored_panel(spark, sf_dir))
    overall = covered.filter(F.col("group") == "overall").select("h", "covered")
    return shown(q.join(overall, "h", "left"), 4)


# ------------------------------------------------------------------ briefing and served forecast
@query
def briefing_rows(spark, sf_dir):
    """Q8: rows only, since the strata start from random centres."""
    parts = AN.briefing(T.detections(spark, sf_dir), z=1.0)
    return shown(parts["recommendations"])


@query
def briefing_markdown(spark, sf_dir):
    """S29."""
    parts = AN.briefing(T.detections(spark, sf_dir), z=1.0)
    return shown(AN.briefing_markdown(parts, z=1.0))


@query
def served_forecast(spark, sf_dir):
    """Q9 without a stored model: the prior blended with the archive's serves every day."""
    record = T.detections(spark, sf_dir)
    shapes = stored(_shapes(spark, sf_dir), "shapes")
    prior = {"shapes": shapes, "levels": P.prior_levels(shapes)}
    return shown(AN.forecast(record, SAMPLE_BOX, 30, prior=prior)["forecast"])


@query
def live_snapshot(spark, sf_dir):
    """Q10: the record delivered twice, cropped and counted once."""
    record = T.detections(spark, sf_dir)
    feeds = R.union_records(record, record.withColumn("src_file", F.lit("again")))
    return shown(AN.live_snapshot(feeds, SAMPLE_BOX, hours=48, crop=True)["sensors"])


@query
def region_presets(spark, sf_dir):
    """Q13: the presets with how much of the record each holds."""
    held = G.in_regions(T.detections(spark, sf_dir)).groupBy("region").agg(F.count("*").alias("n"))
    c = G.region_catalog(spark).join(held, "region", "left")
    return shown(c.select("region", "name", "biome", "feed_region", F.coalesce("n", F.lit(0)).alias("n"),
                          F.array_join(F.col("peak_months").cast("array<string>"), ",").alias("peak_months"),
                          F.size("events").alias("events")))


# ------------------------------------------------------------------ events: batch twins and streams
@query
def events_tumbling(spark, sf_dir):
    return shown(ST.tumbling(T.events(spark, sf_dir), ["event_type"], "ts", value="value"))


@query
def events_sliding(spark, sf_dir):
    return shown(ST.sliding(T.events(spark, sf_dir), ["event_type"], "ts", value="value"))


@query
def events_sessions(spark, sf_dir):
    return shown(ST.bursts(T.events(spark, sf_dir), ["user_id"], "ts", value="value"))


_REPLAYS: dict = {}


def _replay(spark, sf_dir) -> ST.Replay:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REPLAYS:
        _REPLAYS[key] = ST.replay(T.events(spark, sf_dir), "ts")
    return _REPLAYS[key]


def _drained(stream, label, last=None, column="start"):
    """The drained stream without what the closing row of the replay opened."""
    out = ST.drain(stream, label)
    return out if last is None else out.filter(F.col(column) <= F.lit(last))


@query
def events_stream_tumbling(spark, sf_dir):
    """Every day of the stream."""
    s, delay, last = _replay(spark, sf_dir)
    return shown(_drained(ST.tumbling(s, ["event_type"], "ts", value="value", delay=delay), "r3", last))


@query
def events_stream_sliding(spark, sf_dir):
    """Every week of the stream."""
    s, delay, last = _replay(spark, sf_dir)
    return shown(_drained(ST.sliding(s, ["event_type"], "ts", value="value", delay=delay), "r4", last))


@query
def events_stream_sessions(spark, sf_dir):
    """Every burst of the stream."""
    s, delay, last = _replay(spark, sf_dir)
    return shown(_drained(ST.bursts(s, ["user_id"], "ts", value="value", delay=delay), "r5", last))


@query
def events_stream_dedupe(spark, sf_dir):
    """R2: the stream delivered twice, each event once."""
    s, delay, last = _replay(spark, sf_dir)
    out = _drained(ST.dedupe_stream(s.union(s), ["event_id"], "ts", delay=delay), "r2", last, "ts")
    return shown(out.select("event_id", "user_id", "event_type", "value"))


@query
def events_stream_alerts(spark, sf_dir):
    """Days against the stored mean and spread of their type."""
    days = ST.tumbling(T.events(spark, sf_dir), ["event_type"], "ts", value="value")
    stats = stored(days.groupBy("event_type").agg(F.avg("n").alias("mu"), F.stddev_pop("n").alias("sd")), "stats")
    s, delay, last = _replay(spark, sf_dir)
    stream = ST.tumbling(s, ["event_type"], "ts", value="value", delay=delay)
    return shown(_drained(ST.alerts(stream, stats, ["event_type"], z=1.0).drop("mu", "sd"), "r6", last))


@query
def record_stream_alerts(spark, sf_dir):
    """Days of the streamed record against the days of year around them in other years, by sensor."""
    record = T.detections(spark, sf_dir).select("time", "sensor", "frp")
    days = record.groupBy("sensor", F.date_trunc("day", "time").alias("start")).agg(F.count("*").alias("n"))
    stats = stored(ST.day_statistics(days, ["sensor"]), "stats")
    s, delay, last = ST.replay(record, "time")
    stream = ST.tumbling(s, ["sensor"], "time", value="frp", delay=delay)
    out = _drained(ST.alerts_by_day_of_year(stream, stats, ["sensor"]), "r6", last)
    return shown(out.select("sensor", "start", "n", "mu", "sd", "z"))


@query
def events_stream_streaks(spark, sf_dir):
    """Streaks of days on which a user had at least three events."""
    s, delay, last = _replay(spark, sf_dir)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ST.ROCKSDB)
    try:
        return shown(_drained(ST.streaks(s, "user_id", delay=delay), "r7"))
    finally:
        spark.conf.set(name, before)


@query
def events_stream_append(spark, sf_dir):
    """The same stream appended twice leaves each event once."""
    path = scratch_path(spark, "r8-out")
    s, _, last = _replay(spark, sf_dir)
    s = s.filter(F.col("ts") <= F.lit(last)).select("event_id", "user_id", "event_type", "value")
    for _ in range(2):
        ST.append_once(s, path,
                       scratch_path(spark, "r8-marks"), ["event_id"]).awaitTermination()
    return shown(spark.read.parquet(path).drop("batch"))


# ------------------------------------------------------------------ opening archives, remaining series views
@query
def datasets_listing(spark, sf_dir):
    """Q11: the stand-in exports with their coverage notes."""
    out = AN.datasets(_files(spark, sf_dir), T.detections(spark, sf_dir))
    return shown(out.select("src_file", "bytes", "rows", "years", F.size("thin_years").alias("thin_years"), "note"))


@query
def open_record_year(spark, sf_dir):
    """Q12: one year, all of it."""
    opened = AN.open_record(T.detections(spark, sf_dir), _files(spark, sf_dir), year=1999)
    return shown(opened["record"].select("src_file", "lat", "lon", "time", "sensor"))


@query
def open_record_budget(spark, sf_dir):
    """Q12: one year under a budget, spread over the year in each file."""
    opened = AN.open_record(T.detections(spark, sf_dir), _files(spark, sf_dir), limit=600, year=1999)
    return shown(opened["record"].select("src_file", "lat", "lon", "time", "sensor"))


@query
def live_clusters(spark, sf_dir):
    """Q10: the clusters of the record delivered twice, all of them, without their hulls."""
    record = T.detections(spark, sf_dir)
    feeds = R.union_records(record, record.withColumn("src_file", F.lit("again")))
    found = AN.live_snapshot(feeds, hours=48, limit=None)["clusters"]()
    return shown(found.select("id", "total", "n", "frp", "lat", "lon", "start", "end", "duration_h"), 4)


@query
def year_lists(spark, sf_dir):
    """Each year's daily values in order, as text."""
    lists = Q.year_lists(_daily(spark, sf_dir).withColumn("count", X.steady_round("count", 2)), "count")
    return lists.select(F.col("year").cast("bigint").alias("year"),
                        F.array_join(F.transform("values", lambda v: F.format_string("%.2f", v)), ",").alias("values"))


@query
def active_runs(spark, sf_dir):
    """Runs of consecutive active days of every region preset."""
    s = Q.daily(G.in_regions(T.detections(spark, sf_dir)), ["region"])
    runs = Q.value_runs(s.withColumn("v", F.when(F.col("count") > 0, F.col("count"))), "v", ["region"])
    return shown(runs.select("region", "start", "end", "days"))


@query
def every_seventh_day(spark, sf_dir):
    """The origins of a weekly backtest over the whole calendar."""
    return shown(K.every_kth(_daily(spark, sf_dir).select("date", "count"), 7, "date"))
