"""Archives as data: inventory, coverage, budgets and bounded slices.

Nothing is sampled to save cost: coverage is exact, one aggregate over the record. Bounded
slices exist because a user asks for a slice.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.functions import scalars as X
from eventcal.operators.ranking import hour, smallest
from eventcal.operators.series import over
from eventcal.session import stored

SPREAD_STEPS_MAX = 24
THIN_SHARE = 0.25


# ------------------------------------------------------------------ inventory
def inventory(spark: SparkSession, *roots: str) -> DataFrame:
    """CSV and parquet files under the roots, each once, smallest first. No content is read."""
    frames = [spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .load(root).select("path", "length", "modificationTime") for root in roots]
    files = reduce(DataFrame.unionByName, frames).dropDuplicates(["path"])
    named = files.filter(F.lower("path").rlike(r"\.(csv|parquet)$")).select(
        F.element_at(F.split("path", "/"), -1).alias("src_file"), "path",
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.col("length").alias("bytes"), F.round(F.col("length") / 1e6).cast("bigint").alias("mb"),
        F.col("modificationTime").alias("modified"))
    return decode_names(named).orderBy("bytes", "path")


def decode_names(files: DataFrame, name: str = "src_file") -> DataFrame:
    """``fire_<kind>_<product>_<id>`` into sensor, kind, download id and label."""
    stem = F.regexp_replace(F.col(name), r"(?i)\.(csv|parquet)$", "")
    part = lambda i: F.get(F.split(stem, "_"), F.lit(i))
    kind = F.coalesce(X.lookup(S.KINDS, part(1)), part(1), F.lit("archive"))
    code = F.coalesce(part(2), F.lit(""))
    sensor = F.coalesce(X.lookup(S.PRODUCTS, code), F.when(code != "", code), F.lit("unknown sensor"))
    download = F.coalesce(part(3), F.lit(""))
    label = F.concat(sensor, F.lit(" · "), kind,
                     F.when(download != "", F.concat(F.lit(" · "), download)).otherwise(""))
    return files.withColumns({"file_sensor": sensor, "kind": kind, "download": download, "label": label})


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


# ------------------------------------------------------------------ coverage
def coverage(rows: DataFrame) -> DataFrame:
    """Per file and year the rows, the box and the 2° cells. ``rows``: src_file lat lon date.

    Cells are collected per (file, year, cell) first, so a file that holds a third of all rows
    shrinks to its cells before it meets in one task.
    """
    usable = rows.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("date").isNotNull())
    per_cell = usable.groupBy("src_file", F.year("date").alias("year"), X.cell_id().alias("cell")).agg(
        F.count("*").alias("n"), F.min("lat").alias("a"), F.max("lat").alias("b"),
        F.min("lon").alias("c"), F.max("lon").alias("d"))
    return per_cell.groupBy("src_file", "year").agg(
        F.sum("n").alias("rows"), F.min("a").alias("minlat"), F.max("b").alias("maxlat"),
        F.min("c").alias("minlon"), F.max("d").alias("maxlon"), F.count("*").alias("cells"))


def _area(minlat, maxlat, minlon, maxlon) -> Column:
    side = F.lit(S.GRID_DEG)
    return F.greatest(maxlat - minlat, side) * F.greatest(maxlon - minlon, side)


def judge_coverage(blocks: DataFrame) -> DataFrame:
    """The share of the inventory's box each file-year covers; under a quarter is thin."""
    whole = over()
    box = [F.min("minlat").over(whole), F.max("maxlat").over(whole),
           F.min("minlon").over(whole), F.max("maxlon").over(whole)]
    own = [F.col(c) for c in ("minlat", "maxlat", "minlon", "maxlon")]
    share = _area(*own) / _area(*box)
    return blocks.withColumn("area_fraction", share).withColumn("thin", F.col("area_fraction") < THIN_SHARE)


def coverage_notes(judged: DataFrame) -> DataFrame:
    """Thin years per file and the sentence that names them."""
    span = F.format_string("%d (%.0f° × %.0f°, %.1f %% of the inventory's area)", F.col("year"),
                           F.col("maxlat") - F.col("minlat"), F.col("maxlon") - F.col("minlon"),
                           F.col("area_fraction") * 100)
    thin = F.array_sort(F.collect_list(F.when(F.col("thin"), F.struct(F.col("year"), span.alias("t")))))
    notes = judged.groupBy("src_file").agg(thin.alias("_t"), F.count("*").alias("years"))
    return notes.select(
        "src_file", "years", F.transform("_t", lambda e: e["year"]).alias("thin_years"),
        F.when(F.size("_t") > 0, F.concat(F.lit("regional window: "), F.array_join(
            F.transform("_t", lambda e: e["t"]), ", "))).alias("note"))


def stale_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose (path, size, time) the stored coverage does not know."""
    return files.join(stored.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_anti")


def refresh_coverage(files: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of files that are still unchanged, plus the rows computed anew."""
    keep = known.join(files.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_semi")
    return keep.unionByName(fresh, allowMissingColumns=True)


def years_available(judged: DataFrame) -> DataFrame:
    """The years the inventory holds, with how many files, and whether one is not regional."""
    return judged.groupBy("year").agg(
        F.count("*").alias("files"), F.bool_or(~F.col("thin")).alias("global"))


def files_holding(judged: DataFrame, year: int) -> DataFrame:
    """Files to open for a year: all that cover it widely, else the regional ones."""
    held = judged.filter(F.col("year") == year)
    wide = F.bool_or(~F.col("thin")).over(over())
    return (held.withColumn("_wide", wide).filter(~F.col("thin") | ~F.col("_wide"))
            .select("src_file", (~F.col("_wide")).alias("regional_only")))


# ------------------------------------------------------------------ budgets and slices
def allocate(files: DataFrame, limit: int) -> DataFrame:
    """A row budget split in proportion to bytes, floored, at least one row each."""
    total = F.sum("bytes").over(over())
    even = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.count("*").over(over())))
    share = F.floor(F.try_divide(F.lit(limit) * F.col("bytes"), F.col("_total")))
    return (files.withColumn("_total", total).withColumn("_even", even)
            .withColumn("budget", F.when(F.col("_total") > 0, F.greatest(F.lit(1), share)).otherwise(F.col("_even"))
                        .cast("bigint"))
            .drop("_total", "_even"))


ORDER = ("time", "lat", "lon", "sensor")


def _spread(record: DataFrame, keys: list[str], budgets: DataFrame | None, limit: int | None, tie: tuple) -> DataFrame:
    """The budget's rows of each group, taken in turn from equal bins of its time span, earliest first in each.

    Bins hold different numbers of rows. In turn means that every bin gives its first row, then every one its
    second, and so on: a bin that runs out leaves its share to the others. Only counts by bin are needed to know how many
    rows each gives.
    """
    span = record.groupBy(*keys).agg(F.min(F.unix_seconds("time")).alias("_lo"), F.max(F.unix_seconds("time")).alias("_hi"))
    span = span.join(budgets, keys) if budgets is not None else span.withColumn("budget", F.lit(limit))
    span = stored(span.withColumn("_steps", F.greatest(F.lit(1), F.least(F.lit(SPREAD_STEPS_MAX), F.col("budget")))), "spans")
    joined = record.join(span, list(keys)) if keys else record.join(span, F.lit(True))
    wide = F.floor(F.try_divide((F.unix_seconds("time") - F.col("_lo")) * F.col("_steps"), F.col("_hi") - F.col("_lo")))
    tagged = joined.withColumn("step", F.least(F.coalesce(wide, F.lit(0)), F.col("_steps") - 1))
    bins = tagged.groupBy(*keys, "step", "budget").agg(F.count("*").alias("_n"))
    # Bins by size: as long as one holds no more than an equal share of what is left, it gives all. The first that holds
    # more sets the level for itself and all larger ones; shares computed after it only fall.
    by_size = over(*keys).orderBy("_n", "step")
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.count("*").over(over(*keys)) - F.row_number().over(by_size) + 1
    bins = bins.withColumn("_level", F.floor((F.col("budget") - F.col("_before")) / left))
    short = F.col("_n") > F.col("_level")
    bins = bins.withColumn("_level", F.max(F.when(short, F.col("_level"))).over(over(*keys)))
    bins = bins.withColumn("_quota", F.coalesce(F.least("_n", "_level"), "_n"))
    spare = F.col("budget") - F.sum("_quota").over(over(*keys))
    place = F.sum((F.col("_n") > F.col("_quota")).cast("int")).over(over(*keys).orderBy("step"))
    bins = bins.withColumn("_quota", F.col("_quota") + F.when((F.col("_n") > F.col("_quota")) & (place <= spare), 1).otherwise(0))
    quotas = stored(bins.filter("_quota > 0").select(*keys, "step", "_quota"), "quotas")
    order = [F.col(c) for c in (*ORDER, *tie)]
    picked = smallest(tagged.join(quotas, [*keys, "step"]), "_quota", order, hour(), [*keys, "step"])
    return picked.select(*record.columns, "step")


def spread_slice(record: DataFrame, limit: int, keys: list[str] = (), tie: tuple = ()) -> DataFrame:
    """``limit`` rows of each group spread over its time span, or all if there are fewer.

    The span is cut into 24 equal bins, or as many as there are rows to give, and these give rows in turn.
    """
    return _spread(record, list(keys), None, limit, tie)


def merge_budgeted(record: DataFrame, files: DataFrame, limit: int, tie: tuple = ()) -> DataFrame:
    """Of every file the first rows by time, as many as its share of the budget."""
    # Written, the few shares have a known size, and the record is not shuffled by file to meet them.
    shares = stored(allocate(files, limit).select("src_file", "budget"), "shares")
    tagged = record.join(shares, "src_file")
    return smallest(tagged, "budget", [F.col(c) for c in (*ORDER, *tie)], hour(), ["src_file"]).drop("rank")


def spread_merge(record: DataFrame, shares: DataFrame, tie: tuple = ()) -> DataFrame:
    """S8 per file under its own budget (src_file, budget)."""
    return _spread(record, ["src_file"], shares.select("src_file", "budget"), None, tie).select(*record.columns)


def merge_report(files: DataFrame, merged: DataFrame, limit: int) -> DataFrame:
    """What came out of each file; files that gave nothing are named."""
    took = merged.groupBy("src_file").agg(F.count("*").alias("rows_read"))
    out = allocate(files, limit).join(took, "src_file", "left")
    return out.select("src_file", "bytes", "budget", F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
                      F.col("rows_read").isNull().alias("skipped"))


def of_year(record: DataFrame, year: int) -> DataFrame:
    """A year as a range of days, which reaches the scan and skips row groups."""
    return record.filter(F.col("date").between(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))))


def open_year(record: DataFrame, judged: DataFrame, year: int) -> DataFrame:
    """The year's rows of the files chosen for it."""
    # Written, the few files have a known size, and the year's rows are not shuffled by file to meet them.
    chosen = stored(files_holding(judged, year).select("src_file"), "chosen")
    return of_year(record, year).join(chosen, "src_file", "left_semi")


# ------------------------------------------------------------------ row groups
ROW_GROUPS = "path string, row_group int, first_row long, n_rows long, lo timestamp, hi timestamp"
#: Separate stretches of time that go to the scan as a filter; beyond them only the first and last moment do.
MOST_STRETCHES = 200


def row_groups(files: DataFrame, column: str = "time") -> DataFrame:
    """Of each Parquet file in ``path`` the row groups with the least and greatest time in them, from the footers alone.

    Null times where a footer has no statistics of the column, or none that can be read (INT96).
    """
    def read(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch["path"]:
                filesystem, inner = fs.FileSystem.from_uri(path)
                with pq.ParquetFile(inner, filesystem=filesystem) as file:
                    meta, first = file.metadata, 0
                    names = file.schema_arrow.names
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        found = [group.column(i).statistics for i in range(group.num_columns) if group.column(i).path_in_schema == column]
                        stats = found[0] if found and column in names else None
                        known = stats is not None and stats.physical_type != "INT96" and stats.has_min_max
                        out.append((path, g, first, group.num_rows, *(_utc(v) for v in ((stats.min, stats.max) if known else (None, None)))))
                        first += group.num_rows
            yield pd.DataFrame(out, columns=["path", "row_group", "first_row", "n_rows", "lo", "hi"]).astype({"lo": "datetime64[us]", "hi": "datetime64[us]"})

    return files.select("path").mapInPandas(read, ROW_GROUPS)


def _utc(value):
    stamp = pd.Timestamp(value) if value is not None else pd.NaT
    return stamp.tz_convert("UTC").tz_localize(None) if stamp is not pd.NaT and stamp.tzinfo else stamp


def groups_between(groups: DataFrame, start, end) -> DataFrame:
    """The row groups that may hold a time from ``start`` to ``end``; those without statistics may."""
    return groups.filter(F.col("lo").isNull() | F.col("hi").isNull() | ((F.col("lo") <= F.lit(end)) & (F.col("hi") >= F.lit(start))))


def spread_groups(groups: DataFrame, steps: int = SPREAD_STEPS_MAX) -> DataFrame:
    """Of each file about ``steps`` row groups spread over its time, as column ``step``; all where there are no more.

    Bins of equal time give, one after another, their first group not yet taken, or any other one. A file with a group without
    statistics, or without any extent in time, gives every so-manieth group by position.
    """
    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_group").reset_index(drop=True)
        n = len(part)
        if n <= steps:
            return part.assign(step=range(n))
        lo, hi = part["lo"].min(), part["hi"].max()
        if part["lo"].isna().any() or part["hi"].isna().any() or hi <= lo:
            return part.loc[[k * n // steps for k in range(steps)]].assign(step=range(steps))
        left, chosen = list(range(n)), []
        for k in range(steps):
            start, end = lo + (hi - lo) * k / steps, lo + (hi - lo) * (k + 1) / steps
            fits = [g for g in left if part["lo"][g] <= end and part["hi"][g] >= start]
            chosen.append((fits or left)[0])
            left.remove(chosen[-1])
        return part.loc[chosen].assign(step=range(steps))

    return groups.groupBy("path").applyInPandas(pick, f"{ROW_GROUPS}, step int")


def read_row_groups(spark: SparkSession, chosen: DataFrame, column: str = "time") -> DataFrame:
    """The rows of the chosen row groups and no others; groups outside their stretches of time are not read.

    The stretches go to the scan as a filter, which skips row groups by their statistics; the number of a row in its
    file then tells exactly which rows are of a chosen group.
    """
    chosen = stored(chosen.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "first_row", "n_rows", "lo", "hi"), "rowgroups")
    paths = [r.path for r in chosen.select("path").distinct().collect()]
    if not paths:
        raise ValueError("no row group is chosen")
    by_time = Window.orderBy("lo", "hi")                     # rows of footers, not of data
    islands = chosen.withColumn("_top", F.max("hi").over(by_time.rowsBetween(Window.unboundedPreceding, -1)))
    islands = islands.withColumn("_island", F.sum(F.coalesce((F.col("lo") > F.col("_top")).cast("int"), F.lit(0))).over(by_time))
    stretches = islands.groupBy("_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("lo").limit(MOST_STRETCHES + 1).collect()
    rows = spark.read.parquet(*paths)
    columns = rows.columns
    if not chosen.filter(F.col("lo").isNull() | F.col("hi").isNull()).isEmpty():
        within = F.lit(True)                                 # nothing is known of some
    elif len(stretches) > MOST_STRETCHES:
        ends = chosen.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        within = F.col(column).between(F.lit(ends.lo), F.lit(ends.hi)) | F.col(column).isNull()
    else:
        within = reduce(Column.__or__, [F.col(column).between(F.lit(r.lo), F.lit(r.hi)) for r in stretches]) | F.col(column).isNull()
    numbered = rows.select(*columns, F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_path"),
                           F.col("_metadata.row_index").alias("_row")).filter(within)
    # Rows and groups meet in stretches of as many rows as a group has on average, so that a row meets few groups and not all of its file.
    step = F.lit(max(1, int(chosen.agg(F.avg("n_rows")).first()[0] or 1)))
    bin_of = lambda row: F.floor(row / step).cast("bigint")
    held = chosen.filter("n_rows > 0").select("path", "first_row", "n_rows", F.explode(F.sequence(
        bin_of(F.col("first_row")), bin_of(F.col("first_row") + F.col("n_rows") - 1))).alias("_bin"))
    own = ((F.col("_path") == F.col("path")) & (bin_of(F.col("_row")) == F.col("_bin")) & (F.col("_row") >= F.col("first_row"))
           & (F.col("_row") < F.col("first_row") + F.col("n_rows")))
    return numbered.join(held, own).select(*columns)


# ------------------------------------------------------------------ full scans
def archive_scan(record: DataFrame) -> dict[str, DataFrame]:
    """The reductions a training scan leaves behind, from one scan of the record.

    The scan is reduced to cells, days and sensors, and stored; the others are sums of that.
    """
    finest = stored(record.groupBy(X.cell_id().alias("cell"), "date", "sensor").agg(
        F.count("*").alias("n"), F.sum("frp").alias("frp")), "scan")
    return {
        "days": finest.groupBy("date", "sensor").agg(F.sum("n").alias("n"), F.sum("frp").alias("frp")),
        "cell_doy": finest.groupBy("cell", F.dayofyear("date").alias("doy")).agg(F.sum("n").alias("n")),
        "cell_days": finest.select("cell", "date", "sensor", "n"),
        "sensors": finest.groupBy("sensor").agg(
            F.sum("n").alias("n"), F.min("date").alias("start"), F.max("date").alias("end")),
    }
