"""Grid cells and region presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventcal import schema as S
from eventcal.functions import scalars as X

REGION_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("subtitle", T.StringType()),
    T.StructField("minlat", T.DoubleType()), T.StructField("minlon", T.DoubleType()),
    T.StructField("maxlat", T.DoubleType()), T.StructField("maxlon", T.DoubleType()),
    T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
    T.StructField("biome", T.StringType()),
    T.StructField("peak_months", T.ArrayType(T.IntegerType())),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("year", T.IntegerType()), T.StructField("note", T.StringType())]))),
    T.StructField("feed_region", T.StringType()),
])


def region_catalog(spark: SparkSession) -> DataFrame:
    """Q13: the presets as a dimension table."""
    rows = [(key, name, sub, *box, center, biome, list(months), [tuple(e) for e in events], feed)
            for key, name, sub, box, center, biome, months, events, feed in S.REGIONS]
    return spark.createDataFrame(rows, REGION_SCHEMA)


def region_boxes(spark: SparkSession, world: bool = False) -> DataFrame:
    """The presets' boxes, five fixed rows; ``world`` adds the fetch-only box of everything."""
    boxes = region_catalog(spark).select("region", "minlat", "minlon", "maxlat", "maxlon")
    if world:
        boxes = boxes.unionByName(spark.createDataFrame([("world", *S.WORLD_BOX)], boxes.schema))
    return boxes


def region_box(key: str) -> tuple | None:
    """The box a fetch target names, or None."""
    known = {row[0]: row[3] for row in S.REGIONS} | {"world": S.WORLD_BOX}
    return known.get(key)


def in_regions(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row per row and preset that holds its point; the presets are a fixed broadcast."""
    boxes = F.broadcast(region_boxes(df.sparkSession))
    inside = (F.col(lat).between(F.col("minlat"), F.col("maxlat"))
              & F.col(lon).between(F.col("minlon"), F.col("maxlon")))
    return df.join(boxes, inside).drop("minlat", "minlon", "maxlat", "maxlon")


def containing_region(boxes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The smallest preset that wholly contains each box, null where none does.

    ``boxes`` carries ``minlat minlon maxlat maxlon`` and any other columns.
    """
    own = ("minlat", "minlon", "maxlat", "maxlon")
    presets = F.broadcast(region_boxes(boxes.sparkSession).select(
        "region", *[F.col(c).alias(f"r_{c}") for c in own],
        ((F.col("maxlat") - F.col("minlat")) * (F.col("maxlon") - F.col("minlon"))).alias("r_area")))
    holds = ((F.col("minlat") >= F.col("r_minlat") - tolerance) & (F.col("minlon") >= F.col("r_minlon") - tolerance)
             & (F.col("maxlat") <= F.col("r_maxlat") + tolerance) & (F.col("maxlon") <= F.col("r_maxlon") + tolerance))
    return boxes.join(presets, holds, "left").groupBy(*boxes.columns).agg(
        F.min_by("region", F.struct("r_area", "region")).alias("region"))


def with_cell(record: DataFrame) -> DataFrame:
    return record.withColumn("cell", X.cell_id())


def cell_centres(df: DataFrame) -> DataFrame:
    return df.withColumn("cell_lat", X.cell_lat()).withColumn("cell_lon", X.cell_lon())


def cells_touched(boxes: DataFrame) -> DataFrame:
    """Every cell a box touches, edges clipped like P19."""
    low, high = X.cell_id("minlat", "minlon"), X.cell_id("maxlat", "maxlon")
    row = lambda c: F.floor(c / S.LON_BINS).cast("int")
    column = lambda c: F.pmod(c, F.lit(S.LON_BINS)).cast("int")
    return (boxes.withColumn("_row", F.explode(F.sequence(row(low), row(high))))
            .withColumn("_col", F.explode(F.sequence(column(low), column(high))))
            .withColumn("cell", (F.col("_row") * S.LON_BINS + F.col("_col")).cast("bigint"))
            .drop("_row", "_col"))


def cells_centred_in(cells: DataFrame, box: tuple) -> DataFrame:
    """P22."""
    return cells.filter(X.in_box(box, X.cell_lat(), X.cell_lon()))


def cell_density(record: DataFrame) -> DataFrame:
    """C4: detections and power per cell."""
    return with_cell(record).groupBy("cell").agg(F.count("*").alias("n"), F.sum("frp").alias("frp"))
