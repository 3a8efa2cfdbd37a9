"""Record schemas and the fixed tables the analysis is defined by."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "confidence")

CONFIDENCE_CODES = {"l": 20.0, "low": 20.0, "n": 60.0, "nominal": 60.0, "h": 90.0, "high": 90.0}
CONFIDENCE_FLOOR = 30.0

SENSOR_ALIASES = {
    "MODIS": "MODIS",
    "VIIRS": "VIIRS",
    "SNPP": "VIIRS",
    "S-NPP": "VIIRS",
    "SUOMI NPP": "VIIRS",
    "NPP": "VIIRS",
    "N20": "VIIRS",
    "N21": "VIIRS",
    "NOAA-20": "VIIRS",
    "NOAA-21": "VIIRS",
}
SENSOR_FAMILIES = {
    "MODIS": ("MODIS", "MOD14", "MYD14", "TERRA", "AQUA"),
    "VIIRS": ("VIIRS", "SNPP", "SUOMI", "NPP", "N20", "N21", "NOAA-20", "NOAA-21", "JPSS"),
}
NADIR_KM2 = {"MODIS": 1.0, "VIIRS": 0.140625}
FOOTPRINT_CLIP_KM = (0.1, 20.0)

PRODUCTS = {
    "J1V-C2": "VIIRS NOAA-20",
    "J2V-C2": "VIIRS NOAA-21",
    "SV-C2": "VIIRS S-NPP",
    "M-C61": "MODIS C6.1",
    "M-C6": "MODIS C6.1",
    "ALL": "MODIS+VIIRS",
}
KINDS = {"archive": "archive", "nrt": "near-real-time"}

STRATA_KINDS = ("Forest", "Agricultural Crop Residue", "Savanna", "Mediterranean Shrubland")

FEATURES = ("doy_sin", "doy_cos", "lat", "lon", "lag_1", "lag_7", "lag_14", "lag_28",
            "roll_7", "roll_28", "climo")
LAGS = (1, 7, 14, 28)
ROLLS = (7, 28)
HORIZONS = (1, 7, 14, 30)
MODEL_SCHEMA = 1
PRIOR_SCHEMA = 1

# key, name, subtitle, (minlat, minlon, maxlat, maxlon), (lat, lon), biome, peak months, events, feed
REGIONS = (
    ("california", "California", "Western US wildfires", (32.5, -124.4, 42.0, -114.1), (37.2, -119.5),
     "Temperate forest & chaparral", (7, 8, 9, 10),
     ((2018, "Camp Fire"), (2020, "August Complex"), (2021, "Dixie Fire")),
     "North_and_Central_America"),
    ("amazon", "Amazon & Pantanal", "South America", (-18.0, -70.0, -3.0, -48.0), (-9.5, -58.5),
     "Tropical rainforest & Cerrado savanna", (8, 9, 10),
     ((2019, "Amazon surge"), (2020, "Pantanal record fires"), (2024, "drought fires")),
     "South_America"),
    ("australia", "Southeastern Australia", "Bushfire country", (-39.0, 140.0, -28.0, 153.5),
     (-34.5, 147.0), "Eucalyptus temperate & dry forest", (11, 12, 1, 2),
     ((2019, "Black Summer begins"), (2020, "Black Summer peak")),
     "Northern_and_Central_Australia"),
    ("punjab_crop", "Punjab & Haryana", "Agricultural crop residue", (29.5, 74.2, 32.5, 77.3),
     (30.9, 75.8), "Intensive agricultural cropland", (10, 11, 4, 5),
     ((2016, "stubble smog crisis"), (2021, "peak post-harvest residue")),
     "South_Asia"),
    ("mediterranean", "Mediterranean basin", "Southern Europe", (36.0, -9.5, 45.0, 28.5),
     (39.5, 15.0), "Mediterranean sclerophyll & pine forest", (6, 7, 8, 9),
     ((2021, "Greece & Turkey megafires"), (2023, "Rhodes & Attica blazes")),
     "Europe"),
)
WORLD_BOX = (-90.0, -180.0, 90.0, 180.0)

# ---------------------------------------------------------------- grid
GRID_DEG = 2.0
LAT_BINS = 90
LON_BINS = 180
DOY_BINS = 366

# ---------------------------------------------------------------- records
IDENTITY = ("lat", "lon", "time", "sensor")
GEOMETRY = ("scan", "track", "esfp", "pixel_km2")

RECORD = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("date", T.DateType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("sat", T.StringType()),
    T.StructField("conf", T.DoubleType()),
    T.StructField("frp", T.DoubleType()),
    T.StructField("bt", T.DoubleType()),
    T.StructField("scan", T.DoubleType()),
    T.StructField("track", T.DoubleType()),
    T.StructField("daynight", T.StringType()),
    T.StructField("esfp", T.DoubleType()),
    T.StructField("pixel_km2", T.DoubleType()),
])
RECORD_COLUMNS = tuple(RECORD.fieldNames())
LEAN_COLUMNS = tuple(c for c in RECORD_COLUMNS if c not in GEOMETRY)
# A frame carrying these is already a record and is not harmonised again.
RECORD_MARKERS = ("lat", "lon", "time", "date", "sensor", "conf")
