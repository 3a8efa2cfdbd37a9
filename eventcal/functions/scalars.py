"""Column expressions (survey P1-P34). Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcal import schema as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_headers(df: DataFrame) -> DataFrame:
    """Trimmed, lower-cased column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def lenient_double(c: str | Column) -> Column:
    """A number, or null where the text is not one. The text "nan" parses to NaN."""
    return col(c).try_cast("double")


def number_or(c: str | Column, default: float) -> Column:
    """P2 with a default for missing, unreadable and NaN."""
    return F.nanvl(F.coalesce(lenient_double(c), F.lit(default)), F.lit(default))


def lookup(table: dict, key: Column) -> Column:
    """Constant table lookup; null for a key the table does not hold."""
    rule = None
    for value in dict.fromkeys(table.values()):
        hit = key.isin(*[k for k, v in table.items() if v == value])
        rule = F.when(hit, F.lit(value)) if rule is None else rule.when(hit, F.lit(value))
    return rule


def confidence(c: str | Column) -> Column:
    """Letter code, else numeric confidence, else null (codes are never numbers)."""
    return F.coalesce(lookup(S.CONFIDENCE_CODES, F.lower(F.trim(col(c).cast("string")))), lenient_double(c))


def acquired_at(day: str | Column, hhmm: str | Column) -> Column:
    """Day plus an HHMM number; minutes of 60 and more roll into the hour."""
    clock = col(hhmm).try_cast("double")
    minutes = (clock - F.floor(clock / 100) * 40).try_cast("int")
    return F.timestamp_add("MINUTE", minutes, F.try_to_timestamp(col(day).cast("string")))


def family_of(label: Column, otherwise: Column) -> Column:
    """Family by substring of an upper-cased label; the first family in table order wins."""
    rule = None
    for family, marks in S.SENSOR_FAMILIES.items():
        hit = label.rlike("|".join(marks))
        rule = F.when(hit, F.lit(family)) if rule is None else rule.when(hit, F.lit(family))
    return rule.otherwise(otherwise)


def sensor_of(label: str | Column, default: Column | None = None) -> Column:
    """Exact alias, then family, then the label itself; a null label takes the default."""
    key = F.upper(F.trim(col(label)))
    named = F.coalesce(lookup(S.SENSOR_ALIASES, key), family_of(key, key))
    named = F.when(key != "", named)
    return named if default is None else F.coalesce(named, default)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def footprint_side(c: str | Column) -> Column:
    """One side of the footprint in km; unknown counts as one, extremes are clipped."""
    return clip(number_or(c, 1.0), *S.FOOTPRINT_CLIP_KM)


def standard_pixels(area: Column, sensor: Column) -> Column:
    """Area in units of the sensor's own nadir cell, never below one."""
    nadir = F.coalesce(lookup(S.NADIR_KM2, sensor), F.lit(1.0))
    return F.greatest(area / nadir, F.lit(1.0))


def in_box(box: tuple, lat: str | Column = "lat", lon: str | Column = "lon") -> Column:
    minlat, minlon, maxlat, maxlon = box
    return col(lat).between(minlat, maxlat) & col(lon).between(minlon, maxlon)


def parse_box(text: str | None) -> tuple | None:
    """P16: "minlat,minlon,maxlat,maxlon", ends swapped into order, range checked."""
    if not text:
        return None
    try:
        a, b, c, d = (float(x) for x in text.split(","))
    except ValueError:
        raise ValueError("box must be minlat,minlon,maxlat,maxlon (numbers)") from None
    if not (abs(a) <= 90 and abs(c) <= 90 and abs(b) <= 180 and abs(d) <= 180):
        raise ValueError("box coordinates out of range")
    return min(a, c), min(b, d), max(a, c), max(b, d)


def cell_id(lat: str | Column = "lat", lon: str | Column = "lon") -> Column:
    """2° grid cell, clipped (not wrapped) at the edges of the map."""
    row = clip(F.floor((col(lat) + 90) / S.GRID_DEG), 0, S.LAT_BINS - 1)
    column = clip(F.floor((col(lon) + 180) / S.GRID_DEG), 0, S.LON_BINS - 1)
    return (row * S.LON_BINS + column).cast("bigint")


def cell_lat(cell: str | Column = "cell") -> Column:
    """P20: latitude of the cell centre."""
    return (F.floor(col(cell) / S.LON_BINS) + 0.5) * S.GRID_DEG - 90


def cell_lon(cell: str | Column = "cell") -> Column:
    """P20: longitude of the cell centre."""
    return (F.pmod(col(cell), F.lit(S.LON_BINS)) + 0.5) * S.GRID_DEG - 180


def doy_sin(doy: Column) -> Column:
    """P24."""
    return F.sin(doy * (2 * 3.141592653589793 / 365.25))


def doy_cos(doy: Column) -> Column:
    return F.cos(doy * (2 * 3.141592653589793 / 365.25))


def days_in_month(day: str | Column) -> Column:
    """P23."""
    return F.dayofmonth(F.last_day(col(day)))


def heat_level(count: Column, peak: Column) -> Column:
    """0 for a quiet day, else 1..5 by the square root of the share of the peak."""
    top = F.greatest(peak, F.lit(1.0))
    level = 1 + F.floor(F.sqrt(count / top) * 4.99)
    return F.when(count <= 0, F.lit(0)).otherwise(F.least(F.lit(5), level)).cast("bigint")


def month_verdict(z: Column) -> Column:
    """High, low or normal by |z| > 1; no z gives no verdict."""
    return F.when(z > 1, "high").when(z < -1, "low").when(z.isNotNull(), "normal")


def swing_label(recent: Column, record: Column) -> Column:
    """Recent against record mean as a signed percentage."""
    # Rounds half towards positive infinity, as the label always has.
    pct = F.floor((recent / record - 1) * 100 + 0.5).cast("bigint")
    text = F.concat(F.when(pct > 0, "+").otherwise("−"), F.abs(pct).cast("string"), F.lit("%"))
    return F.when(recent.isNull() | record.isNull() | (record == 0), "—").otherwise(text)


def month_start(day: str | Column) -> Column:
    """P31."""
    return F.trunc(col(day), "month")


def month_end(day: str | Column) -> Column:
    """P31."""
    return F.last_day(col(day))


def steady_round(c: str | Column, digits: int = 6) -> Column:
    """Round for display with the tie point moved off exact halves.

    Sums taken in a different order differ in the last bits; an exact half would then round
    either way. Moving the tie by 1e-5 of the last digit makes the shown value reproducible.
    """
    scale = 10.0 ** digits
    # Beyond 2^53 units a double has no fraction to round; infinities and NaN stay what they are.
    fits = F.abs(col(c)) < float(2 ** 53) / scale
    return F.when(fits, F.floor(col(c) * scale + 0.50001).cast("double") / scale).otherwise(col(c).cast("double"))
