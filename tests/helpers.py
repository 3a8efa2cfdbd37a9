"""Small frames for tests."""

import datetime as dt

DAY = dt.timedelta(days=1)


def day(text):
    return dt.date.fromisoformat(text)


def days(start, end):
    d, out = day(start), []
    while d <= day(end):
        out.append(d)
        d += DAY
    return out


def series(spark, values, keys=()):
    """[(date, count)] or [(key, date, count)] as a series frame."""
    names = [f"{k} string" for k in keys]
    return spark.createDataFrame(list(values), ", ".join([*names, "date date", "count double"]))


def record(spark, rows):
    """[(lat, lon, time, sensor)] as record rows."""
    full = [(float(la), float(lo), t, t.date(), s, "A", 80.0, 1.0, 300.0, 1.0, 1.0, "D", 1.0, 1.0) for la, lo, t, s in rows]
    from eventcal.schema import RECORD

    return spark.createDataFrame(full, RECORD)
