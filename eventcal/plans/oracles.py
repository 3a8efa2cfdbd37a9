"""ANSI SQL twins of the registered queries, written from the definitions for DuckDB."""

from __future__ import annotations

from eventcal.schema import REGIONS
from eventcal.sources.driver_tables import FIRST, RAW_SELECT


def r(expr: str, digits: int = 6) -> str:
    """Round with the tie point moved off exact halves (see scalars.steady_round)."""
    return (f"(CASE WHEN abs(({expr})) < {2 ** 53}e0 / 1e{digits} THEN floor(({expr}) * 1e{digits} + 0.50001) / 1e{digits} "
            f"ELSE CAST(({expr}) AS DOUBLE) END)")


RAW = RAW_SELECT.format(text="VARCHAR", first=FIRST) + " FROM lineitem"
# Harmonised rows, written out from the definitions.
HARM = f"""
SELECT src_file, latitude AS lat, longitude AS lon,
 CAST(acq_date AS TIMESTAMP) + to_minutes(CAST(floor(CAST(acq_time AS DOUBLE) / 100) * 60
      + CAST(acq_time AS DOUBLE) % 100 AS BIGINT)) AS time,
 CAST(acq_date AS DATE) AS date, sensor, satellite AS sat, conf, frp, bt, scan1 AS scan, track1 AS track,
 scan1 * track1 AS pixel_km2, greatest(scan1 * track1, nadir) / nadir AS esfp
FROM (SELECT *, CASE WHEN sensor = 'VIIRS' THEN 0.140625e0 ELSE 1e0 END AS nadir FROM (
 SELECT *, greatest(least(coalesce(scan, 1e0), 20e0), 0.1e0) AS scan1,
  greatest(least(coalesce(track, 1e0), 20e0), 0.1e0) AS track1, coalesce(bright_ti4, brightness) AS bt,
  CASE WHEN upper(trim(coalesce(instrument, CASE WHEN bright_ti4 IS NOT NULL THEN 'VIIRS' ELSE 'MODIS' END)))
       IN ('VIIRS', 'SNPP') THEN 'VIIRS' ELSE 'MODIS' END AS sensor,
  coalesce(try_cast(confidence AS DOUBLE), CASE lower(trim(confidence))
    WHEN 'l' THEN 20e0 WHEN 'low' THEN 20e0 WHEN 'n' THEN 60e0 WHEN 'nominal' THEN 60e0
    WHEN 'h' THEN 90e0 WHEN 'high' THEN 90e0 END) AS conf
 FROM ({RAW}) q) q2) q3
WHERE conf >= 30 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND bt IS NOT NULL
"""
KEPT = ("row_number() OVER (PARTITION BY lat, lon, time, sensor "
        "ORDER BY src_file, sat, conf, frp, bt, scan, track, esfp, pixel_km2)")
BASE = f"""WITH harm AS ({HARM}),
det AS (SELECT * EXCLUDE (k) FROM (SELECT *, {KEPT} AS k FROM harm) WHERE k = 1)"""


def daily_ctes(source: str = "det", keys: tuple = ()) -> str:
    """cnt, fac, obs, ser: counts, factors, observed days and the contiguous series."""
    k = "".join(f"{c}, " for c in keys)
    on = lambda a, b: " AND ".join([f"{a}.{c} = {b}.{c}" for c in keys] or ["true"])
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""
cnt AS (SELECT {k} date, sensor, count(*) AS n, sum(frp) AS frp FROM {source} GROUP BY ALL),
act AS (SELECT {k} sensor, count(*) AS active FROM cnt GROUP BY ALL),
ref AS (SELECT {k} sensor FROM (SELECT *, row_number() OVER ({part} ORDER BY active DESC, sensor) AS k FROM act) WHERE k = 1),
ovl AS (SELECT {"".join(f"s.{c}, " for c in keys)} s.sensor, r.sensor AS reference, count(m.n) AS days,
    sum(m.n) AS ref_n, sum(CASE WHEN m.n IS NOT NULL THEN s.n END) AS own_n
  FROM cnt s JOIN ref r ON {on("s", "r")}
  LEFT JOIN cnt m ON {on("s", "m")} AND m.date = s.date AND m.sensor = r.sensor GROUP BY ALL),
fac AS (SELECT {k} sensor, reference, days AS overlap_days,
    CASE WHEN sensor <> reference AND days >= 5 THEN CAST(ref_n AS DOUBLE) / own_n ELSE 1e0 END AS factor FROM ovl),
obs AS (SELECT {"".join(f"c.{c}, " for c in keys)} c.date, sum(c.n * f.factor) AS count,
    CAST(sum(c.n) AS BIGINT) AS raw, sum(c.frp) AS frp
  FROM cnt c JOIN fac f ON {on("c", "f")} AND f.sensor = c.sensor GROUP BY ALL),
span AS (SELECT {k} CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM obs
  {"GROUP BY " + ", ".join(keys) if keys else ""}),
ser AS (SELECT {"".join(f"s.{c}, " for c in keys)} s.date, coalesce(o.count, 0) AS count, coalesce(o.raw, 0) AS raw,
    coalesce(o.frp, 0) AS frp FROM span s LEFT JOIN obs o ON {on("s", "o")} AND o.date = s.date)"""


DAILY = BASE + "," + daily_ctes()


def scored(ser: str, keys: tuple = ()) -> str:
    """zs: every day against the ±7 days of year (mod 366) of all other years, by self-join."""
    on = "".join(f" AND a.{c} = b.{c}" for c in keys)
    k = "".join(f"a.{c}, " for c in keys)
    return f"""
w AS (SELECT {"".join(f"{c}, " for c in keys)} date, count AS v, year(date) AS y, dayofyear(date) AS doy FROM {ser}),
oth AS (SELECT {k} a.date, a.v, count(*) AS n, avg(b.v) AS mu, stddev_pop(b.v) AS sd
  FROM w a JOIN w b ON a.y <> b.y{on} AND (abs(a.doy - b.doy) <= 7 OR abs(a.doy - b.doy) >= 359) GROUP BY ALL),
zs AS (SELECT *, CASE WHEN n > 1 AND sd > 1e-9 THEN (v - mu) / sd END AS z FROM oth)"""


def streak_ctes(z: float, keys: tuple = ()) -> str:
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""
hot AS (SELECT *, CASE WHEN date - lag(date) OVER ({part} ORDER BY date) <= 2 THEN 0 ELSE 1 END AS opens
  FROM zs WHERE z >= {z} AND v >= 3),
isl AS (SELECT *, sum(opens) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM hot),
stk AS (SELECT {k} min(date) AS start, max(date) AS "end", count(*) AS days, round(max(z), 1) AS max_z,
  sum(v) AS total FROM isl GROUP BY {k} g)"""


def bands_sql(ser: str, keys: tuple = ()) -> str:
    k = "".join(f"{c}, " for c in keys)
    a = "".join(f"a.{c}, " for c in keys)
    on = lambda x, y: "".join(f" AND {x}.{c} = {y}.{c}" for c in keys)
    return f"""
mon AS (SELECT {k} year(date) AS y, month(date) AS m, avg(count) AS mean, count(*) AS days,
  count(*) = max(day(last_day(date))) AS f FROM {ser} GROUP BY ALL),
yrs AS (SELECT DISTINCT {k} y FROM mon),
spine AS (SELECT {"".join(f"yrs.{c}, " for c in keys)} yrs.y, g.m FROM yrs, (SELECT unnest(range(1, 13)) AS m) g),
cal AS (SELECT {"".join(f"s.{c}, " for c in keys)} s.y, s.m, mon.mean, coalesce(mon.days, 0) AS days,
  coalesce(mon.f, false) AS f FROM spine s LEFT JOIN mon ON mon.y = s.y AND mon.m = s.m{on("mon", "s")}),
st AS (SELECT {a} a.y, a.m, any_value(a.mean) AS mean, any_value(a.days) AS days, any_value(a.f) AS f,
  count(b.mean) AS n, avg(b.mean) AS om, stddev_samp(b.mean) AS sd, median(b.mean) AS med
  FROM cal a LEFT JOIN cal b ON a.m = b.m AND a.y <> b.y AND b.f{on("a", "b")} GROUP BY {a} a.y, a.m),
md AS (SELECT {a} a.y, a.m, median(abs(b.mean - a.med)) * 1.4826 AS mad
  FROM st a JOIN cal b ON a.m = b.m AND a.y <> b.y AND b.f{on("a", "b")} GROUP BY ALL),
sb AS (SELECT {"".join(f"st.{c}, " for c in keys)} st.y AS year, st.m AS month, CASE WHEN f THEN mean END AS avg, days,
  CASE WHEN n >= 2 THEN om END AS normal, CASE WHEN n >= 2 THEN greatest(om - sd, 0) END AS low,
  CASE WHEN n >= 2 THEN om + sd END AS high, CASE WHEN n >= 1 THEN med END AS normal_mad,
  CASE WHEN n >= 2 THEN greatest(med - mad, 0) WHEN n = 1 THEN med END AS low_mad,
  CASE WHEN n >= 2 THEN med + mad WHEN n = 1 THEN med END AS high_mad,
  CASE WHEN n >= 2 AND f AND sd > 1e-9 AND greatest(mean, om) >= 5 THEN (mean - om) / sd END AS z, n
  FROM st LEFT JOIN md ON md.y = st.y AND md.m = st.m{on("md", "st")})"""


def curve_ctes(source: str, value: str = "count") -> str:
    """crv: day-of-year means, linear over missing days, nearest at the ends, 15-row mean."""
    return f"""
dm AS (SELECT dayofyear(date) AS doy, avg({value}) AS v FROM {source} GROUP BY 1),
g366 AS (SELECT CAST(unnest(range(1, 367)) AS BIGINT) AS doy),
nb AS (SELECT g.doy, max(a.doy) AS lo, min(b.doy) AS hi FROM g366 g
  LEFT JOIN dm a ON a.doy <= g.doy LEFT JOIN dm b ON b.doy >= g.doy GROUP BY g.doy),
fil AS (SELECT nb.doy, CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR hi = lo THEN l.v
    ELSE l.v + (h.v - l.v) * (nb.doy - lo) / (hi - lo) END AS v
  FROM nb LEFT JOIN dm l ON l.doy = lo LEFT JOIN dm h ON h.doy = hi),
crv AS (SELECT doy, avg(v) OVER (ORDER BY doy ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM fil)"""


ROLLED = DAILY + """,
rol AS (SELECT date, count, count(*) OVER f AS k, quantile_cont(count, 0.10) OVER f AS p10,
  quantile_cont(count, 0.50) OVER f AS p50, quantile_cont(count, 0.90) OVER f AS p90,
  quantile_cont(count, 0.95) OVER f AS p95
  FROM ser WINDOW f AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
env AS (SELECT dayofyear(date) AS doy, avg(p10) AS p10, avg(p50) AS p50, avg(p90) AS p90, avg(p95) AS p95,
  avg(count) AS mean FROM rol WHERE k >= 3 GROUP BY 1)"""

PAIRED = DAILY + """,
pd AS (SELECT date, sum(CASE WHEN sensor = 'MODIS' THEN n END) AS m, sum(CASE WHEN sensor = 'VIIRS' THEN n END) AS v,
  sum(n) AS raw FROM cnt GROUP BY date),
era AS (SELECT *, sensor = 'MODIS' AS is_m FROM det WHERE year(date) <= 2001),
tot AS (SELECT count_if(is_m) AS nm, count_if(NOT is_m) AS nv,
  avg(CASE WHEN NOT is_m THEN frp END) / avg(CASE WHEN is_m THEN frp END) AS frp_ratio,
  avg(CASE WHEN NOT is_m THEN esfp END) / avg(CASE WHEN is_m THEN esfp END) AS esfp_ratio FROM era),
pr AS (SELECT CAST(m AS DOUBLE) AS m, CAST(v AS DOUBLE) AS v FROM pd
  WHERE m IS NOT NULL AND v IS NOT NULL AND year(date) <= 2001),
fit AS (SELECT count(*) AS paired_days, corr(m, v) ** 2 AS r2, sum(m) / sum(v) AS k FROM pr),
rms AS (SELECT sqrt(avg((m - fit.k * v) ** 2)) AS rmse FROM pr, fit),
cmp AS (SELECT pd.*, greatest(coalesce(m, 0), coalesce(v, 0) * round(fit.k, 3)) AS comparable FROM pd, fit)"""


CELL = ("CAST(least(greatest(floor(({lat} + 90) / 2), 0), 89) * 180"
        " + least(greatest(floor(({lon} + 180) / 2), 0), 179) AS BIGINT)")
CELL_OF = CELL.format(lat="lat", lon="lon")
REGION_VALUES = ", ".join(f"('{row[0]}', {', '.join(f'{float(v)}e0' for v in row[3])})" for row in REGIONS)
REG = f"reg AS (SELECT * FROM (VALUES {REGION_VALUES}) v(region, a, b, c, d))"


def oracle_sql() -> dict:
    q: dict[str, str] = {}
    record_cols = ("src_file, {lat} AS lat, {lon} AS lon, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, "
                   "CAST(date AS VARCHAR) AS date, sensor, sat, {conf} AS conf, {frp} AS frp, {bt} AS bt, "
                   "{scan} AS scan, {track} AS track, {esfp} AS esfp, {pixel_km2} AS pixel_km2").format(
        **{c: r(c) for c in ("lat", "lon", "conf", "frp", "bt", "scan", "track", "esfp", "pixel_km2")})
    q["harmonize_record"] = f"WITH harm AS ({HARM}) SELECT {record_cols}, '0' AS daynight FROM harm"
    q["dedupe_record"] = BASE + f" SELECT {record_cols} FROM det"
    q["ingest_csv"] = q["dedupe_record"]
    q["record_summary"] = BASE + f"""
SELECT count(*) AS n, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS "end",
 {r("min(lat)", 3)} AS minlat, {r("min(lon)", 3)} AS minlon, {r("max(lat)", 3)} AS maxlat, {r("max(lon)", 3)} AS maxlon,
 {r("sum(frp * esfp)", 3)} AS hfi, {r("sum(esfp)", 3)} AS esfp FROM det"""
    q["sensor_counts"] = BASE + " SELECT sensor, count(*) AS n FROM det GROUP BY sensor"
    q["sensor_platform_counts"] = BASE + """
SELECT sensor, sat, count(*) AS n, CAST(grouping(sensor, sat) AS BIGINT) AS level
FROM det GROUP BY ROLLUP (sensor, sat)"""
    q["file_report"] = BASE + f"""
SELECT a.src_file, a.rows, coalesce(b.kept, 0) AS kept,
 CASE WHEN b.kept > 0 THEN 'accepted' ELSE 'rejected' END AS status,
 CASE WHEN b.kept > 0 THEN NULL ELSE
  'no usable rows: every row was low-confidence, out of range or incomplete' END AS reason
FROM (SELECT src_file, count(*) AS rows FROM ({RAW}) GROUP BY 1) a
LEFT JOIN (SELECT src_file, count(*) AS kept FROM harm GROUP BY 1) b USING (src_file)"""
    q["ingest_report"] = q["file_report"]
    q["calendar_daily"] = DAILY + f"""
SELECT CAST(date AS VARCHAR) AS date, {r("count")} AS count, raw, {r("frp")} AS frp FROM ser"""
    q["sensor_factors"] = DAILY + f"""
SELECT sensor, reference, overlap_days, {r("factor")} AS factor FROM fac"""
    lvl = lambda over: ("CASE WHEN count <= 0 THEN 0 ELSE least(5, 1 + CAST(floor(sqrt(count / greatest("  # noqa: E731
                        f"max(count) OVER ({over}), 1)) * 4.99) AS BIGINT)) END")
    q["calendar_levels"] = DAILY + f"""
SELECT CAST(date AS VARCHAR) AS date, {lvl("")} AS level_record, {lvl("PARTITION BY year(date)")} AS level_year FROM ser"""
    q["calendar_year_summary"] = DAILY + f"""
SELECT year(date) AS year, {r("sum(count)")} AS total,
 CAST(arg_max(date, struct_pack(c := count, d := -epoch(date))) AS VARCHAR) AS peak_date,
 {r("max(count)")} AS peak_count, count_if(count > 0) AS active_days, count(*) AS days FROM ser GROUP BY 1"""
    q["month_bounds"] = DAILY + """
SELECT CAST(date AS VARCHAR) AS date, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS first_day,
 CAST(last_day(date) AS VARCHAR) AS last_day, day(last_day(date)) AS days_in_month, year(date) AS year,
 month(date) AS month, dayofyear(date) AS doy FROM ser"""
    q["log_level"] = DAILY + f"""
SELECT {r("avg(ln(1 + count))")} AS mu, {r("stddev_pop(ln(1 + count))")} AS sd, count(*) AS days FROM ser"""
    names = ("p10", "p50", "p90", "p95")
    q["rolling_percentiles"] = ROLLED + f"""
SELECT CAST(date AS VARCHAR) AS date, {", ".join(f"CASE WHEN k >= 3 THEN {r(c)} END AS {c}" for c in names)} FROM rol"""
    q["climatology_envelope"] = ROLLED + f"""
SELECT doy, {", ".join(f"{r(c)} AS {c}" for c in names)} FROM env WHERE doy <= 365 AND (doy - 1) % 5 = 0"""
    q["climatology_summary"] = ROLLED + f"""
SELECT (SELECT doy FROM env ORDER BY p95 DESC, doy LIMIT 1) AS peak_doy, {r("max(p95)")} AS peak_p95,
 min(CASE WHEN doy <= 365 AND p95 >= 0.5 * top THEN doy END) AS onset_doy,
 max(CASE WHEN doy <= 365 AND p95 >= 0.5 * top THEN doy END) AS cessation_doy,
 (SELECT {r("median(count)")} FROM ser) AS median_daily,
 (SELECT doy FROM env ORDER BY mean DESC, doy LIMIT 1) AS max_mean_doy
FROM env, (SELECT max(p95) AS top FROM env)"""
    q["doy_matrix"] = DAILY + f"""
SELECT dayofyear(date) AS doy, string_agg(printf('%.2f', {r("count", 2)}), ',' ORDER BY date) AS values
FROM ser GROUP BY 1"""
    q["doy_curve"] = DAILY + "," + curve_ctes("ser") + f" SELECT doy, {r('v')} AS count FROM crv"
    q["transition_calibration"] = PAIRED + f"""
SELECT least(nm, nv) AS matched, {r("frp_ratio")} AS frp_ratio, {r("esfp_ratio")} AS esfp_ratio, paired_days,
 {r("r2")} AS r2, {r("rmse")} AS rmse_daily, {r("k")} AS k FROM tot, fit, rms"""
    q["transition_yearly"] = PAIRED + f"""
SELECT year(date) AS year, CAST(coalesce(sum(m), 0) AS BIGINT) AS first_source,
 CAST(coalesce(sum(v), 0) AS BIGINT) AS second_source,
 CAST(coalesce(sum(m), 0) + coalesce(sum(v), 0) AS BIGINT) AS raw_total, {r("sum(comparable)")} AS adjusted
FROM cmp GROUP BY 1"""
    q["transition_growth"] = PAIRED + f""",
e AS (SELECT avg(CASE WHEN year(date) < 1998 THEN raw END) AS a, avg(CASE WHEN year(date) BETWEEN 1998 AND 2001 THEN raw END) AS b,
  avg(CASE WHEN year(date) < 1998 THEN comparable END) AS c,
  avg(CASE WHEN year(date) BETWEEN 1998 AND 2001 THEN comparable END) AS d FROM cmp),
f AS (SELECT count_if(year(date) < 1998) AS pre_rows, count_if(year(date) BETWEEN 1998 AND 2001) AS overlap_rows,
  avg(CASE WHEN year(date) < 1998 THEN frp END) AS x, avg(CASE WHEN year(date) BETWEEN 1998 AND 2001 THEN frp END) AS y,
  sum(frp * esfp) AS hfi, sum(esfp) AS es, count(*) AS px FROM det)
SELECT pre_rows, overlap_rows, {r("a", 4)} AS pre_mean_daily, {r("b", 4)} AS post_mean_daily, {r("x", 4)} AS pre_mean_frp,
 {r("y", 4)} AS post_mean_frp, {r("(b / a - 1) * 100", 4)} AS observed_growth_pct,
 {r("(d / c - 1) * 100", 4)} AS adjusted_growth_pct, {r("(b / a - d / c) * 100", 4)} AS artifact_pct,
 {r("b / d", 4)} AS scaling, {r("hfi", 4)} AS hfi, {r("es", 4)} AS esfp, px AS pixels FROM e, f"""
    zcols = f"CAST(date AS VARCHAR) AS date, {r('v')} AS v, {r('mu')} AS mu, {r('sd')} AS sd, {r('z')} AS z, n"
    ZS = DAILY + "," + scored("ser")
    q["zscore_doy_window"] = ZS + f" SELECT {zcols} FROM zs"
    q["zscore_boundary"] = DAILY + f""",
p AS (SELECT date, count AS v, row_number() OVER (ORDER BY date) AS i FROM ser),
off AS (SELECT CAST(unnest(range(-7, 8)) AS BIGINT) AS o),
k AS (SELECT a.date, a.v, b.v AS bv FROM p a CROSS JOIN off
  LEFT JOIN p b ON b.i = a.i - o AND o <> 0 AND year(CAST(a.date + CAST(o AS INTEGER) AS DATE)) <> year(a.date)),
oth AS (SELECT date, v, count(bv) AS n, avg(bv) AS mu, CASE WHEN count(bv) > 1 THEN stddev_pop(bv) END AS sd FROM k GROUP BY ALL),
zs AS (SELECT *, CASE WHEN n > 1 AND sd > 1e-9 THEN (v - mu) / sd END AS z FROM oth)
SELECT {zcols} FROM zs"""
    q["top_anomalies"] = ZS + f" SELECT {zcols} FROM zs WHERE z > 2 AND v >= 5 ORDER BY zs.z DESC, zs.date LIMIT 50"
    q["month_profile"] = DAILY + f""",
mm AS (SELECT month(date) AS month, avg(count) AS avg FROM ser GROUP BY 1),
th AS (SELECT avg(avg) + stddev_samp(avg) AS t FROM mm)
SELECT g.month, {r("coalesce(mm.avg, 0)")} AS avg, {r("t")} AS threshold, coalesce(mm.avg >= t, false) AS critical
FROM (SELECT CAST(unnest(range(1, 13)) AS BIGINT) AS month) g LEFT JOIN mm USING (month), th"""
    bandcols = ("year, month, {0}days, n, " + ", ".join(
        f"{r(c, 6)} AS {c}" for c in ("avg", "normal", "low", "high", "normal_mad", "low_mad", "high_mad", "z")))
    q["season_bands"] = DAILY + "," + bands_sql("ser") + f"""
SELECT {bandcols.format("")}, CASE WHEN z > 1 THEN 'high' WHEN z < -1 THEN 'low' WHEN z IS NOT NULL THEN 'normal' END AS verdict FROM sb"""
    stkcols = "CAST(start AS VARCHAR) AS start, CAST(\"end\" AS VARCHAR) AS \"end\", days, "
    q["streaks"] = ZS + "," + streak_ctes(1.0) + f" SELECT {stkcols}{r('max_z')} AS max_z, {r('total')} AS total FROM stk"
    LEAD = ZS + "," + streak_ctes(1.0) + """,
ld AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY max_z DESC, start) AS rank FROM stk) WHERE rank <= 10 AND days >= 2),
rec AS (SELECT avg(CASE WHEN date > last - 30 THEN count END) AS recent_mean, max(CASE WHEN date > last - 30 THEN count END) AS recent_max,
  avg(count) AS record_mean, count(*) AS record_days FROM ser, (SELECT max(date) AS last FROM ser))"""
    q["leading_streaks"] = LEAD + f" SELECT {stkcols}{r('max_z')} AS max_z, {r('total')} AS total, rank FROM ld"
    reccols = (f"{r('recent_mean')} AS recent_mean, {r('recent_max')} AS recent_max, {r('record_mean')} AS record_mean, record_days")
    pct = "CAST(floor((recent_mean / record_mean - 1) * 100 + 0.5) AS BIGINT)"
    q["recent_vs_record"] = LEAD + f"""
SELECT {reccols}, (CASE WHEN {pct} > 0 THEN '+' ELSE '−' END) || abs({pct}) || '%' AS swing FROM rec"""
    q["threat_level"] = LEAD + f""",
t AS (SELECT coalesce(max(max_z), 0) AS top, coalesce(sum(days), 0) AS d, count(*) AS streaks FROM ld),
s AS (SELECT *, top + 0.5 * d + least(2.0, recent_mean / 25) AS sc, streaks = 0 OR recent_mean <= 0 AS quiet FROM t, rec)
SELECT {reccols}, streaks, CASE WHEN quiet THEN 'Low' WHEN sc >= 6 THEN 'Critical' WHEN sc >= 3.5 THEN 'Elevated' ELSE 'Watch' END AS level,
 CASE WHEN quiet THEN 1 ELSE {r("sc")} END AS score FROM s"""
    ORD = ("WITH det AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, 'ORDERS' AS sensor, "
           "o_totalprice / 1000 AS frp FROM orders)," + daily_ctes("det", ("o_orderpriority",)))
    q["orders_calendar"] = ORD + f"""
SELECT o_orderpriority, CAST(date AS VARCHAR) AS date, {r("count", 4)} AS count, raw, {r("frp", 4)} AS frp FROM ser"""
    q["orders_season_bands"] = ORD + "," + bands_sql("ser", ("o_orderpriority",)) + f"""
SELECT o_orderpriority, {bandcols.format("")} FROM sb"""
    q["orders_streaks"] = (ORD + "," + scored("ser", ("o_orderpriority",)) + "," + streak_ctes(1.5, ("o_orderpriority",))
                           + f" SELECT o_orderpriority, {stkcols}{r('max_z', 4)} AS max_z, {r('total', 4)} AS total FROM stk")
    q["customer_region_daily"] = """WITH det AS (SELECT r_name, CAST(o_orderdate AS DATE) AS date, 'ORDERS' AS sensor,
 o_totalprice / 1000 AS frp FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey),""" + daily_ctes("det", ("r_name",)) + f"""
SELECT r_name, CAST(date AS VARCHAR) AS date, {r("count", 4)} AS count, raw, {r("frp", 4)} AS frp FROM ser"""
    key = f"{r('lat')} AS lat, {r('lon')} AS lon, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, sensor"
    dcols = f"CAST(date AS VARCHAR) AS date, {r('count')} AS count, raw, {r('frp')} AS frp"
    q["calendar_for_box"] = BASE + """,
box AS (SELECT * FROM det WHERE lat BETWEEN -20 AND 45 AND lon BETWEEN -130 AND 60
  AND date BETWEEN DATE '1997-03-01' AND DATE '2000-10-31'),""" + daily_ctes("box") + f" SELECT {dcols} FROM ser"
    q["points_sample"] = BASE + f"""
SELECT {r("lat", 4)} AS lat, {r("lon", 4)} AS lon, {r("frp", 4)} AS frp, sensor FROM det
WHERE lat BETWEEN -20 AND 45 AND lon BETWEEN -130 AND 60
ORDER BY md5(concat_ws('|', '0', CAST(CAST(round(det.lat * 100000) AS BIGINT) AS VARCHAR),
 CAST(CAST(round(det.lon * 100000) AS BIGINT) AS VARCHAR), strftime(det.time, '%Y-%m-%d %H:%M:%S'), det.sensor)) LIMIT 2000"""
    q["stride_sample"] = BASE + f"""
SELECT {key} FROM (SELECT *, row_number() OVER (ORDER BY time, lat, lon, sensor) AS i FROM det) WHERE (i - 1) % 5 = 0"""
    q["newest_rows"] = BASE + f"""
SELECT {key} FROM (SELECT *, row_number() OVER (ORDER BY time DESC, lat DESC, lon DESC, sensor DESC) AS i FROM det) WHERE i <= 1500"""
    q["head_slice"] = BASE + f"""
SELECT {key}, (SELECT count(*) FROM det) > 1500 AS capped
FROM (SELECT *, row_number() OVER (ORDER BY time, lat, lon, sensor) AS i FROM det) WHERE i <= 1500"""
    q["cell_density"] = BASE + f"""
SELECT cell, n, {r("frp", 4)} AS frp, (cell // 180 + 0.5) * 2 - 90 AS cell_lat, (cell % 180 + 0.5) * 2 - 180 AS cell_lon
FROM (SELECT {CELL_OF} AS cell, count(*) AS n, sum(frp) AS frp FROM det GROUP BY 1)"""
    q["calendar_by_region"] = BASE + f""",
{REG}, rdet AS (SELECT region, det.* FROM det JOIN reg ON lat BETWEEN a AND c AND lon BETWEEN b AND d),""" + daily_ctes(
        "rdet", ("region",)) + f" SELECT region, {dcols} FROM ser"
    q["region_of_cell_box"] = BASE + f""",
{REG}, cb AS (SELECT {CELL_OF} AS cell, min(lat) AS minlat, min(lon) AS minlon, max(lat) AS maxlat, max(lon) AS maxlon
  FROM det GROUP BY 1)
SELECT cell, {r("minlat")} AS minlat, {r("minlon")} AS minlon, {r("maxlat")} AS maxlat, {r("maxlon")} AS maxlon,
 (SELECT region FROM reg WHERE cb.minlat >= a - 1e-6 AND cb.minlon >= b - 1e-6 AND cb.maxlat <= c + 1e-6
   AND cb.maxlon <= d + 1e-6 ORDER BY (c - a) * (d - b), region LIMIT 1) AS region FROM cb"""
    q["region_cells"] = BASE + f""",
{REG}, cc AS (SELECT {CELL_OF} AS cell, count(*) AS n FROM det GROUP BY 1)
SELECT region, cell, n, (cell // 180 + 0.5) * 2 - 90 BETWEEN a AND c AND (cell % 180 + 0.5) * 2 - 180 BETWEEN b AND d AS centred
FROM cc JOIN reg ON cell // 180 BETWEEN floor((a + 90) / 2) AND floor((c + 90) / 2)
 AND cell % 180 BETWEEN floor((b + 180) / 2) AND floor((d + 180) / 2)"""
    FILES = BASE + f""",
rw AS ({RAW}), fl AS (SELECT src_file, CAST(sum(length(acq_date) + length(acq_time) + length(confidence) + length(satellite)) AS BIGINT) AS bytes,
  count(*) AS rows FROM rw GROUP BY 1),
bud AS (SELECT *, CAST(greatest(1, floor(4000 * bytes / sum(bytes) OVER ())) AS BIGINT) AS budget,
  bytes / sum(bytes) OVER () AS share FROM fl)"""
    q["file_names_decoded"] = FILES + """,
p AS (SELECT src_file, split_part(src_file, '_', 2) AS k, split_part(src_file, '_', 3) AS c,
  split_part(replace(src_file, '.csv', ''), '_', 4) AS download FROM fl),
n AS (SELECT src_file, download, CASE k WHEN 'nrt' THEN 'near-real-time' ELSE k END AS kind,
  CASE c WHEN 'M-C61' THEN 'MODIS C6.1' WHEN 'SV-C2' THEN 'VIIRS S-NPP' ELSE c END AS file_sensor FROM p)
SELECT *, file_sensor || ' · ' || kind || ' · ' || download AS label FROM n"""
    q["budget_allocation"] = FILES + f" SELECT src_file, bytes, rows, budget, {r('share')} AS share FROM bud"
    cov = lambda src: f""",
cv AS (SELECT src_file, year(date) AS year, count(*) AS rows, min(lat) AS minlat, max(lat) AS maxlat, min(lon) AS minlon,
  max(lon) AS maxlon, count(DISTINCT {CELL_OF}) AS cells FROM {src} GROUP BY 1, 2),
un AS (SELECT greatest(max(maxlat) - min(minlat), 2) * greatest(max(maxlon) - min(minlon), 2) AS total FROM cv),
jc AS (SELECT cv.*, greatest(maxlat - minlat, 2) * greatest(maxlon - minlon, 2) / total AS area_fraction FROM cv, un)"""  # noqa: E731
    q["coverage_by_year"] = BASE + cov("det") + f"""
SELECT src_file, year, rows, {r("minlat", 4)} AS minlat, {r("maxlat", 4)} AS maxlat, {r("minlon", 4)} AS minlon,
 {r("maxlon", 4)} AS maxlon, cells, {r("area_fraction", 4)} AS area_fraction, area_fraction < 0.25 AS thin FROM jc"""
    q["coverage_notes"] = BASE + """,
st AS (SELECT * REPLACE ('site_' || CAST(CAST(floor(lat / 40) AS BIGINT) AS VARCHAR) AS src_file) FROM det)""" + cov("st") + """
SELECT src_file, count(*) AS years, coalesce(string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FILTER (area_fraction < 0.25), '') AS thin_years,
 'regional window: ' || string_agg(printf('%d (%.0f° × %.0f°, %.1f %% of the inventory''s area)', year, maxlat - minlat,
  maxlon - minlon, area_fraction * 100), ', ' ORDER BY year) FILTER (area_fraction < 0.25) AS note FROM jc GROUP BY 1"""
    q["years_available"] = BASE + cov("det") + """
SELECT year, count(*) AS files, bool_or(area_fraction >= 0.25) AS "global" FROM jc GROUP BY 1"""
    q["open_year"] = BASE + cov("det") + f"""
SELECT src_file, count(*) AS n, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS "end",
 {r("min(lat)", 3)} AS minlat, {r("min(lon)", 3)} AS minlon, {r("max(lat)", 3)} AS maxlat, {r("max(lon)", 3)} AS maxlon,
 {r("sum(frp * esfp)", 3)} AS hfi, {r("sum(esfp)", 3)} AS esfp FROM det WHERE year(date) = 1999
 AND src_file IN (SELECT src_file FROM jc WHERE year = 1999 AND (area_fraction >= 0.25
   OR NOT EXISTS (SELECT 1 FROM jc WHERE year = 1999 AND area_fraction >= 0.25))) GROUP BY src_file"""
    q["spread_slice"] = BASE + f""",
sp AS (SELECT min(epoch(time)) AS lo, max(epoch(time)) AS hi FROM det),
bn AS (SELECT det.*, CAST(least(floor((epoch(time) - lo) * 24 / (hi - lo)), 23) AS BIGINT) AS step FROM det, sp),
rk AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY time, lat, lon, sensor) AS k FROM bn)
SELECT step, {key} FROM rk QUALIFY row_number() OVER (ORDER BY k, step) <= 4800"""
    MERGED = FILES + """,
mg AS (SELECT * FROM (SELECT det.*, budget, row_number() OVER (PARTITION BY det.src_file ORDER BY time, lat, lon, sensor) AS k
  FROM det JOIN bud ON bud.src_file = det.src_file) WHERE k <= budget)"""
    q["merge_budgeted"] = MERGED + f" SELECT src_file, {key} FROM mg"
    q["merge_report"] = MERGED + """
SELECT bud.src_file, bytes, budget, coalesce(t.n, 0) AS rows_read, t.n IS NULL AS skipped
FROM bud LEFT JOIN (SELECT src_file, count(*) AS n FROM mg GROUP BY 1) t ON t.src_file = bud.src_file"""
    q["archive_scan_cells"] = BASE + f"""
SELECT {CELL_OF} AS cell, CAST(date AS VARCHAR) AS date, sensor, count(*) AS n FROM det GROUP BY ALL"""
    q["archive_scan_days"] = BASE + f"""
SELECT CAST(date AS VARCHAR) AS date, sensor, count(*) AS n, {r("sum(frp)")} AS frp FROM det GROUP BY ALL"""
    q["archive_scan_doy"] = BASE + f" SELECT {CELL_OF} AS cell, CAST(dayofyear(date) AS BIGINT) AS doy, count(*) AS n FROM det GROUP BY ALL"
    q["archive_scan_sensors"] = BASE + """
SELECT sensor, count(*) AS n, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS "end" FROM det GROUP BY sensor"""
    q["year_from_row_groups"] = BASE + f" SELECT {key}, {r('frp')} AS frp FROM det WHERE year(date) = 1999"
    q["export_resume"] = BASE + f" SELECT {key} FROM det WHERE NOT date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
    q["seen_keys"] = BASE + f" SELECT {key} FROM det WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-03-31'"
    q["export_manifest"] = BASE + """
SELECT count(*) AS rows, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day,
 string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS sensors, 'lat,lon,time,sensor' AS dedupe,
 '1995-01-01' AS window_from, '2001-12-31' AS window_to FROM det"""
    TILES = BASE + """,
sn AS (SELECT sensor, min(date) AS s, max(date) AS e FROM det GROUP BY 1),
tl AS (SELECT sensor, CAST(unnest(generate_series(s, e, INTERVAL 5 DAY)) AS DATE) AS w, e FROM sn)"""
    q["window_tiling"] = TILES + """
SELECT sensor, CAST(w AS VARCHAR) AS window_start, least(5, e - w + 1) AS span FROM tl"""
    q["missing_windows"] = BASE + f""",
dc AS (SELECT DISTINCT {CELL_OF} AS cell, date FROM det), sn AS (SELECT cell, min(date) AS s, max(date) AS e FROM dc GROUP BY 1),
tl AS (SELECT cell, CAST(unnest(generate_series(s, e, INTERVAL 5 DAY)) AS DATE) AS w, e FROM sn)
SELECT cell, CAST(w AS VARCHAR) AS window_start, least(5, e - w + 1) AS span FROM tl
WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.cell = tl.cell AND dc.date >= tl.w AND dc.date < tl.w + 5)"""
    DBSCAN = ("WITH RECURSIVE" + BASE[len("WITH"):] + """,
m0 AS (SELECT avg(lat) AS lat0 FROM det),
pt AS (SELECT row_number() OVER (ORDER BY time, lat, lon, sensor) AS i, det.*, lon * 111320 * cos(radians(lat0)) AS x,
  lat * 110540 AS y, epoch(time) / 3600 / 48 * 550 AS t FROM det, m0),
gr AS (SELECT *, CAST(floor(x / 550) AS BIGINT) AS gx, CAST(floor(y / 550) AS BIGINT) AS gy,
  CAST(floor(t / 550) AS BIGINT) AS gt FROM pt),
o3 AS (SELECT CAST(unnest(range(-1, 2)) AS BIGINT) AS o),
ex AS (SELECT i, x, y, t, gx + a.o AS gx, gy + b.o AS gy, gt + c.o AS gt FROM gr, o3 a, o3 b, o3 c),
nbr AS (SELECT ex.i AS p, gr.i AS q FROM ex JOIN gr ON ex.gx = gr.gx AND ex.gy = gr.gy AND ex.gt = gr.gt
  AND (ex.x - gr.x) ** 2 + (ex.y - gr.y) ** 2 + (ex.t - gr.t) ** 2 <= 550 ** 2),
co AS (SELECT p AS i FROM nbr GROUP BY 1 HAVING count(*) >= 3),
ce AS (SELECT p, q FROM nbr WHERE p IN (SELECT i FROM co) AND q IN (SELECT i FROM co)),
reach AS (SELECT i AS p, i AS q FROM co UNION SELECT reach.p, ce.q FROM reach JOIN ce ON reach.q = ce.p),
lab AS (SELECT p AS i, min(q) AS root FROM reach GROUP BY 1),
fr AS (SELECT nbr.p AS i, min(lab.root) AS root FROM nbr JOIN lab ON lab.i = nbr.q
  WHERE nbr.p NOT IN (SELECT i FROM co) GROUP BY 1),
mem AS (SELECT i, root, true AS core FROM lab UNION ALL SELECT i, root, false FROM fr),
cl AS (SELECT pt.*, core, strftime(rp.time, '%Y-%m-%d %H:%M:%S') || '|' || printf('%.4f|%.4f', rp.lat, rp.lon) AS cluster,
  rp.time AS cluster_time, rp.lat AS cluster_lat, rp.lon AS cluster_lon
  FROM mem JOIN pt USING (i) JOIN pt rp ON rp.i = mem.root)""")
    q["dbscan_members"] = DBSCAN + f" SELECT {key}, core, cluster FROM cl"
    q["cluster_summary"] = DBSCAN + f"""
SELECT cluster, count(*) AS n, {r("sum(frp)")} AS frp, {r("avg(lat)")} AS lat, {r("avg(lon)")} AS lon,
 strftime(min(time), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS "end",
 string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS sensors, {r("(epoch(max(time)) - epoch(min(time))) / 3600")} AS duration_h
FROM cl GROUP BY cluster"""
    q["live_clusters"] = DBSCAN + f"""
SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min((cluster_time, cluster_lat, cluster_lon))) AS BIGINT) AS id,
 count(*) OVER () AS total, count(*) AS n, {r("sum(frp)", 4)} AS frp,
 {r("avg(lat)", 4)} AS lat, {r("avg(lon)", 4)} AS lon, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS start,
 strftime(max(time), '%Y-%m-%d %H:%M:%S') AS "end", {r("(epoch(max(time)) - epoch(min(time))) / 3600", 4)} AS duration_h
FROM cl GROUP BY cluster"""
    # Hulls: of each longitude the outermost latitudes, then both halves of a monotone chain, a point a round.
    q["clusters_with_hulls"] = DBSCAN + f""",
sm AS (SELECT cluster, count(*) AS n, sum(frp) AS frp, avg(lat) AS lat, avg(lon) AS lon, min(time) AS s, max(time) AS e,
  string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS sensors, count(*) OVER () AS total,
  row_number() OVER (ORDER BY count(*) DESC, min((cluster_time, cluster_lat, cluster_lon))) AS id FROM cl GROUP BY cluster),
tp AS (SELECT * FROM sm WHERE id <= 300),
mp AS (SELECT DISTINCT id, cl.lon, cl.lat FROM cl JOIN tp USING (cluster)),
ex2 AS (SELECT id, lon, unnest([min(lat), max(lat)]) AS lat FROM mp GROUP BY id, lon),
up AS (SELECT DISTINCT id, lon, lat FROM ex2),
sq AS (SELECT id, 0 AS d, row_number() OVER (PARTITION BY id ORDER BY lon, lat) AS r, lon, lat FROM up UNION ALL
  SELECT id, 1, row_number() OVER (PARTITION BY id ORDER BY lon DESC, lat DESC), lon, lat FROM up),
ch AS (SELECT id, d, r, [{{'lon': lon, 'lat': lat}}] AS c FROM sq WHERE r = 1 UNION ALL
  SELECT ch.id, ch.d, sq.r, list_append(list_filter(c, lambda x, i: i = 1 OR (x.lon - c[i - 1].lon) * (sq.lat - c[i - 1].lat)
    - (x.lat - c[i - 1].lat) * (sq.lon - c[i - 1].lon) > 0), {{'lon': sq.lon, 'lat': sq.lat}})
  FROM ch JOIN sq ON sq.id = ch.id AND sq.d = ch.d AND sq.r = ch.r + 1),
hf AS (SELECT id, d, arg_max(c, r) AS c, max(r) AS n FROM ch GROUP BY 1, 2),
hl AS (SELECT a.id, CASE WHEN a.n = 1 THEN a.c ELSE list_concat(a.c[:len(a.c) - 1], b.c[:len(b.c) - 1]) END AS c
  FROM hf a JOIN hf b ON a.id = b.id AND a.d = 0 AND b.d = 1),
al AS (SELECT id, list({{'lon': lon, 'lat': lat}} ORDER BY lon, lat) AS c FROM mp GROUP BY 1),
hw AS (SELECT hl.id, CASE WHEN len(hl.c) < 3 THEN al.c ELSE hl.c END AS c FROM hl JOIN al USING (id))
SELECT CAST(tp.id AS BIGINT) AS id, cluster, n, total, {r("frp", 4)} AS frp, {r("lat", 4)} AS lat, {r("lon", 4)} AS lon,
 strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS "end", sensors,
 {r("(epoch(e) - epoch(s)) / 3600", 4)} AS duration_h,
 '[' || array_to_string(list_transform(c, lambda x: printf('{{"lat":%.4f,"lon":%.4f}}', x.lat, x.lon)), ',') || ']' AS hull
FROM tp JOIN hw ON hw.id = tp.id"""
    # Numbers as the JSON writer shows doubles: below a thousandth by their exponent.
    num = lambda x: f"CASE WHEN abs({x}) < 1e-3 AND {x} <> 0 THEN printf('%.1fE-4', {x} * 1e4) ELSE CAST({x} AS VARCHAR) END"
    q["cluster_features"] = q["clusters_with_hulls"].split("SELECT CAST(tp.id")[0].rstrip() + f""",
ft AS (SELECT tp.n, {r("frp", 4)} AS frp, c, len(list_distinct(c)) AS kinds FROM tp JOIN hw ON hw.id = tp.id),
rg AS (SELECT n, frp, kinds, list_transform(CASE WHEN kinds >= 3 AND c[1] <> c[len(c)] THEN list_append(c, c[1]) ELSE c END,
  lambda x: '[' || {num("x.lon")} || ',' || {num("x.lat")} || ']') AS ring FROM ft WHERE kinds >= 3 OR len(c) > 1)
SELECT '{{"type":"Feature","properties":{{"kind":"CLUSTER","count":' || n || ',"frp":' || {num("frp")} || '}},"geometry":{{"type":"' ||
 CASE WHEN kinds >= 3 THEN 'Polygon","coordinates":[[' ELSE 'LineString","coordinates":[' END || array_to_string(ring, ',') ||
 CASE WHEN kinds >= 3 THEN ']]' ELSE ']' END || '}}}}' AS text FROM rg"""
    q["point_features"] = BASE + f""",
pf AS (SELECT sensor, {r("lat", 4)} AS lat, {r("lon", 4)} AS lon, {r("frp", 4)} AS frp FROM det)
SELECT '{{"type":"Feature","properties":{{"kind":"' || CASE WHEN sensor = 'VIIRS' THEN 'VIIRS' ELSE 'MODIS' END || '","frp":' || {num("frp")} ||
 '}},"geometry":{{"type":"Point","coordinates":[' || {num("lon")} || ',' || {num("lat")} || ']}}}}' AS text FROM pf"""
    # Every row has one of the four strata, and none stands nearer to another's centre.
    q["strata_assignment"] = BASE + " SELECT count(*) AS rows, CAST(0 AS BIGINT) AS misplaced, CAST(4 AS BIGINT) AS strata FROM det"
    q["cell_doy_grid"] = BASE + f" SELECT {CELL_OF} AS cell, dayofyear(date) AS doy, count(*) AS n FROM det GROUP BY 1, 2"
    SHAPES = DAILY + f""",
cg AS (SELECT {CELL_OF} AS cell, dayofyear(date) AS doy, count(*) AS n FROM det GROUP BY 1, 2),
shp AS (SELECT cell, doy, n * 366e0 / total AS shape, total / 366e0 AS level FROM (SELECT *, sum(n) OVER (PARTITION BY cell) AS total,
  count(*) OVER (PARTITION BY cell) AS active FROM cg) WHERE active >= 25),
{REG}, bx AS (SELECT * FROM reg UNION ALL SELECT 'world', -90, -180, 90, 180),
inb AS (SELECT region, shp.* FROM shp JOIN bx ON cell // 180 BETWEEN floor((a + 90) / 2) AND least(floor((c + 90) / 2), 89)
  AND cell % 180 BETWEEN floor((b + 180) / 2) AND least(floor((d + 180) / 2), 179)),
sz AS (SELECT region, count(*) AS cells, avg(level) AS level FROM (SELECT DISTINCT region, cell, level FROM inb) GROUP BY 1),
pr AS (SELECT sz.region, g.doy, coalesce(sum(shape), 0) / any_value(cells) AS shape, any_value(cells) AS cells, any_value(sz.level) AS level
  FROM sz CROSS JOIN (SELECT CAST(unnest(range(1, 367)) AS BIGINT) AS doy) g
  LEFT JOIN inb ON inb.region = sz.region AND inb.doy = g.doy GROUP BY 1, 2)"""
    q["prior_shapes"] = SHAPES + f" SELECT cell, doy, {r('shape')} AS shape, {r('level')} AS level FROM shp"
    q["prior_for_boxes"] = SHAPES + f" SELECT region, doy, {r('shape')} AS shape, cells, {r('level')} AS level FROM pr"
    PANEL = DAILY + f""",
cc AS (SELECT {CELL_OF} AS cell, date, sensor, count(*) AS n FROM det GROUP BY ALL),
cv AS (SELECT cell, date, sum(n * factor) AS v FROM cc JOIN fac USING (sensor) GROUP BY ALL),
kc AS (SELECT cell FROM cv WHERE v > 0 GROUP BY 1 HAVING count(*) >= 5),
cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM cv),
pan AS (SELECT kc.cell, cal.date, coalesce(cv.v, 0) AS v FROM kc CROSS JOIN cal LEFT JOIN cv ON cv.cell = kc.cell AND cv.date = cal.date)"""
    q["cell_panel"] = PANEL + f"""
SELECT cell, year(date) AS year, month(date) AS month, {r("sum(v)")} AS total, count(*) AS days, count_if(v > 0) AS active
FROM pan GROUP BY 1, 2, 3"""
    # The whole record has no seam (coverage_seam), so nothing is cut.
    q["training_panel"] = PANEL + f"""
SELECT cell, count(*) AS days, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, {r("sum(v)", 3)} AS total,
 0 AS dropped_days FROM pan GROUP BY 1"""
    q["serving_series"] = PANEL + f""",
kn AS (SELECT cell FROM (SELECT DISTINCT cell, dayofyear(date) AS d FROM cc) GROUP BY 1 HAVING count(*) >= 25)
SELECT cell, {r("sum(v)")} AS total, (SELECT count(*) FROM cal) AS days FROM cv WHERE cell IN (SELECT cell FROM kn)
GROUP BY cell ORDER BY sum(v) DESC, cell LIMIT 20"""
    q["cell_climatology"] = PANEL + f"""
SELECT cell, dayofyear(date) AS doy, {r("ln(1 + avg(v))")} AS climo FROM pan WHERE year(date) < 2001 GROUP BY 1, 2"""
    FEAT = PANEL + """,
clm AS (SELECT cell, dayofyear(date) AS doy, ln(1 + avg(v)) AS climo FROM pan GROUP BY 1, 2),
ctr AS (SELECT *, (cell // 180 + 0.5) * 2 - 90 AS lat, (cell % 180 + 0.5) * 2 - 180 AS lon FROM clm)"""
    flist = ("doy_sin", "doy_cos", "lat", "lon", "lag_1", "lag_7", "lag_14", "lag_28", "roll_7", "roll_28", "climo")
    q["panel_features"] = FEAT + f""",
lg AS (SELECT cell, date, v, row_number() OVER w AS i, dayofyear(date) AS doy,
  {", ".join(f"ln(1 + lag(v, {k}) OVER w) AS lag_{k}" for k in (1, 7, 14, 28))},
  {", ".join(f"ln(1 + avg(v) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)) AS roll_{k}" for k in (7, 28))}
  FROM pan WINDOW w AS (PARTITION BY cell ORDER BY date)),
fx AS (SELECT lg.*, sin(2 * pi() * lg.doy / 365.25) AS doy_sin, cos(2 * pi() * lg.doy / 365.25) AS doy_cos, lat, lon, climo
  FROM lg JOIN ctr ON ctr.cell = lg.cell AND ctr.doy = lg.doy WHERE i > 28)
SELECT cell, year(date) AS year, count(*) AS rows, {", ".join(f"{r(f'avg({c})')} AS {c}" for c in ("v", *flist))} FROM fx GROUP BY 1, 2"""
    q["path_features"] = FEAT + f""",
ix AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY date DESC) AS b FROM pan),
la AS (SELECT cell, max(date) AS origin, {", ".join(f"ln(1 + max(CASE WHEN b = {k} THEN v END)) AS lag_{k}" for k in (1, 7, 14, 28))},
  {", ".join(f"ln(1 + avg(CASE WHEN b <= {k} THEN v END)) AS roll_{k}" for k in (7, 28))} FROM ix GROUP BY 1),
px AS (SELECT la.*, h, CAST(origin + CAST(h AS INTEGER) AS DATE) AS target FROM la, (SELECT unnest([1, 7, 14, 30]) AS h)),
fx AS (SELECT px.*, sin(2 * pi() * dayofyear(target) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(target) / 365.25) AS doy_cos,
  lat, lon, climo FROM px JOIN ctr ON ctr.cell = px.cell AND ctr.doy = dayofyear(target))
SELECT cell, CAST(origin AS VARCHAR) AS origin, CAST(h AS BIGINT) AS h, CAST(target AS VARCHAR) AS target,
 {", ".join(f"{r(c)} AS {c}" for c in flist)} FROM fx"""
    q["coverage_seam"] = PANEL + f""",
wh AS (SELECT date, sum(v) AS v FROM pan GROUP BY 1), lt AS (SELECT max(date) AS last FROM wh),
kd AS (SELECT 'whole' AS kind, date, v FROM wh UNION ALL
  SELECT 'cliff', date, CASE WHEN date > last - 60 THEN v / 1000 ELSE v END FROM wh, lt),
ld AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY date) AS i, count(*) OVER (PARTITION BY kind) AS n,
  CASE WHEN count(*) OVER f = 30 THEN avg(v) OVER f END AS lead30 FROM kd
  WINDOW f AS (PARTITION BY kind ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
fi AS (SELECT *, last_value(lead30 IGNORE NULLS) OVER (PARTITION BY kind ORDER BY date) AS level FROM ld),
bu AS (SELECT kind, quantile_cont(level, 0.9) AS busy FROM fi GROUP BY 1),
kp AS (SELECT fi.kind, any_value(busy) AS busy, any_value(n) AS days, max(CASE WHEN level >= busy / 50 THEN i END) AS kept,
  max(CASE WHEN level >= busy / 50 THEN date END) AS keep_to, max(CASE WHEN level < busy / 50 THEN i END) AS lowest
  FROM fi JOIN bu ON bu.kind = fi.kind GROUP BY 1)
SELECT kind, days, {r("busy")} AS busy, CASE WHEN lowest = days AND days - kept >= 30 AND kept >= 180 THEN CAST(keep_to AS VARCHAR) END AS keep_to,
 CASE WHEN lowest = days AND days - kept >= 30 AND kept >= 180 THEN days - kept END AS dropped_days FROM kp"""
    FORE = DAILY + "," + curve_ctes("ser") + """,
lst AS (SELECT max(date) AS last FROM ser),
lev AS (SELECT (avg(count) + 1) / (avg(crv.v) + 1) AS scale FROM ser JOIN crv ON crv.doy = dayofyear(date), lst WHERE date > last - 30),
ah AS (SELECT CAST(unnest(range(1, 41)) AS BIGINT) AS h),
fp AS (SELECT h, CAST(last + CAST(h AS INTEGER) AS DATE) AS date, crv.v * scale AS count FROM ah, lst, lev
  JOIN crv ON crv.doy = dayofyear(CAST(last + CAST(h AS INTEGER) AS DATE))),
fn AS (SELECT h, CAST(last + CAST(h AS INTEGER) AS DATE) AS date,
  coalesce((SELECT count FROM ser WHERE ser.date = last + CAST(h AS INTEGER) - 364), 0) AS count FROM ah, lst)"""
    fcols = f"h, CAST(date AS VARCHAR) AS date, {r('count')} AS count"
    q["forecast_prior"] = FORE + f" SELECT {fcols} FROM fp WHERE h <= 30"
    q["forecast_naive"] = FORE + f" SELECT {fcols} FROM fn WHERE h <= 30"
    # The model's path is the prior's doubled and begun ten days earlier: on a date it has the value of ten days on.
    q["served_by_date"] = FORE + f"""
SELECT a.h, CAST(a.date AS VARCHAR) AS date, {r("CASE WHEN a.h <= 14 THEN b.count * 2 ELSE a.count END")} AS count,
 CASE WHEN a.h <= 14 THEN 'model' ELSE 'prior' END AS method
FROM fp a LEFT JOIN fp b ON b.h = a.h + 10 WHERE a.h <= 30"""
    q["observed_and_forecast"] = FORE + f"""
SELECT CAST(date AS VARCHAR) AS date, {r("count")} AS count, 'observed' AS kind FROM ser, lst WHERE date > last - 365
UNION ALL SELECT CAST(date AS VARCHAR), {r("count")}, 'forecast' FROM fp WHERE h <= 30"""
    q["forecast_prior_by_region"] = BASE + f""",
{REG}, rdet AS (SELECT region, det.* FROM det JOIN reg ON lat BETWEEN a AND c AND lon BETWEEN b AND d),""" + daily_ctes(
        "rdet", ("region",)) + f""",
dmr AS (SELECT region, dayofyear(date) AS doy, avg(count) AS v FROM ser GROUP BY 1, 2),
crr AS (SELECT region, doy, avg(v) OVER (PARTITION BY region ORDER BY doy ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM dmr),
lst AS (SELECT region, max(date) AS last FROM ser GROUP BY 1),
lev AS (SELECT ser.region, (avg(count) + 1) / (avg(crr.v) + 1) AS scale FROM ser JOIN lst ON lst.region = ser.region
  JOIN crr ON crr.region = ser.region AND crr.doy = dayofyear(date) WHERE date > last - 30 GROUP BY 1),
ah AS (SELECT CAST(unnest(range(1, 31)) AS BIGINT) AS h),
fr AS (SELECT lst.region, h, CAST(last + CAST(h AS INTEGER) AS DATE) AS date FROM lst, ah)
SELECT fr.region, h, CAST(date AS VARCHAR) AS date, {r("crr.v * scale")} AS count FROM fr JOIN lev ON lev.region = fr.region
JOIN crr ON crr.region = fr.region AND crr.doy = dayofyear(date)"""
    q["forecast_prior_blended"] = SHAPES.replace(DAILY, BASE) + """,
d2 AS (SELECT * FROM det WHERE date >= DATE '2000-01-01'),""" + daily_ctes("d2") + f""",
ow AS (SELECT dayofyear(date) AS doy, avg(count) AS v FROM ser GROUP BY 1),
al AS (SELECT least(1.0, count(DISTINCT year(date)) / 3e0) AS alpha FROM ser),
bl AS (SELECT pr.doy, exp(alpha * ln(1 + coalesce(ow.v, shape)) + (1 - alpha) * ln(1 + shape)) - 1 AS v
  FROM pr LEFT JOIN ow ON ow.doy = pr.doy, al WHERE region = 'world'),
crv AS (SELECT doy, avg(v) OVER (ORDER BY doy ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM bl),
lst AS (SELECT max(date) AS last FROM ser),
lev AS (SELECT (avg(count) + 1) / (avg(crv.v) + 1) AS scale FROM ser JOIN crv ON crv.doy = dayofyear(date), lst WHERE date > last - 30),
ah AS (SELECT CAST(unnest(range(1, 31)) AS BIGINT) AS h),
fp AS (SELECT h, CAST(last + CAST(h AS INTEGER) AS DATE) AS date, crv.v * scale AS count FROM ah, lst, lev
  JOIN crv ON crv.doy = dayofyear(CAST(last + CAST(h AS INTEGER) AS DATE)))
SELECT {fcols} FROM fp"""
    GROUPS = f""",
{REG}, gp AS (SELECT DISTINCT cell, 'overall' AS g FROM pan UNION ALL
  SELECT cell, region FROM (SELECT DISTINCT cell FROM pan) JOIN reg ON (cell // 180 + 0.5) * 2 - 90 BETWEEN a AND c
  AND (cell % 180 + 0.5) * 2 - 180 BETWEEN b AND d),
gs AS (SELECT g, date, sum(v) AS v FROM pan JOIN gp USING (cell) GROUP BY 1, 2),
yr AS (SELECT DISTINCT year(date) AS fold FROM gs),
fm AS (SELECT g, fold, dayofyear(date) AS doy, avg(v) AS c FROM gs, yr WHERE year(date) <> fold GROUP BY ALL),
fc AS (SELECT g, fold, doy, avg(c) OVER (PARTITION BY g, fold ORDER BY doy ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS c FROM fm),
ps AS (SELECT g, date, v, row_number() OVER (PARTITION BY g ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
  row_number() OVER (PARTITION BY g, year(date) ORDER BY date) - 1 AS k FROM gs),
og AS (SELECT g, date, pos, year(date) AS fold FROM ps WHERE k % 7 = 0 AND pos >= 30 AND pos + 30 <= n),
sc AS (SELECT og.g, og.pos, any_value(og.date) AS origin, any_value(og.fold) AS fold, (avg(b.v) + 1) / (avg(fc.c) + 1) AS scale FROM og
  JOIN ps b ON b.g = og.g AND b.pos BETWEEN og.pos - 30 AND og.pos - 1
  JOIN fc ON fc.g = og.g AND fc.fold = og.fold AND fc.doy = dayofyear(b.date) GROUP BY 1, 2),
er AS (SELECT sc.g AS "group", sc.fold, sc.origin, CAST(h AS BIGINT) AS h, t.v AS actual, fc.c * scale AS prior, coalesce(nv.v, 0) AS naive
  FROM sc CROSS JOIN (SELECT unnest([1, 7, 14, 30]) AS h) JOIN ps t ON t.g = sc.g AND t.pos = sc.pos + h - 1
  JOIN fc ON fc.g = sc.g AND fc.fold = sc.fold AND fc.doy = dayofyear(t.date)
  LEFT JOIN ps nv ON nv.g = sc.g AND nv.date = t.date - 364),
df AS (SELECT g, date, abs(v - lag(v) OVER (PARTITION BY g ORDER BY date)) AS d, min(year(date)) OVER () AS y0 FROM gs),
ns AS (SELECT g, greatest(avg(d), 1e-9) AS scale FROM df WHERE year(date) <> y0 GROUP BY 1),
ms AS (SELECT "group", h, avg(abs(prior - actual)) / any_value(scale) AS prior, avg(abs(naive - actual)) / any_value(scale) AS naive,
  count(*) AS n FROM er JOIN ns ON ns.g = er."group" GROUP BY 1, 2),
gt AS (SELECT o."group", o.h, o.naive < o.prior AS serve, o."group" AS scope FROM ms o),
dy AS (SELECT CAST(unnest(range(1, 41)) AS BIGINT) AS day),
ed AS (SELECT s."group", day, coalesce((SELECT serve FROM gt WHERE gt."group" = s."group" AND gt.h >= day ORDER BY gt.h LIMIT 1), false) AS earned
  FROM (SELECT DISTINCT "group" FROM gt) s, dy),
rs AS (SELECT *, abs(ln(1 + actual) - ln(1 + greatest(prior, 0))) AS r FROM er),
cq AS (SELECT h, list_sort(list(r))[least(CAST(ceil((count(*) + 1) * 0.9) AS BIGINT), count(*))] AS q, count(*) AS n FROM rs WHERE fold = 2000 GROUP BY 1),
ec AS (SELECT "group", rs.h, avg(CASE WHEN r <= q THEN 1.0 ELSE 0.0 END) AS covered, count(*) AS n FROM rs JOIN cq ON cq.h = rs.h
  WHERE fold = 2001 GROUP BY 1, 2)"""
    BT = PANEL + GROUPS
    q["backtest_paths"] = BT + f"""
SELECT "group", fold, CAST(origin AS VARCHAR) AS origin, h, {r("actual")} AS actual, {r("prior")} AS prior, {r("naive")} AS naive FROM er"""
    q["backtest_mase_baselines"] = BT + f""" SELECT "group", h, {r("prior")} AS prior, {r("naive")} AS naive, n FROM ms"""
    q["spatial_fold_cells"] = PANEL + f""",
{REG}, pc AS (SELECT DISTINCT cell, (cell // 180 + 0.5) * 2 - 90 AS la, (cell % 180 + 0.5) * 2 - 180 AS lo FROM pan),
fa AS (SELECT region AS fold, cell FROM pc JOIN reg ON la BETWEEN a AND c AND lo BETWEEN b AND d),
fb AS (SELECT CAST(CAST(floor((la + 90) / 30) * 1000 + floor((lo + 180) / 30) AS BIGINT) AS VARCHAR) AS fold, cell FROM pc),
nm AS (SELECT count(DISTINCT fold) AS k FROM fa),
al AS (SELECT * FROM fa WHERE (SELECT k FROM nm) >= 2 UNION ALL SELECT * FROM fb WHERE (SELECT k FROM nm) < 2)
SELECT fold, cell, count(*) OVER (PARTITION BY fold) AS held_out FROM al"""
    q["conformal_quantiles"] = BT + f" SELECT h, {r('q')} AS q, n FROM cq"
    q["conformal_coverage"] = BT + f""" SELECT "group", h, {r("covered")} AS covered, n FROM ec"""
    q["conformal_verdict"] = BT + f"""
SELECT {r("max(abs(covered - 0.9))")} AS max_deviation, max(abs(covered - 0.9)) <= 0.05 + 1e-9 AS within_tolerance
FROM ec WHERE "group" = 'overall'"""
    q["gate_verdicts"] = BT + """ SELECT "group", h, serve, scope FROM gt"""
    q["gate_days"] = BT + """ SELECT "group", day, earned FROM ed"""
    q["gate_day_spans"] = BT + """,
gi AS (SELECT "group", day, day - row_number() OVER (PARTITION BY "group" ORDER BY day) AS g FROM ed WHERE earned),
sp AS (SELECT "group", min(day) AS a, max(day) AS b FROM gi GROUP BY "group", g)
SELECT "group", string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ' · ' ORDER BY a) AS spans FROM sp GROUP BY 1"""
    both = FORE + PANEL[len(DAILY):] + GROUPS
    q["forecast_band"] = both + f""",
wd AS (SELECT ah.h, coalesce(cq.q, (SELECT q FROM cq ORDER BY h DESC LIMIT 1)) AS w FROM ah LEFT JOIN cq ON cq.h = ah.h)
SELECT fp.h, CAST(date AS VARCHAR) AS date, {r("count")} AS count, {r("exp(greatest(ln(1 + greatest(count, 0)) - w, 0)) - 1")} AS lower,
 {r("exp(ln(1 + greatest(count, 0)) + w) - 1")} AS upper FROM fp JOIN wd ON wd.h = fp.h"""
    q["forecast_blend"] = both + f"""
SELECT fp.h, CAST(fp.date AS VARCHAR) AS date, {r("CASE WHEN earned THEN fn.count ELSE fp.count END")} AS count,
 CASE WHEN earned THEN 'model' ELSE 'prior' END AS method
FROM fp JOIN fn ON fn.h = fp.h JOIN ed ON ed.day = fp.h AND ed."group" = 'overall' WHERE fp.h <= 30"""
    q["live_snapshot"] = BASE + """
SELECT sensor, count(*) AS n FROM det WHERE lat BETWEEN -20 AND 45 AND lon BETWEEN -130 AND 60 GROUP BY 1"""
    catalog = ", ".join("({})".format(", ".join("'{}'".format(str(v)) for v in (
        row[0], row[1], row[5], row[8], ",".join(map(str, row[6]))))) + "" for row in REGIONS)
    sizes = " ".join(f"WHEN '{row[0]}' THEN {len(row[7])}" for row in REGIONS)
    q["region_presets"] = BASE + f""",
{REG}, ct AS (SELECT * FROM (VALUES {catalog}) v(region, name, biome, feed_region, peak_months)),
hd AS (SELECT region, count(*) AS n FROM det JOIN reg ON lat BETWEEN a AND c AND lon BETWEEN b AND d GROUP BY 1)
SELECT ct.*, coalesce(n, 0) AS n, CASE ct.region {sizes} END AS events FROM ct LEFT JOIN hd ON hd.region = ct.region"""
    boxed = SHAPES.replace(DAILY, BASE).replace("'world', -90, -180, 90, 180", "'world', -20, -130, 45, 60")
    q["served_forecast"] = boxed + """,
d2 AS (SELECT * FROM det WHERE lat BETWEEN -20 AND 45 AND lon BETWEEN -130 AND 60),""" + daily_ctes("d2") + f""",
ow AS (SELECT dayofyear(date) AS doy, avg(count) AS v FROM ser GROUP BY 1),
al AS (SELECT least(1.0, count(DISTINCT year(date)) / 3e0) AS alpha FROM ser),
bl AS (SELECT pr.doy, exp(alpha * ln(1 + coalesce(ow.v, shape)) + (1 - alpha) * ln(1 + shape)) - 1 AS v
  FROM pr LEFT JOIN ow ON ow.doy = pr.doy, al WHERE region = 'world'),
crv AS (SELECT doy, avg(v) OVER (ORDER BY doy ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM bl),
lst AS (SELECT max(date) AS last FROM ser),
lev AS (SELECT (avg(count) + 1) / (avg(crv.v) + 1) AS scale FROM ser JOIN crv ON crv.doy = dayofyear(date), lst WHERE date > last - 30),
ah AS (SELECT CAST(unnest(range(1, 31)) AS BIGINT) AS h),
fp AS (SELECT h, CAST(last + CAST(h AS INTEGER) AS DATE) AS date, crv.v * scale AS count FROM ah, lst, lev
  JOIN crv ON crv.doy = dayofyear(CAST(last + CAST(h AS INTEGER) AS DATE)))
SELECT {fcols}, 'prior' AS method FROM fp"""
    at = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    wcols = f"{at('s')} AS start, {at('e')} AS \"end\", {{0}}, count(*) AS n, {r('sum(value)')} AS total"
    TUM = "WITH w AS (SELECT *, date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS e FROM events)"
    q["events_tumbling"] = TUM + f" SELECT {wcols.format('event_type')} FROM w GROUP BY s, e, event_type"
    q["events_stream_tumbling"] = TUM + f" SELECT {wcols.format('event_type')} FROM w GROUP BY s, e, event_type"
    SLI = """WITH w AS (SELECT events.*, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS s,
 date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) + INTERVAL 7 DAY AS e FROM events, (SELECT unnest(range(0, 7)) AS k))"""
    q["events_sliding"] = SLI + f" SELECT {wcols.format('event_type')} FROM w GROUP BY s, e, event_type"
    q["events_stream_sliding"] = SLI + f" SELECT {wcols.format('event_type')} FROM w GROUP BY s, e, event_type"
    SES = """WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
 g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o),
 w AS (SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 12 HOUR AS e, count(*) AS n, sum(value) AS total FROM g GROUP BY user_id, g)"""
    scols = f"{at('s')} AS start, {at('e')} AS \"end\", user_id, n, {r('total')} AS total"
    q["events_sessions"] = SES + f" SELECT {scols} FROM w"
    q["events_stream_sessions"] = SES + f" SELECT {scols} FROM w"
    ev = f"SELECT event_id, user_id, event_type, {r('value')} AS value FROM events"
    q["events_stream_dedupe"] = q["events_stream_append"] = ev
    q["events_stream_alerts"] = TUM + f""",
d AS (SELECT s, e, event_type, count(*) AS n, sum(value) AS total FROM w GROUP BY 1, 2, 3),
st AS (SELECT event_type, avg(n) AS mu, stddev_pop(n) AS sd FROM d GROUP BY 1)
SELECT {at('s')} AS start, {at('e')} AS "end", d.event_type, n, {r("total")} AS total, {r("(n - mu) / sd")} AS z
FROM d JOIN st ON st.event_type = d.event_type WHERE (n - mu) / sd >= 1"""
    q["record_stream_alerts"] = BASE + f""",
d AS (SELECT sensor, date, count(*) AS n FROM det GROUP BY 1, 2),
o AS (SELECT unnest(range(-7, 8)) AS o),
sp AS (SELECT sensor, (dayofyear(date) - 1 + o + 366) % 366 + 1 AS doy, year(date) AS y, n FROM d, o),
zz AS (SELECT d.sensor, d.date, d.n, count(*) AS k, avg(sp.n) AS mu, stddev_pop(sp.n) AS sd
  FROM d JOIN sp ON sp.sensor = d.sensor AND sp.doy = dayofyear(d.date) AND sp.y <> year(d.date) GROUP BY 1, 2, 3)
SELECT sensor, strftime(date, '%Y-%m-%d %H:%M:%S') AS start, n, {r("mu")} AS mu, {r("sd")} AS sd, {r("(n - mu) / sd")} AS z
FROM zz WHERE k > 1 AND sd > 1e-9 AND (n - mu) / sd >= 2"""
    q["events_stream_streaks"] = TUM + f""",
d AS (SELECT user_id, CAST(s AS DATE) AS d, count(*) AS v FROM w GROUP BY 1, 2 HAVING count(*) >= 3),
o AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY user_id ORDER BY d) <= 2 THEN 0 ELSE 1 END AS opens FROM d),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS g FROM o),
k AS (SELECT user_id, g, min(d) AS a, max(d) AS b, count(*) AS days, CAST(sum(v) AS DOUBLE) AS total,
  lead(min(d)) OVER (PARTITION BY user_id ORDER BY g) AS nxt FROM g GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS "key", CAST(a AS VARCHAR) AS start, CAST(b AS VARCHAR) AS "end", days, total
FROM k"""
    q["datasets_listing"] = FILES + cov("det") + """,
nt AS (SELECT src_file, count(*) AS years, count_if(area_fraction < 0.25) AS thin_years,
 'regional window: ' || string_agg(printf('%d (%.0f° × %.0f°, %.1f %% of the inventory''s area)', year, maxlat - minlat,
  maxlon - minlon, area_fraction * 100), ', ' ORDER BY year) FILTER (area_fraction < 0.25) AS note FROM jc GROUP BY 1)
SELECT fl.src_file, bytes, rows, years, thin_years, note FROM fl LEFT JOIN nt ON nt.src_file = fl.src_file"""
    q["open_record_year"] = FILES + cov("det") + f""",
ch AS (SELECT src_file FROM jc WHERE year = 1999 AND (area_fraction >= 0.25
  OR NOT EXISTS (SELECT 1 FROM jc WHERE year = 1999 AND area_fraction >= 0.25))),
yr AS (SELECT det.* FROM det JOIN ch ON ch.src_file = det.src_file WHERE year(date) = 1999)"""
    q["open_record_budget"] = q["open_record_year"] + f""",
sh AS (SELECT src_file, CAST(greatest(1, floor(600 * bytes / sum(bytes) OVER ())) AS BIGINT) AS quota FROM fl WHERE src_file IN (SELECT src_file FROM ch)),
sp AS (SELECT yr.src_file, quota, least(quota, 24) AS steps, min(epoch(time)) AS lo, max(epoch(time)) AS hi
  FROM yr JOIN sh ON sh.src_file = yr.src_file GROUP BY ALL),
bn AS (SELECT yr.*, quota, CASE WHEN hi = lo THEN 0 ELSE least(floor((epoch(time) - lo) * steps / (hi - lo)), steps - 1) END AS step
  FROM yr JOIN sp ON sp.src_file = yr.src_file),
rk AS (SELECT *, row_number() OVER (PARTITION BY src_file, step ORDER BY time, lat, lon, sensor) AS k FROM bn)
SELECT src_file, {key} FROM rk QUALIFY row_number() OVER (PARTITION BY src_file ORDER BY k, step) <= quota"""
    q["open_record_year"] += f" SELECT src_file, {key} FROM yr"
    q["year_lists"] = DAILY + f"""
SELECT year(date) AS year, string_agg(printf('%.2f', {r("count", 2)}), ',' ORDER BY date) AS values FROM ser GROUP BY 1"""
    q["active_runs"] = BASE + f""",
{REG}, rdet AS (SELECT region, det.* FROM det JOIN reg ON lat BETWEEN a AND c AND lon BETWEEN b AND d),""" + daily_ctes(
        "rdet", ("region",)) + """,
ac AS (SELECT region, date, date - CAST(row_number() OVER (PARTITION BY region ORDER BY date) AS INTEGER) AS g FROM ser WHERE count > 0)
SELECT region, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS "end", count(*) AS days FROM ac GROUP BY region, g"""
    q["every_seventh_day"] = DAILY + f"""
SELECT CAST(date AS VARCHAR) AS date, {r("count")} AS count FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM ser) WHERE i % 7 = 0"""
    return q
