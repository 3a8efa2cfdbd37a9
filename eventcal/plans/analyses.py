"""The user-visible analyses (Q1-Q13): parameters in, frames out.

Every analysis answers with a dict of frames. A record too short to answer gives frames of the
same schema without rows and a ``status`` frame that says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.functions import scalars as X
from eventcal.operators import anomalies as A
from eventcal.operators import clusters as C
from eventcal.operators import diagnostic as D
from eventcal.operators import forecast as FC
from eventcal.operators import panel as P
from eventcal.operators import ranking as K
from eventcal.operators import record as R
from eventcal.operators import series as Q
from eventcal.operators import spatial as G
from eventcal.session import stored
from eventcal.sources import archive as V


def _clamp(v, low, high):
    return min(max(v, low), high)


def status(series: DataFrame, need: int, note: str, keys: list[str] = ()) -> DataFrame:
    """One row per series: its days and, where they are too few, the note."""
    if keys:
        sized = series.groupBy(*keys).agg(F.count("*").alias("days"))
    else:
        sized = series.agg(F.count("*").alias("days"))
    return sized.withColumn("note", F.when(F.col("days") < need, F.lit(note)))


def _series(record, box, start=None, end=None) -> DataFrame:
    return stored(Q.daily(R.subset(record, box, start, end)), "daily")


def empty_record(spark) -> DataFrame:
    """A cleared record: no rows, every type."""
    return spark.createDataFrame([], S.RECORD)


def record_summary(record: DataFrame) -> dict:
    """Q1."""
    return {"summary": R.summary(record), "sensors": R.sensor_counts(record)}


def datasets(files: DataFrame, record: DataFrame) -> DataFrame:
    """Q11: the inventory, smallest first, with each file's years and the note on thin ones."""
    judged = V.judge_coverage(V.coverage(record))
    return files.join(V.coverage_notes(judged), "src_file", "left").orderBy("bytes", "src_file")


def open_record(record: DataFrame, files: DataFrame, limit: int | None = None, spread: bool = True,
                src_file: str | None = None, year: int | None = None) -> dict:
    """Q12: open one file, one calendar year, or everything; all of it, or under a budget of ``limit`` rows.

    A budget for several files is split by their bytes and, with ``spread``, spread over the time that is opened: the
    year is cut out first. ``year`` wins over ``src_file``.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit: one row or more, or None for all")
    tie = tuple(c for c in ("src_file",) if c in record.columns)
    if year is not None:
        chosen = V.files_holding(V.judge_coverage(V.coverage(record)), year)
        files = stored(files.join(chosen.select("src_file"), "src_file", "left_semi"), "files")
        held = V.of_year(record, year).join(files.select("src_file"), "src_file", "left_semi")
    elif src_file is not None:
        files = files.filter(F.col("src_file") == src_file)
        held = record.filter(F.col("src_file") == src_file)
    else:
        held = record
    if limit is None:
        opened = held
    elif spread:
        opened = V.spread_merge(held, V.allocate(files, limit), tie)
    else:
        opened = V.merge_budgeted(held, files, limit, tie).drop("budget", "bytes")
    opened = R.dedupe(opened.select(*record.columns))
    report = files.join(opened.groupBy("src_file").agg(F.count("*").alias("rows_kept")), "src_file", "left")
    return {"record": opened, "report": report.withColumn("rows_kept", F.coalesce("rows_kept", F.lit(0)))}


def calendar(record: DataFrame, box=None, start=None, end=None) -> DataFrame:
    """Q2."""
    return Q.daily(R.subset(record, box, start, end)).drop("present")


def points(record: DataFrame, box=None, start=None, end=None, limit: int = 6000) -> DataFrame:
    """Q3."""
    picked = K.sample(R.subset(record, box, start, end), limit)
    return picked.select(*[F.round(c, 4).alias(c) for c in ("lat", "lon", "frp")], "sensor")


def clusters(record: DataFrame, box=None, start=None, end=None, eps: float = 550, min_pts: int = 3,
             hours: float = 12, limit: int | None = 300) -> DataFrame:
    """Q4."""
    C.check_parameters(eps, min_pts, hours)
    return C.clusters(R.subset(record, box, start, end), eps, min_pts, hours, limit)


def climatology(record: DataFrame, box=None, window: int = 15, step: int = 5) -> dict:
    """Q5."""
    series = _series(record, box)
    long_enough = Q.at_least_days(series, 60)
    return {"envelope": Q.envelope_steps(Q.doy_envelope(long_enough, window), step).drop("mean"),
            "summary": Q.season_summary(long_enough, window),
            "doy": Q.doy_matrix(long_enough, "count"), "years": Q.year_lists(long_enough, "count"),
            "status": status(series, 60, "Need at least ~60 days of data")}


def transition(record: DataFrame, box=None, break_year: int = D.BREAK_YEAR, overlap_to: int = D.OVERLAP_TO) -> dict:
    """Q6."""
    days = stored(D.paired_days(Q.daily_counts(R.subset(record, box), weights=True)), "paired")
    comparable = D.comparable_days(days, (), break_year, overlap_to)
    growth = D.growth(comparable, (), break_year, overlap_to)
    missing = F.col("observed_growth_pct").isNull() | F.col("adjusted_growth_pct").isNull()
    note = F.when(missing, F.format_string(
        f"growth needs detections from before {break_year} and from {break_year}-{overlap_to}; this record has "
        "%d and %d, so the growth figures are n/a", "pre_rows", "overlap_rows"))
    return {"series": D.yearly(comparable), "calibration": D.calibration(days, (), break_year, overlap_to),
            "growth": growth, "status": growth.select(note.alias("note"))}


def anomalies(record: DataFrame, box=None, z: float = 2.0) -> dict:
    """Q7."""
    series = _series(record, box)
    long_enough = Q.at_least_days(series, 400)
    months = A.month_profile(long_enough)
    return {"anomalies": A.top_anomalies(A.zscore_doy_window(long_enough), z), "months": months,
            "critical": months.filter("critical"), "seasons": A.season_bands(long_enough),
            "status": status(series, 400, "Need >1 year of data")}


# ------------------------------------------------------------------ briefing (Q8)
# The sentences of the briefing.
STAGE = "Stage aerial retardant and preposition crews ahead of the next burning window."
ROUTINE = "No sustained anomaly streaks at the chosen z-threshold; routine monitoring is sufficient."
ABOVE_MEAN = "The last 30 days are running above the record mean — heighten early-warning dissemination."
NOTHING = "No actions flagged — conditions within climatological norms."
BY_KIND = {
    "Agricultural Crop Residue": "Agricultural residue burning dominates cluster activity near (%s, %s) — "
                                 "consider a temporary burn ban and farmer outreach.",
    "Forest": "Forest fuel cluster near (%s, %s) carries the highest total FRP (%s MW) — "
              "prioritize patrols and firebreak checks.",
    "Savanna": "Savanna burns near (%s, %s) are spreading fast but low intensity — "
               "early dry-season suppression is most cost-effective.",
    "Mediterranean Shrubland": "Mediterranean shrubland fires near (%s, %s) pose high crown-fire risk during "
                               "wind events — issue red-flag warnings if winds exceed 30 km/h.",
}


def _num(c: str, digits: int) -> Column:
    return F.round(c, digits).cast("string")


def _advice() -> Column:
    rule = None
    for kind, sentence in BY_KIND.items():
        args = [_num("lat", 3), _num("lon", 3)] + ([_num("total_frp", 1)] if sentence.count("%s") == 3 else [])
        filled = F.format_string(sentence, *args)
        rule = F.when(F.col("kind") == kind, filled) if rule is None else rule.when(F.col("kind") == kind, filled)
    return rule


def briefing(record: DataFrame, box=None, z: float = 2.0, min_days: int = 2, restarts: int = 10) -> dict:
    """Q8: threat, streaks, strata and recommendations (P32) as frames."""
    z, min_days = _clamp(z, 1.0, 5.0), _clamp(min_days, 1, 14)
    picked = R.subset(record, box)
    series = _series(record, box)
    long_enough = Q.at_least_days(series, 60)
    lead = stored(A.leading_streaks(A.streaks(A.zscore_doy_window(long_enough), z), min_days), "streaks")
    recent = A.recent_and_record(long_enough).filter("record_days >= 60")
    threat = stored(A.threat(lead, recent), "threat")
    strata = stored(C.kmeans_strata(picked, restarts=restarts), "strata")
    top_two = strata.filter("rank <= 2").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", _advice().alias("text")))),
                    lambda e: e["text"]).alias("_by_kind"))
    say = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    listed = F.concat(
        say(F.col("level").isin("Elevated", "Critical"), STAGE), say(F.col("streaks") == 0, ROUTINE),
        F.coalesce("_by_kind", F.array().cast("array<string>")),
        say(F.col("recent_mean") > F.col("record_mean"), ABOVE_MEAN))
    recommendations = threat.join(top_two, F.lit(True), "left").select(
        F.posexplode(F.slice(listed, 1, 6)).alias("position", "text"))
    return {"threat": threat, "streaks": lead, "strata": strata, "recommendations": recommendations,
            "status": status(series, 60, "Need at least ~60 days of data")}


def briefing_markdown(parts: dict, z: float = 2.0, min_days: int = 2) -> DataFrame:
    """The briefing as lines of Markdown, in order."""
    threat = parts["threat"]
    head = threat.select(F.posexplode(F.array(
        F.lit("# Briefing"), F.lit(""),
        F.format_string("**Threat level:** %s (score %.1f)  ", "level", "score"),
        F.format_string("**Record window:** %d days · mean %.1f fires/day  ", "record_days", "record_mean"),
        F.format_string("**Last 30 days:** mean %.1f/day · peak %.1f", "recent_mean", "recent_max"), F.lit(""),
        F.lit(f"## Critical burning periods (z ≥ {z}σ, ≥ {min_days}d)"))).alias("line", "text"))
    streaks = parts["streaks"].select("rank", F.format_string(
        "- **%s → %s** — %d day(s), peak z=%.1f, total %.1f fires", F.col("start").cast("string"),
        F.col("end").cast("string"), "days", "max_z", "total").alias("text"))
    strata = parts["strata"].select("rank", F.format_string(
        "- **%s** — %d fires, mean FRP %.1f MW, total %.1f MW, spread ~%.1f km",
        "kind", "n", "mean_frp", "total_frp", "spread_km").alias("text"))
    advice = parts["recommendations"].select(F.col("position").alias("rank"), F.concat(F.lit("- "), "text").alias("text"))

    def section(order: int, title: str | None, body: DataFrame, otherwise: str) -> DataFrame:
        lines = body.select(F.lit(order).alias("section"), F.col("rank").cast("int").alias("line"), "text")
        absent = body.agg(F.count("*").alias("_n")).filter("_n = 0").select(
            F.lit(order).alias("section"), F.lit(0).alias("line"), F.lit(otherwise).alias("text"))
        out = lines.unionByName(absent)
        if title:
            heading = threat.select(F.lit(order).alias("section"), F.posexplode(
                F.array(F.lit(""), F.lit(title))).alias("_p", "text"))
            out = out.unionByName(heading.select("section", (F.col("_p") - 10).alias("line"), "text"))
        return out

    whole = (head.select(F.lit(0).alias("section"), "line", "text")
             .unionByName(section(1, None, streaks, "- None detected at this threshold."))
             .unionByName(section(2, "## Dominant fuel strata", strata, "- Not enough clustered detections to stratify."))
             .unionByName(section(3, "## Recommendations", advice, f"- {NOTHING}")))
    return whole.orderBy("section", "line")


# ------------------------------------------------------------------ forecast (Q9)
def forecast(record: DataFrame, box=None, horizon: int = 30, prior: dict | None = None,
             model: dict | None = None) -> dict:
    """Q9: the served forecast, with the method of every day.

    ``prior`` and ``model`` are what ``export.load_prior`` and ``export.load_model`` return. The model
    draws the days its stored scores earn for the preset that contains the box (else globally) and
    for cells it was trained on; the seasonal prior draws the rest.
    """
    if not 1 <= horizon <= 90:
        raise ValueError(f"horizon is {horizon}; it may be from 1 to 90 days")
    box = X.parse_box(box) if isinstance(box, str) else box
    spark = record.sparkSession
    series = _series(record, box)
    asked = spark.createDataFrame([("box", *(box or S.WORLD_BOX))],
                                  "region string, minlat double, minlon double, maxlat double, maxlon double")
    shape = None
    if prior is not None:
        shape = P.prior_for_boxes(prior["shapes"].join(prior["levels"].select("cell"), "cell"), asked)
        shape = stored(shape, "prior")
        shape = None if shape.isEmpty() else shape
    base = FC.seasonal_forecast(series, horizon, prior=shape)
    rows = base.withColumn("method", F.lit("prior"))
    verdicts = coverage = None
    if model is not None:
        coverage = model.get("coverage")
        named = G.containing_region(asked.drop("region")).first()
        scope = named["region"] if box and named["region"] else "overall"
        verdicts = stored(FC.gate(model["scores"]), "verdicts")
        here = verdicts.filter(F.col("group") == scope)
        here = verdicts.filter(F.col("group") == "overall") if here.isEmpty() else here
        earned = stored(FC.earned_days(here, horizon), "earned")
        counts = P.cell_day_counts(R.subset(record, box))
        cells = stored(P.serving_series(counts, model["climo"].select("cell").distinct()), "cells")
        days = cells.agg(F.count_distinct("date").alias("d")).first()["d"]
        if days > max(S.LAGS) and not earned.filter("earned").isEmpty():
            path = FC.model_forecast(cells, model["climo"], model["model"], horizon)
            rows = FC.serve(base, stored(path, "path"), earned)
            widths = model.get("quantiles")
            if widths is not None:
                banded = FC.with_band(rows, FC.half_widths(widths, horizon))
                rows = banded.withColumns({c: F.when(F.col("method") == "model", F.col(c)) for c in ("lower", "upper")})
    return {"forecast": rows, "verdicts": verdicts, "coverage": coverage,
            "status": status(series, FC.MIN_DAYS, f"Need at least {FC.MIN_DAYS} days of data")}


def live_snapshot(feeds: DataFrame, box=None, eps: float = 550, min_pts: int = 3, hours: float = 12,
                  crop: bool = False, limit: int | None = 150) -> dict:
    """Q10: several feeds' records overlaid: each detection once, counted, and clustered.

    ``clusters`` is a function of no arguments, so that only who asks for clusters pays for them.
    """
    C.check_parameters(eps, min_pts, hours, (50, 10000), (0.5, 48))
    rows = R.dedupe_stored(R.subset(feeds, box if crop else None), "live")
    return {"rows": rows, "summary": R.summary(rows), "sensors": R.sensor_counts(rows),
            "clusters": lambda: C.clusters(rows, eps, min_pts, hours, limit)}
