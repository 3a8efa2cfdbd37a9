"""One training run, from detections to a stored model that the served forecast reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.operators import forecast as FC
from eventcal.operators import panel as P
from eventcal.session import stored
from eventcal.sources import export as E


def training_panel(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel up to the coverage seam, the seam): what a model may learn from; too short a record is an error."""
    rows = stored(P.panel(counts), "panel")
    seam = stored(P.coverage_seam(P.totals(rows)), "seam")
    rows = P.trim_seam(rows, seam)
    FC.enough_history(rows)
    return stored(rows.repartition("cell"), "panel"), seam


def train(counts: DataFrame, path: str, fit=FC.fit_tweedie, step: int = 7, cal_days: int = 365, test_days: int = 365) -> DataFrame:
    """Fit, score, calibrate and save; one row about the run.

    ``counts``: (cell, date, sensor, n) of the whole archive. Scores come from leaving out a year at a time. Widths are
    calibrated only on a record long enough for it; ``conformal`` says whether.
    """
    rows, seam = training_panel(counts)
    climo = stored(P.climo_table(rows), "climo")
    scores = stored(FC.backtest(rows, fit, step=step), "scores")
    model = fit(P.training_features(rows, climo))
    model = model[0] if isinstance(model, tuple) else model
    quantiles = coverage = None
    if FC.conformal_applies(rows, cal_days, test_days):
        quantiles, coverage = (stored(t, "conformal") for t in FC.model_residuals(rows, fit=fit, cal_days=cal_days, test_days=test_days))
    E.save_model(path, model, climo, scores, quantiles=quantiles, coverage=coverage)
    about = rows.agg(F.count_distinct("cell").alias("cells"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                     F.count_distinct("date").alias("days"), F.count("*").alias("rows"), F.sum("v").alias("total"))
    served = FC.gate(scores).filter((F.col("group") == "overall") & F.col("serve")).agg(F.count("*").alias("horizons_served"))
    one = F.lit(True)
    return about.join(seam.select("keep_to", "dropped_days"), one).join(served, one).withColumn("conformal", F.lit(quantiles is not None))
