"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Each query runs to its last row (``noop`` sink). ``record_build`` is the first query of all, with the start of the JVM's
work, the parsing of the source and the writing of the stored record.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "harmonize_record", "dedupe_record", "record_summary", "calendar_daily", "calendar_by_region",
    "climatology_envelope", "transition_growth", "zscore_doy_window", "season_bands", "threat_level",
    "points_sample", "spread_slice", "coverage_by_year", "prior_for_boxes", "archive_scan_cells",
    "cell_panel", "backtest_mase_baselines", "forecast_blend", "dbscan_members", "clusters_with_hulls",
    "briefing_markdown", "export_resume", "customer_region_daily", "events_stream_tumbling",
)


def main() -> None:
    from eventcal.plans import registry
    from eventcal.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="eventcal-bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    picked = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first query writes the stored record that the others read; that costs a line of its own.
    start = time.perf_counter()
    run("record_summary")
    seconds = {} if sys.argv[1:] else {"record_build": round(time.perf_counter() - start, 3)}
    for name in picked:
        seconds[name] = round(run(name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(v for k, v in seconds.items() if k != "record_build"), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
        "rows_per_sec_scan_to_prior": round(rows / (seconds["record_build"] + seconds["prior_for_boxes"])) if "record_build" in seconds else None,
    }))


if __name__ == "__main__":
    main()
