import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventcal.operators import clusters as C
from helpers import record

T0 = dt.datetime(2024, 3, 1)


def brute(rows, eps, min_pts, hours):
    """Textbook density clustering on all pairs; {row index: (first core position, core?)}."""
    lat = np.array([r[0] for r in rows]); lon = np.array([r[1] for r in rows])
    t = np.array([(r[2] - dt.datetime(1970, 1, 1)).total_seconds() / 3600 for r in rows])
    X = np.c_[lon * 111320 * math.cos(math.radians(lat.mean())), lat * 110540, t / hours * eps]
    near = ((X[:, None] - X[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_pts
    label = np.where(core, np.arange(len(rows)), -1)
    while True:
        new = np.array([min([label[i]] + [label[j] for j in np.flatnonzero(near[i] & core)]) if core[i] else -1
                        for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    place = lambda i: (rows[i][2], rows[i][0], rows[i][1])
    first = {root: min(place(i) for i in np.flatnonzero(label == root)) for root in set(label[core])}
    out = {}
    for i in range(len(rows)):
        if core[i]:
            out[i] = (first[label[i]], True)
        else:
            around = [first[label[j]] for j in np.flatnonzero(near[i] & core)]
            if around:
                out[i] = (min(around), False)
    return out


def spark_labels(spark, rows, eps, min_pts, hours):
    got = C.dbscan(record(spark, rows), eps, min_pts, hours).collect()
    return sorted(((r.time, r.lat, r.lon, r.sensor), (tuple(r.cluster), r.core)) for r in got)


def check(spark, rows, eps, min_pts, hours):
    rows = sorted(set(rows), key=lambda r: (r[2], r[0], r[1], r[3]))
    want = brute(rows, eps, min_pts, hours)
    want = sorted(((rows[i][2], rows[i][0], rows[i][1], rows[i][3]), v) for i, v in want.items())
    assert spark_labels(spark, rows, eps, min_pts, hours) == want
    return want


def scatter(seed, n, spread, span_hours, centres=1):
    rng = np.random.default_rng(seed)
    mid = rng.uniform(-0.05, 0.05, (centres, 2))
    rows = []
    for i in range(n):
        a, b = mid[i % centres] + rng.normal(0, spread, 2)
        rows.append((round(float(10 + a), 5), round(float(20 + b), 5), T0 + dt.timedelta(minutes=int(rng.integers(0, span_hours * 60))),
                     "MODIS" if i % 3 else "VIIRS"))
    return rows


@pytest.mark.parametrize("seed,n,spread,span,min_pts", [
    (0, 120, 0.01, 24, 3), (1, 200, 0.003, 48, 4), (2, 150, 0.02, 12, 3)])
def test_matches_all_pairs(spark, seed, n, spread, span, min_pts):
    assert check(spark, scatter(seed, n, spread, span, centres=3), 550, min_pts, 12)


def test_one_place_holds_most_rows(spark):
    """Crowded cells side by side, a hot spot of many copies' worth of positions, and stragglers."""
    rows = scatter(5, 250, 0.0015, 6) + scatter(6, 40, 0.02, 24)
    check(spark, rows, 550, 5, 12)


@pytest.mark.parametrize("gap", [0.0049, 0.00497, 0.004976, 0.0051])
def test_crowded_cells_linked_only_if_in_reach(spark, gap):
    """Two tight crowds whose boxes leave the answer open are split until it is known."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(30):
        rows.append((round(float(10 - abs(rng.normal(0, 0.0004))), 6), 20.0, T0, "MODIS"))
        rows.append((round(float(10 + gap + abs(rng.normal(0, 0.0004))), 6), 20.0, T0, "MODIS"))
    rows += [(10.0, 20.0, T0, "VIIRS"), (round(10 + gap, 6), 20.0, T0, "VIIRS")]
    check(spark, rows, 550, 4, 12)


def test_hot_bucket_is_salted(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_BUCKET", 20)
    check(spark, scatter(9, 220, 0.002, 12, centres=2), 550, 4, 12)


def test_border_goes_to_the_smallest_cluster(spark):
    deg = lambda m: m / 110540
    rows = [(round(10 + deg(y), 7), 20.0, T0 + dt.timedelta(minutes=m), "MODIS")
            for m, y in ((0, -900), (1, -800), (2, -700), (3, -500), (4, 0), (5, 500), (6, 700), (7, 800), (8, 900))]
    check(spark, rows, 520, 4, 1000)


def test_noise_only(spark):
    rows = [(10.0 + i, 20.0, T0, "MODIS") for i in range(4)]
    assert spark_labels(spark, rows, 550, 3, 12) == []
    assert C.clusters(record(spark, rows)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 149], "u long, v long")
    got = {r.node: r.label for r in C.components(nodes, edges).collect()}
    assert set(got.values()) == {0, 150} and got[149] == 0 and got[299] == 150


def test_hull_of_square_line_and_point():
    square = [(0, 0), (0, 2), (2, 2), (2, 0), (1, 1), (0, 1)]
    assert set(C.convex_hull(square)) == {(0, 0), (0, 2), (2, 2), (2, 0)}
    assert set(C.convex_hull([(0, 0), (1, 1), (2, 2)])) == {(0, 0), (1, 1), (2, 2)}
    assert C.convex_hull([(3, 4)]) == [(3, 4)]


def test_hull_holds_every_member(spark):
    rows = scatter(11, 150, 0.004, 10)
    out = C.clusters(record(spark, rows), eps=550, min_pts=3, hours=12).collect()
    assert out and [r.n for r in out] == sorted((r.n for r in out), reverse=True)
    members = C.dbscan(record(spark, rows), 550, 3, 12).collect()
    for c in out:
        own = [(m.lat, m.lon) for m in members if m.cluster == c.cluster]
        assert len(own) == c.n >= 3
        assert {(p.lat, p.lon) for p in c.hull} == set(C.convex_hull(own))
        assert c.duration_h <= 10


def test_strata(spark):
    rng = np.random.default_rng(0)
    frame = record(spark, [(float(10 * (i % 4) + rng.normal()), float(rng.normal()), T0, "MODIS") for i in range(80)])
    out = C.kmeans_strata(frame, restarts=2).orderBy("rank").collect()
    assert len(out) == 4 and sum(r.n for r in out) == 80
    assert [r.total_frp for r in out] == sorted((r.total_frp for r in out), reverse=True)
    assert out[0].kind == "Forest" and all(r.spread_km > 0 for r in out)
    assert C.kmeans_strata(frame.limit(11), restarts=1).count() == 0


# ------------------------------------------------------------------ tiles, crowded tiles, hulls of hulls
def wide(seed, n=260):
    """Chains that cross the edges of tiles, a crowd on one of them, and stragglers."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = (i * 0.0031) % 0.31, (i * 0.0017) % 0.23
        rows.append((round(10 + a + float(rng.normal(0, 0.001)), 5), round(20 + b, 5), T0 + dt.timedelta(minutes=int(i * 41 % 4000)), "MODIS"))
    return rows + [(round(10.08 + 0.0004 * (i % 9), 5), round(20.08 + 0.0004 * (i // 9), 5), T0 + dt.timedelta(minutes=i), "VIIRS") for i in range(60)]


@pytest.mark.parametrize("crowded", [-1, 30, 10 ** 9])
def test_all_some_or_no_tiles_are_crowded(spark, monkeypatch, crowded):
    monkeypatch.setattr(C, "CROWDED", crowded)
    want = check(spark, wide(3), 550, 3, 12)
    assert len({cluster for _, (cluster, _) in want}) > 3


def test_tiles_in_many_groups_and_pairs_in_blocks(spark, monkeypatch):
    from eventcal.operators import tiles

    monkeypatch.setattr(tiles, "PAIRS", 50)
    monkeypatch.setattr(C, "GROUP_SPOTS", 40)
    check(spark, wide(4) + scatter(5, 150, 0.01, 24, centres=3), 550, 4, 12)


def test_a_third_of_all_rows_at_one_place(spark):
    rows = scatter(8, 120, 0.01, 24, centres=2)
    df = record(spark, rows + [(10.0, 20.0, T0, "MODIS")] * 60)
    got = C.dbscan(df, 550, 30, 12).collect()
    assert sum((r.lat, r.lon, r.time) == (10.0, 20.0, T0) for r in got) == 60 and all(r.core for r in got if r.lat == 10.0 and r.lon == 20.0)


@pytest.mark.parametrize("points", [3, 4096])
def test_hulls_of_hulls(spark, monkeypatch, points):
    monkeypatch.setattr(C, "HULL_POINTS", points)
    rng = np.random.default_rng(2)
    shapes = {1: [(round(float(a), 3), round(float(b), 3)) for a, b in rng.normal(0, 1, (200, 2))], 2: [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)],
              3: [(5.0, 1.0), (6.0, 1.0), (7.0, 1.0)], 4: [(1.0, 5.0), (1.0, 6.0), (1.0, 7.0)], 5: [(4.0, 4.0)] * 3, 6: [(1.0, 2.0), (3.0, 4.0)],
              7: [(float(i % 5), float(i // 5)) for i in range(25)], 8: [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]}
    members = spark.createDataFrame([(k, a, b) for k, v in shapes.items() for a, b in v], "cluster int, lat double, lon double")
    picked = members.groupBy("cluster").count().selectExpr("cluster", "cluster id", "count n")
    out = C.with_hulls(members, picked)
    for r in out.collect():
        assert [(p.lat, p.lon) for p in r.hull] == C.convex_hull(shapes[r.id]), r.id
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_a_cluster_without_members_is_left_out(spark):
    members = spark.createDataFrame([], "cluster int, lat double, lon double")
    assert C.with_hulls(members, members.groupBy("cluster").count().selectExpr("cluster", "cluster id", "count n")).count() == 0


def test_restarts_together_find_what_one_by_one_fits_find(spark):
    """Well apart groups are found; the cost is that of the best of many plain fits."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1.0, (80, 3)) for c in ((0, 0, 0), (30, 0, 5), (0, 40, 9), (25, 25, 60))])
    df = spark.createDataFrame([(*map(float, p), int(rng.integers(-2 ** 62, 2 ** 62))) for p in x], "x double, y double, z double, h long").repartition(3)
    centres, cost = C.nearest_centres(df, 4, 8, seed=1)

    def plain(seed):
        own = np.random.default_rng(seed)
        c = x[own.choice(len(x), 4, replace=False)]
        for _ in range(100):
            label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(4)])
        return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()

    assert cost == pytest.approx(min(plain(s) for s in range(40)), rel=1e-9)
    again, _ = C.nearest_centres(df.repartition(7), 4, 8, seed=1)
    assert np.abs(np.sort(centres, 0) - np.sort(again, 0)).max() < 1e-9


def test_copies_of_few_places_have_no_more_centres_than_places(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, i) for i in range(30)] + [(2.0, 2.0, 2.0, 50)], "x double, y double, z double, h long")
    centres, cost = C.nearest_centres(df, 4, 3)
    assert cost == 0.0 and {tuple(c) for c in centres} == {(1.0, 1.0, 1.0), (2.0, 2.0, 2.0)}


def test_a_dense_tile_keeps_no_pairs():
    """Very many positions in reach of each other take memory by positions, not by pairs."""
    import tracemalloc

    import pandas as pd

    from eventcal.operators import tiles

    rng = np.random.default_rng(3)
    n = 12_000
    d = pd.DataFrame({"pid": rng.permutation(n), "w": 1, "own": True, "us": 0, "lat": 0.0, "lon": 0.0,
                      **{a: rng.uniform(3000, 3000 + reach, n) for a, reach in (("x", 700), ("y", 700), ("t", 3000))}})
    d = d.assign(**{f"g{a}": np.floor(d[a] / 550).astype(int) for a in tiles.AXES}, **{k: 0 for k in tiles.TILE})
    tracemalloc.start()
    found = tiles.solve(d, 550, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and (found["label"] == 0).all() and (found["role"] == tiles.CORE).all() and peak < 400e6


def test_tiles_of_a_group_are_solved_in_parts_of_little_memory():
    """Eight dense tiles in one group, by parts as at once; what a task holds beside its input stays small."""
    import tracemalloc

    import pandas as pd
    from eventcal.operators import tiles as TL

    rng, n, k = np.random.default_rng(11), 12_000, 8
    tile = np.repeat(np.arange(k), n)
    at = pd.DataFrame({"pid": np.arange(n * k), "w": 1, "us": 0, "lat": rng.uniform(2, 4, n * k), "lon": rng.uniform(2, 4, n * k)})
    at = at.assign(x=at["lon"] * 550 + 300, y=at["lat"] * 550 + 300, t=(tile * 16 + rng.uniform(0, 16, n * k)) * 550, own=True)
    at = at.assign(**{f"g{a}": (at[a] // 550).astype(int) for a in "xyt"}, kx=0, ky=0, kt=tile)
    pieces = TL.parts(at)
    assert len(pieces) > 1 and sorted(pd.concat(pieces)["pid"]) == list(range(n * k))
    assert all(piece.groupby("kt").size().eq(n).all() for piece in pieces)
    tracemalloc.start()
    found = pd.concat([TL.solve(piece, 550.0, 60) for piece in pieces])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = lambda f: sorted(f[["pid", "label", "role"]].itertuples(index=False, name=None))
    assert rows(found) == rows(TL.solve(at, 550.0, 60)) and set(found["role"]) >= {TL.CORE}
    assert peak < 50e6


def test_the_steps_of_clustering_read_in_finer_tasks(spark, monkeypatch):
    """A task holds what it reads once for each tile that sees it, until it is shuffled."""
    from eventcal.operators import clusters as C
    from eventcal.operators import tiles as TL
    from eventcal.session import SCAN_BYTES

    name, seen, tiles = "spark.sql.files.maxPartitionBytes", [], TL.found_in_tiles
    before = spark.conf.get(name)
    monkeypatch.setattr(TL, "found_in_tiles", lambda *a: seen.append(spark.conf.get(name)) or tiles(*a))
    rows = [(f"2001-05-01 00:0{i}:00", 10.0, 20.0 + i / 10000, 1.0, "MODIS") for i in range(5)]
    df = spark.createDataFrame(rows, "time string, lat double, lon double, frp double, sensor string").selectExpr(
        "to_timestamp(time) AS time", "lat", "lon", "frp", "sensor")
    got = C.clusters(df, eps=550, min_pts=3, hours=48).collect()
    assert seen == [SCAN_BYTES] and spark.conf.get(name) == before and [r.n for r in got] == [5]


# ------------------------------------------------------------------ disk
def test_shuffled_blocks_of_a_written_step_are_removed(spark):
    """A run writes many steps; what was shuffled for each would else lie beside all of them."""
    import time

    from eventcal.session import stored

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in (blocks.apply(i).name() for i in range(blocks.size())) if name.startswith("shuffle_")}

    before = shuffled()
    df = stored(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and df.count() == 7


def test_all_columns_travel_as_they_are(spark):
    rows = [(T0 + dt.timedelta(minutes=i), 10.0, 20.0 + i / 1e4, None if i % 2 else i, None if i % 3 else f"s{i}", None if i % 2 else float("nan"), None if i % 4 else T0.date()) for i in range(20)]
    df = spark.createDataFrame(rows, "time timestamp, lat double, lon double, n int, s string, f double, d date").repartition(3)
    got = C.dbscan(df.union(df.limit(0)), 550, 3, 12)
    assert [(f.name, f.dataType) for f in got.schema][:7] == [(f.name, f.dataType) for f in df.schema]
    assert sorted(map(repr, (tuple(r)[:7] for r in got.collect()))) == sorted(map(repr, map(tuple, df.collect())))


def test_places_without_a_time_or_none_at_all(spark):
    df = record(spark, scatter(1, 30, 0.001, 2))
    more = df.limit(1).withColumn("time", F.lit(None).cast("timestamp")).union(df.limit(1).withColumn("lat", F.lit(None).cast("double")))
    assert C.dbscan(df.union(more), 550, 3, 12).count() == C.dbscan(df, 550, 3, 12).count() > 0
    assert C.dbscan(df.limit(0), 550, 3, 12).count() == 0


def test_the_steps_of_a_dense_record_hold_its_rows_once(spark, monkeypatch):
    """Positions are not written or numbered before they go to the tiles, and few rows tell tiles of each other."""
    written, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda *a: written.append(out := stored(*a)) or out)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=i * 600), *map(float, 10 + rng.uniform(0, 0.004, 2))) for i in range(6000)], "time timestamp, lat double, lon double")
    assert C.dbscan(df, 550, 3, 48).count() == 6000
    counts = [out.count() for out in written]
    assert 6000 <= sum(counts) < 8000, counts


@pytest.mark.parametrize("rows", [40, 10 ** 9])
def test_tiles_of_many_rows_are_crowded(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "TILE_ROWS", rows)
    monkeypatch.setattr(C, "SENT_LABELS", 0)
    check(spark, wide(6), 550, 4, 12)


def test_the_summary_asks_for_the_columns_it_needs(spark, sf, monkeypatch):
    from eventcal.plans import registry

    asked, dbscan = [], C.dbscan
    monkeypatch.setattr(C, "dbscan", lambda df, **how: asked.append(df.columns) or dbscan(df, **how))
    registry.cluster_summary(spark, sf)
    registry.dbscan_members(spark, sf)
    assert asked == [["lat", "lon", "time", "frp", "sensor"], ["lat", "lon", "time", "sensor"]]


def test_members_are_not_written_once_more(spark, monkeypatch):
    written, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda *a: written.append(out := stored(*a)) or out)
    assert C.clusters(record(spark, scatter(11, 150, 0.004, 10)), eps=550, min_pts=3, hours=12).count()
    assert not any({"frp", "sensor", "cluster"} <= set(df.columns) for df in written)
    assert sum({"frp", "sensor"} <= set(df.columns) and "sat" not in df.columns for df in written) == 1
