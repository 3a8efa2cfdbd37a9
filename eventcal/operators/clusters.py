"""Spatio-temporal clusters, hulls and strata.

Density clustering is exact. Tiles of moderate content are solved each by itself (``tiles``) and only ties between their
labels meet. Crowded tiles are solved together by a method that never lists the pairs inside a crowded place: positions are
put on a grid whose cells have the diagonal ``eps``: whatever lies in one cell is mutually within reach, so a cell of
``min_pts`` or more is all core and acts as a single node. Only positions of sparse cells, of which a cell has
fewer than ``min_pts``, are compared one by one. Two crowded cells are compared by their bounding boxes, which are
split further only while the boxes leave the answer open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.operators import tiles as TL
from eventcal.operators.series import over
from eventcal.session import finer_scans, stored

HOT_BUCKET = 20_000
#: A tile is crowded when the squares of its buckets' rows add up to more, or when it has more rows.
CROWDED, TILE_ROWS = 1_000_000_000, 500_000
#: So many tied labels or fewer are sent to every task instead of sending every row to its label.
SENT_LABELS = 250_000
#: Rows for one group of tiles, and points of a cluster for one part of its hull.
GROUP_SPOTS, HULL_POINTS = 25_000, 4096
SPLIT = 4
AXES = ("x", "y", "t")


def check_parameters(eps: float, min_pts: int, hours: float, eps_range=(10, 5000), hours_range=(0.5, 720)) -> None:
    for name, value, (low, high) in (("eps", eps, eps_range), ("min_pts", min_pts, (1, 100)), ("hours", hours, hours_range)):
        if not low <= value <= high:
            raise ValueError(f"{name} is {value}; it may be from {low} to {high}")


def project(record: DataFrame, eps: float, hours: float) -> DataFrame:
    """Local metres about the mean latitude, and time scaled so that ``hours`` equals ``eps``."""
    centre = record.agg(F.avg("lat").alias("_lat0"))
    return (record.join(centre, F.lit(True)).withColumns(dict(zip(AXES, _local(F.cos(F.radians("_lat0")), eps, hours)))).drop("_lat0"))


def _local(narrow: Column, eps: float, hours: float) -> list[Column]:
    """x, y and t; ``narrow`` is the cosine of the mean latitude."""
    return [F.col("lon") * 111320 * narrow, F.col("lat") * 110540, F.unix_micros("time") / 3.6e9 / hours * eps]


# ------------------------------------------------------------------ connected components
def components(nodes: DataFrame, edges: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, label): the least node id of each connected component.

    The graph is contracted: every node joins its least neighbour (or stays, if it is the least),
    chains of joins are shortened, and the edges between what is left form the next, smaller graph.
    Each round at least halves what still has edges. Rounds are written to the shared folder and read
    back, which also sheds the constraints a checkpoint would carry from round to round.
    """
    labels = nodes.select("node", F.col("node").alias("label"))
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    work = stored(both.filter(F.col("u") != F.col("v")).distinct())
    while not work.isEmpty():
        parent = stored(work.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
        for _ in range(jumps):
            parent = parent.join(parent.select(F.col("u").alias("p"), F.col("p").alias("above")), "p").select(
                "u", F.col("above").alias("p"))
        parent = stored(parent)
        labels = labels.join(parent, F.col("label") == F.col("u"), "left").select(
            "node", F.coalesce("p", "label").alias("label"))
        ends = [parent.select(F.col("u").alias(e), F.col("p").alias(f"n{e}")) for e in ("u", "v")]
        work = stored(work.join(ends[0], "u").join(ends[1], "v").filter(F.col("nu") != F.col("nv"))
                          .select(F.col("nu").alias("u"), F.col("nv").alias("v")).distinct())
    return stored(labels)


# ------------------------------------------------------------------ boxes
def _gap(a: str, b: str, near: bool) -> Column:
    """Squared least (or greatest) distance between the boxes whose columns start with a and b."""
    total = F.lit(0.0)
    for axis in AXES:
        low_a, high_a = F.col(f"{a}{axis}_lo"), F.col(f"{a}{axis}_hi")
        low_b, high_b = F.col(f"{b}{axis}_lo"), F.col(f"{b}{axis}_hi")
        d = (F.greatest(F.lit(0.0), low_a - high_b, low_b - high_a) if near
             else F.greatest(high_a - low_b, high_b - low_a))
        total = total + d * d
    return total


def _boxes(points: DataFrame, *by) -> DataFrame:
    return points.groupBy(*by).agg(
        *[f(axis).alias(f"{axis}_{end}") for axis in AXES for f, end in ((F.min, "lo"), (F.max, "hi"))])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}{c}" for c in df.columns])


def _judge(pairs: DataFrame, eps: float) -> DataFrame:
    """Keep pairs that can be in reach; ``sure`` marks those that must be."""
    reach = eps * eps
    return (pairs.filter(_gap("a_", "b_", near=True) <= reach)
            .withColumn("sure", _gap("a_", "b_", near=False) <= reach))


def _link_dense(points: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """Edges (u, v) between crowded cells that hold two positions in reach of each other."""
    offsets = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    shifts = F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(off, "ijk")]) for off in offsets])
    left = _prefixed(cells, "a_").withColumn("_o", F.explode(shifts))
    for axis, step in zip(AXES, "ijk"):
        left = left.withColumn(f"b_c{axis}", F.col(f"a_c{axis}") + F.col(f"_o.{step}"))
    pairs = _judge(left.join(_prefixed(cells, "b_"), [f"b_c{axis}" for axis in AXES]), eps)
    pairs = stored(pairs.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"), "sure"))
    edges, open_pairs = pairs.filter("sure").select("u", "v"), pairs.filter(~F.col("sure")).select("u", "v")
    open_pairs = open_pairs.withColumns({f"{s}{axis}": F.lit(0).cast("bigint") for s in "ab" for axis in AXES})
    # Boxes of the cells still in question, one level finer each round. ``a*``/``b*`` index the
    # part of its cell a pair is about; level 0 has one part, the whole cell.
    level = 0
    while not open_pairs.isEmpty():
        level += 1
        wanted = open_pairs.select(F.col("u").alias("node")).union(open_pairs.select("v")).distinct()
        scale = float(SPLIT ** level)
        parts = {f"p{axis}": F.floor((F.col(f"f{axis}") - F.col(f"c{axis}")) * scale).cast("bigint") for axis in AXES}
        fine = _boxes(points.join(wanted, "node", "left_semi").withColumns(parts), "node", *parts)
        parent = lambda side: [
            (F.floor(F.col(f"{side}_p{axis}") / SPLIT) if level > 1 else F.lit(0)) == F.col(f"{side}{axis}")
            for axis in AXES]
        split = (open_pairs.join(_prefixed(fine, "a_"), [F.col("u") == F.col("a_node"), *parent("a")])
                 .join(_prefixed(fine, "b_"), [F.col("v") == F.col("b_node"), *parent("b")]))
        judged = stored(_judge(split, eps).select(
            "u", "v", "sure", *[F.col(f"{s}_p{axis}").alias(f"{s}{axis}") for s in "ab" for axis in AXES]))
        sure = judged.filter("sure").select("u", "v").distinct()
        edges = edges.union(sure)
        open_pairs = judged.filter(~F.col("sure")).drop("sure").join(sure, ["u", "v"], "left_anti")
    return edges


# ------------------------------------------------------------------ neighbours
def _near(sparse: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """(p, node, dense, w): the nodes within reach of each sparse position, with their weight.

    A bucketed equi-join over the 27 buckets around. A bucket with very many positions is split
    into salts, and the few probes that ask for it are sent to every salt.
    """
    bucket = lambda df: df.withColumns({f"g{axis}": F.floor(F.col(axis) / eps) for axis in AXES})
    grid = [f"g{axis}" for axis in AXES]
    held = bucket(points)
    hot = (held.groupBy(*grid).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_BUCKET)
           .select(*grid, F.ceil(F.col("_n") / HOT_BUCKET).alias("_salts")))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    probe = bucket(sparse.select(F.col("pid").alias("p"), *AXES))
    for g in grid:
        probe = probe.withColumn("_d", F.explode(around)).withColumn(g, F.col(g) + F.col("_d")).drop("_d")
    probe = probe.join(hot, grid, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)).cast("int") - 1))).drop("_salts")
    probe = probe.select("p", *grid, "_salt", *[F.col(a).alias(f"p{a}") for a in AXES])
    held = held.join(hot, grid, "left").withColumn(
        "_salt", F.pmod("pid", F.coalesce("_salts", F.lit(1))).cast("int"))
    squared = sum(((F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in AXES), F.lit(0.0))
    return (probe.join(held, [*grid, "_salt"]).filter(squared <= eps * eps)
            .groupBy("p", F.when(F.col("dense"), F.col("node")).otherwise(F.col("pid")).alias("node"), "dense")
            .agg(F.sum("w").alias("w")))


def _found_together(spots: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """Rows of ``tiles.FOUND`` from the positions of crowded tiles, of which ``own`` marks those that lie in one.

    A position further out may seem no core, since not all around it is there, but what seems a core is one.
    """
    side = eps / math.sqrt(3) * (1 - 1e-9)
    spots = stored(spots.withColumns({f"f{a}": F.col(a) / side for a in AXES})
                        .withColumns({f"c{a}": F.floor(F.col(a) / side) for a in AXES}))
    grid = [f"c{a}" for a in AXES]
    cells = spots.groupBy(*grid).agg(
        F.sum("w").alias("_cw"), F.min("pid").alias("node"),
        *[f(a).alias(f"{a}_{end}") for a in AXES for f, end in ((F.min, "lo"), (F.max, "hi"))])
    crowded = stored(cells.filter(F.col("_cw") >= min_pts).drop("_cw"))
    points = spots.join(crowded.select(*grid, "node"), grid, "left")
    points = stored(points.withColumn("dense", F.col("node").isNotNull())
                        .withColumn("node", F.coalesce("node", "pid")))
    near = stored(_near(points.filter(~F.col("dense")), points, eps))
    lone = near.groupBy("p").agg(F.sum("w").alias("w")).filter(F.col("w") >= min_pts).select(F.col("p").alias("node"))
    core = stored(crowded.select("node").union(lone))

    from_core = near.join(core.select(F.col("node").alias("p")), "p", "left_semi").join(core, "node", "left_semi")
    edges = from_core.filter(F.col("p") != F.col("node")).select(F.col("p").alias("u"), F.col("node").alias("v"))
    labels = components(core, edges.union(_link_dense(points.filter("dense"), crowded, eps)))
    fringe = near.join(core.select(F.col("node").alias("p")), "p", "left_anti").join(labels, "node")
    cores = points.join(labels, "node").withColumn("role", F.when(F.col("own"), F.lit(TL.CORE)).otherwise(F.lit(TL.SHARED)))
    border = points.filter("own").join(fringe.select(F.col("p").alias("pid"), "label").distinct(), "pid")
    border = border.withColumn("role", F.lit(TL.BORDER))
    columns = ["pid", "label", "role", *TL.PLACE]
    return cores.select(*columns).union(border.select(*columns))


def dbscan(record: DataFrame, eps: float = 550, min_pts: int = 3, hours: float = 12) -> DataFrame:
    """The record's clustered rows with ``cluster`` (its first core position) and ``core``.

    A position counts itself. A border position joins the cluster with the smallest first core
    position among those in reach; noise is left out. All columns travel with the rows, so a caller names those it needs.
    """
    place = ["time", "lat", "lon"]
    record = record.select(*place, *[c for c in record.columns if c not in place])
    # What a task reads is multiplied by the tiles that see it, and held until it is shuffled.
    with finer_scans(record.sparkSession):
        return _members(record, eps, min_pts, hours)


def _members(record: DataFrame, eps: float, min_pts: int, hours: float) -> DataFrame:
    """The clustered rows, from rows that know their label and from labels that are tied."""
    place, tiles = ["time", "lat", "lon"], [*TL.TILE]
    here = F.struct(*[F.col(c) for c in place])
    narrow = record.agg(F.cos(F.radians(F.avg("lat")))).first()[0]
    at = record.filter(F.col("time").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    at = TL.with_buckets(at.withColumns(dict(zip(AXES, _local(F.lit(narrow), eps, hours)))), eps)
    counts = at.groupBy(*tiles, *[f"g{a}" for a in AXES]).agg(F.count("*").alias("n"))
    counts = stored(counts.groupBy(*tiles).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("work")))
    crowded = stored(counts.filter((F.col("work") > CROWDED) | (F.col("n") > TILE_ROWS)).select(*tiles))
    seen = TL.seen_by(at)
    some = not crowded.isEmpty()
    groups = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // GROUP_SPOTS))
    found = stored(TL.found_in_tiles(seen.join(crowded, tiles, "left_anti") if some else seen, eps, min_pts, groups, float(hours), float(narrow or 0.0)))

    told = lambda role: found.filter(F.col("role") == role).select("at", "label")
    rows = found.filter(F.col("role").isin(TL.CORE, TL.BORDER)).select(*record.columns, (F.col("role") == TL.CORE).alias("core"), "label")
    edges, shared, choices = told(TL.EDGE_CORE), told(TL.SHARED), told(TL.CHOICE)
    if some:
        inside = seen.join(crowded, tiles, "left_semi").groupBy(*place, *tiles).agg(F.count("*").alias("w"), F.max("own").alias("own"), *[F.first(a).alias(a) for a in AXES])
        inside = inside.groupBy(*place).agg(F.max("w").alias("w"), F.max("own").alias("own"), *[F.first(a).alias(a) for a in AXES])
        spots = stored(inside.select(F.monotonically_increasing_id().alias("pid"), F.unix_micros("time").alias("us"), "lat", "lon", "w", "own", *AXES))
        together = _found_together(spots, eps, min_pts).select("pid", F.col("label").alias("_l"), "role", F.struct(
            F.timestamp_micros("us").alias("time"), "lat", "lon").alias("at"))
        together = stored(together)
        first = together.filter(F.col("role") != TL.BORDER).groupBy("_l").agg(F.min("at").alias("label"))
        together = stored(together.join(first, "_l").select("at", "role", "label"))
        cores, fringe = (together.filter(F.col("role") == role).select("at", "label") for role in (TL.CORE, TL.BORDER))
        edges, choices = edges.union(cores), choices.union(fringe)
        shared = shared.union(together.filter(F.col("role") == TL.SHARED).select("at", "label"))
        known = cores.select("at.*", F.lit(True).alias("core"), "label").union(
            fringe.select("at").distinct().select("at.*", F.lit(False), F.lit(None).cast(cores.schema["label"].dataType)))
        rows = rows.union(at.select(*record.columns, *tiles).join(crowded, tiles, "left_semi").drop(*tiles).join(known, place).select(*record.columns, "core", "label"))

    ties = shared.select("at", F.col("label").alias("u")).join(edges.select("at", F.col("label").alias("v")), "at")
    ties = stored(ties.filter(F.col("u") != F.col("v")).select("u", "v").distinct())
    # A label is the first core of those that a tile sees together, so the least of the labels that are tied is the first of the cluster.
    roots = components(ties.select(F.col("u").alias("node")).union(ties.select("v")).distinct(), ties)
    roots = roots.select(F.col("node").alias("label"), F.col("label").alias("_root"))
    roots = F.broadcast(roots) if roots.count() <= SENT_LABELS else roots
    rooted = lambda df: df.join(roots, "label", "left").withColumn("cluster", F.coalesce("_root", "label")).drop("label", "_root")
    best = rooted(choices).groupBy("at").agg(F.min("cluster").alias("cluster"))
    alone = rooted(rows.filter(F.col("label").isNotNull())).select(*record.columns, "cluster", "core")
    between = rows.filter(F.col("label").isNull()).drop("label").withColumn("at", here).join(best, "at").select(*record.columns, "cluster", "core")
    return alone.union(between)


# ------------------------------------------------------------------ summaries
def cluster_summary(members: DataFrame) -> DataFrame:
    """A19 without the hull."""
    return members.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("frp").alias("frp"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.min("time").alias("start"), F.max("time").alias("end"),
        F.array_sort(F.collect_set("sensor")).alias("sensors"),
        ((F.max(F.unix_seconds("time")) - F.min(F.unix_seconds("time"))) / 3600).alias("duration_h"))


def largest(summary: DataFrame, limit: int | None = 300) -> DataFrame:
    """The biggest clusters, numbered from 1, and how many there are in all (``total``).

    ``limit=None`` takes all; they are then numbered without one sort of everything in a task.
    """
    order = [F.col("n").desc(), F.col("cluster").asc()]
    total = summary.agg(F.count("*").alias("total"))
    if limit is None:
        from eventcal.operators.ranking import global_rank

        ranked = global_rank(summary.withColumn("_m", -F.col("n")), ["_m"], ["cluster"])
        return ranked.withColumn("id", F.col("row").cast("int")).drop("_m", "row").join(total, F.lit(True))
    picked = summary.orderBy(*order).limit(limit)
    return picked.withColumn("id", F.row_number().over(over().orderBy(*order))).join(total, F.lit(True))


def convex_hull(points: list[tuple]) -> list[tuple]:
    """Corners of the hull of a few (lat, lon) pairs, counter-clockwise in lon/lat; all points if flat."""
    pts = sorted({(lon, lat) for lat, lon in points})

    def half(seq):
        chain = []
        for p in seq:
            while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                      - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    corners = half(pts) + half(pts[::-1]) if len(pts) > 2 else pts
    if len(corners) < 3:
        corners = pts
    return [(lat, lon) for lon, lat in corners]


_CORNER = "array<struct<lon:double,lat:double>>"


def _chain(points: Column) -> Column:
    """One half of a hull: of points in order, those at which a walk along them turns left.

    The corners kept so far turn left everywhere, so those that a new point makes useless are the last ones.
    """
    def add(chain: Column, p: Column) -> Column:
        def stays(c: Column, i: Column) -> Column:
            before = F.get(chain, i - 1)
            return (i == 0) | ((c["lon"] - before["lon"]) * (p["lat"] - before["lat"]) - (c["lat"] - before["lat"]) * (p["lon"] - before["lon"]) > 0)

        return F.concat(F.filter(chain, stays), F.array(p))

    return F.aggregate(points, F.array().cast(_CORNER), add)


def _corners(df: DataFrame, by: list[str]) -> DataFrame:
    """The hull of each group's points, as an array ``hull`` from the least lon on, counter-clockwise."""
    df = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lon", "lat"))).alias("_p"))
    df = df.withColumns({"_low": _chain(F.col("_p")), "_high": _chain(F.reverse("_p"))})
    cut = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    # Of a single point both halves are it alone, and cutting the last of each would leave nothing.
    return df.select(*by, F.when(F.size("_p") < 2, F.col("_p")).otherwise(F.concat(cut("_low"), cut("_high"))).alias("hull"))


def with_hulls(members: DataFrame, picked: DataFrame) -> DataFrame:
    """Hulls of the picked clusters only, as hulls of hulls.

    Of each longitude only the outermost latitudes can be corners. What is left of a large cluster is dealt to salts, each salt
    gives the corners of its own part, and only those meet. Flat clusters show all their places.
    """
    ids = picked.select("id", "cluster", F.greatest(F.ceil(F.col("n") / HULL_POINTS), F.lit(1)).alias("_salts"))
    points = members.join(ids, "cluster").select("id", "_salts", "lat", "lon")
    outer = points.groupBy("id", "_salts", "lon").agg(F.min("lat").alias("_a"), F.max("lat").alias("_b"))
    outer = outer.select("id", "lon", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("lat"),
                         F.pmod(F.xxhash64("lon"), F.col("_salts")).alias("_salt"))
    parts = _corners(outer, ["id", "_salt"]).select("id", F.explode("hull").alias("_c")).select("id", "_c.lon", "_c.lat")
    hulls = stored(_corners(parts, ["id"]).select("id", "hull"), "hulls")
    flat = points.join(hulls.filter(F.size("hull") < 3).select("id"), "id", "left_semi").select("id", "lon", "lat").distinct()
    flat = flat.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lon", "lat"))).alias("_all"))
    shape = "array<struct<lat:double,lon:double>>"
    swapped = lambda c: F.transform(c, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).cast(shape)
    return picked.join(hulls, "id").join(flat, "id", "left").withColumn(
        "hull", F.coalesce(swapped("_all"), swapped("hull"))).drop("_all")


def clusters(record: DataFrame, eps: float = 550, min_pts: int = 3, hours: float = 12,
             limit: int | None = 300, members: DataFrame | None = None) -> DataFrame:
    """Q4: the largest clusters (all with ``limit=None``) with their hulls and the number of clusters there are."""
    if members is None:                                      # read again rather than written once more
        members = dbscan(record.select("time", "lat", "lon", "frp", "sensor"), eps, min_pts, hours)
    else:
        with finer_scans(record.sparkSession):
            members = stored(members.select("cluster", "lat", "lon", "time", "frp", "sensor"))
    with finer_scans(record.sparkSession):
        picked = stored(largest(cluster_summary(members), limit))
        return with_hulls(members, picked)


# ------------------------------------------------------------------ strata
ROUNDS, STILL = 100, 1e-6


def _passed(points: DataFrame, part, shape: str) -> list:
    """What one pass over all points gives: of each task an array by ``part``, its first axis as rows; a bounded collect.

    ``part`` gets the coordinates and row hashes of a batch and the array of the one before it.
    """
    def run(batches):
        import numpy as np
        import pandas as pd

        total = None
        for batch in batches:
            total = part(batch[["x", "y", "z"]].to_numpy(), batch["h"].to_numpy(), total)
        if total is not None:
            yield pd.DataFrame({"task": [0] * len(total), "v": [np.asarray(t, float).ravel().tolist() for t in total]})

    return [r.v for r in points.mapInPandas(run, shape).collect()]


def nearest_centres(points: DataFrame, k: int, restarts: int, seed: int = 0):
    """(centres, cost) of the best of several K-means fits of columns x, y, z; all of them advance in the same passes.

    Centres begin far apart: each next one is drawn with a chance by its squared distance from those there, by a hash
    of the row (column ``h``) and the restart. A pass moves the centres of every restart; those of a restart that stand still stay.
    """
    import numpy as np

    def far(x, centres):                                     # rows x restarts: squared distance to the nearest centre
        return ((x[:, None, None, :] - centres[None]) ** 2).sum(3).min(2)

    def drawn(step):
        def part(x, h, best):
            weight = np.ones((len(x), restarts)) if not step else far(x, centres[:, :step])
            u = np.stack([_unit(h, 1009 * seed + 101 * step + r) for r in range(restarts)], 1)
            # The least of exponential draws over the weights falls on a row with a chance by its weight.
            draw = np.where(weight > 0, -np.log(u) / np.maximum(weight, 1e-300), np.inf)
            at = draw.argmin(0)
            own = np.column_stack([draw[at, np.arange(restarts)], x[at]])
            return own if best is None else np.where(own[:, :1] < best[:, :1], own, best)

        return part

    centres = np.zeros((restarts, k, 3))
    for step in range(k):
        found = np.array(_passed(points, drawn(step), "task int, v array<double>")).reshape(-1, restarts, 4)
        centres[:, step] = found[found[:, :, 0].argmin(0), np.arange(restarts), 1:]

    def summed(x, h, total):
        gap = ((x[:, None, None, :] - centres[None]) ** 2).sum(3)
        own = gap.argmin(2)
        out = np.zeros((restarts, k, 5))
        for r in range(restarts):
            out[r, :, 0] = np.bincount(own[:, r], minlength=k)
            out[r, :, 4] = np.bincount(own[:, r], gap[np.arange(len(x)), r, own[:, r]], minlength=k)
            for c in range(3):
                out[r, :, 1 + c] = np.bincount(own[:, r], x[:, c], minlength=k)
        return out if total is None else total + out

    for _ in range(ROUNDS):
        parts = np.array(_passed(points, summed, "task int, v array<double>")).reshape(-1, restarts, k, 5)
        total = np.sort(parts, axis=0).sum(0)                # in an order of its own, so that no task's place matters
        n = total[:, :, :1]
        moved = np.where(n > 0, total[:, :, 1:4] / np.maximum(n, 1), centres)
        step = np.abs(moved - centres).max()
        cost = total[:, :, 4].sum(1)
        best = int(cost.argmin())
        if step <= STILL * max(1.0, float(np.abs(centres).max())):
            break
        centres = moved
    return centres[best], float(cost[best])


def _unit(h, salt: int):
    """A number from (0, 1) by a row's hash and a salt."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53 + 2.0 ** -54


def strata_members(record: DataFrame, k: int = 4, restarts: int = 10, seed: int = 0) -> DataFrame:
    """The record's rows with x, y, z (kilometres and power), ``prediction``, their stratum, and ``gaps``, their squared
    distance from the centre of each. Fewer than 3 rows for each stratum give none."""
    centre = record.agg(F.avg("lat").alias("_lat0"), F.count("*").alias("_n"))
    ready = stored(record.join(centre, F.lit(True)).filter(F.col("_n") >= k * 3).select(
        "lat", "lon", "frp", (F.col("lon") * 111.32 * F.cos(F.radians("_lat0"))).alias("x"), (F.col("lat") * 110.57).alias("y"),
        F.col("frp").alias("z"), F.xxhash64("time", "lat", "lon", "sensor").alias("h")), "strata-input")
    if ready.isEmpty():
        return ready.drop("h").withColumns({"gaps": F.array().cast("array<double>"), "prediction": F.lit(0)})
    centres, _ = nearest_centres(ready.select("x", "y", "z", "h"), k, restarts, seed)
    gap = lambda c: sum(((F.col(a) - F.lit(float(v))) * (F.col(a) - F.lit(float(v))) for a, v in zip("xyz", c)), F.lit(0.0))
    out = ready.drop("h").withColumn("gaps", F.array(*[gap(c) for c in centres]))
    return out.withColumn("prediction", (F.array_position("gaps", F.array_min("gaps")) - 1).cast("int"))


def kmeans_strata(record: DataFrame, k: int = 4, restarts: int = 10, seed: int = 0) -> DataFrame:
    """Strata of place and power, the most powerful first.

    Of several restarts the one with the least cost is kept. Fewer than 3 rows per stratum give
    no strata. Kinds are handed out by rank of total power.
    """
    labelled = strata_members(record, k, restarts, seed)
    strata = labelled.groupBy("prediction").agg(
        F.count("*").alias("n"), F.avg("frp").alias("mean_frp"), F.sum("frp").alias("total_frp"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.stddev_samp("lat").alias("_a"), F.stddev_samp("lon").alias("_o"))
    ranked = strata.withColumn("rank", F.row_number().over(over().orderBy(F.col("total_frp").desc(), "prediction")))
    kinds = F.array(*[F.lit(name) for name in S.STRATA_KINDS])
    spread = F.sqrt(F.pow(F.coalesce("_a", F.lit(0.0)) + 1e-6, 2) + F.pow(F.coalesce("_o", F.lit(0.0)) + 1e-6, 2))
    return ranked.select(
        "rank", F.element_at(kinds, F.pmod(F.col("rank") - 1, F.lit(len(S.STRATA_KINDS))) + 1).alias("kind"),
        "n", "mean_frp", "total_frp", "lat", "lon", (spread * 111.32).alias("spread_km"))
