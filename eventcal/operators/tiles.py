"""Density clustering tile by tile.

A tile is a cube of ``EDGE`` reaches; it also sees the positions around it up to two reaches away (its halo), so it knows by itself
which of its own positions, and of those within one reach of it, are cores, and which of these are in reach of each other. Each
tile gives its groups a label; a core that several tiles see ties their labels together. Only such ties meet in the
whole, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reaches along the edge of a tile; and on each side of it.
EDGE, HALO = 16, 2
WIDE = EDGE + 2 * HALO
#: More than the cells of the diagonal of one reach along a tile and its halo, and two steps beyond on both sides.
CELLS = 48
#: Pairs of positions compared at a time in a task, and positions for tiles solved at a time in it.
PAIRS, PART_SPOTS = 250_000, 25_000
AXES = ("x", "y", "t")
TILE = ("kx", "ky", "kt")
#: What a row says: a core of the tile, a position of the tile next to a core, a core that another tile holds.
CORE, BORDER, SHARED = 0, 1, 2
#: In rows of ``found_schema``: a core that other tiles know too, and a label in reach of a border position that has several.
EDGE_CORE, CHOICE = 3, 4
PLACE = ("us", "lat", "lon")
FOUND = "pid long, label long, role int, us long, lat double, lon double"


def with_buckets(points: DataFrame, eps: float) -> DataFrame:
    """Columns gx, gy, gt: the bucket of one reach that each position is in; and kx, ky, kt: its tile."""
    points = points.withColumns({f"g{a}": F.floor(F.col(a) / eps) for a in AXES})
    return points.withColumns({k: F.floor(F.col(f"g{a}") / EDGE) for k, a in zip(TILE, AXES)})


def seen_by(points: DataFrame) -> DataFrame:
    """Each position once for every tile that sees it, as columns kx, ky, kt; ``own`` where it lies in the tile."""
    def around(a: str, k: str) -> Column:
        place = F.pmod(f"g{a}", F.lit(EDGE))
        return F.filter(F.array(*[F.when(near, F.lit(step)) for near, step in (
            (F.lit(True), 0), (place < HALO, -1), (place >= EDGE - HALO, 1))]), lambda s: s.isNotNull())

    out = points.withColumns({f"home_{k}": F.col(k) for k in TILE})
    for a, k in zip(AXES, TILE):
        out = out.withColumn("_s", F.explode(around(a, k))).withColumn(k, F.col(k) + F.col("_s")).drop("_s")
    own = F.lit(True)
    for k in TILE:
        own = own & (F.col(k) == F.col(f"home_{k}"))
    return out.withColumn("own", own).drop(*[f"home_{k}" for k in TILE])


def _merge(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each node's connected group."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:                                          # shorten the chains
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
        if (before == label).all() and len(u):
            raise RuntimeError("labels stand still")
    return label


def _meet(left: np.ndarray, right: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Blocks of (i, j, which): each position of cell ``left[which]`` with each of cell ``right[which]``, at most about PAIRS at a time."""
    rows = np.repeat(np.arange(len(left)), size[left])       # a row for each position on the left
    at = np.repeat(first[left], size[left]) + _ramp(size[left])
    edge = np.cumsum(size[right[rows]])
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(edge, (edge[low - 1] if low else 0) + PAIRS, side="right")))
        which = rows[low:high]
        many = size[right[which]]
        yield np.repeat(at[low:high], many), np.repeat(first[right[which]], many) + _ramp(many), np.repeat(which, many)
        low = high


def _around(code: np.ndarray, left: np.ndarray, steps: np.ndarray):
    """(a, b) of each step: the cells of ``left`` that have a cell one such step further, and these."""
    for step in steps:
        at = np.minimum(np.searchsorted(code, code[left] + step), len(code) - 1)
        hit = code[at] == code[left] + step
        yield left[hit], at[hit]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each size, one after the other."""
    edge = np.cumsum(sizes)
    return np.arange(edge[-1] if len(edge) else 0) - np.repeat(edge - sizes, sizes)


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The labels when the groups of ``u`` and ``v`` are one each."""
    u, v = label[u], label[v]
    open_ = u != v
    return _merge(len(label), u[open_], v[open_])[label] if open_.any() else label


def _gaps(at: list, i, j) -> np.ndarray:
    far = np.zeros(len(i))
    for c in at:
        d = c[i] - c[j]
        far += d * d
    return far


def solve(points: pd.DataFrame, eps: float, min_pts: int) -> pd.DataFrame:
    """Rows of FOUND of all tiles of a group; a label is the least pid of the cores that a tile sees together.

    Two tiles that give the same label see the same core, so equal labels mean one cluster. Positions lie in cells of the diagonal
    ``eps``. All of a cell of ``min_pts`` or more are cores of one group, so only positions of other cells are compared with those around
    them, and two such cells only until they are known to be in one group. Pairs are seen in blocks and never kept, so memory grows
    with the positions, however dense they lie.
    """
    tile = points.groupby(list(TILE), sort=True).ngroup().to_numpy()
    side = eps / math.sqrt(3) * (1 - 1e-9)
    code = tile.astype(np.int64)
    for a, k in zip(AXES, TILE):
        corner = np.floor((points[k].to_numpy() * EDGE - HALO) * eps / side)
        code = code * CELLS + (np.floor(points[a].to_numpy() / side) - corner).astype(np.int64) + 3
    pid = points["pid"].to_numpy()
    order = np.lexsort((pid, code))
    code, pid = code[order], pid[order]
    weight, own = points["w"].to_numpy()[order].astype(np.int64), points["own"].to_numpy()[order]
    at = [points[a].to_numpy()[order] for a in AXES]
    # Whether a position is a core is known up to one reach around the tile.
    place = [(points[f"g{a}"].to_numpy() - points[k].to_numpy() * EDGE + HALO)[order] for a, k in zip(AXES, TILE)]
    known = np.logical_and.reduce([(p >= HALO - 1) & (p < WIDE - HALO + 1) for p in place])
    n = len(code)
    cells, first, cell = np.unique(code, return_index=True, return_inverse=True)
    size = np.diff(np.append(first, n))
    dense = np.add.reduceat(weight, first) >= min_pts
    sparse = np.flatnonzero(~dense)
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3)]
    number = lambda chosen: np.array([(i * CELLS + j) * CELLS + k for i, j, k in chosen])

    def reached():
        """(p, q): positions of sparse cells and those in reach of each."""
        for a, b in _around(cells, sparse, number(steps)):
            for i, j, _ in _meet(a, b, first, size):
                near = _gaps(at, i, j) <= eps * eps
                yield i[near], j[near]

    degree = np.where(dense[cell], min_pts, 0)
    for p, q in reached():
        degree += np.bincount(p, weight[q], n).astype(np.int64)
    core = (degree >= min_pts) & known

    # The cores of a dense cell are one group, named by the first of them.
    label = np.arange(n)
    together = np.flatnonzero(core & dense[cell])
    head = np.full(len(cells), n)
    np.minimum.at(head, cell[together], together)
    label[together] = head[cell[together]]
    label = _linked(label, at, together, cell, cells, eps, [s for s in steps if s > (0, 0, 0)], number)
    fringe_p, fringe_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in reached():
        both = core[p] & core[q]
        label = _joined(label, p[both], q[both])
        # What is no core is known by the group of the cores around: of a dense cell one stands for all.
        for x, y in ((p, q), (q, p)):
            edge = own[x] & ~core[x] & core[y]
            x, y = x[edge], y[edge]
            y = np.where(dense[cell[y]], head[cell[y]], y)
            x, y = np.divmod(np.unique(x * n + y), n)
            fringe_p.append(x)
            fringe_q.append(y)
    # Positions are ordered by cell, not by pid: the least pid of each group names it.
    name = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(name, label[core], pid[core])
    label = name[label]
    parts = [(np.flatnonzero(core & own), CORE), (np.flatnonzero(core & ~own), SHARED)]
    parts = [(p, label[p], role) for p, role in parts]
    parts.append((np.concatenate(fringe_p), label[np.concatenate(fringe_q)], BORDER))
    which, names, roles = (np.concatenate(x) for x in zip(*[(p, x, np.full(len(p), r, np.int32)) for p, x, r in parts]))
    rows = pd.DataFrame({"at": which, "label": names, "role": roles}).drop_duplicates()
    which = rows["at"].to_numpy()
    return pd.DataFrame({"pid": pid[which], "label": rows["label"].to_numpy(), "role": rows["role"].to_numpy(),
                         **{c: points[c].to_numpy()[order][which] for c in PLACE}})


def _linked(label, at, together, cell, cells, eps, steps, number) -> np.ndarray:
    """The labels when dense cells with two cores in reach of each other are one group; ``together`` are the cores of dense cells."""
    if not len(together):
        return label
    held, first = np.unique(cell[together], return_index=True)
    size, code = np.diff(np.append(first, len(together))), cells[held]
    low = [np.minimum.reduceat(c[together], first) for c in at]
    high = [np.maximum.reduceat(c[together], first) for c in at]
    open_a, open_b = [], []
    for a, b in _around(code, np.arange(len(held)), number(steps)):
        near, far = np.zeros(len(a)), np.zeros(len(a))
        for lo, hi in zip(low, high):
            d = np.maximum(0.0, np.maximum(lo[a] - hi[b], lo[b] - hi[a]))
            near += d * d
            d = np.maximum(hi[a] - lo[b], hi[b] - lo[a])
            far += d * d
        sure = far <= eps * eps
        label = _joined(label, together[first[a[sure]]], together[first[b[sure]]])
        left = ~sure & (near <= eps * eps)
        open_a.append(a[left])
        open_b.append(b[left])
    a, b = np.concatenate(open_a), np.concatenate(open_b)
    while len(a):
        apart = label[together[first[a]]] != label[together[first[b]]]
        a, b = a[apart], b[apart]
        some = max(1, int(np.searchsorted(np.cumsum(size[a] * size[b]), PAIRS, side="right")))
        for i, j, which in _meet(a[:some], b[:some], first, size):
            hit = np.unique(which[_gaps(at, together[i], together[j]) <= eps * eps])
            label = _joined(label, together[first[a[hit]]], together[first[b[hit]]])
        a, b = a[some:], b[some:]
    return label


def parts(points: pd.DataFrame) -> list[pd.DataFrame]:
    """The positions of a group's tiles, whole tiles at a time, about PART_SPOTS each: tiles know nothing of each other."""
    tile = points.groupby(list(TILE), sort=True).ngroup().to_numpy()
    size = np.bincount(tile)
    part = ((np.cumsum(size) - size) // PART_SPOTS)[tile]
    return [points[part == number] for number in np.unique(part)]


def edges(found: pd.DataFrame, eps: float) -> pd.DataFrame:
    """(pid, label) of cores known to two tiles or more, from rows of ``solve`` with their places: one core for all that stand for the same.

    Cores of one cell that lie in one bucket are in reach of each other, and a tile that knows one knows all. So the least of them
    tells as much as all, and every tile takes the same one.
    """
    side = eps / math.sqrt(3) * (1 - 1e-9)
    bucket = [np.floor(found[a].to_numpy() / eps) for a in AXES]
    step = [b % EDGE for b in bucket]
    outer = np.logical_or.reduce([(b == 0) | (b == EDGE - 1) for b in step])
    role = found["role"].to_numpy()
    chosen = (role == SHARED) | ((role == CORE) & outer)
    by = {f"g{a}": b[chosen] for a, b in zip(AXES, bucket)} | {f"c{a}": np.floor(found[a].to_numpy()[chosen] / side) for a in AXES}
    told = found.loc[chosen, ["pid", "label", "role"]].reset_index(drop=True).assign(**by)
    return told.groupby(["role", "label", *by], sort=False)["pid"].min().reset_index()[["pid", "label", "role"]]


def found_in_tiles(seen: DataFrame, eps: float, min_pts: int, groups: int, hours: float, narrow: float) -> DataFrame:
    """Rows of ``found_schema`` from rows as ``seen_by`` gives them; tiles are dealt to so many groups.

    Only the rows and the tile that sees each are sent; the rest is worked out again from the place (``narrow`` is the
    cosine of the latitude). A label is the first core place, by time, lat and lon, of those that a tile sees together.
    """
    own_columns = [f for f in seen.schema if f.name not in (*AXES, *[f"g{a}" for a in AXES], *TILE, "own")]
    schema = found_schema(T.StructType(own_columns))
    names = [f.name for f in own_columns]

    def run(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        us = pc.cast(group["time"], pa.int64()).to_numpy()
        # Added to zero, the negative zero is the positive one.
        lat, lon = (group[c].to_numpy() + 0.0 for c in ("lat", "lon"))
        # The places in order, so that the least number is the first place.
        order = np.lexsort((lon, lat, us))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([np.diff(c[order]) != 0 for c in (us, lat, lon)])
        pid = np.empty(len(order), np.int64)
        pid[order] = np.cumsum(new) - 1
        at = order[new]
        place = {"us": us[at], "lat": lat[at], "lon": lon[at]}
        x = {"x": place["lon"] * 111320.0 * narrow, "y": place["lat"] * 110540.0, "t": place["us"] / 3.6e9 / hours * eps}
        home = [np.floor(np.floor(v / eps) / EDGE).astype(np.int64) for v in x.values()]
        step = group["_step"].to_numpy().astype(np.int64)
        tile = [h[pid] + step // n % 3 - 1 for h, n in zip(home, (9, 3, 1))]
        points = pd.DataFrame({"pid": pid, **dict(zip(TILE, tile)), "own": step == 13})
        points = points.groupby([*TILE, "pid", "own"], sort=False).size().rename("w").reset_index()
        points = points.assign(**{c: v[points["pid"].to_numpy()] for c, v in (place | x).items()})
        points = points.assign(**{f"g{a}": np.floor(points[a].to_numpy() / eps).astype(np.int64) for a in AXES})
        found = [solve(part, eps, min_pts) for part in parts(points)]
        told = pd.concat([edges(f.assign(**{a: v[f["pid"].to_numpy()] for a, v in x.items()}), eps) for f in found], ignore_index=True)
        found = pd.concat(found, ignore_index=True)
        found = found[found["role"] != SHARED]
        label, role = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int32)
        label[found["pid"].to_numpy()], role[found["pid"].to_numpy()] = found["label"].to_numpy(), found["role"].to_numpy()
        # A border position has a row for each label in reach; the rows of one that has several get theirs when all clusters are known.
        many = found[found["pid"].duplicated(keep=False)]
        label[many["pid"].to_numpy()] = -1
        times = pa.array(place["us"]).cast(group.schema.field("time").type)

        def struct(pid, known):
            take = lambda v: v.take(pa.array(pid))
            fields = [take(times), pa.array(place["lat"][pid]), pa.array(place["lon"][pid])]
            return pa.StructArray.from_arrays(fields, ["time", "lat", "lon"], mask=pa.array(~known))

        rows = np.flatnonzero((step == 13) & (role[pid] >= 0))
        kept = group.select(names).take(pa.array(rows))
        own = label[pid[rows]]
        kept = kept.append_column("role", pa.array(role[pid[rows]], pa.int32())).append_column("label", struct(np.maximum(own, 0), own >= 0))
        kept = kept.append_column("at", struct(np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)))
        told = pd.concat([told.assign(role=np.where(told["role"] == CORE, EDGE_CORE, SHARED)), many.assign(role=CHOICE)[["pid", "label", "role"]]])
        p, l = told["pid"].to_numpy(), told["label"].to_numpy()
        links = {n: pa.nulls(len(told), group.schema.field(n).type) for n in names}
        links |= {"role": pa.array(told["role"].to_numpy(), pa.int32()), "label": struct(l, l >= 0), "at": struct(p, p >= 0)}
        return pa.concat_tables([kept.combine_chunks(), pa.table(links).cast(kept.schema)])

    home = [F.floor(F.col(f"g{a}") / EDGE) for a in AXES]
    step = sum(((F.col(k) - h + 1) * n for k, h, n in zip(TILE, home, (9, 3, 1))), F.lit(0)).cast("int")
    dealt = seen.select(F.pmod(F.xxhash64(*TILE), F.lit(groups)).alias("_group"), *names, step.alias("_step"))
    # Dealt by number: by size alone Spark would put a few small groups, each with much to compute, into one task.
    return dealt.repartition(groups, "_group").groupBy("_group").applyInArrow(run, schema)


def found_schema(record: T.StructType) -> T.StructType:
    """Of the rows of a record the role (CORE or BORDER) and the label, null where a border place has several in reach; and rows
    without them that tell of a place ``at`` the label that a tile gives it: a core that others know (EDGE_CORE), a core of
    another tile (SHARED), a border position with several labels (CHOICE)."""
    place = T.StructType([T.StructField("time", record["time"].dataType), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
    rows = [T.StructField(f.name, f.dataType) for f in record]
    return T.StructType([*rows, T.StructField("role", T.IntegerType()), T.StructField("label", place), T.StructField("at", place)])
