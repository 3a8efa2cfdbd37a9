"""Whitening of embeddings by Jacobi-Davidson.

Vectors are taken on a grid of 64 steps a unit, x = floor(64 c) + 1,000,000. The fit list has each different x once. Its
covariance V is never formed: a product of V with a few columns is one job over the fit list, in which each task centres its
vectors and returns the sum of theirs. The leading eigenvectors come from a search space that grows by the solutions of
the projected correction equations (I - QQ')(V - t)(I - QQ') z = -r, a few steps of MINRES for all open pairs at once;
Rayleigh-Ritz in the space gives new pairs, those with a residual of double precision are locked and leave it. The driver
holds only matrices of d rows and a few blocks of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from eventcal.llm.text import give_back
from eventcal.session import stored

COMPONENTS = 16
STEPS, OFFSET = 64, 1_000_000
#: Vectors of the fit list that lie together in a row of it.
BLOCK_ROWS = 4096
#: Steps of MINRES for one correction, and the blocks of columns in the search space before it is cut back.
INNER, BLOCKS = 6, 5
#: Partial sums that are added up in one place.
FAN_IN = 256
EPS = float(np.finfo(float).eps)
#: Eigenvalues below this share of the trace are those of directions without any spread, up to rounding.
LEAST_SHARE = 1e-12


# ------------------------------------------------------------------ eigenpairs
def _minres(apply, b: np.ndarray, steps: int, share: float = 0.05) -> np.ndarray:
    """Approximate solutions of the symmetric, perhaps indefinite systems apply(x) = b, column by column but in one product a step."""
    x = np.zeros_like(b)
    first = np.linalg.norm(b, axis=0)
    live = first > 0
    before, now, beta, old = b.copy(), b.copy(), first.copy(), np.zeros_like(first)
    dbar, epsln, phibar = np.zeros_like(first), np.zeros_like(first), first.copy()
    cs, sn = -np.ones_like(first), np.zeros_like(first)
    w, w2 = np.zeros_like(b), np.zeros_like(b)
    for step in range(steps):
        if not live.any():
            break
        v = np.where(live, now / np.where(live, beta, 1), 0)
        y = apply(v)
        if step:
            y = y - before * (beta / np.where(old > 0, old, 1))
        alfa = (v * y).sum(0)
        y = y - now * (alfa / np.where(live, beta, 1))
        before, now, old = now, y, beta
        beta = np.linalg.norm(y, axis=0)
        oldeps, delta, gbar = epsln, cs * dbar + sn * alfa, sn * dbar - cs * alfa
        epsln, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), 1e-300)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - w1 * oldeps - w2 * delta) / gamma
        x += np.where(live, w * phi, 0)
        live = live & (phibar > share * first) & (beta > 1e-13 * np.abs(alfa))
    return x


def _orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what the columns of t add to an orthonormal space."""
    out = np.zeros((len(t), 0))
    for c in range(t.shape[1]):
        v, space = t[:, c], np.hstack([against, out])
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - space @ (space.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-8:
            v = v / size
            v = v - space @ (space.T @ v)
            out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
    return out


def _ritz(w: np.ndarray, aw: np.ndarray):
    h = w.T @ aw
    value, turn = np.linalg.eigh((h + h.T) / 2)
    return value[::-1], turn[:, ::-1]


def leading_pairs(apply, d: int, k: int, seed: int = 0, inner: int = INNER, rounds: int = 200):
    """(values, vectors, residual norms) of the k greatest eigenvalues of a symmetric non-negative operator, falling.

    ``apply`` multiplies a matrix of d rows. Pairs are locked when their residual is within rounding of the operator's
    norm; where rounding in ``apply`` keeps it above, when it has not halved in ten rounds.
    """
    k = min(k, d)
    if not k:
        return np.zeros(0), np.zeros((d, 0)), np.zeros(0)
    rng = np.random.default_rng(seed)
    width = min(d, k + 4)                                    # a few more than asked, so that the last ones are apart from the rest
    locked, values = np.zeros((d, 0)), np.zeros(0)
    w = _orthonormal(rng.standard_normal((d, width)), locked)
    aw = apply(w)
    norm, least, since = 0.0, np.inf, 0
    for _ in range(rounds):
        value, turn = _ritz(w, aw)
        norm = max(norm, float(np.abs(value).max()))
        open_ = min(k - locked.shape[1], w.shape[1])
        u, au = w @ turn, aw @ turn
        r = au[:, :open_] - u[:, :open_] * value[:open_]
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        tight = size <= 8 * EPS * np.sqrt(d) * norm
        full = locked.shape[1] + w.shape[1] >= d             # the space is all there is: Rayleigh-Ritz is exact in it
        since = 0 if size.max() < least / 2 else since + 1
        least = min(least, size.max())
        done = open_ if full or since >= 10 and size.max() < 1e-10 * norm else int(np.argmin(np.append(tight, False)))
        if done:                                             # the first ones in order leave the search space
            locked, values = np.hstack([locked, u[:, :done]]), np.append(values, value[:done])
            w, aw, value, r = u[:, done:], au[:, done:], value[done:], r[:, done:]
            open_, least, since = open_ - done, np.inf, 0
        else:
            w, aw = u, au
        if locked.shape[1] >= k:
            break
        if w.shape[1] + open_ > BLOCKS * width:              # cut back to the best of the space
            w, aw = w[:, :width], aw[:, :width]
        q = np.hstack([locked, w[:, :open_]])
        clear = lambda x: x - q @ (q.T @ x)                  # noqa: E731, B023
        shift = value[:open_]
        z = _minres(lambda x: clear(apply(clear(x)) - x * shift), -clear(r), inner)     # noqa: B023
        space = np.hstack([locked, w])
        new = _orthonormal(z, space)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, min(open_ or 1, d - space.shape[1]))), space)
        w, aw = np.hstack([w, new]), np.hstack([aw, apply(new)])
    # Once more with fresh products, so that what was summed up over the rounds does not count.
    basis = np.linalg.qr(locked[:, :k])[0]
    product = apply(basis)
    value, turn = _ritz(basis, product)
    vectors = basis @ turn
    return value, vectors, np.linalg.norm(product @ turn - vectors * value, axis=0)


# ------------------------------------------------------------------ vectors
def _grid(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, floor(64 c) one after the other) of the vectors without null or non-finite entries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    value = np.floor(np.asarray(pc.fill_null(flat, np.nan)) * STEPS)
    owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    good = size >= 0
    good[owner[~(np.abs(value) < 2.0 ** 62)]] = False
    return np.flatnonzero(good), size[good], value[good[owner]].astype(np.int64)


def _packed(values: np.ndarray) -> np.ndarray:
    """Rows of numbers as bytes, in the least of three widths that holds all of a row; one row always gives the same bytes."""
    for kind in ("<i2", "<i4"):
        if (values == values.astype(kind)).all():
            return values.astype(kind)
    return values.astype("<i8")


def _unpacked(data: list[bytes], d: int) -> np.ndarray:
    out = np.zeros((len(data), d), np.int64)
    sizes = np.array([len(x) for x in data])
    for width in (2, 4, 8):
        own = np.flatnonzero(sizes == width * d)
        if len(own):
            out[own] = np.frombuffer(b"".join([data[i] for i in own]), f"<i{width}").reshape(-1, d)
    return out


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(d, n, data): the different vectors on the grid, in blocks; d is their length."""
    def pack(batches):
        for batch in batches:
            _, size, value = _grid(batch["v"])
            at = np.concatenate([[0], np.cumsum(size)])
            ds, rows = [], []
            for d in np.unique(size[size > 0]):
                own = np.flatnonzero(size == d)
                x = value[at[own][:, None] + np.arange(d)]
                width = np.where((np.abs(x) < 2 ** 15).all(1), 2, np.where((np.abs(x) < 2 ** 31).all(1), 4, 8))
                for b in (2, 4, 8):
                    some = x[width == b].astype(f"<i{b}")
                    raw = some.tobytes()
                    rows += [raw[i:i + b * d] for i in range(0, len(raw), b * d)]
                ds += [d] * len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ds, np.int32)), pa.array(rows, pa.binary())], ["d", "x"])

    def join(batches):
        for batch in batches:
            length = np.asarray(batch["d"])
            for d in np.unique(length):
                own = batch["x"].filter(pa.array(length == d)).to_pylist()
                for a in range(0, len(own), BLOCK_ROWS):
                    x = _packed(_unpacked(own[a:a + BLOCK_ROWS], int(d)))
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(x)], pa.int64()),
                                                      pa.array([x.tobytes()], pa.binary())], ["d", "n", "data"])
            give_back()

    packed = vectors.select(F.col(vec_col).alias("v")).mapInArrow(pack, "d int, x binary").distinct()
    return stored(packed.mapInArrow(join, "d int, n long, data binary"), "fitlist")


def _block(n: int, d: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // max(1, n * d)}").reshape(n, d).astype(np.int64)


def _summed(blocks: DataFrame, part, shape: tuple, exact: bool = False) -> np.ndarray:
    """The sum of part(block) over all blocks: each task returns one sum; beyond FAN_IN tasks, groups of them are added up first."""
    kind = "<i8" if exact else "<f8"

    def run(batches):
        total = None
        for batch in batches:
            for d, n, data in zip(*[batch[c].to_pylist() for c in ("d", "n", "data")]):
                own = part(_block(n, d, data))
                total = own if total is None else total + own
        if total is not None:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.astype(kind).tobytes()], pa.binary())], ["task", "sum"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = sum(np.frombuffer(x, kind) for x in table["sum"].to_pylist())
        return pa.table({"task": table["task"][:1], "sum": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.mapInArrow(run, "task long, sum binary")
    if blocks.rdd.getNumPartitions() > FAN_IN:
        groups = int(np.ceil(blocks.rdd.getNumPartitions() / FAN_IN))
        sums = sums.groupBy(F.pmod("task", F.lit(groups))).applyInArrow(add, "task long, sum binary")
    rows = sorted(sums.collect(), key=lambda r: r["task"])
    return sum((np.frombuffer(r["sum"], kind) for r in rows), np.zeros(int(np.prod(shape)), kind)).reshape(shape)


@dataclass
class Whitening:
    n: int                       # vectors of the fit list
    sums: np.ndarray             # of each dimension, of floor(64 c)
    values: np.ndarray           # eigenvalues, falling
    vectors: np.ndarray          # d x components
    trace: float
    residual: float              # the largest, as a share of the greatest eigenvalue
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray | None:
    """n x - S as whole numbers, or None where they may not fit."""
    most = max(float(np.abs(x).max(initial=0)) * n, float(np.abs(sums).max(initial=0)))
    return n * x - sums if most < 2.0 ** 61 else None


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    whole = _deviations(x, n, sums)
    return whole / n if whole is not None else (x.astype(object) * n - sums.astype(object)).astype(float) / n


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, seed: int = 0) -> Whitening:
    """The leading components of the different vectors on the grid.

    Vectors that are null, or hold null or non-finite entries (or ones whose grid number is 2^62 or more), are left out. All
    vectors of a table have one length; where some have another, the length that most of the different vectors have counts (of
    equally many the longest) and the others are left out. No vectors, and vectors without any spread, give no component.
    """
    blocks = fit_list(vectors, vec_col)
    lengths = blocks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0.0)
    d, n = lengths[0]["d"], lengths[0]["n"]
    blocks = blocks.filter(F.col("d") == d)
    sums = _summed(blocks, lambda x: x.sum(0), (d,), exact=True)
    trace = float(_summed(blocks, lambda x: (_centred(x, n, sums) ** 2).sum(keepdims=True), (1,))[0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return _summed(blocks, part, q.shape) / n if q.shape[1] else q

    values, basis, residual = leading_pairs(apply, d, components, seed)
    keep = values > LEAST_SHARE * trace if trace > 0 else np.zeros(len(values), bool)
    values, basis, residual = values[keep], basis[:, keep], residual[keep]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1) if len(values) else basis
    k, scaled = len(values), basis / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        t = _centred(x, n, sums) @ scaled
        return t.T @ t

    error = float(np.abs(_summed(blocks, spread, (k, k)) / n - np.eye(k)).max()) if k else 0.0
    return Whitening(n, sums, values, basis, trace, float(residual.max() / values[0]) if k else 0.0, error)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every vector that ``fit`` does not leave out.

    A row for each component from 1 on. ``deviation`` is the sum over dimensions of (n x - S)^2, exact, and null beyond a long.
    ``whitened``: x - S / n on the component, over the root of its eigenvalue; ``explained``: its share of the trace. Rows that
    repeat an id or a vector, and null ids, are whitened one by one; other columns are not read.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(model)        # d x components numbers
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [S.IntegerType(), S.LongType(), S.LongType(), S.DoubleType(), S.DoubleType(), S.DoubleType()]
    schema = S.StructType([rows.schema["id"], *[S.StructField(c, t) for c, t in zip(names[1:], kinds)]])

    def run(batches):
        m = sent.value
        d, k = m.vectors.shape
        scaled = m.vectors / np.sqrt(m.values) if k else m.vectors
        for batch in batches:
            which, size, value = _grid(batch["v"])
            own = which[size == d]
            if not k or not len(own):
                continue
            x = value[np.repeat(size == d, size)].reshape(-1, d)
            white = m.centred(x) @ scaled
            whole = _deviations(x, m.n, m.sums)
            if whole is not None and float(np.abs(whole).max()) ** 2 * d < 2.0 ** 62:
                far = (whole * whole).sum(1).tolist()
            else:
                far = [sum(v * v for v in row) for row in (x.astype(object) * m.n - m.sums.astype(object))]
                far = [v if v < 1 << 63 else None for v in far]
            rows = np.repeat(np.arange(len(own)), k)
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(pa.array(own[rows])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                pa.array(np.full(len(rows), m.n)), pa.array(far, pa.int64()).take(pa.array(rows)), pa.array(white.ravel()),
                pa.array(np.tile(m.values / m.trace, len(own))), pa.array(np.full(len(rows), m.identity_error))], names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
