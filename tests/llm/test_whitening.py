"""Whitening against dense eigenvectors and exact whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventcal.llm import queries, whitening


@pytest.mark.parametrize("name, matrix", [
    ("squares", np.diag(np.arange(1, 121.0) ** 2)), ("identity", np.eye(40)), ("zero", np.zeros((5, 5))),
    ("one", np.array([[3.0]])), ("ties", np.diag([5.0] * 7 + [1.0] * 60)), ("low rank", np.diag([4.0, 2.0, 1.0] + [0.0] * 30))])
def test_pairs_are_those_of_a_dense_solver(name, matrix):
    value, vector, residual = whitening.leading_pairs(lambda q: matrix @ q, len(matrix), 16)
    want = np.linalg.eigvalsh(matrix)[::-1][:16]
    assert len(value) == len(want) and np.abs(value - want).max() <= 1e-13 * max(want[0], 1e-300)
    assert np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-13 and residual.max() <= 1e-13 * max(want[0], 1e-300)


def test_a_correlated_matrix():
    rng = np.random.default_rng(3)
    b = rng.standard_normal((2000, 200)) * np.linspace(2, 0.2, 200) @ np.linalg.qr(rng.standard_normal((200, 200)))[0]
    v = b.T @ b / 2000
    value, vector, residual = whitening.leading_pairs(lambda q: v @ q, 200, 16)
    ref, own = np.linalg.eigh(v)
    assert np.abs(value - ref[::-1][:16]).max() < 1e-13 * ref[-1] and residual.max() < 1e-12 * ref[-1]
    assert np.abs(np.abs((own[:, ::-1][:, :16] * vector).sum(0)) - 1).max() < 1e-10


def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(4)
    a = np.diag(np.concatenate([-np.arange(1, 6.0), np.arange(1, 16.0)]))
    b = rng.standard_normal((20, 3))
    x = whitening._minres(lambda q: a @ q, b, 60, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-8


def plain(rows, k=16):
    """{(id, component): row} with whole numbers and a dense solver."""
    x = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, v in x:
        far = [n * a - b for a, b in zip(v, s)]
        w = np.array(far, float) / n @ u / np.sqrt(e)
        out += [(i, c + 1, n, sum(f * f for f in far), abs(float(w[c])), float(e[c] / np.trace(cov))) for c in range(len(e))]
    return sorted(out)


@pytest.fixture
def rows():
    rng = np.random.default_rng(5)
    mix = np.diag(np.linspace(3, 0.3, 24)) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    v = (rng.standard_normal((400, 24)) @ mix).astype(np.float32)
    out = [(i, v[i].tolist()) for i in range(400)]
    return out + [(1000 + i, out[7][1]) for i in range(200)] + [out[3], out[3]]     # a third are copies of one


def compare(got, want):
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    for r, w in zip(got, want):
        assert abs(abs(r.whitened) - w[4]) < 1e-7 and abs(r.explained / w[5] - 1) < 1e-9 and r.identity_error < 1e-10


def test_query_against_a_dense_solver(spark, rows, tmp_path):
    bad = [(2000, None), (2001, [float("nan")] + [0.0] * 23), (2002, [None] + [0.5] * 23), (2003, [float("inf")] * 24), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("d", "n", "x", "data", "id", "v")})
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op11_whitening"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(sorted(got.collect(), key=lambda r: (r.vec_id, r.component)), plain(rows))
    by_id = {}
    for r in got.collect():                                  # one sign for a component in all rows: projections, not their sizes
        by_id.setdefault(r.component, {})[r.vec_id] = r.whitened
    cov = np.array([[by_id[c][i] for c in range(1, 17)] for i in range(400)])
    assert np.abs(cov.T @ cov / 400 - np.outer(cov.mean(0), cov.mean(0)) - np.eye(16)).max() < 1e-6


def test_groups_of_partial_sums(spark, rows, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 1)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df.repartition(5))
    assert model.n == 400 and model.identity_error < 1e-10 and model.residual < 1e-12
    compare(sorted(whitening.whiten(df, model).collect(), key=lambda r: (r.vec_id, r.component)), plain(rows))


@pytest.mark.parametrize("values", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_no_spread_no_component(spark, values):
    df = spark.createDataFrame(values, "vec_id long, embedding array<float>")
    model = whitening.fit(df)
    assert len(model.values) == 0 and whitening.whiten(df, model).count() == 0


def test_few_vectors_have_few_components(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 3.0]), (2, [5.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert len(model.values) == 2 and model.n == 3
    got = whitening.whiten(df, model).collect()
    assert len(got) == 6 and {r.vec_id for r in got} == {None, 2} and model.identity_error < 1e-12


def test_great_numbers(spark):
    big = [(i, [float(i * 2 ** 40), float(-i * i * 2 ** 33)]) for i in range(20)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    got = {(r.vec_id, r.component): r.deviation for r in whitening.whiten(df, model).collect()}
    s = [sum(math.floor(64 * v[c]) for _, v in big) for c in (0, 1)]
    want = {i: sum((20 * math.floor(64 * v[c]) - s[c]) ** 2 for c in (0, 1)) for i, v in big}
    assert got == {(i, c): w if w < 1 << 63 else None for i, w in want.items() for c in (1, 2)}
