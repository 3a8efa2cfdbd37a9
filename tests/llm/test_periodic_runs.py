"""Periodic runs and the extensions they rest on, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventcal.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """(start, end, period), each stretch with its least period: for each period the stretches of words like the one behind."""
    found, w = {}, np.unique(np.array(w, dtype=str), return_inverse=True)[1]
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if e - s + q >= max(6, 4 * q):
                found.setdefault((int(s), int(e) + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    w = planted(doc_id, text)
    runs = plain_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(rng, n):
    for _ in range(n):
        kind = rng.choice([1, 2, 3, 10])
        w = [rng.randrange(kind) for _ in range(rng.randrange(0, 120))]
        if w and rng.random() < .6:
            a = rng.randrange(len(w))
            p = 1 + rng.randrange(max(1, (len(w) - a) // 4 + 1))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        yield w


def test_runs_and_extensions_of_batches():
    rng = random.Random(3)
    for _ in range(250):
        docs = list(texts(rng, rng.randrange(1, 6)))
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        words = np.array(sum(docs, []), np.int64)
        got = sorted(zip(*[x.tolist() for x in periodic_runs.runs_of(words, off)]))
        assert got == sorted((s + int(o), e + int(o), q) for d, o in zip(docs, off) for s, e, q in plain_runs(d))
        if len(words) > 5:
            own = periodic_runs.Extensions(words)
            i = np.array([rng.randrange(len(words) - 1) for _ in range(50)])
            j = np.array([rng.randrange(a + 1, len(words)) for a in i])
            ahead = [next((k for k in range(len(words)) if b + k == len(words) or words[a + k] != words[b + k])) for a, b in zip(i, j)]
            back = [next((k for k in range(len(words) + 1) if a - k < 0 or words[a - k] != words[b - k])) for a, b in zip(i, j)]
            assert own.forward(i, j).tolist() == ahead and own.backward(i, j).tolist() == back


def test_a_grid_in_small_pieces(monkeypatch):
    rng = random.Random(5)
    docs = list(texts(rng, 40))
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    words = np.array(sum(docs, []), np.int64)
    whole = [x.tolist() for x in periodic_runs.runs_of(words, off)]
    monkeypatch.setattr(periodic_runs, "GRID_PLACES", 7)
    assert [x.tolist() for x in periodic_runs.runs_of(words, off)] == whole


def test_the_grammar_is_logarithmic_in_a_power():
    assert len(periodic_runs.grammar(np.zeros(1_000_000, np.int64))) <= 3
    levels = periodic_runs.grammar(np.tile(np.random.default_rng(1).integers(0, 50, 300), 2_000))
    assert len(levels) < 60 and sum(len(x.symbols) for x in levels) < 8 * 600_000


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_query_on_odd_tables(request, spark, table, tmp_path):
    rows = [(100 + k, "z " + "a b c " * (k % 7) + "d " * k, "en", "a", 1) for k in range(60)]
    df = request.getfixturevalue(table)
    df = df.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 20


def test_outputs_of_the_operator(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, None)], "k long, t string")
    got = {r.k: r for r in periodic_runs.find_runs(df, "k", "t").collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "x a b y" and got[1].n_words == 10
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].n_words == 0


def test_nothing(nothing):
    assert periodic_runs.find_runs(nothing).count() == 0


def test_one_long_text(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    w += w[-30_000:] * 4
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    row = periodic_runs.find_runs(df).select(periodic_runs.longest().alias("r"), F.col("n_words")).first()
    assert tuple(row.r) == (170_000, 150_000, 30_000) and row.n_words == 320_000
