"""Substring, suffix and Jaccard dedup against plain loops over all texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from eventcal.llm import jaccard_join, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def first_id(i):
    return float("inf") if i is None else i


def plain_repeats(rows, units, size):
    """Per row: which units lie in a window that also starts at a smaller (id, start)."""
    least = {}
    for i, text in rows:
        u = units(text)
        for k in range(len(u) - size + 1):
            w, at = tuple(u[k:k + size]), (first_id(i), k)
            least[w] = min(least.get(w, at), at)
    out = []
    for i, text in rows:
        u = units(text)
        gone = [False] * len(u)
        for k in range(len(u) - size + 1):
            if least[tuple(u[k:k + size])] < (first_id(i), k):
                gone[k:k + size] = [True] * size
        out.append((i, u, gone))
    return out


def key(x):
    return tuple((v is None, str(v)) for v in x)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_substrings(request, table):
    df = request.getfixturevalue(table)
    for window, chunk in ((20, 3_000_000), (5, 2_000)):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in
                      substring_dedup.dedup_substrings(df, window, chunk_bytes=chunk).collect()), key=key)
        plain = plain_repeats([(r.doc_id, r.text) for r in df.collect()], lambda t: WORD.findall(t or ""), window)
        assert got == sorted(((i, len(u), sum(g), " ".join(w for w, x in zip(u, g) if not x)) for i, u, g in plain), key=key)


@pytest.mark.parametrize("hot", [30_000, 2])
@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_suffixes(request, table, hot):
    df = request.getfixturevalue(table)
    for length, chunk in ((100, 2_000_000), (13, 3_000)):
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in
                      suffix_dedup.dedup_suffixes(df, length, chunk_bytes=chunk, hot_anchor=hot).collect()), key=key)
        plain = plain_repeats([(r.doc_id, r.text) for r in df.collect()], lambda t: (t or "").encode(), length)
        want = [(i, len(u), sum(g), len(re.findall("1+", "".join("01"[x] for x in g))), bytes(b for b, x in zip(u, g) if not x)) for i, u, g in plain]
        assert got == sorted(want, key=key)


def test_columns_are_the_suffix_order():
    rng = random.Random(3)
    for _ in range(40):
        texts, left = [], []
        for _ in range(rng.randrange(1, 12)):
            a, b = rng.randrange(0, 9), rng.randrange(1, 9)
            texts.append(bytes(rng.choice(b"ab") for _ in range(a + b)))
            left.append(a)
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for column, order, common in suffix_dedup.columns(data, at, np.array(left)):
            here = [(texts[i][left[i] + column:], i) for i in range(len(texts)) if 0 <= left[i] + column < len(texts[i])]
            # End signs are less than all symbols, and by text number.
            want = sorted(here, key=lambda x: ([c + 1000 for c in x[0]] + [x[1]]))
            assert [i for _, i in want] == order.tolist()
            for k in range(1, len(want)):
                a, b = want[k - 1][0], want[k][0]
                same = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                assert common[k] == same


def shingles(text, size=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(held):
        for j, t in held[:k]:
            if 100 * len(s & t) >= 80 * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=key)


@pytest.mark.parametrize("block_rows", [500, 3])
@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_components(request, table, block_rows):
    df = request.getfixturevalue(table)
    got = jaccard_join.jaccard_components(df, block_rows=block_rows, chunk_bytes=3_000)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == plain_components(
        [(r.doc_id, r.text) for r in df.collect()])


def test_near_copies_around_the_threshold(spark):
    """Groups of near copies with similarities around 0.8, where chains of links matter."""
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(10_000)}" for _ in range(70)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[f"e{rng.randrange(9)}"], [], [w[at], "more"]])
            rows.append((100 * g + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert 6 < len({c for *_, c in want}) < 150
    for block_rows in (500, 7):
        got = jaccard_join.jaccard_components(df, block_rows=block_rows)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == want


def test_filters_of_several_orders_agree():
    """One order or five: the filters only save work."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.sort(np.where(rng.random(100) < 0.07, rng.integers(0, 1 << 60, 100, dtype=np.uint64), base)) for _ in range(60)]
    n, own = np.full(60, 100), np.zeros(60, int)
    labels = [jaccard_join.link(n, own, sets, None, 80, orders).tolist() for orders in (1, 3, 5)]
    assert labels[0] == labels[1] == labels[2] and 1 < len(set(labels[0])) < 60


def test_empty(nothing):
    assert substring_dedup.dedup_substrings(nothing).count() == 0
    assert suffix_dedup.dedup_suffixes(nothing).count() == 0
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_hashes_do_not_depend_on_neighbours():
    from eventcal.llm import text as T

    buf = np.frombuffer(b"one two one two one", np.uint8)
    s, e, _ = T.spans(buf, np.array([0, len(buf)]), T.NOT_SPACE)
    h = T.hash_spans(buf, s, e)
    assert Counter(h.tolist()).most_common(1)[0][1] == 3
    w = T.hash_windows(h, 2)
    assert w[0] == w[2] and w[0] != w[1]
