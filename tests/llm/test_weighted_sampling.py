"""Fingerprints against generalised Jaccard and plain versions of the samples and of the edited texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventcal.llm import queries, weighted_sampling as ws

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def terms(text, size=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = terms(a), terms(b)
    both = set(a) | set(b)
    return sum(min(a[t], b[t]) for t in both) / sum(max(a[t], b[t]) for t in both) if both else 1.0


def plain_edits(rows):
    """{(id, text): (n_chars, edited)} by the order of ids; texts of one id are not compared."""
    each = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    out = {}
    for k, (there, i, t) in enumerate(each):
        n = len(t)
        out[(i if there else None, t)] = (n, t[:n - n // 4] + each[(k + 1) % len(each)][2][:n // 4])
    return out


def test_share_of_equal_samples_is_generalised_jaccard(spark):
    rng = random.Random(2)
    pairs = []
    for share in (0.1, 0.3, 0.6, 0.9):
        a = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
        b = [w if i < share * 120 else f"v{rng.randrange(10 ** 6)}" for i, w in enumerate(a)]
        pairs.append((" ".join(a + a[:40] * 3), " ".join(b + b[:40])))            # weights of up to four
    pairs.append(("x y z v w " * 50, "x y z v w " * 20))                          # the same terms with other weights
    rows = [(2 * i + s, t) for i, p in enumerate(pairs) for s, t in enumerate(p)]
    samples = 256
    got = {r.doc_id: r.fingerprint for r in ws.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), samples=samples).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = ([got[2 * i + s][k:k + ws.HEX] for k in range(0, ws.HEX * samples, ws.HEX)] for s in (0, 1))
        want = jaccard(a, b)
        assert abs(sum(p == q for p, q in zip(x, y)) / samples - want) < 4 * math.sqrt(want * (1 - want) / samples) + 0.01


def test_many_pairs_have_no_bias(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(300):
        a = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
        b = a[:36] + [f"v{rng.randrange(10 ** 6)}" for _ in range(24)]
        a, b = a + a[:20] * rng.randrange(3), b + b[:20] * rng.randrange(3)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        want.append(jaccard(" ".join(a), " ".join(b)))
    df = ws.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    left, right = df.filter("doc_id % 2 = 0"), df.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fingerprint").alias("other"))
    got = left.join(right, "doc_id").select(F.avg(ws.likeness(F.col("fingerprint"), F.col("other")))).first()[0]
    assert abs(got - sum(want) / len(want)) < 0.02


def test_samples_are_those_of_the_formula(spark):
    """Ranks and samples recomputed in Python from the same hashes."""
    term, weight = 123456789012345, 3.0
    row = spark.range(1).select(*[ws._sample(F.lit(term), F.ln(F.lit(weight)), k).alias(f"s{k}") for k in range(8)],
                                *[F.xxhash64(F.lit(term), F.lit(j)).alias(f"h{j}") for j in range(16)]).first()
    for k in range(8):
        one, two = row[f"h{2 * k}"] % 2 ** 64, row[f"h{2 * k + 1}"] % 2 ** 64
        gamma = lambda x: -math.log(((x >> 37) + 0.5) * 2.0 ** -27 * ((x >> 10) % 2 ** 27 + 0.5) * 2.0 ** -27)
        r, c, b = gamma(one), gamma(two), (one % 1024 * 1024 + two % 1024 + 0.5) / 2 ** 20
        t = math.floor(math.log(weight) / r + b)
        rank = math.log(c) - r * (t - b + 1)
        assert abs((row[f"s{k}"] >> ws.OWN_BITS) / ws.RANK_STEP - (rank + 128)) < 1e-8
        assert row[f"s{k}"] % (1 << ws.OWN_BITS) == (two ^ t) % (1 << ws.OWN_BITS)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_query_on_odd_tables(request, spark, table, tmp_path):
    df = request.getfixturevalue(table)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op12_fingerprints"](spark, str(tmp_path)).collect()
    want = plain_edits([(r.doc_id, r.text) for r in df.collect()])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(
        (r.doc_id is None, r.doc_id or 0, want[(r.doc_id, r.text or "")][0],
         hashlib.sha256(want[(r.doc_id, r.text or "")][1].encode()).hexdigest()) for r in df.collect())
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[None].fingerprint and by_id[1].near_next == 1.0
    assert by_id[4].fingerprint == by_id[5].fingerprint == by_id[6].fingerprint == ws.EMPTY * ws.SAMPLES
    assert by_id[4].near_next == by_id[4].near_edited == 1.0 and by_id[6].near_next == 0.0
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next)) and by_id[3].near_next == 0.0
    alone = {(r.doc_id, r.fingerprint) for r in ws.fingerprint(df).collect()}
    assert alone == {(r.doc_id, r.fingerprint) for r in got}
    edited = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want.values())], "doc_id long, text string")
    own = dict(zip(want, [None] * len(want)))
    for r in ws.fingerprint(edited).collect():
        own[list(want)[r.doc_id]] = r.fingerprint
    assert {(r.doc_id, r.edited_fingerprint) for r in got} == {(i, f) for (i, _), f in own.items()}


def test_ids_that_repeat_with_other_texts(spark):
    rows = [(1, "a b c d e f g h"), (1, "i j k l m n o p"), (1, "a b c d e f g h"), (2, "q r s t u v w x")]
    got = ws.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.doc_id for r in got) == [1, 1, 1, 2] and len({r.fingerprint for r in got}) == 3
    only = ws.compare_with_next(spark.createDataFrame([(5, "eins zwei drei vier fünf")], "doc_id long, text string")).first()
    assert only.edited_sha256 == hashlib.sha256("eins zwei drei vieeins z".encode()).hexdigest()


def test_order_over_many_parts(spark):
    rows = spark.range(0, 3000, 7).select(F.col("id").alias("_key"), (F.col("id") * 31 % 11).alias("_own"), (F.col("id") % 5).alias("n_chars"))
    got = {r._key: (r.p_key, r.p_own, r.p_chars) for r in ws.neighbours(rows.repartition(6)).collect()}
    ids = list(range(0, 3000, 7))
    assert got == {i: (ids[k - 1], ids[k - 1] * 31 % 11, ids[k - 1] % 5) for k, i in enumerate(ids)}


def test_no_python_in_the_plans(spark, odd, capsys):
    ws.compare_with_next(odd).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas", plan)


def test_nothing(nothing):
    assert ws.compare_with_next(nothing).count() == 0 and ws.fingerprint(nothing).count() == 0


def test_entries_count_each_term_on_each_side(spark):
    rng = random.Random(5)
    rows = [(0, [], []), (1, [4], []), (2, [], [4]), (3, [4], [4]), (4, [-6] * 9, [-6] * 7 + [8]), (5, [2 ** 62, -2 ** 62] * 3, [-2 ** 62])]
    rows += [(i, *[[2 * rng.randrange(-9, 9) for _ in range(rng.randrange(60))] for _ in range(2)]) for i in range(6, 40)]
    df = spark.createDataFrame([(i, a, [t + 1 for t in b]) for i, a, b in rows], "k long, a array<long>, b array<long>")
    got, want = {}, {}
    for r in ws._entries(df, ["a", "b"], ["k"]).collect():
        got.setdefault(r.k, []).append((r._t, r._n0, r._n1))
    for i, a, b in rows:
        want[i] = sorted((t >> 1, a.count(t), b.count(t)) for t in set(a) | set(b)) or [(None, None, None)]
    assert set(got) == set(want) and all(sorted(got[i]) == w if w[0][0] is not None else got[i][0][0] is None for i, w in want.items())


def test_the_counts_of_terms_are_compiled(spark, capsys):
    """Lambda functions are run one node at a time; only where terms begin may need one after the sides have met."""
    df = spark.createDataFrame([(1, [2, 2], [3])], "k long, a array<long>, b array<long>")
    ws._entries(df, ["a", "b"], ["k"]).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("lambdafunction") <= 2
