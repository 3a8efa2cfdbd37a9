"""Operators on single texts against plain versions, exact round trips and held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventcal.llm import (decontamination, language, license_scan, quality, secrets, sentencepiece_codec, token_counts)
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(x):
    return tuple((v is None, str(v)) for v in x)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------ token counts
def greedy(word, first, inner):
    at = n = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (inner if at else first):
                break
        else:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(60):
        make = lambda n: tuple({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(n)})
        first, inner = make(rng.randrange(1, 9)), make(rng.randrange(1, 9))
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 12))) for _ in range(80)]
        data, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
        got = token_counts.count_pieces(token_counts.build(first, inner), data, at)
        assert got.tolist() == [greedy(w, set(first), set(inner)) for w in words]


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_token_counts(request, table):
    df = request.getfixturevalue(table)
    first, inner = map(set, token_counts.pieces_of(token_counts.VOCABULARY))
    want = []
    for r in df.collect():
        n = [greedy(w.encode(), first, inner) for w in WORD.findall(r.text or "")]
        want.append((r.doc_id, len(n), sum(max(k, 1) for k in n), n.count(0)))
    assert sorted((tuple(r) for r in token_counts.count_tokens(df).collect()), key=key) == sorted(want, key=key)


# ------------------------------------------------------------------ licences
def test_licenses(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows, want = [], {}
    for k, ((name, text), gap) in enumerate(itertools.product(license_scan.TEMPLATES, (0, 1, 7, 40))):
        rows.append((k, f"{noise(gap)}\n{text.upper()}\n{noise(30)}"))
        want[k] = name
    words = license_scan.TEMPLATES[3][1].split()
    words[20] = "other"                                      # most of the shingles are left
    rows += [(900, " ".join(words)), (901, " ".join(words[::2])), (902, None), (903, ""), (904, "MIT License"), (905, noise(20_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("w", "sh", "_id", "found")})
    got = {r.doc_id: r.licenses for r in license_scan.scan(df).collect()}
    assert all(name in got[k] for k, name in want.items()) and got[900] == ["MIT"]
    assert all(got[k] == [] for k in range(901, 906))
    assert license_scan.scan(df.limit(0)).count() == 0
    none = spark.createDataFrame([], "name string, text string")
    assert all(r.licenses == [] for r in license_scan.scan(df, none).collect())
    with pytest.raises(ValueError):
        license_scan.scan(df, spark.createDataFrame([("x", "too short")], "name string, text string"))


def test_license_scan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = license_scan.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# ------------------------------------------------------------------ secrets
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(s for *_, s in sorted(found))


def test_secrets(spark, odd):
    texts = [None, "", "ü password = hunter2222 x", "TOKEN:abc", "token=secret=abcdef", "é AKIA" + "A1" * 9, "AKIA123", "0" * 23, "00ff" * 6,
             'api_key: "' + "deadbeef" * 5 + '"', "secret' = 'Zz9+/=._-", "passphrase: Xk9!vQ2#rT7$wZ", "login: sunshine1",
             "https://user:q8Zr!x0Lw#M3v@host/path", "pwd = password123", "ſecret: abcdefgh", "toKen: abcdefgh", "credentials are listed below",
             "key" * 9, "password is x7Kq!9ZpL2mWv and AKIA" + "B" * 16 + "a" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("redacted", F.lit("x"))
    got = {r.doc_id: r for r in secrets.scan(df, keep=("text",)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_spans == plain_spans(t or ""), t
        assert got[i].text == t
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in got[i].spans.split(",") if s)]
        if spans:
            hidden = set().union(*[range(a, b) for a, b in spans])
            out = "".join("\0" if k in hidden else c for k, c in enumerate(t))
            assert got[i].redacted == re.sub("\0+", secrets.MARK, out)
        else:
            assert got[i].redacted is None
    assert [got[i].n_guess for i in (11, 12, 13, 14, 17, 19)] == [1, 0, 1, 0, 0, 1]
    assert all(r.base_spans == plain_spans(dict_text or "") for r, dict_text in
               ((r, r.text) for r in secrets.scan(odd, keep=("text",)).collect()))
    assert secrets.scan(df.limit(0)).count() == 0


def test_credential_values_are_redacted_whole(spark):
    texts = ["my password: Xk9vQ2!#rT7$wZpq end", "ü token=abcdef12#Zr8!kQ0vW, then", 'api_key: "Zz9Zz9Zz9"', "secret = sunshine!!",
             "password: x!" + "0af3" * 6 + "#Qz7!pL", "https://token:8ZrxA0Lw!M3v'tail9Xq@host/path"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.base_spans, r.spans, r.redacted) for r in secrets.scan(df).orderBy("doc_id").collect()]
    assert [b for b, *_ in got] == [plain_spans(t) for t in texts]
    assert got[0][1:] == ("assign:3:19,guess:13:29", f"my {secrets.MARK} end")
    assert got[1][1:] == ("assign:2:16,guess:8:26", f"ü {secrets.MARK}, then")
    assert got[2][1] == got[2][0] and got[3][1] == got[3][0]     # covered whole by the base span; cheap to guess
    assert got[4][2] == f"password: {secrets.MARK}"
    assert got[5][2] == f"https://{secrets.MARK}@host/path"       # what a context and an address each find, together


def test_guess_cost_is_the_least_over_all_divisions():
    words = {"pass": 1.0, "word": 1.5, "password": 0.5, "sun": 1.2, "shine": 2.0}
    for value in ("password", "sunshine12", "aaaa1998", "qwertyx", "Sun9sun9", "zk", "abc123pass", "p4ss"):
        pieces = {}
        for i, j, c in secrets._matches(value, words):
            pieces[i, j] = min(c, pieces.get((i, j), math.inf))
        best = math.inf
        for marks in itertools.product([0, 1], repeat=len(value) - 1):
            ends = [0, *[k + 1 for k, m in enumerate(marks) if m], len(value)]
            spans = list(zip(ends, ends[1:]))
            cost = sum(min(pieces.get(s, math.inf), sum(map(secrets._alphabet, value[s[0]:s[1]]))) for s in spans)
            best = min(best, cost + math.log10(math.factorial(len(spans))))
        assert abs(secrets.guess_cost(value, words) - best) < 1e-9, value
    d = secrets.dictionary(secrets.VOCABULARY)
    assert secrets.guess_cost("password", d) < 6 < 10 < secrets.guess_cost("x7Kq9ZpL2mWv", d)
    assert secrets.guess_cost("a" * 5000, d) < 6


# ------------------------------------------------------------------ language
def plain_bits(text, counts, classes, contexts):
    """Code length by walking from the longest known context down, symbol by symbol."""
    data = [classes[b] for b in low(text).encode()] if text else []
    total = 0.0
    for i, s in enumerate(data):
        context = tuple(([0] * 3 + data[:i])[-3:])
        bits, known = 0.0, False
        while True:
            if context in contexts and counts.get(context):
                after = counts[context]
                n, kinds = sum(after.values()), len(after)
                if s in after:
                    bits += -math.log2(after[s] / (n + kinds))
                    break
                bits += -math.log2(kinds / (n + kinds))
            if not context:
                bits += 8.0
                break
            context = context[1:]
        total += bits
    return total


def test_code_lengths_are_those_of_the_tree(spark):
    rng = random.Random(4)
    texts = [("aa", "".join(rng.choice("ab c") for _ in range(80))) for _ in range(6)] + [("bb", "".join(rng.choice("bcdé ") for _ in range(80))) for _ in range(6)]
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == ["aa", "bb"]
    ask = ["abc", "", "é b", "zz~ a", texts[0][1] * 3]
    from eventcal.llm import text as T

    buf, off = T.flat(pa.array(ask))
    got = language.code_lengths(model, buf, off)
    classes = model.classes
    seen = {g: {} for g in model.languages}
    contexts = {()}
    for g, t in texts:
        data = [int(classes[b]) for b in low(t).encode()]
        for i, s in enumerate(data):
            full = tuple(([0] * 3 + data[:i])[-3:])
            for k in range(4):
                c = full[3 - k:]
                contexts.add(c)
                after = seen[g].setdefault(c, {})
                after[s] = after.get(s, 0) + 1
    for i, t in enumerate(ask):
        for v, g in enumerate(model.languages):
            assert abs(got[i, v] - plain_bits(t, seen[g], classes, contexts)) < 1e-3


def test_language_of_held_out_documents(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(language.learnable(docs))
    out = language.predict(docs.withColumn("held", language.held_out()), model, keep=("lang", "held")).filter("held")
    rows = out.collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    strange = {r.text: r for r in language.predict(odd, model, keep=("text",)).collect()}
    assert {strange[t].lang_pred for t in (None, "", "   \n\t ")} == {"und"}
    assert language.predict(nothing, model).count() == 0
    untaught = language.train(nothing)
    assert {r.lang_pred for r in language.predict(odd, untaught).collect()} == {"und"}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.train(unlabelled).languages == []


# ------------------------------------------------------------------ decontamination
def plain_hits(docs, items, window):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(item) if item is not None else "null")
    out = []
    for i, text in docs:
        w = ALNUM.findall(low(text))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    found |= windows[tuple(w[k:k + size])]
                    hit[k:k + size] = [True] * size
        out.append((i, len(w), sum(hit), tuple(sorted(found))))
    return sorted(out, key=key)


@pytest.mark.parametrize("block", [4_000_000, 300])
@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_decontamination(request, spark, table, block, monkeypatch):
    df = request.getfixturevalue(table)
    texts = [r.text for r in df.collect() if r.text]
    longest = max(texts, key=len).split()
    items = [(1, " ".join(longest[500:530])), (2, "Two, three!"), (3, ""), (4, None), (None, "zeile ZEILE"), (5, "x" * 700),
             (2, " ".join(longest[1000:1012])), (6, "w1"), (7, " ".join(longest[7:16]) + " never"), (8, "ab ab ab ab ab ab ab ab ab ab ab")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("shard", F.lit(1))
    monkeypatch.setattr(decontamination, "ITEM_BLOCK_BYTES", block)
    got = decontamination.decontaminate(df, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=key) == plain_hits(
        [(r.doc_id, r.text) for r in df.collect()], items, 10)
    assert decontamination.decontaminate(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f rare g h"), (2, "rare x x x x x x x a"), (3, "a rare"), (4, "rare")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare a")], "item_id long, text string")
    near = lambda k: sorted(r.doc_id for r in decontamination.decontaminate(docs, items, within=k).filter("n_hit > 0").collect())
    assert near(1) == [3] and near(6) == [1, 3] and near(8) == [1, 2, 3]
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, items).filter("n_hit > 0").collect()) == []


# ------------------------------------------------------------------ SentencePiece
def test_pieces_without_dropout_are_the_library_s(odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for r in sentencepiece_codec.encode(odd, dropout=0.0).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert np.frombuffer(bytes(r["ids"]), "<i4").tolist() == library.encode(r.text or "") and r.lossless


@pytest.mark.parametrize("long_unit", [64, 0])
def test_dropout_is_seeded_and_decodes(spark, odd, monkeypatch, long_unit):
    monkeypatch.setattr(sentencepiece_codec, "LONG_UNIT", long_unit)
    p = sentencepiece_codec.pieces(sentencepiece_codec.MODEL)
    texts = ["", "  lead", "trail  ", "▁a ▁", "日本 🎉\r\n\x00", "x" * 200, "some ordinary words in a row " * 20, "à é"]
    out = {}
    for seed in (1, 2):
        ids, at = sentencepiece_codec.encode_batch(p, pa.array(texts), np.zeros(len(texts), np.int64), seed, 0.2)
        assert sentencepiece_codec.decode_batch(p, ids, at).to_pylist() == texts
        out[seed] = ids.tolist()
    assert out[1] != out[2]
    whole, at = sentencepiece_codec.encode_batch(p, pa.array(texts), np.zeros(len(texts), np.int64), 1, 0.2)
    for i, t in enumerate(texts):                # the batch does not matter
        alone, _ = sentencepiece_codec.encode_batch(p, pa.array([t]), np.zeros(1, np.int64), 1, 0.2)
        assert alone.tolist() == whole[at[i]:at[i + 1]].tolist()


def test_lockstep_and_agenda_agree(monkeypatch):
    p = sentencepiece_codec.pieces(sentencepiece_codec.MODEL)
    texts = ["international understanding of unbelievable things", "aaaaaaaaaaaaaaa bbbb", "x1y2z3 " * 5]
    got = []
    for size in (1000, 0):
        monkeypatch.setattr(sentencepiece_codec, "LONG_UNIT", size)
        got.append(sentencepiece_codec.encode_batch(p, pa.array(texts), np.zeros(3, np.int64), 3, 0.3)[0].tolist())
    assert got[0] == got[1]


def test_encode_and_decode_frames(odd, clashing, nothing):
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    for df in (odd, clashing):
        encoded = sentencepiece_codec.encode(df, seed=9)
        assert Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode(encoded).collect()) == texts
    short = encoded.filter("n_pieces < 40").withColumn("list", sentencepiece_codec.as_array()).collect()
    assert all(r["list"] == np.frombuffer(bytes(r["ids"]), "<i4").tolist() for r in short) and len(short) > 3
    assert sentencepiece_codec.encode(nothing).count() == 0


def test_every_occurrence_draws_its_own_dropout(spark):
    p = sentencepiece_codec.pieces(sentencepiece_codec.MODEL)
    df = spark.createDataFrame([*[(i, "understanding") for i in range(300)], (1000, "understanding " * 300), (1, "understanding"),
                                (None, "understanding things"), (None, "understanding other things"), (None, "understanding things")],
                               "doc_id long, text string")
    rows = [(r.doc_id, r.n_pieces, bytes(r["ids"])) for r in sentencepiece_codec.encode(df, dropout=0.2).collect()]
    copies = {i: ids for i, _, ids in rows if i is not None and i < 300}
    assert len(set(copies.values())) > 20                     # the variety grows with the copies
    assert [ids for i, _, ids in rows if i == 1] == [copies[1]] * 2
    long = next(np.frombuffer(ids, "<i4") for i, _, ids in rows if i == 1000)
    first = [k for k, x in enumerate(long) if p.data[p.at[x]:p.at[x] + 1].tobytes() == b" "]
    words = {tuple(long[a:b]) for a, b in zip(first, first[1:])}
    assert len(words) > 20                                    # and with the places in one text
    assert len({ids for i, _, ids in rows if i is None}) == 2


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 1.0])
def test_dropout_is_that_of_segmenting_each_unit(monkeypatch, share):
    p = sentencepiece_codec.pieces(sentencepiece_codec.MODEL)
    rng = random.Random(5)
    words = ["international", "understanding", "of", "aaaaaaaaab", "naïve", "日本語", "x" * 90, "a"]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)] + ["", "one", None, "understanding"]
    owners = np.array([7, 7, -1, 9, 1, 2, 3, 7])
    got, at = sentencepiece_codec.encode_batch(p, pa.array(texts), owners, 3, share)
    monkeypatch.setattr(sentencepiece_codec, "_skipping", lambda n, met, code, keys, share: np.arange(len(code)))
    whole, whole_at = sentencepiece_codec.encode_batch(p, pa.array(texts), owners, 3, share)
    assert got.tolist() == whole.tolist() and at.tolist() == whole_at.tolist()
    monkeypatch.undo()
    monkeypatch.setattr(sentencepiece_codec, "LOOKED_AT", 5)
    assert sentencepiece_codec.encode_batch(p, pa.array(texts), owners, 3, share)[0].tolist() == got.tolist()


# ------------------------------------------------------------------ quality
def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if n[tuple(w[i:i + 3])] > 1:
            again[i:i + 3] = [True] * 3
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, sum(again),
            len(w) < 50 or 100 * sum(again) > 50 * len(w))


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_quality_counts(request, table):
    df = request.getfixturevalue(table)
    got = quality.supervise(df).collect()
    shown = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(shown, key=key) == sorted(((r.doc_id, *plain_counts(r.text)) for r in df.collect()), key=key)
    assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in got)


def test_quality_against_labels(spark, sf, nothing):
    out = {r.doc_id: r for r in quality.supervise(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not out[r.doc_id].base_failed]
    good = [out[r.doc_id].kept for r in labels if r.quality == 1]
    assert sum(good) / len(good) > 0.97
    assert quality.supervise(nothing).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    n, right = 20_000, np.array([[0.95, 0.8, 0.7, 0.6], [0.9, 0.85, 0.6, 0.75]])
    good = rng.random(n) < 0.7
    agree = rng.random((n, 4)) < np.where(good[:, None], right[0], right[1])
    votes = np.where(agree == good[:, None], 1, -1) * (rng.random((n, 4)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    w = quality.fit(patterns, counts.astype(float), list("abcd"))
    assert abs(1 / (1 + math.exp(-w.prior)) - 0.7) < 0.05
    for j, name in enumerate("abcd"):
        assert abs(w.rules[name][0] - math.log(right[0, j] / (1 - right[1, j]))) < 0.35
        assert abs(w.rules[name][1] - math.log((1 - right[0, j]) / right[1, j])) < 0.35


def secret_values(rng, n):
    """Values of words, walks, repeats, dates and noise."""
    parts = ["password", "Sunshine", "dragon", "qwerty", "asdfgh", "1234567", "aaaaaaa", "abab", "1999-12-31", "2024", "p4ssw0rd", "zyxw", "!", "#%"]
    for _ in range(n):
        yield "".join(rng.choice(parts) if rng.random() < .6 else "".join(rng.choice("aZ09$_xQ") for _ in range(rng.randrange(1, 6)))
                      for _ in range(rng.randrange(1, 5)))


def test_the_cost_is_judged_like_the_whole_division():
    words, rng = secrets.dictionary(secrets.VOCABULARY), random.Random(8)
    for value in secret_values(rng, 400):
        cost = secrets.guess_cost(value, words)
        for least in (3.0, 6.0, 10.0, 14.0):
            assert secrets.costs_at_least(value, words, least) == (cost >= least), (value, cost, least)


def test_logins_are_those_of_one_pattern():
    url, rng = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20:/@]+:([^\x00-\x20@/]{6,})@"), random.Random(4)
    for _ in range(3000):
        text = b"".join(rng.choice((b"://", b"http", b"a", b"1", b"+.", b":", b"/", b"@", b" ", b"user", b"secret99", b"\xc3\xa4")) for _ in range(rng.randrange(1, 25)))
        assert [(s, m.start(1), m.end(1), m.end()) for s, m in secrets.logins(text)] == [(m.start(), m.start(1), m.end(1), m.end()) for m in url.finditer(text)]


@pytest.mark.parametrize("text, found", [
    (b"key " + b"x" * 1_000_000, 0), (b"key " + b"x1+" * 330_000 + b"://u:Xk9vQ2!rT7$wZp@h", 1),
    (b"password: " + bytes(random.Random(1).choices(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#", k=1_000_000)) + b"! end", 1),
    (b"pwd=" + b"a" * 1_000_000, 0), (b"pwd=" + b"qw" * 500_000, 0), (b"pass: (Xk9vQ2!rT7$wZp) " * 20_000, 20_000), (b"secret :" + b" " * 1_000_000, 0)])
def test_very_long_values_and_runs_take_little_time(text, found):
    import time

    words = secrets.dictionary(secrets.VOCABULARY)
    start = time.process_time()
    spans = secrets.guessed_spans(text, secrets.base_spans(text), words, 10.0)
    assert len(spans) == found and time.process_time() - start < 4
