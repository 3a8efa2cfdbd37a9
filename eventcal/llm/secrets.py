"""Secret scans: patterns, and values of credential contexts judged by what it costs to guess them.

The guess cost of a value is that of its cheapest division into dictionary words, dates, repeats, keyboard walks,
sequences and stretches of brute force, found by dynamic programming. A value in a context that speaks
of credentials is a secret if the cost is high: ``password: sunshine1`` is not, a random value is.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventcal.llm import text as T

#: The kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "guess")

# The patterns of the base kinds.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
HEX = T.byte_class(b"0123456789abcdef")

# Contexts whose values are judged by their guess cost.
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"auth", b"login", b"://")
CONTEXT = re.compile(
    rb"""(?<![A-Za-z0-9])(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client|auth|secret)[_-]?key|credentials?|auth|login)"""
    rb"""(?:["']?[\x20\t]*(?:[:=]|->|(?<=[\x20\t])is(?=[\x20\t]))[\x20\t]*["']?)([^\x00-\x20"'<>]{6,})""")
SCHEME, NO_LETTER = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in "+.-"), b"0123456789+.-"
LOGIN = re.compile(rb"://[^\x00-\x20:/@]+:([^\x00-\x20@/]{6,})@")

# Rows of a keyboard, and alphabets that are walked.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("@430$517", "aaeossit")
DATES = (re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
         re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"),
         re.compile(r"(?:19|20)\d\d"))
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LONGEST_WORD = 16


@lru_cache(2)
def dictionary(path: str) -> dict[str, float]:
    """log10 of the rank of each whole word of a tokenizer's vocabulary, which lists frequent words first."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocabulary.items() if w.endswith("</w>") and len(w) > 6)
    return {w: math.log10(rank + 2) for rank, (_, w) in enumerate(words)}


@lru_cache(1)
def _neighbours() -> dict[str, set]:
    near: dict[str, set] = {}
    for y, row in enumerate(KEYBOARD):
        for x, key in enumerate(row):
            near[key] = {r[x + d] for r, moves in ((row, (-1, 1)), *[(KEYBOARD[v], (-1, 0, 1)) for v in (y - 1, y + 1) if 0 <= v < 4])
                         for d in moves if 0 <= x + d < len(r)}
    return near


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _matches(value: str, words: dict[str, float]):
    """(from, to, log10 of guesses) of every piece that has a pattern; of repeats, walks and sequences the longest."""
    low = value.lower()
    plain = low.translate(LEET)
    for i in range(len(value)):
        for j, cost in _pieces_from(value, low, plain, i, words, math.inf):
            yield i, j, cost


def _pieces_from(value: str, low: str, plain: str, i: int, words: dict[str, float], most: float):
    """(to, log10 of guesses) of the pieces that begin at a place; walks that cost ``most`` or more are left out."""
    n, near = len(value), _neighbours()
    for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
        for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
            if form in words:
                own = value[i:j]
                case = 0.0 if own == own.lower() else 0.3 if own[1:] == own[1:].lower() or own == own.upper() else 1.0
                yield j, words[form] + extra + case
                break
    for pattern, size in zip(DATES, (365 * 160, 365 * 160, 160)):
        if m := pattern.match(value, i):
            yield m.end(), math.log10(size) + (0.6 if m.lastindex and m[1] else 0)
    for block in range(1, min(8, (n - i) // 2) + 1):          # a block and its repeats
        if i and value[i - 1:i - 1 + block] == value[i - 1 + block:i - 1 + 2 * block]:
            continue
        j, own = i + block, value[i:i + block]
        while value.startswith(own, j):
            j += block
        if j - i >= max(3, 2 * block):
            yield j, sum(map(_alphabet, own)) + math.log10((j - i) // block)
    if not (i and low[i] in near.get(low[i - 1], ())):        # a walk over the keyboard
        j, turns = i + 1, 0
        while j < n and low[j] in near.get(low[j - 1], ()) and turns * math.log10(4.6) < most:
            turns += j - i < 2 or low[j] not in near[low[j - 1]] or abs(_key(low[j]) - _key(low[j - 1])) != abs(_key(low[j - 1]) - _key(low[j - 2]))
            j += 1
        if j - i >= 3:
            yield j, math.log10(47 * (j - i)) + turns * math.log10(4.6)
    for row in SEQUENCES:
        for step in (1, -1):
            j = i + 1
            if i and low[i - 1] in row and low[i] in row and row.index(low[i]) - row.index(low[i - 1]) == step:
                continue
            while j < n and low[j - 1] in row and low[j] in row and row.index(low[j]) - row.index(low[j - 1]) == step:
                j += 1
            if j - i >= 3:
                yield j, math.log10(len(row) * (j - i))


_PLACES = {c: 100 * y + x for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}


def _key(c: str) -> int:
    return _PLACES.get(c, -1000)


def guess_cost(value: str, words: dict[str, float]) -> float:
    """log10 of the guesses that the cheapest division of the value takes.

    A division into k pieces costs the sum of theirs and log10 of k factorial, for the order is not known. Takes time with the
    square of the value's length; of a place's divisions those above the least by more than 10^40 are left out.
    """
    n = len(value)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _matches(value, words):
        ending[j].append((i, cost))
    brute = np.concatenate([[0.0], np.cumsum([_alphabet(c) for c in value])])
    best: list[dict[int, float]] = [{0: 0.0}]                # by place: pieces so far -> least sum
    tail: list[dict[int, float]] = [{}]                      # the same, where the last piece is brute force
    for j in range(1, n + 1):
        step = float(brute[j] - brute[j - 1])
        loose: dict[int, float] = {}
        for k, c in best[j - 1].items():                     # a brute stretch begins
            loose[k + 1] = min(loose.get(k + 1, math.inf), c + step)
        for k, c in tail[j - 1].items():                     # or goes on
            loose[k] = min(loose.get(k, math.inf), c + step)
        here = dict(loose)
        for i, cost in ending[j]:
            for k, c in best[i].items():
                if c + cost < here.get(k + 1, math.inf):
                    here[k + 1] = c + cost
        lowest = min(here.values())
        # More pieces never pay unless they are cheaper.
        kept, least = {}, math.inf
        for k in sorted(here):
            if here[k] < least:
                kept[k] = least = here[k]
        best.append({k: v for k, v in kept.items() if v <= lowest + 40})
        tail.append(loose)
    return min((c + math.lgamma(k + 1) / math.log(10) for k, c in best[n].items()), default=0.0)


def costs_at_least(value: str, words: dict[str, float], least: float) -> bool:
    """Does every division of the value take 10 to the ``least`` guesses or more?

    Divisions are followed only from places that some pieces reach below that, in order of place. More pieces and longer ones
    only add to the cost, so once no such place is left the answer is yes, however long the value is.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    order = [math.lgamma(k + 1) / math.log(10) for k in range(min(n, 1000) + 2)]
    free: dict[int, dict[int, float]] = {0: {0: 0.0}}        # by place: pieces so far -> least sum
    loose: dict[int, dict[int, float]] = {}                  # the same, where the last piece is brute force
    open_ = [0]

    def reach(to: dict, place: int, k: int, cost: float) -> None:
        if cost + order[min(k, len(order) - 1)] >= least:
            return
        if place not in free and place not in loose:
            heapq.heappush(open_, place)
        here = to.setdefault(place, {})
        if cost < here.get(k, math.inf):
            here[k] = cost

    while open_:
        i = heapq.heappop(open_)
        ends, goes_on = free.pop(i, {}), loose.pop(i, {})
        for k, c in goes_on.items():
            ends[k] = min(c, ends.get(k, math.inf))
        if i == n:
            return False                         # reached below the cost
        step = _alphabet(value[i])
        for k, c in ends.items():
            reach(loose, i + 1, k + 1, c + step)
        for k, c in goes_on.items():
            reach(loose, i + 1, k, c + step)
        for j, cost in _pieces_from(value, low, plain, i, words, least):
            for k, c in ends.items():
                reach(free, j, k + 1, c + cost)
    return True


def logins(text: bytes):
    """(start, match) of ``scheme://user:password@``, from the left and without overlap; the password is group 1.

    The scheme is what stands before ``://``, from its first letter on. Found from there back, a long run of letters is read once.
    """
    low = at = 0
    while (at := text.find(b"://", at)) >= 0:
        run = text[low:at]
        scheme = run[len(run.rstrip(SCHEME)):].lstrip(NO_LETTER)
        m = LOGIN.match(text, at) if scheme else None
        if m:
            yield at - len(scheme), m
        low = at = m.end() if m else at + 3


def base_spans(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes of the assign and access matches."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def guessed_spans(text: bytes, taken: list[tuple[int, str, int]], words: dict[str, float], least: float):
    """Values of credential contexts that cost 10 to the ``least`` guesses or more, unless a span found before covers them whole.

    A base span ends at the first symbol beyond its own, so a value is judged whole also where one overlaps it.
    """
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out = []
    for matches in (CONTEXT.finditer(text), (m for _, m in logins(text))):
        # Those of one pattern do not overlap; what covers a value was there before.
        known = sorted((s, e) for s, _, e in [*taken, *out])
        starts, reach = [s for s, _ in known], list(itertools.accumulate((e for _, e in known), max))
        for m in matches:
            a, shown = m.start(1), m[1].rstrip(b".,;:!?)")
            b = a + len(shown)
            k = bisect.bisect_right(starts, a)
            if k and reach[k - 1] >= b:
                continue
            value = shown.decode("utf-8", "replace")
            if len(value) >= 6 and costs_at_least(value, words, least):
                out.append((a, "guess", b))
    return out


SCHEMA = ("id long, n_assign long, n_access long, n_hex long, n_guess long, base_spans string, spans string, redacted string")
ARROW = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_spans", pa.string()),
                   ("spans", pa.string()), ("redacted", pa.string())])
MARK = "[secret]"


def _redacted(text: str, spans: list[tuple[int, str, int]], mark: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s > at or not out:                    # else it overlaps or touches the one before
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, least: float = 10.0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
         mark: str = MARK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess, base_spans, spans, redacted) of every row, and the columns in ``keep``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by kind as listed, comma-joined; the
    base ones alone in ``base_spans``. ``redacted`` is the text with each run of secrets replaced by ``mark``, null where there is
    none. Patterns are ASCII, letters of keywords in either case. Null and empty texts have no secrets; texts
    are scanned whole; rows that repeat an id are scanned one by one; other columns are not read. A guess span may overlap
    base spans, which stay as they are: the value of a credential counts whole, symbols too.
    """
    def look(batches):
        words = dictionary(vocabulary)
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            for a, b in T.parts(batch["text"], 2_000_000):
                part = batch.slice(a, b - a)
                buf, off = T.flat(part["text"])
                start, end, doc = T.spans(buf, off, HEX)
                long = end - start >= LEAST_HEX
                found: dict[int, list] = {}
                for s, e, d in zip(start[long], end[long], doc[long]):
                    found.setdefault(int(d), []).append((int(s - off[d]), "hex", int(e - off[d])))
                data, rows = buf.tobytes(), []
                for d, i in enumerate(part["id"].to_pylist()):
                    text = data[off[d]:off[d + 1]]
                    base = found.get(d, []) + base_spans(text)
                    spans = base + guessed_spans(text, base, words, least)
                    if not spans:
                        rows.append((i, 0, 0, 0, 0, "", "", None))
                        continue
                    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    spans = sorted(((int(lead[s]), k, int(lead[e])) for s, k, e in spans), key=lambda x: (x[0], order[x[1]]))
                    count = {k: sum(x[1] == k for x in spans) for k in KINDS}
                    shown = lambda xs: ",".join(f"{k}:{s}:{e}" for s, k, e in xs)
                    rows.append((i, *count.values(), shown([x for x in spans if x[1] != "guess"]), shown(spans),
                                 _redacted(text.decode("utf-8", "replace"), spans, mark)))
                made = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), ARROW)]
                yield pa.RecordBatch.from_arrays([*made, *[part[c] for c in kept]], [*ARROW.names, *kept])
            T.give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep) if c != text_col])
    kept = ["text" if c == text_col else f"_keep{i}" for i, c in enumerate(keep)]
    carried = rows.select(*kept)
    schema = StructType([*StructType.fromDDL(SCHEMA).fields, *carried.schema.fields])
    out = rows.mapInArrow(look, schema)
    return out.select(F.col("id").alias(id_col), *ARROW.names[1:], *[F.col(k).alias(c) for k, c in zip(kept, keep)])
