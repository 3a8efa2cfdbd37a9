"""Periodic runs of words by recompression.

A run is a stretch of words with a smallest period q, four periods or more and six words or more, that no neighbouring word
extends. The words of a batch of texts become a run-length grammar: block compression gives each maximal block of
one symbol a symbol of its own, pair compression each pair of a left and a right symbol, in turn, until all symbols differ. How a
place is parsed depends only on its neighbours, so equal stretches are parsed alike but at their edges; the longest
common extension of two places is found by climbing the levels while both stand at edges and descending again where symbols
differ, a few comparisons a level, without a suffix array.

Candidates come from harmonic grids: a run of period q and four periods holds four neighbouring multiples of q with equal words. For
each period only such places are asked, n / q of them, and their extensions to both sides by q are the runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.llm import text as T
from eventcal.llm.text import U64

#: A run has so many periods and words at least.
PERIODS, WORDS = 4, 6
#: Bytes of text looked at together; a longer text is a part of its own.
PART_BYTES = 1_000_000
#: Grid places asked at a time.
GRID_PLACES = 4_000_000


# ------------------------------------------------------------------ the grammar
@dataclass
class Level:
    symbols: np.ndarray          # the symbols of this level
    at: np.ndarray               # where each begins among those of the level below; one more at the end
    blocks: bool                 # made by block compression, else by pairs


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _compress_blocks(below: Level) -> Level:
    s = below.symbols
    new = np.append(True, s[1:] != s[:-1])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(s)))
    return Level(_ranked(s[start] * (n.max() + 1) + n), np.append(start, len(s)), True)


def _compress_pairs(below: Level, seed: int) -> Level:
    """Pairs of a left and a right symbol become one; the sides are drawn by hash, and exchanged if that joins more."""
    s = below.symbols
    left = (T.mix(s.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U64(1)).astype(bool)
    joined = left[:-1] & ~left[1:]
    other = ~left[:-1] & left[1:]
    if other.sum() > joined.sum():
        joined = other
    new = np.append(True, ~joined)
    start = np.flatnonzero(new)
    second = np.where(np.diff(np.append(start, len(s))) == 2, s[np.minimum(start + 1, len(s) - 1)] + 1, 0)
    return Level(_ranked(s[start] * (s.max() + 2) + second), np.append(start, len(s)), False)


def grammar(words: np.ndarray) -> list[Level]:
    """The levels over an array of symbols, from the symbols themselves up to where all symbols differ."""
    n = len(words)
    levels = [Level(words, np.arange(n + 1), False)]
    seed = 0
    while len(levels[-1].symbols) and len(np.unique(levels[-1].symbols)) < len(levels[-1].symbols):
        levels.append(_compress_blocks(levels[-1]))
        seed += 1
        levels.append(_compress_pairs(levels[-1], seed))
    return levels


class Extensions:
    """Longest common extensions of places, many at a time, over one grammar."""

    def __init__(self, words: np.ndarray):
        self.levels = grammar(words)
        self.ups = []            # of each level but the last: the parent of each symbol, by the level above
        for above in self.levels[1:]:
            self.ups.append(np.repeat(np.arange(len(above.symbols)), np.diff(above.at)))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i < j."""
        return self._extend(i, j, 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i, that one included, equal those up to j; i < j. Minus one stands before the first word."""
        return self._extend(i, j, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        base, last = np.asarray(j, np.int64), len(self.levels) - 1
        i, j = np.asarray(i, np.int64).copy(), base.copy()
        # Queries climb together; those that stop are set down level by level on the way back.
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3 for _ in range(last + 1)]
        who, out = np.arange(len(i)), np.zeros(len(i), np.int64)
        for level in range(last + 1):
            ended, i, j = self._step(level, i, j, step, climbing=level < last)
            waiting[level] = who[ended], i[ended], j[ended]
            who, i, j = who[~ended], i[~ended], j[~ended]
            if level < last and len(who):
                up = self.ups[level]
                i, j = self._parents(up, i, step), self._parents(up, j, step)
        who, i, j = waiting[last]
        for level in range(last, -1, -1):
            if level < last:
                who, i, j = (np.concatenate([a, b]) for a, b in zip((who, i, j), waiting[level]))
            if level:
                i, j = self._children(level, i, step), self._children(level, j, step)
                _, i, j = self._step(level - 1, i, j, step, climbing=False)
        # At the bottom each stands on the first word that differs, or beyond the end.
        out[who] = (j - base[who]) * step
        return out

    def _parents(self, up: np.ndarray, x: np.ndarray, step: int) -> np.ndarray:
        n = up[-1] + 1 if len(up) else 0
        inside = (x >= 0) & (x < len(up))
        return np.where(inside, up[np.clip(x, 0, len(up) - 1)], n if step > 0 else -1)

    def _children(self, level: int, x: np.ndarray, step: int) -> np.ndarray:
        """The first symbol below, or the last one when walking back; beyond the end stays beyond it."""
        at = self.levels[level].at
        if step > 0:
            return at[np.clip(x, 0, len(at) - 1)]
        return np.where(x >= 0, at[np.clip(x + 1, 0, len(at) - 1)] - 1, -1)

    def _step(self, level: int, i: np.ndarray, j: np.ndarray, step: int, climbing: bool):
        """(ended, i, j) after comparing what stands at this level before both are at edges of the level above.

        At most two symbols are compared: pairs have two, and a block is passed at once.
        """
        s = self.levels[level].symbols
        n = len(s)
        i, j = i.copy(), j.copy()
        up = self.ups[level] if level < len(self.ups) else None
        above = self.levels[level + 1] if up is not None else None
        ended = np.zeros(len(i), bool)
        rest = np.arange(len(i))
        for turn in range(3):
            a, b = i[rest], j[rest]
            inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
            if climbing:
                edge = inside.copy()
                ka, kb = a[inside], b[inside]
                pa_, pb = up[ka], up[kb]
                if step > 0:
                    edge[inside] = (above.at[pa_] == ka) & (above.at[pb] == kb)
                else:
                    edge[inside] = (above.at[pa_ + 1] - 1 == ka) & (above.at[pb + 1] - 1 == kb)
                ended[rest[~inside]] = True
                keep = inside & ~edge
                rest, a, b = rest[keep], a[keep], b[keep]
            else:
                rest, a, b = rest[inside], a[inside], b[inside]
            if not len(rest):
                break
            same = s[a] == s[b]
            ended[rest[~same]] = True
            rest, a, b = rest[same], a[same], b[same]
            if not len(rest):
                break
            if above is not None and above.blocks:           # the rest of both blocks at once
                if step > 0:
                    left, right = above.at[up[a] + 1] - a, above.at[up[b] + 1] - b
                else:
                    left, right = a - above.at[up[a]] + 1, b - above.at[up[b]] + 1
                move = np.minimum(left, right)
            else:
                move = np.ones(len(rest), np.int64)
            i[rest], j[rest] = a + step * move, b + step * move
        if not climbing:
            ended[:] = True
        return ended, i, j


# ------------------------------------------------------------------ runs
def _candidates(words: np.ndarray, start: np.ndarray, n: np.ndarray, periods: np.ndarray):
    """(place, period) of every place on the grid of a period where four neighbouring grid words of a text are equal.

    The grid of period q is every q-th place of a text, from its first word on. ``n``: words of the texts, longest first.
    """
    texts = np.searchsorted(-n, -np.maximum(PERIODS * periods, WORDS), "right")
    q = np.repeat(periods, texts)
    text = np.arange(len(q)) - np.repeat(np.cumsum(texts) - texts, texts)
    count = (n[text] - 1 - 3 * q) // q + 1
    total = np.cumsum(count)
    cut = np.flatnonzero(np.diff(total // GRID_PLACES, prepend=0)) if len(q) else []
    out = [(np.zeros(0, np.int64),) * 2]
    for a, b in zip([0, *cut], [*cut, len(q)]):
        c, step = count[a:b], q[a:b]
        edge = np.cumsum(c) - c
        step = np.repeat(step, c)
        place = (np.arange(len(step)) - np.repeat(edge, c)) * step + np.repeat(start[text[a:b]], c)
        for k in (1, 2, 3):
            same = words[place] == words[place + k * step]
            place, step = place[same], step[same]
        out.append((place, step))
    return tuple(np.concatenate(x) for x in zip(*out))


def runs_of(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of texts words[off[t]:off[t+1]], by start; places are those of ``words``.

    Words are numbers from 0 on. Periods are asked in groups of q up to 2 q - 1, so that all that divide a period
    are known before it: a place inside a known run whose four grid words it covers adds nothing.
    """
    n = np.diff(off)
    by_length = np.argsort(-n, kind="stable")
    start, size = off[:-1][by_length], n[by_length]
    longest = int(size[0]) if len(n) else 0
    known = np.zeros((0, 3), np.int64)
    asked: Extensions | None = None
    shift = None
    low = 1
    while PERIODS * low <= longest:
        at, period = _candidates(words, start, size, np.arange(low, min(2 * low, longest // PERIODS + 1)))
        at, period = _uncovered(at, period, known)
        low *= 2
        # The first place of each chain of neighbouring ones first; then whatever it does not cover.
        for only_first in (True, False):
            if not len(at):
                break
            if asked is None:                                # the grammar has a mark of its own between texts
                shift = np.repeat(np.arange(len(n)), n)
                asked = Extensions(np.insert(words, off[1:], (words.max() + 1) + np.arange(len(n))))
            pick = np.ones(len(at), bool)
            if only_first:
                order = np.lexsort((at, period))
                at, period = at[order], period[order]
                pick[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] != period[1:])
            i = at[pick] + shift[at[pick]]
            q = period[pick]
            first = at[pick] - asked.backward(i - 1, i + q - 1)
            end = at[pick] + q + asked.forward(i, i + q)
            enough = end - first >= np.maximum(PERIODS * q, WORDS)
            known = _least(np.concatenate([known, np.stack([first, end, q], 1)[enough]]))
            at, period = at[~pick], period[~pick]
            if len(at):
                at, period = _uncovered(at, period, known)
    return known[:, 0], known[:, 1], known[:, 2]


def _least(runs: np.ndarray) -> np.ndarray:
    """Of runs with equal ends the one of least period, by start, end."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))] if len(runs) else runs


def _uncovered(at: np.ndarray, period: np.ndarray, known: np.ndarray):
    """The places whose four grid words lie in no known run of that period or a shorter one.

    Two runs that share as many words as both periods are one; so of the runs that begin before a place and have a period up to
    the one asked, only the one that reaches furthest can cover it.
    """
    if not len(known):
        return at, period
    covered = np.zeros(len(at), bool)
    for lowest in np.unique(1 << np.log2(known[:, 2]).astype(np.int64)):
        own = known[(known[:, 2] >= lowest) & (known[:, 2] < 2 * lowest)]
        own = own[np.argsort(own[:, 0], kind="stable")]
        reach = np.maximum.accumulate(own[:, 1])
        which = np.maximum.accumulate(np.where(own[:, 1] == reach, np.arange(len(own)), 0))
        k = np.searchsorted(own[:, 0], at, "right") - 1
        there = k >= 0
        k = np.maximum(k, 0)
        covered |= there & (reach[k] > at + 3 * period) & (own[which[k], 2] <= period)
    return at[~covered], period[~covered]


# ------------------------------------------------------------------ texts
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _of_part(texts):
    """(words of each text, its runs, its kept words joined by one space)."""
    buf, off = T.flat(texts)
    n_docs = len(off) - 1
    start, end, doc = T.spans(buf, off, T.NOT_SPACE)
    n = np.bincount(doc, minlength=n_docs).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    own, edge = T.pieces(buf, start, end)
    coded = T.binary(own, np.diff(edge)).dictionary_encode()
    first, last, period = runs_of(np.asarray(coded.indices).astype(np.int64), at)
    # Words from the second period on go.
    mark = np.zeros(len(start) + 1, np.int64)
    np.add.at(mark, first + period, 1)
    np.add.at(mark, last, -1)
    keep = np.cumsum(mark)[:len(start)] == 0
    collapsed = T.joined(buf, start[keep], end[keep], doc[keep], n_docs)
    whose = np.searchsorted(at, first, "right") - 1
    order = np.lexsort((period, first, whose))
    first, last, period, whose = first[order], last[order], period[order], whose[order]
    flat = pa.StructArray.from_arrays([pa.array(first - at[whose]), pa.array(last - first), pa.array(period)], fields=list(_RUN))
    counts = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n_docs))]).astype(np.int32)
    return n, pa.ListArray.from_arrays(pa.array(counts), flat), collapsed


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    ``runs`` has (start, length, period) in words from 0 on, by start, then period; ``collapsed`` is the text without the words
    that stand in a run behind its first period, joined by one space. Words are what stands between ASCII white space. Null and empty
    texts have no words, no runs and an empty ``collapsed``. Rows that repeat an id are taken one by one, a null id stays
    null; other columns are not read. No row depends on another, texts are taken whole, and the memory used grows with the longest one.
    """
    def run(batches):
        for batch in batches:
            for a, b in T.parts(batch["text"], PART_BYTES):
                part = batch.slice(a, b - a)
                n, runs, collapsed = _of_part(part["text"])
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(n), runs, collapsed.cast(pa.string())],
                                                 ["id", "n_words", "runs", "collapsed"])
            T.give_back()

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id long, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_col)


def longest(runs: str = "runs"):
    """The run of greatest length, of equal ones the first by start, then period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(runs: str = "runs"):
    """Every run as ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
