"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs the votes.

Every rule says good, bad or nothing about a text. Texts with equal votes are alike, so the whole corpus is summed
up by counts of vote patterns, of which there are at most three to the number of rules, however many texts there
are. On these, expectation-maximisation finds each rule's accuracy on good and on bad texts and the share of good
ones; a text's posterior probability of being good replaces the demand that it pass every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcal.llm import text as T
from eventcal.session import stored

SYMBOLS = T.byte_class(b"#*$%&|<>")
NOT_NEWLINE = ~T.byte_class(b"\n")
LEADING = ~T.byte_class(bytes(range(0x80, 0xC0)))
LETTER = T.byte_class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 0x100)))
FEATURES = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ended_lines", "n_repeat_words", "n_letter_words",
    "n_kinds", "n_marked_words", "letter_chars")]])


def _counts(table) -> pa.RecordBatch:
    buf, off = T.flat(table["text"])
    n = len(off) - 1
    start, end, doc = T.spans(buf, off, T.NOT_SPACE)
    count = lambda d: np.bincount(d, minlength=n)
    running = lambda mask: np.concatenate([[0], np.cumsum(mask[buf])])
    points, symbols, letters = running(LEADING), running(SYMBOLS), running(LETTER)
    chars = np.bincount(doc, points[end] - points[start], n).astype(np.int64)
    words = T.hash_spans(buf, start, end)
    alphabetic = running(LETTER & LEADING)

    ls, le, ld = T.spans(buf, off, NOT_NEWLINE)
    filled = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, ld = ls[filled], le[filled], ld[filled]
    h = T.hash_spans(buf, ls, le)
    order = np.lexsort((ls, h, ld))
    again = np.append(False, (h[order][1:] == h[order][:-1]) & (ld[order][1:] == ld[order][:-1])) if len(h) else np.zeros(0, bool)
    ended = np.isin(buf[le - 1], np.frombuffer(b".!?", np.uint8)) if len(le) else np.zeros(0, bool)

    inside = T.within(doc, 3)
    at = np.flatnonzero(inside)
    h3, d3 = T.hash_windows(words, 3)[at], doc[at]
    order3 = np.lexsort((h3, d3))
    same = (h3[order3][1:] == h3[order3][:-1]) & (d3[order3][1:] == d3[order3][:-1]) if len(at) else np.zeros(0, bool)
    twice = np.append(same, False) | np.append(False, same) if len(at) else np.zeros(0, bool)
    repeat = T.covered(at[order3[twice]], 3, len(doc))
    kinds = np.unique(np.stack([doc.astype(np.uint64), words], 1), axis=0)[:, 0].astype(np.int64) if len(doc) else doc
    return pa.RecordBatch.from_arrays([table["id"], *[pa.array(np.asarray(x, np.int64)) for x in (
        count(doc), chars, symbols[off[1:]] - symbols[off[:-1]], count(ld), count(ld[order][again]), count(ld[ended]),
        count(doc[repeat]), count(doc[letters[end] > letters[start]]), count(kinds),
        count(doc[symbols[end] > symbols[start]]), np.bincount(doc, alphabetic[end] - alphabetic[start], n))]], schema=FEATURES)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: a row for each row."""
    def scan(batches):
        for batch in batches:
            for a, b in T.parts(batch["text"], 1_500_000):
                yield _counts(batch.slice(a, b - a))
            T.give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scan, ", ".join(f"{f.name} long" for f in FEATURES))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules as columns over ``features``: 1 good, -1 bad, 0 abstains. Texts under 20 words get few votes."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    enough = c("n_words") >= 20
    return {
        "length": _vote(c("n_words") >= 80, c("n_words") < 40),
        "word_size": _vote(enough & share("word_chars", "n_words").between(2.5, 10), enough & ~share("word_chars", "n_words").between(2, 14)),
        "symbols": _vote(enough & (share("n_symbols", "n_words") < 0.05), share("n_symbols", "n_words") > 0.2),
        "marked_words": _vote(enough & (share("n_marked_words", "n_words") < 0.02), enough & (share("n_marked_words", "n_words") > 0.15)),
        "letter_chars": _vote(enough & (share("letter_chars", "word_chars") > 0.85), enough & (share("letter_chars", "word_chars") < 0.8)),
        "lines": _vote((c("n_lines") >= 3) & (share("n_dup_lines", "n_lines") < 0.1), (c("n_lines") >= 3) & (share("n_dup_lines", "n_lines") > 0.3)),
        "repeats": _vote(enough & (share("n_repeat_words", "n_words") < 0.15), enough & (share("n_repeat_words", "n_words") > 0.4)),
        "letters": _vote(enough & (share("n_letter_words", "n_words") > 0.9), enough & (share("n_letter_words", "n_words") < 0.7)),
        "variety": _vote(enough & (share("n_kinds", "n_words") > 0.3), (c("n_words") < 2000) & enough & (share("n_kinds", "n_words") < 0.15)),
        "sentences": _vote(share("n_ended_lines", "n_lines") > 0.5, (c("n_lines") >= 3) & (share("n_ended_lines", "n_lines") < 0.1)),
    }


@dataclass
class Weights:
    """log-odds of a good text before any vote, and what a good and a bad vote of each rule add."""

    prior: float
    rules: dict[str, tuple[float, float]]

    def posterior(self) -> Column:
        z = F.lit(self.prior)
        for name, (good, bad) in self.rules.items():
            z = z + F.when(F.col(f"vote_{name}") > 0, good).when(F.col(f"vote_{name}") < 0, bad).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 200, prior: float = 0.8,
        accuracy: float = 0.8, belief: float = 20.0) -> Weights:
    """Expectation-maximisation over vote patterns (rows of 1, 0, -1) with their counts.

    A rule has one accuracy on good and one on bad texts; ``belief`` votes at ``accuracy`` are added to each, which keeps a
    rule that hardly votes near it and the classes from trading places.
    """
    right = np.full((2, len(names)), accuracy)   # P(votes good | good), P(votes bad | bad), where it votes
    share = prior
    if counts.sum():
        up, down = patterns > 0, patterns < 0
        for _ in range(rounds):
            good = np.log(share) + up @ np.log(right[0]) + down @ np.log(1 - right[0])
            bad = np.log(1 - share) + up @ np.log(1 - right[1]) + down @ np.log(right[1])
            p = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
            a, b = counts * p, counts * (1 - p)
            new = np.stack([(a @ up + belief * accuracy) / (a @ (up | down) + belief),
                            (b @ down + belief * accuracy) / (b @ (up | down) + belief)])
            moved = np.abs(new - right).max()
            right = np.clip(new, 1e-4, 1 - 1e-4)
            share = float(np.clip((a.sum() + belief * prior) / (counts.sum() + belief), 1e-4, 1 - 1e-4))
            if moved < 1e-9:
                break
    log = lambda x: round(float(x), 9)
    return Weights(log(math.log(share / (1 - share))), {
        n: (log(np.log(right[0, j] / (1 - right[1, j]))), log(np.log((1 - right[0, j]) / right[1, j]))) for j, n in enumerate(names)})


def supervise(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``features``, a vote of each rule, ``posterior``, ``base_failed`` and ``kept`` of every row.

    ``base_failed``: under 50 words, or more than half of them in repeated three-word windows; such a text is not kept,
    others are if their posterior is ``least`` or more. Null and empty texts have no words. An empty table gives an
    empty result; other columns are not read; rows that repeat an id are judged one by one.
    """
    rules = votes()
    rated = stored(features(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in rules.items()}), "votes")
    summed = rated.groupBy(*[f"vote_{k}" for k in rules]).count().collect()  # at most three to the number of rules
    patterns = np.array([[r[f"vote_{k}"] for k in rules] for r in summed], np.int64).reshape(-1, len(rules))
    order = np.lexsort(patterns.T[::-1]) if len(patterns) else []
    weights = fit(patterns[order], np.array([r["count"] for r in summed], float)[order], list(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rated.withColumn("posterior", weights.posterior()).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= least)).withColumnRenamed("id", id_col)
