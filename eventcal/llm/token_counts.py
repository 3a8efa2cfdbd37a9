"""Token counts by a linear longest-match automaton.

Greedy word pieces are those that a trie of the vocabulary finds if each node has a failure link: where to go on when
no edge fits, and how many pieces are complete by then. A word is read once, byte by byte; following links adds
numbers of pieces, so no piece is ever built. Words of a batch advance together, each different word once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.llm import text as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
NOWHERE = -1
FIRST, INNER = 0, 1          # the roots of pieces that begin a word and of those inside one
PART_BYTES = 4_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def pieces_of(path: str) -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """(pieces that begin a word, pieces inside one) of a byte-level vocabulary, whose words begin with a space."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    letters = byte_letters()
    special = {t["content"] for t in stored.get("added_tokens", ())}
    made = [bytes(letters[c] for c in piece) for piece in stored["model"]["vocab"] if piece not in special]
    return tuple(p[1:] for p in made if p[:1] == b" " and len(p) > 1), tuple(p for p in made if p[:1] != b" ")


@dataclass
class Automaton:
    edges: np.ndarray        # node * 256 + byte, sorted
    targets: np.ndarray
    link: np.ndarray         # failure link of each node, NOWHERE if the word cannot be cut
    popped: np.ndarray       # pieces complete when the link is followed

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.targets[at], NOWHERE)


def build(first: tuple[bytes, ...], inner: tuple[bytes, ...]) -> Automaton:
    goto: list[dict[int, int]] = [{}, {}]
    piece_ends = [False, False]
    for root, group in ((FIRST, first), (INNER, inner)):
        for piece in group:
            v = root
            for b in piece:
                if b not in goto[v]:
                    goto[v][b] = len(goto)
                    goto.append({})
                    piece_ends.append(False)
                v = goto[v][b]
            piece_ends[v] |= v > INNER
    link, popped = [NOWHERE] * len(goto), [0] * len(goto)
    queue = [FIRST, INNER]
    for u in queue:                              # breadth first: links lead to shorter strings
        for b, v in goto[u].items():
            if piece_ends[v]:
                link[v], popped[v] = INNER, 1
            else:
                z, k = link[u], popped[u]
                while z != NOWHERE and b not in goto[z]:
                    z, k = link[z], k + popped[z]
                if z != NOWHERE:
                    link[v], popped[v] = goto[z][b], k
            queue.append(v)
    edges = sorted((u * 256 + b, v) for u, out in enumerate(goto) for b, v in out.items())
    at = np.array([e for e, _ in edges] or [-1], np.int64)
    return Automaton(at, np.array([v for _, v in edges] or [NOWHERE], np.int64), np.array(link), np.array(popped))


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return build(*pieces_of(path))


def count_pieces(machine: Automaton, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pieces of each word data[at[i]:at[i+1]]; 0 if it cannot be cut into pieces."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    node, count = np.full(len(size), FIRST), np.zeros(len(size), np.int64)
    dead = np.zeros(len(size), bool)
    ends = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0)) + 1), "left")  # words longer than k

    def fail(words: np.ndarray) -> np.ndarray:
        """Follow the links of these words; those that have one."""
        to = machine.link[node[words]]
        dead[words[to == NOWHERE]] = True
        words, to = words[to != NOWHERE], to[to != NOWHERE]
        count[words] += machine.popped[node[words]]
        node[words] = to
        return words

    for k in range(len(ends) - 1):
        words = order[:ends[k]]
        words = words[~dead[words]]
        while len(words):
            to = machine.step(node[words], data[at[words] + k].astype(np.int64))
            node[words[to != NOWHERE]] = to[to != NOWHERE]
            words = fail(words[to == NOWHERE])
    words = np.flatnonzero(~dead & (size > 0) & (node != INNER))
    while len(words):
        words = fail(words)
        words = words[node[words] != INNER]
    count[dead] = 0
    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of every row: pieces of its words, each cut greedily from the left.

    Words stand between ASCII white space. A word that cannot be cut into pieces of the vocabulary is one token, and
    counted in ``n_unknown``. Null and empty texts have none; texts are counted whole; rows that repeat an id one by one;
    other columns are not read.
    """
    def scan(batches):
        machine = automaton(vocabulary)
        for batch in batches:
            for a, b in T.parts(batch["text"], PART_BYTES):
                part = batch.slice(a, b - a)
                n = part.num_rows
                buf, off = T.flat(part["text"])
                start, end, doc = T.spans(buf, off, T.NOT_SPACE)
                data, at = T.pieces(buf, start, end)
                coded = T.binary(data, np.diff(at)).dictionary_encode()
                code = np.asarray(coded.indices).astype(np.int64)
                found, edge = T.flat(coded.dictionary.view(pa.large_string())) if len(code) else (data, at)
                pieces = count_pieces(machine, found, edge) if len(code) else np.zeros(0, np.int64)
                each = pieces[code]
                yield pa.RecordBatch.from_arrays([part["id"], *[pa.array(x.astype(np.int64)) for x in (
                    np.bincount(doc, minlength=n), np.bincount(doc, np.maximum(each, 1), n), np.bincount(doc[each == 0], minlength=n))]],
                    ["id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scan, "id long, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
