"""Substring dedup with fixed-block anchors.

Every text is cut into non-overlapping blocks of words; they are the index. Every rolling window of a
block's length, of every text, probes it. With blocks of at most half a window, a passage of ``window``
words always holds a whole block of whichever text has it first, so a passage that repeats always has
a hit. Hits are then extended: the passages of ``window`` words around a hit are grouped by content,
and runs of those that start earlier elsewhere are the maximal exact repeats.

Probes and answers travel packed (``packed``); a chunk sends each distinct passage once, so a passage that
a third of all texts share is one item for each chunk. Passages are compared by 80 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventcal.llm import packed as P
from eventcal.llm import text as T
from eventcal.llm.text import U64

NO_ID = np.iinfo(np.int64).max

PASSAGES = "owner int, chunk long, kind int, h binary, g binary, id binary, row binary, start binary"
PASSAGES_ARROW = pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()),
                            *[(c, pa.binary()) for c in ("h", "g", "id", "row", "start")]])
LATER = "chunk long, row binary, start binary"
LATER_ARROW = pa.schema([("chunk", pa.int64()), ("row", pa.binary()), ("start", pa.binary())])
#: Passages that the chunk itself knows to be later ones, and those that a bucket has to judge.
KNOWN, ASKED = 0, 1


def _chunk(table: pa.Table):
    table = T.in_order(table)
    buf, off = T.flat(table["text"])
    start, end, doc = T.spans(buf, off, T.NOT_SPACE)
    ids = table["id"].fill_null(NO_ID).to_numpy().astype(np.int64)
    return table, buf, start, end, doc, ids


def _aligned(doc: np.ndarray, n_docs: int, block: int) -> np.ndarray:
    first = np.searchsorted(doc, np.arange(n_docs))
    return (np.arange(len(doc)) - first[doc]) % block == 0


def planes(x: np.ndarray, kind: str) -> bytes:
    """An array as byte planes, which the codec shrinks better than whole numbers."""
    return np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def columns(h, g, ids, rows, starts) -> tuple:
    return planes(h, "<u8"), planes(g, "<u2"), planes(ids, "<i8"), planes(rows, "<u4"), planes(starts, "<u4")


def plain(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def first_of(h, g, ids, starts):
    """(order, beginning of each group, is a row later than the first of its group) by (h, g), then (id, start)."""
    order = np.lexsort((starts, ids, g, h))
    a, b, i, s = h[order], g[order], ids[order], starts[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return order, (i != i[head][group]) | (s != s[head][group])


def judge(table: pa.Table) -> pa.Table:
    """Which passages of a bucket also start earlier, by chunk; strictly, so that repeated rows of one id stay."""
    kinds, chunks = table["kind"].to_pylist(), table["chunk"].to_pylist()
    raw = {c: table[c].to_pylist() for c in ("h", "g", "id", "row", "start")}
    out = [(chunks[k], raw["row"][k], raw["start"][k]) for k, kind in enumerate(kinds) if kind == KNOWN]
    asked = [k for k, kind in enumerate(kinds) if kind == ASKED]
    if asked:
        get = lambda c, kind: [plain(raw[c][k], kind) for k in asked]
        row, start, h = get("row", "<u4"), get("start", "<u4"), get("h", "<u8")
        sizes = [len(x) for x in h]
        order, later = first_of(np.concatenate(h), np.concatenate(get("g", "<u2")), np.concatenate(get("id", "<i8")),
                                np.concatenate(start))
        mark = np.zeros(len(order), bool)
        mark[order] = later
        for k, r, s, m in zip(asked, row, start, np.split(mark, np.cumsum(sizes)[:-1])):
            if m.any():
                out.append((chunks[k], planes(r[m], "<u4"), planes(s[m], "<u4")))
    return P.as_table(out, LATER_ARROW)


def passages(chunk: int, h, g, ids, rows, starts, owners: int) -> list[tuple]:
    """Rows of PASSAGES: each content of the chunk once; its later ones in the chunk are known at once."""
    order, later = first_of(h, g, ids, starts)
    out = []
    known = order[later]
    if len(known):
        out.append((int(chunk % owners), chunk, KNOWN, None, None, None,
                    planes(rows[known], "<u4"), planes(starts[known], "<u4")))
    asked = order[~later]
    owner = (h[asked] >> U64(40)) % U64(owners)
    by = np.argsort(owner, kind="stable")
    asked, owner = asked[by], owner[by]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        k = asked[a:b]
        out.append((int(owner[a]), chunk, ASKED, *columns(h[k], g[k], ids[k], rows[k], starts[k])))
    return out


def later_starts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of one chunk's repeats."""
    if table.num_rows == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([plain(x, "<u4") for x in table[c].to_pylist()]).astype(np.int64) for c in ("row", "start"))


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     chunk_bytes: int = P.CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text) of every row: words within a repeat that starts earlier go.

    ``spans`` are the maximal removed runs, ``from:to`` in words, comma-joined. Earlier is a smaller id, or an
    earlier start in the same text; a null id comes last. Rows that repeat an id and its text are one text
    for that matter. A null or empty text has no words and keeps an empty text; an empty table gives an
    empty result. Texts are processed whole, whatever their length; other columns are not read.
    """
    if window < 2:
        raise ValueError("window: two words or more")
    block = (window + 1) // 2
    n_bytes = P.corpus_bytes(docs, text_col)
    buckets = P.bucket_count(n_bytes // 6)
    owners = P.bucket_count(n_bytes // 20)
    dealt = P.chunked(docs, n_bytes, id_col, text_col, chunk_bytes)

    def probe(table: pa.Table) -> pa.Table:
        table, buf, start, end, doc, _ = _chunk(table)
        chunk = table["chunk"][0].as_py()
        keys = P.key(T.hash_windows(T.hash_spans(buf, start, end), block), buckets)
        valid = T.within(doc, block)
        fixed = valid & _aligned(doc, table.num_rows, block)[:len(valid)]
        return P.as_table(P.send(chunk, keys[valid]) + P.send(chunk, keys[fixed], 1, False), P.SENT_ARROW)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return P.as_table([], PASSAGES_ARROW)
        table, buf, start, end, doc, ids = _chunk(table)
        words = T.hash_spans(buf, start, end)
        hit = P.lookup(P.key(T.hash_windows(words, block), buckets), P.answered(answers)[0]) >= 0
        seen = np.concatenate([[0], np.cumsum(hit & T.within(doc, block))])
        inside = T.within(doc, window)
        n, reach = len(inside), window - block + 1
        at = np.flatnonzero(inside & (seen[reach:reach + n] > seen[:n]))
        if not len(at):
            return P.as_table([], PASSAGES_ARROW)
        h = T.hash_windows(words, window)[at]
        g = T.hash_windows(T.hash_spans(buf, start, end, 11), window)[at] & U64(0xFFFF)
        first = np.searchsorted(doc, np.arange(table.num_rows))
        row = doc[at]
        return P.as_table(passages(table["chunk"][0].as_py(), h, g, ids[row], row, at - first[row], owners), PASSAGES_ARROW)

    def strip(table: pa.Table, later: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.schema(RESULT).empty_table()
        table, buf, start, end, doc, _ = _chunk(table)
        row, at = later_starts(later)
        first = np.searchsorted(doc, np.arange(table.num_rows))
        gone = T.covered(first[row] + at, window, len(doc)) if len(row) else np.zeros(len(doc), bool)
        stay = ~gone
        n = table.num_rows
        return pa.Table.from_arrays([
            table["id"], pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[gone], minlength=n)),
            pa.array(runs(gone, doc, first, n)), T.joined(buf, start[stay], end[stay], doc[stay], n, pa.large_string()).cast(pa.string()),
        ], schema=pa.schema(RESULT))

    answers = P.repeated(dealt.groupBy("chunk").applyInArrow(probe, P.SENT), indexed=True)
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(extend, PASSAGES)
    later = found.groupBy("owner").applyInArrow(judge, LATER)
    out = dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(
        strip, "id long, n_words long, n_removed long, spans string, kept_text string")
    return out.withColumnRenamed("id", id_col)


RESULT = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.string()),
          ("kept_text", pa.string())]


def runs(gone: np.ndarray, doc: np.ndarray, first: np.ndarray, n_docs: int) -> list[str]:
    """The maximal runs of marked places in each text, from:to, comma-joined."""
    out: list[list[str]] = [[] for _ in range(n_docs)]
    at = np.flatnonzero(gone)
    if len(at):
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) != 0)) + 1
        for a, b in zip(at[np.append(0, cut)], at[np.append(cut, len(at)) - 1]):
            d = doc[a]
            out[d].append(f"{a - first[d]}:{b - first[d] + 1}")
    return [",".join(x) for x in out]
