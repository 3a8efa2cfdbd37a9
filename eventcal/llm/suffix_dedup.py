"""Byte-exact substring dedup with column-wise suffix orders of many texts.

Strings of ``length`` bytes that occur twice are found in the suffix order of collections of excerpts. A
collection is built column by column from the right: each round inserts one symbol of every excerpt,
appends the new part of the collection's Burrows-Wheeler transform and of the neighbours' common prefixes to
two files, and the next round reads that part back.

To spread this over a cluster, a collection is a group of excerpts that can have anything in common.
Every string of ``length`` bytes has one anchor, its leftmost k-gram of least hash, so equal strings
have equal anchors at equal distances. Consecutive strings with one anchor form an excerpt of less than twice
their length, and excerpts are dealt by their anchor's content. A symbol counts as different at another distance from
the anchor; so what a round inserts is a part of its own, at the end of the files, and no earlier part is touched.

Work follows what repeats: an anchor that occurs once in the corpus (``packed``) has no repeat; equal excerpts,
compared by 80 bits of hash, enter a collection once; an anchor with one content left needs no collection. If an
anchor occurs too often for one task, each of its strings is an excerpt of its own, dealt by its own content.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from eventcal.llm import packed as P
from eventcal.llm import text as T
from eventcal.llm.substring_dedup import NO_ID, plain, planes
from eventcal.llm.text import U64

#: Occurrences of one anchor from which its strings are dealt one by one.
HOT_ANCHOR = 30_000
CHUNK_BYTES = 2_000_000

#: What is told of excerpts: hashes of anchor and content, place of the text, place in the text, distance from the
#: start to the anchor, number of strings.
FIELDS = {"anchor": "<u8", "h": "<u8", "g": "<u2", "id": "<i8", "row": "<u4", "start": "<u4", "left": "<u4", "count": "<u4"}
#: Rows that a task passes on: repeats found already, excerpts told, excerpts wanted with their bytes.
FOUND, TOLD, WANTED = 0, 1, 2
TALK = "owner int, chunk long, kind int, bytes binary, " + ", ".join(f"{c} binary" for c in FIELDS)
TALK_ARROW = pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("bytes", pa.binary()),
                        *[(c, pa.binary()) for c in FIELDS]])
RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept", pa.binary())])


def _row(owner: int, chunk: int, kind: int, values: dict, data: bytes | None = None) -> tuple:
    return (owner, chunk, kind, data, *[planes(values[c], k) if c in values else None for c, k in FIELDS.items()])


def _read(table: pa.Table, kind: int, *fields: str):
    """(chunk of each excerpt, {field: values}) over the rows of one kind."""
    table = table.filter(pc.equal(table["kind"], kind))
    got = {c: [plain(x, FIELDS[c]) for x in table[c].to_pylist()] for c in fields}
    sizes = [len(x) for x in got[fields[0]]]
    chunk = np.repeat(table["chunk"].to_numpy().astype(np.int64), sizes)
    whole = {c: np.concatenate(x) if x else np.zeros(0, FIELDS[c]) for c, x in got.items()}
    return table, chunk, {c: x if x.dtype == U64 else x.astype(np.int64) for c, x in whole.items()}


def _by_chunk(kind: int, chunk: np.ndarray, values: dict) -> list[tuple]:
    order = np.argsort(chunk, kind="stable")
    c = chunk[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]]) if len(c) else [0]
    return [_row(0, int(c[a]), kind, {k: v[order[a:b]] for k, v in values.items()}) for a, b in zip(edges[:-1], edges[1:])]


# ------------------------------------------------------------------ anchors
def seed_size(length: int) -> int:
    return 1 << max(0, (max(1, length // 3)).bit_length() - 1)


#: Bytes taken at a time, so that the passes below stay in a core's cache.
BLOCK = 32_768


def _gram_hash(coded: np.ndarray, k: int) -> np.ndarray:
    h, step, odd = coded, 1, 0x9E3779B1
    while step < k:
        h = h[:-step] * np.uint32(odd) + h[step:]
        step, odd = step * 2, (odd * odd + 2) & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    return h


def _anchor_of(buf: np.ndarray, k: int, reach: int) -> np.ndarray:
    """For each start the leftmost of the ``reach`` k-grams from there that has the least hash."""
    table = np.random.default_rng(5).integers(1, 1 << 32, 256, dtype=np.uint32)
    n = len(buf) - k - reach + 2
    out = np.empty(n, np.int64)
    for a in range(0, n, BLOCK):
        size = min(BLOCK, n - a)
        h = _gram_hash(table[buf[a:a + size + k + reach - 2]], k)
        low = (h.astype(U64) << U64(32)) | np.arange(len(h), dtype=U64)
        step = 1
        while step * 2 <= reach:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < reach:
            low = np.minimum(low[:len(low) - (reach - step)], low[reach - step:])
        out[a:a + size] = (low & U64(0xFFFFFFFF)).astype(np.int64) + a
    return out


def anchors(buf: np.ndarray, off: np.ndarray, length: int):
    """(text, anchor, first start, last start) of each run of strings that share an anchor."""
    k = seed_size(length)
    reach, n = length - k + 1, len(buf) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = _anchor_of(buf, k, reach)
    valid = np.zeros(n + 1, np.int32)
    a, b = off[:-1], np.maximum(off[1:] - length + 1, off[:-1])
    np.add.at(valid, np.minimum(a, n), 1)
    np.add.at(valid, np.minimum(b, n), -1)
    start = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchor = at[start]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first, last = start[np.append(0, cut)], start[np.append(cut, len(start)) - 1]
    doc = np.searchsorted(off, first, "right") - 1
    # Neighbouring texts can share no string, but may share a run: split at the text's edge.
    return doc, anchor[np.append(0, cut)], first, last


# ------------------------------------------------------------------ the collection
class _Parts:
    """A file to which each round appends its part, and from which the next round reads it back."""

    def __init__(self, folder: str, name: str, kind):
        self.path, self.kind, self.at, self.n = os.path.join(folder, name), np.dtype(kind), 0, 0

    def append(self, values: np.ndarray) -> None:
        self.at, self.n = self.at + self.n, len(values)
        with open(self.path, "ab") as f:
            values.astype(self.kind).tofile(f)

    def last(self) -> np.ndarray:
        return np.fromfile(self.path, self.kind, self.n, offset=self.at * self.kind.itemsize)


def columns(data: np.ndarray, at: np.ndarray, left: np.ndarray):
    """Each column from the right: (column, excerpts in the order of their suffixes from it, common prefixes).

    Excerpt i is data[at[i]:at[i+1]] and its anchor begins ``left[i]`` bytes in, at column 0. A prefix in common
    is told for each excerpt and the one before it. End signs come first, by excerpt, and share nothing.
    """
    right = np.diff(at) - left                       # columns from the anchor to the end
    if not len(right):
        return
    joins = np.argsort(-right, kind="stable")        # excerpts by the round in which they join
    joined, order = 0, np.zeros(0, np.int64)
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        transform, common = _Parts(folder, "bwt", np.uint8), _Parts(folder, "lcp", np.uint32)
        for column in range(int(right.max()) - 1, -int(left.max()) - 1, -1):
            end = joined + int(np.searchsorted(-right[joins[joined:]], -(column + 1), "right"))
            fresh = np.sort(joins[joined:end])
            joined = end
            symbols, shared = transform.last() if joined > len(fresh) else np.zeros(0, np.uint8), None
            shared = common.last() if len(symbols) else np.zeros(0, np.uint32)
            here = left[order] + column >= 0         # an excerpt leaves left of its first byte
            if len(fresh) or not here.all():
                stay = np.flatnonzero(here)
                if len(stay) < len(order):           # the least between the neighbours that stay
                    shared = (np.minimum.reduceat(shared[:stay[-1] + 1], np.append(0, stay[:-1] + 1)) if len(stay)
                              else shared[:0])
                symbols = np.concatenate([data[at[fresh] + left[fresh] + column], symbols[stay]])
                shared = np.concatenate([np.zeros(len(fresh), np.uint32), shared])
                if len(fresh) and len(stay):
                    shared[len(fresh)] = 0
                order = np.concatenate([fresh, order[stay]])
            by = np.argsort(symbols, kind="stable")
            s = symbols[by]
            same = np.append(False, s[1:] == s[:-1])
            grown = np.zeros(len(by), np.uint32)
            if same.any():
                k = np.flatnonzero(same)
                between = np.stack([by[k - 1] + 1, by[k] + 1], 1).ravel()
                grown[k] = np.minimum.reduceat(np.append(shared, np.uint32(0)), between)[::2] + 1
            order = order[by]
            more = left[order] + column > 0
            transform.append(np.where(more, data[np.maximum(at[order] + left[order] + column - 1, 0)], 0))
            common.append(grown)
            yield column, order, grown


def later_strings(data, at, left, ids, starts, length: int):
    """(excerpt, offset) of every string of ``length`` bytes that starts strictly earlier in another place."""
    size, out = np.diff(at), []
    for column, order, common in columns(data, at, left):
        joins = np.flatnonzero(common >= length)
        if not len(joins):
            continue
        head = joins[np.append(True, np.diff(joins) > 1)] - 1
        member = np.union1d(joins, head)
        who, group = order[member], np.cumsum(np.isin(member, head)) - 1
        begin = starts[who] + left[who] + column
        by, late = _later(ids[who], begin, group)
        hit = who[by[late]]
        out.append((hit, left[hit] + column))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, offset = (np.concatenate(x) for x in zip(*out))
    assert (offset + length <= size[which]).all()
    return which, offset


# ------------------------------------------------------------------ the operator
def _chunk(table: pa.Table):
    """A chunk's texts, rows that repeat id and text once; and which of them each row is."""
    table = T.in_order(table)
    twin = np.zeros(table.num_rows, bool)
    if table.num_rows > 1:
        a, b = table.slice(0, table.num_rows - 1), table.slice(1)
        same = lambda c: np.asarray(pc.fill_null(pc.or_(
            pc.fill_null(pc.equal(a[c], b[c]), False), pc.and_(pc.is_null(a[c]), pc.is_null(b[c]))), False))
        twin[1:] = same("id") & same("text")
    one = table.filter(pa.array(~twin))
    buf, off = T.flat(one["text"])
    return one, buf, off, one["id"].fill_null(NO_ID).to_numpy().astype(np.int64), np.cumsum(~twin) - 1


def _later(ids: np.ndarray, starts: np.ndarray, group: np.ndarray):
    """(order, is the row later than its group's first), by group, id and start."""
    order = np.lexsort((starts, ids, group))
    if not len(order):
        return order, np.zeros(0, bool)
    g = group[order]
    new = np.append(True, g[1:] != g[:-1])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, (ids[order] != ids[lead]) | (starts[order] != starts[lead])


def _groups(*parts: np.ndarray) -> np.ndarray:
    """A number for each different combination of values."""
    order = np.lexsort(parts)
    new = np.zeros(len(order), bool)
    for p in parts:
        new[1:] |= p[order][1:] != p[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def compare(table: pa.Table) -> pa.Table:
    """Of the excerpts told to one task: repeats of whole excerpts, and the contents to be compared byte by byte."""
    known, _, _ = _read(table, FOUND, "row")
    out = [tuple(r.values()) for r in known.to_pylist()]
    _, chunk, v = _read(table, TOLD, *FIELDS)
    if len(chunk):
        content = _groups(v["g"], v["h"])
        order, later = _later(v["id"], v["start"], content)
        gone, left = order[later], order[~later]
        out += _by_chunk(FOUND, chunk[gone], {c: v[c][gone] for c in ("row", "start", "count")})
        _, anchor = np.unique(v["anchor"][left], return_inverse=True)
        several = np.bincount(anchor, minlength=1)[anchor] > 1
        want = left[several]
        out += _by_chunk(WANTED, chunk[want], {c: v[c][want] for c in FIELDS})
    return P.as_table(out, TALK_ARROW)


def collect(table: pa.Table, length: int) -> pa.Table:
    """The repeats among the excerpts of one collection."""
    known, _, _ = _read(table, FOUND, "row")
    out = [tuple(r.values()) for r in known.to_pylist()]
    asked, chunk, v = _read(table, WANTED, "row", "start", "left", "count", "id")
    if len(chunk):
        data = np.concatenate([np.frombuffer(x, np.uint8) for x in asked["bytes"].to_pylist()])
        at = np.concatenate([[0], np.cumsum(v["count"] + length - 1)])
        which, offset = later_strings(data, at, v["left"], v["id"], v["start"], length)
        if len(which):
            by = np.lexsort((offset, which))
            which, offset = which[by], offset[by]
            head = np.flatnonzero(np.append(True, (np.diff(which) != 0) | (np.diff(offset) != 1)))
            t = which[head]
            out += _by_chunk(FOUND, chunk[t], {"row": v["row"][t], "start": v["start"][t] + offset[head],
                                               "count": np.diff(np.append(head, len(which)))})
    return P.as_table(out, TALK_ARROW)


def dedup_suffixes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = CHUNK_BYTES, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row: bytes of a repeat that starts earlier go.

    A repeat is a string of ``length`` bytes of UTF-8 that also starts at a smaller id, or earlier in the
    same text; a null id comes last, and rows that repeat an id and its text are one text for that matter.
    ``n_spans`` counts maximal removed runs, ``kept`` is what is left, as bytes (a removed run may cut a
    character). A null or empty text has no bytes; texts shorter than ``length`` stay; an empty table gives
    an empty result. Texts are processed whole; other columns are not read.
    """
    if length < 3:
        raise ValueError("length: three bytes or more")
    n_bytes = P.corpus_bytes(docs, text_col)
    buckets = P.bucket_count(n_bytes // 35)
    owners = P.bucket_count(n_bytes, 6_000_000)
    dealt = P.chunked(docs, n_bytes, id_col, text_col, chunk_bytes)
    k = seed_size(length)

    def probe(table: pa.Table) -> pa.Table:
        _, buf, off, _, _ = _chunk(table)
        _, anchor, _, _ = anchors(buf, off, length)
        return P.as_table(P.send(table["chunk"][0].as_py(), P.key(T.hash_spans(buf, anchor, anchor + k), buckets)),
                          P.SENT_ARROW)

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0 or answers.num_rows == 0:
            return P.as_table([], TALK_ARROW)
        _, buf, off, ids, _ = _chunk(table)
        chunk = table["chunk"][0].as_py()
        doc, anchor, first, last = anchors(buf, off, length)
        h = T.hash_spans(buf, anchor, anchor + k)
        held, counts = P.answered(answers)
        place = P.lookup(P.key(h, buckets), held)
        hot = (place >= 0) & (counts[place] >= hot_anchor)
        cold = (place >= 0) & ~hot
        one = last[hot] - first[hot] + 1
        alone = np.repeat(first[hot], one) + np.arange(one.sum()) - np.repeat(np.cumsum(one) - one, one)
        doc = np.concatenate([doc[cold], np.repeat(doc[hot], one)])
        start = np.concatenate([first[cold], alone])
        end = np.concatenate([last[cold], alone]) + length
        v = {"anchor": np.concatenate([h[cold], T.hash_spans(buf, alone, alone + length)]),
             "h": T.hash_spans(buf, start, end), "g": T.hash_spans(buf, start, end, 11) & U64(0xFFFF), "id": ids[doc],
             "row": doc, "start": start - off[doc], "left": np.concatenate([anchor[cold], alone]) - start,
             "count": end - start - length + 1}
        order, later = _later(v["id"], v["start"], _groups(v["g"], v["h"]))
        known, asked = order[later], order[~later]
        out = [_row(int(chunk % owners), chunk, FOUND, {c: v[c][known] for c in ("row", "start", "count")})] if len(known) else []
        return P.as_table(out + _by_owner(chunk, asked, v, owners, TOLD), TALK_ARROW)

    def fetch(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if table.num_rows == 0 or wanted.num_rows == 0:
            return P.as_table([], TALK_ARROW)
        chunk = table["chunk"][0].as_py()
        known, _, _ = _read(wanted, FOUND, "row")
        out = [(int(chunk % owners), *list(r.values())[1:]) for r in known.to_pylist()]
        _, at, v = _read(wanted, WANTED, *FIELDS)
        if len(at):
            _, buf, off, _, _ = _chunk(table)
            start = off[v["row"]] + v["start"]
            out += _by_owner(chunk, np.arange(len(at)), v, owners, WANTED, buf, start, start + v["count"] + length - 1)
        return P.as_table(out, TALK_ARROW)

    def gather(table: pa.Table) -> pa.Table:
        return collect(table, length)

    def strip(table: pa.Table, later: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return RESULT.empty_table()
        one, buf, off, _, row_of = _chunk(table)
        edge = np.zeros(len(buf) + length + 1, np.int32)
        _, _, v = _read(later, FOUND, "row", "start", "count")
        at = off[v["row"]] + v["start"]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + v["count"] + length - 1, -1)
        gone = np.cumsum(edge)[:len(buf)] > 0
        size = np.diff(off)
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[off[1:]] - sums[off[:-1]]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        begin = off[:-1][size > 0]
        opens[begin] = gone[begin]
        sums = np.concatenate([[0], np.cumsum(opens)])
        made = pa.Table.from_arrays([
            one["id"], pa.array(size), pa.array(removed), pa.array(sums[off[1:]] - sums[off[:-1]]),
            T.binary(buf[~gone], size - removed).cast(pa.binary())], schema=RESULT)
        return made.take(pa.array(row_of))

    answers = P.repeated(dealt.groupBy("chunk").applyInArrow(probe, P.SENT))
    told = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tell, TALK)
    wanted = told.groupBy("owner").applyInArrow(compare, TALK)
    brought = dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(fetch, TALK)
    later = brought.groupBy("owner").applyInArrow(gather, TALK)
    out = dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(
        strip, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def _by_owner(chunk: int, which: np.ndarray, v: dict, owners: int, kind: int, buf=None, start=None, end=None) -> list[tuple]:
    """Excerpts dealt by their anchor's content, with their bytes if a buffer is given."""
    owner = ((v["anchor"][which] >> U64(40)) % U64(owners)).astype(np.int64)
    by = np.argsort(owner, kind="stable")
    which, owner = which[by], owner[by]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else [0]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        i = which[a:b]
        data = T.pieces(buf, start[i], end[i])[0].tobytes() if buf is not None else None
        out.append(_row(int(owner[a]), chunk, kind, {c: v[c][i] for c in FIELDS}, data))
    return out
