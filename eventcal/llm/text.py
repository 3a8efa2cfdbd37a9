"""Words, lines and windows of a batch of texts as flat arrays.

A batch is one byte buffer plus the offset of each text in it; everything else here are positions in
that buffer. Hashes are 64-bit polynomial sums over random tables, which turn the hash of any window
into a difference of two running sums.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Words are what stands between ASCII white space.
NOT_SPACE = ~byte_class(b" \t\n\v\f\r")
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = ~byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Rows that are sent to a Python worker at a time; texts are long, so fewer than for numbers.
BATCH_ROWS = 2_000


def small_batches(df):
    """The frame, in a session that sends texts in small batches; a smaller setting is kept.

    Python workers and the JVM each hold a batch or two, and share an executor's memory.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return what Arrow and the allocator keep for later to the system.

    Workers live on from one step to the next, and what they no longer use counts against the executor. Where the
    C library cannot trim its heap, only Arrow's part goes back. A long table of powers, made anew in little time, goes too.
    """
    global _LARGEST
    if _LARGEST > 1 << 18:
        _LARGEST = 0
        _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = _trimmer()
    if trim is not None:
        trim(0)


@lru_cache(1)
def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def parts(column, size: int) -> list[tuple[int, int]]:
    """(from, to) of runs of texts of about ``size`` bytes each; a longer text is a run of its own."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    if not len(sizes):
        return []
    edges = np.append(np.flatnonzero(np.append(True, np.diff(sizes // size) != 0)), len(sizes))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def in_order(table: pa.Table, id_col: str = "id", text_col: str = "text") -> pa.Table:
    """Rows by id, then text: the same order whatever order the shuffle delivered them in."""
    return table.take(pc.sort_indices(table, [(id_col, "ascending"), (text_col, "ascending")]))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray):
    """(start, end, text number) of the maximal runs of member bytes; no run crosses two texts."""
    inside = member[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = off[(off > 0) & (off < len(buf))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(np.random.default_rng(7).integers(1 << 59)) * 8 + 5
    up, down = np.full(n + 1, U64(base)), np.full(n + 1, U64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int):
    """The base to 0..n and its inverse to 0..n, modulo 2^64; one array that grows until ``give_back`` serves all."""
    global _LARGEST
    _LARGEST = max(_LARGEST, 1 << max(10, int(n).bit_length()))
    up, down = _powers(_LARGEST)
    return up[:n + 1], down[:n + 1]


_LARGEST = 0


@lru_cache(8)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 1000).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def _sums(values: np.ndarray):
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return total, down


def hash_spans(buf, start, end, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    total, down = _sums(_table(seed)[buf])
    return mix((total[end] - total[start]) * down[start])


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` neighbours in an array of hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total, down = _sums(words)
    return mix((total[size:] - total[:n]) * down[:n])


def within(doc: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` neighbours lie in one text."""
    n = max(0, len(doc) - size + 1)
    return doc[:n] == doc[size - 1:size - 1 + n]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``size`` that begins at one of the starts."""
    edge = np.zeros(n + size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0


def pieces(buf, start, end, gap: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after the other, each followed by ``gap``; and where each begins."""
    size = end - start + len(gap)
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    index = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    out = buf[np.minimum(index, max(len(buf) - 1, 0))] if len(buf) else np.zeros(at[-1], np.uint8)
    for i, b in enumerate(gap):
        out[at[1:] - len(gap) + i] = b
    return out, at


def joined(buf, start, end, doc, n_docs: int, kind=None) -> pa.Array:
    """For each text its spans joined by one space."""
    out, at = pieces(buf, start, end, b" ")
    final = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    keep = np.ones(len(out), bool)
    keep[at[1:][final] - 1] = False
    sizes = np.bincount(doc, (end - start + 1) - final, n_docs).astype(np.int64)
    return binary(out[keep], sizes, kind or pa.large_string())


def binary(data: np.ndarray, sizes: np.ndarray, kind=None) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    made = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    return made.view(kind) if kind is not None and kind != pa.large_binary() else made
