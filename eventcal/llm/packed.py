"""Corpus-wide repeats of hashed items without a row for each item.

Texts are dealt into chunks of a few MB by their id and text, so that many rows with one id or none spread too. A chunk sends its distinct hashes as sorted
32-bit remainders to the buckets that own them (the upper half of the hash names the bucket), and a
bucket answers each chunk with those that occur elsewhere. A hash takes about four bytes on the wire,
arrives at most once from a chunk however often it occurs there, and the number of buckets grows
with the corpus, so no bucket grows with it. Remainders can collide: the answer may hold a few hashes
that do not repeat, never miss one that does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.llm.text import U64, give_back

CHUNK_BYTES = 1_500_000
#: Of each item sent by a chunk: its own count there is told up to this.
MOST_TOLD = 65_535

SENT = "bucket int, chunk long, kind int, keys binary, counts binary"
ANSWER = "chunk long, bucket int, keys binary, counts binary"


def corpus_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()["b"]


def chunked(docs: DataFrame, n_bytes: int, id_col: str = "doc_id", text_col: str = "text",
            chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, id, text); other columns are left out. Rows that repeat id and text meet in one chunk."""
    n = max(1, -(-n_bytes // chunk_bytes))
    return docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).alias("chunk"),
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def bucket_count(n_items: int, per_bucket: int = 1_000_000) -> int:
    return int(max(8, -(-n_items // per_bucket)))


def key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and remainder of a hash in one number."""
    return (((h >> U64(32)) % U64(buckets)) << U64(32)) | (h & U64(0xFFFFFFFF))


def pack(sorted32: np.ndarray) -> bytes:
    """Sorted remainders as differences, byte plane by byte plane, so that the codec finds the zeros."""
    return np.diff(sorted32, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def by_bucket(keys: np.ndarray):
    """(bucket, from, to) over sorted keys."""
    owner = (keys >> U64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(owner)) + 1
    edges = np.concatenate([[0], cut, [len(keys)]]) if len(keys) else np.zeros(1, int)
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def send(chunk: int, keys: np.ndarray, kind: int = 0, counted: bool = True) -> list[tuple]:
    """Rows of SENT for the keys of one chunk, each key once, with its count there."""
    own, n = np.unique(keys, return_counts=True)
    low, n = (own & U64(0xFFFFFFFF)).astype(np.uint32), np.minimum(n, MOST_TOLD).astype("<u2")
    return [(b, chunk, kind, pack(low[i:j]), n[i:j].tobytes() if counted and n[i:j].max() > 1 else None)
            for b, i, j in by_bucket(own)]


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    give_back()
    return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)


SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()),
                        ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()),
                          ("counts", pa.binary())])


def answer(table: pa.Table, indexed: bool) -> pa.Table:
    """Rows of ANSWER: for each chunk the keys that occur twice or more in all, and how often.

    ``indexed``: only keys that some chunk also sent with kind 1.
    """
    bucket = table["bucket"][0].as_py()
    chunks, kinds = table["chunk"].to_pylist(), table["kind"].to_pylist()
    keys = [unpack(k) for k in table["keys"].to_pylist()]
    told = [np.frombuffer(c, "<u2").astype(np.int64) if c is not None else np.ones(len(k), np.int64)
            for c, k in zip(table["counts"].to_pylist(), keys)]
    probes = [i for i, k in enumerate(kinds) if k == 0]
    if not probes:
        return as_table([], ANSWER_ARROW)
    every = np.concatenate([keys[i] for i in probes])
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    total = np.add.reduceat(np.concatenate([told[i] for i in probes])[order], first)
    value = ranked[first]
    keep = total > 1
    if indexed:
        held = [keys[i] for i, k in enumerate(kinds) if k == 1]
        keep &= np.isin(value, np.unique(np.concatenate(held))) if held else False
    value, total = value[keep], total[keep]
    rows = []
    if len(value):
        for i in probes:
            at = np.minimum(np.searchsorted(value, keys[i]), len(value) - 1)
            same = value[at] == keys[i]
            if same.any():
                rows.append((chunks[i], bucket, pack(keys[i][same]),
                             np.minimum(total[at[same]], MOST_TOLD).astype("<u2").tobytes()))
    return as_table(rows, ANSWER_ARROW)


def repeated(sent: DataFrame, indexed: bool = False) -> DataFrame:
    def reply(table: pa.Table) -> pa.Table:
        return answer(table, indexed)

    return sent.groupBy("bucket").applyInArrow(reply, ANSWER)


def answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of one chunk's answers."""
    if table.num_rows == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    rows = sorted(zip(table["bucket"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist()),
                  key=lambda r: r[0])
    keys = np.concatenate([unpack(k).astype(U64) | U64(b << 32) for b, k, _ in rows])
    return keys, np.concatenate([np.frombuffer(c, "<u2").astype(np.int64) for *_, c in rows])


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted ones, -1 where it is not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
