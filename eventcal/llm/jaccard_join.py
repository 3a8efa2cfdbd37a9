"""N-gram Jaccard join with several global orders.

Two texts that link share a token among the first ``n - need + 1`` of each in *any* global order of tokens, so a
pair is verified only if it does in every one of several orders. The first order puts rare tokens first, the
others are keyed hashes; all put tokens that no other text has at the front, which alone rules out most texts.

1. Shingles that occur in two texts or more are found with ``packed``. A text links with nothing unless at
   least ``threshold`` of its shingles are such; only those texts' shingles are kept.
2. Texts with equal sets become one. What remains is cut into blocks that no link can leave: texts joined, directly
   or not, by a token in their first-order prefixes. Only ids travel for that.
3. Inside a block every pair that passes all orders, the length filter and the bound from unique tokens is
   verified exactly, unless both ends are connected already. A block of more than ``block_rows`` texts or its
   bytes is dealt into slices, and each two slices meet in a task of their own; nothing is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.llm import packed as P
from eventcal.llm import text as T
from eventcal.llm.substring_dedup import plain, planes
from eventcal.llm.text import U64
from eventcal.operators.clusters import components
from eventcal.session import stored

ORDERS = 3
BLOCK_ROWS = 500
BLOCK_BYTES = 64_000_000

SETS = "id long, n long, own long, set_id string, tokens binary"
SETS_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("set_id", pa.string()), ("tokens", pa.binary())])


def _shingles(table: pa.Table, size: int):
    """(hash, text number) of each text's distinct shingles, by hash."""
    buf, off = T.flat(table["text"])
    buf = T.LOWER[buf]
    start, end, doc = T.spans(buf, off, T.NOT_SPACE)
    words = T.hash_spans(buf, start, end)
    inside = T.within(doc, size)
    h, d = T.hash_windows(words, size)[inside], doc[:len(inside)][inside]
    count = np.bincount(doc, minlength=table.num_rows)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):                               # a text of fewer words is one shingle, different for each length
        first = np.cumsum(count) - count
        whole = [T.hash_windows(words[first[i]:first[i] + count[i]], int(count[i]))[0] for i in short]
        h = np.concatenate([h, T.mix(np.array(whole, U64) + count[short].astype(U64))])
        d = np.concatenate([d, short])
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], d[new]


def need(n, percent: int):
    """The least shingles in common that a text of n needs with any text that links with it."""
    return -(-n * percent // 100)


# ------------------------------------------------------------------ inside a block
class _Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def roots(self) -> np.ndarray:
        p = self.parent
        while (p[p] != p).any():
            p = p[p]
        self.parent = p
        return p

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def _postings(tokens: np.ndarray, doc: np.ndarray, n_tokens: int):
    order = np.argsort(tokens, kind="stable")
    return doc[order], np.searchsorted(tokens[order], np.arange(n_tokens + 1))


def link(n: np.ndarray, own: np.ndarray, tokens: list[np.ndarray], side: np.ndarray | None, percent: int,
         orders: int = ORDERS) -> np.ndarray:
    """The connected group of each text of a block; with ``side``, only pairs of different sides are compared.

    ``tokens``: of each text those of its shingles that others have, in the first order; ``own``: how many it has alone.
    """
    size = np.array([len(t) for t in tokens])
    doc = np.repeat(np.arange(len(tokens)), size)
    value, token = np.unique(np.concatenate(tokens) if len(tokens) else np.zeros(0, U64), return_inverse=True)
    first = np.cumsum(size) - size
    room = n - need(n, percent) + 1 - own        # places of the prefix left beside the tokens a text has alone
    prefixes = []
    for k in range(orders):
        if k == 0:
            ranked = np.arange(len(doc))
        else:
            ranked = np.lexsort((T.mix(value[token] ^ U64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)), doc))
        inside = np.arange(len(doc)) - first[doc] < room[doc]
        t, d = token[ranked][inside], doc[inside]
        prefixes.append((t, np.searchsorted(d, np.arange(len(tokens) + 1)), *_postings(t, d, len(value))))
    held = [np.sort(token[a:b]) for a, b in zip(first, first + size)]
    groups = _Union(len(tokens))
    shared = n - own
    for x in np.argsort(n, kind="stable"):
        alive = None
        for t, edge, who, at in prefixes:        # the filters of all orders, intersected
            mark = np.zeros(len(tokens), bool)
            for p in t[edge[x]:edge[x + 1]]:
                mark[who[at[p]:at[p + 1]]] = True
            alive = mark if alive is None else alive & mark
            if not alive.any():
                break
        y = np.flatnonzero(alive)
        # Each pair once, from its smaller text; sizes close enough; enough tokens that anyone shares.
        y = y[(n[y] > n[x]) | ((n[y] == n[x]) & (y > x))]
        y = y[n[x] * 100 >= percent * n[y]]
        most = np.minimum(shared[x], shared[y])
        y = y[most * 100 >= percent * (n[x] + n[y] - most)]
        if side is not None:
            y = y[side[y] != side[x]]
        while len(y):
            roots = groups.roots()
            y = y[roots[y] != roots[x]]
            some, y = y[:64], y[64:]
            if not len(some):
                break
            both = np.concatenate([held[i] for i in some])
            at = np.minimum(np.searchsorted(held[x], both), len(held[x]) - 1)
            cut = np.cumsum(size[some]) - size[some]
            common = np.add.reduceat((held[x][at] == both).astype(np.int64), cut)
            for i in some[common * 100 >= percent * (n[x] + n[some] - common)]:
                groups.join(int(x), int(i))
    return groups.roots()


# ------------------------------------------------------------------ the operator
def shingle_sets(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                 chunk_bytes: int = P.CHUNK_BYTES) -> DataFrame:
    """SETS, a row for each text: its set's size, and the set itself where it can link with anything."""
    n_bytes = P.corpus_bytes(docs, text_col)
    buckets = P.bucket_count(n_bytes // 6)
    dealt = P.chunked(docs, n_bytes, id_col, text_col, chunk_bytes)

    def probe(table: pa.Table) -> pa.Table:
        h, _ = _shingles(T.in_order(table), shingle)
        return P.as_table(P.send(table["chunk"][0].as_py(), P.key(h, buckets)), P.SENT_ARROW)

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return SETS_ARROW.empty_table()
        table = T.in_order(table)
        h, d = _shingles(table, shingle)
        held, counts = P.answered(answers)
        at = P.lookup(P.key(h, buckets), held)
        n = np.bincount(d, minlength=table.num_rows)
        several = np.bincount(d[at >= 0], minlength=table.num_rows)
        with_others = (n > 0) & (several >= need(n, percent))
        # Equal sets have equal sums of two scrambles of their members.
        sums = [np.zeros(table.num_rows, U64) for _ in range(2)]
        np.add.at(sums[0], d, T.mix(h))
        np.add.at(sums[1], d, T.mix(h ^ U64(0xD6E8FEB86659FD93)))
        mine = (at >= 0) & with_others[d]
        order = np.lexsort((h[mine], counts[at[mine]], d[mine]))
        tokens, owner = h[mine][order], d[mine][order]
        edge = np.searchsorted(owner, np.arange(table.num_rows + 1))
        some = with_others.tolist()
        T.give_back()
        return pa.Table.from_arrays([
            table["id"], pa.array(n), pa.array(n - several),
            pa.array([f"{n[i]}-{sums[0][i]:016x}{sums[1][i]:016x}" if s else None for i, s in enumerate(some)], pa.string()),
            pa.array([planes(tokens[edge[i]:edge[i + 1]], "<u8") if s else None for i, s in enumerate(some)], pa.binary()),
        ], schema=SETS_ARROW)

    answers = P.repeated(dealt.groupBy("chunk").applyInArrow(probe, P.SENT))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(keep, SETS)


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                       block_rows: int = BLOCK_ROWS, chunk_bytes: int = P.CHUNK_BYTES, orders: int = ORDERS) -> DataFrame:
    """(id, n_shingles, set_id, component_id) of every row: the smallest id that links reach, its own included.

    Texts link when their sets of distinct ``shingle``-word runs have a Jaccard similarity of ``percent`` or more. A text
    of fewer words is one run; without words, or null, it has none and links with nothing. ``set_id`` is equal for equal
    sets that occur twice or more. Rows that repeat an id are one document; a row with a null id has no component
    and links nothing. An empty table gives an empty result; other columns are not read.
    """
    sets = stored(shingle_sets(docs, shingle, percent, id_col, text_col, chunk_bytes), "sets")
    usable = sets.filter(F.col("tokens").isNotNull() & F.col("id").isNotNull())
    one = usable.groupBy("set_id").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("own").alias("own"),
                                       F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    one = stored(one, "classes")

    def prefix(batches):
        for batch in batches:
            nodes, n, own, tokens = (batch[c].to_pylist() for c in ("node", "n", "own", "tokens"))
            cut = [plain(t, "<u8")[:k - need(k, percent) + 1 - o] for t, k, o in zip(tokens, n, own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(nodes, np.int64), [len(c) for c in cut])),
                 pa.array((np.concatenate(cut) if cut else np.zeros(0, U64)).view(np.int64))], ["node", "token"])

    first = one.select("node", "n", "own", "tokens").mapInArrow(prefix, "node long, token long")
    least = first.groupBy("token").agg(F.min("node").alias("lead"), F.count("*").alias("k")).filter("k > 1")
    edges = stored(first.join(least, "token").filter("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
                   .distinct(), "edges")
    touched = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    blocks = components(touched, edges)
    held = one.select("node", "n", "own", "tokens").join(blocks.withColumnRenamed("label", "block"), "node")
    sizes = blocks.join(one.select("node", F.octet_length("tokens").alias("b")), "node").groupBy(
        F.col("label").alias("block")).agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("b") / BLOCK_BYTES)).alias("slices"))
    held = held.join(sizes, "block").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1))
    held = held.withColumn("other", other).select(
        "block", F.least("slice", "other").alias("a"), F.greatest("slice", "other").alias("b"), "slice", "node", "n", "own", "tokens")

    def inside(key, table):
        node, n, own, slices = (table[c].to_numpy().astype(np.int64) for c in ("node", "n", "own", "slice"))
        cross = key[1].as_py() != key[2].as_py()
        label = link(n, own, [plain(t, "<u8") for t in table["tokens"].to_pylist()], slices if cross else None, percent, orders)
        linked = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"u": pa.array(node[linked]), "v": pa.array(node[label[linked]])})

    # Else the join's partitioning by block would serve, and all slices of a block would meet in one task.
    held = held.repartition("block", "a", "b")
    links = stored(held.groupBy("block", "a", "b").applyInArrow(inside, "u long, v long"), "links")
    joined = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    # The least id of a component is the least of its classes' least ids.
    labels = components(joined, links)
    classes = one.select("set_id", "node").join(labels, "node", "left").select(
        "set_id", F.coalesce("label", "node").alias("label"))
    by_id = (usable.select("id", "set_id").join(classes, "set_id").groupBy("id").agg(F.min("label").alias("label")))
    out = sets.select("id", F.col("n").alias("n_shingles"), "set_id").join(by_id, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", "set_id", F.coalesce("label", "id").alias("component_id"))
