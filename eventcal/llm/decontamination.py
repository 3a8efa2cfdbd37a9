"""Benchmark decontamination over a positional inverted index of the training texts.

The index is cut by text: a shard holds the postings (term, place) of a few MB of texts, sorted by term and then
by place, and is one row of a table in the shared folder. So no list of a frequent word ever meets in one place,
and a phrase is looked for where its text is. In each shard a phrase starts from the list of its rarest term there;
the places it gives are moved by the term's offset and looked up in the list of the next rarest term, until all
agree. Test items are sent to the shards in blocks of bounded size, so that a test set of any size can be searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.llm import packed as P
from eventcal.llm import text as T
from eventcal.llm.substring_dedup import plain, planes
from eventcal.session import scratch_path

SHARD_BYTES = 2_000_000
#: Bytes of item texts that are broadcast at a time.
ITEM_BLOCK_BYTES = 4_000_000

INDEX = "shard string, ids binary, nulls binary, lengths binary, terms binary, counts binary, places binary"
HITS = "shard string, row binary, start binary, size binary, item binary, names array<string>"
SHARD = pa.schema([("shard", pa.string()), *[(c, pa.binary()) for c in ("ids", "nulls", "lengths", "terms", "counts", "places")]])
HIT = pa.schema([("shard", pa.string()), *[(c, pa.binary()) for c in ("row", "start", "size", "item")],
                 ("names", pa.list_(pa.string()))])


# ------------------------------------------------------------------ the index
def _terms(column):
    """(codes, dictionary, text number) of the lower-case words of a column of texts."""
    buf, off = T.flat(column)
    buf = T.LOWER[buf]
    start, end, doc = T.spans(buf, off, T.ALPHANUMERIC)
    data, at = T.pieces(buf, start, end)
    coded = T.binary(data, np.diff(at)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, doc


def _shard(name: str, ids: pa.Array, texts) -> tuple:
    codes, terms, doc = _terms(texts)
    order = np.argsort(codes.astype(np.uint32), kind="stable")
    return (name, planes(ids.fill_null(0).to_numpy(), "<i8"), planes(np.asarray(ids.is_null()).astype(np.uint8), "u1"),
            planes(np.bincount(doc, minlength=len(ids)), "<u4"), b"\n".join(terms.to_pylist()),
            planes(np.bincount(codes, minlength=len(terms)), "<u4"), planes(order, "<u4"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of every word of every text, written to ``path`` (a fresh one in the shared folder by default).

    Words are runs of ASCII letters, digits and all beyond ASCII, in lower case. Every row is a text of its own,
    with or without words; other columns are not read.
    """
    path = path or scratch_path(docs.sparkSession, "postings")

    def shards(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in T.parts(batch["text"], shard_bytes):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pylist([dict(zip(SHARD.names, _shard(f"{task}-{n}", piece["id"], piece["text"])))], SHARD)
                n += 1
            T.give_back()

    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(shards, INDEX)
    made.write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


# ------------------------------------------------------------------ the search
class Items:
    """Words and windows of a block of items: what is sent to the shards."""

    def __init__(self, names: list[str], texts: list[str | None], window: int):
        codes, self.terms, doc = _terms(pa.array(texts, pa.string()))
        n = np.bincount(doc, minlength=len(names))
        first = np.cumsum(n) - n
        size = np.minimum(n, window)
        many = np.where(n > 0, n - size + 1, 0)
        self.names, self.codes = names, codes
        self.item = np.repeat(np.arange(len(names)), many)
        self.start = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.size = size[self.item]
        self.width = int(self.size.max(initial=0))


def _search(items: Items, terms: bytes, counts: np.ndarray, places: np.ndarray, lengths: np.ndarray, within: int | None):
    """(window, start, size) of every place of a shard where a window occurs."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    if not len(places) or not len(items.item):
        return none
    held = pa.array(terms.split(b"\n"), pa.large_binary())
    term = np.asarray(pc.fill_null(pc.index_in(items.terms.cast(pa.large_binary()), value_set=held), -1)).astype(np.int64)
    offset = np.arange(items.width)
    inside = offset[None, :] < items.size[:, None]
    wanted = term[items.codes[np.where(inside, items.start[:, None] + offset, 0)]]
    live = np.flatnonzero(((wanted >= 0) | ~inside).all(1))
    if not len(live):
        return none
    wanted, inside = wanted[live], inside[live]
    begin = np.cumsum(counts) - counts
    weight = np.where(inside, counts[wanted], np.iinfo(np.int64).max)
    rarest = np.argsort(weight, axis=1, kind="stable")
    keys = (np.repeat(np.arange(len(counts)), counts) << 32) | places
    edge = np.concatenate([[0], np.cumsum(lengths)])

    lead = np.take_along_axis(wanted, rarest[:, :1], 1)[:, 0]
    n = counts[lead]
    which = np.repeat(np.arange(len(live)), n)
    at = places[np.repeat(begin[lead], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    doc = np.searchsorted(edge, at, "right") - 1
    low, high = edge[doc], edge[doc + 1]
    if within is None:
        at = at - rarest[which, 0]
        fits = (at >= low) & (at + items.size[live][which] <= high)
        which, at = which[fits], at[fits]
    for k in range(1, items.width):
        if not len(which):
            break
        column = rarest[which, k]
        there = inside[which, column]
        t = wanted[which, column]
        if within is None:
            asked = (t << 32) | (at + column)
            found = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
        else:
            a, b = np.maximum(at - within, low), np.minimum(at + within, high - 1)
            next_ = np.searchsorted(keys, (t << 32) | a)
            found = (next_ < len(keys)) & (keys[np.minimum(next_, len(keys) - 1)] <= ((t << 32) | b))
        keep = found | ~there
        which, at = which[keep], at[keep]
        if within is not None:
            low, high = low[keep], high[keep]
    return live[which], at, (items.size[live][which] if within is None else np.ones(len(which), np.int64))


def search(index: DataFrame, items: DataFrame, window: int = 10, within: int | None = None, id_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """HITS: for each shard the (row, first word, words, item) of each occurring window of each item.

    A window is ``window`` consecutive words of an item; a shorter item with a word is one window. By default a
    window occurs where its words stand one after the other. With ``within``, it occurs near each place of its rarest
    word around which, at most ``within`` words away in the same text, each of its other words stands, in any order.
    """
    if window < 1:
        raise ValueError("window: one word or more")
    spark = index.sparkSession
    items = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-P.corpus_bytes(items) // ITEM_BLOCK_BYTES))
    found = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # a bounded block
        sent = spark.sparkContext.broadcast(Items([r["item"] for r in own], [r["text"] for r in own], window))

        def look(batches, sent=sent):
            asked = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    lengths = plain(r["lengths"], "<u4").astype(np.int64)
                    w, at, size = _search(asked, r["terms"], plain(r["counts"], "<u4").astype(np.int64),
                                          plain(r["places"], "<u4").astype(np.int64), lengths, within)
                    if not len(w):
                        continue
                    edge = np.concatenate([[0], np.cumsum(lengths)])
                    row = np.searchsorted(edge, at, "right") - 1
                    used, item = np.unique(asked.item[w], return_inverse=True)
                    yield pa.RecordBatch.from_pylist([{
                        "shard": r["shard"], "row": planes(row, "<u4"), "start": planes(at - edge[row], "<u4"),
                        "size": planes(size, "<u4"), "item": planes(item, "<u4"),
                        "names": [asked.names[i] for i in used]}], HIT)
                T.give_back()

        found.append(index.select("shard", "lengths", "terms", "counts", "places").mapInArrow(look, HITS))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, within: int | None = None, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every row of ``docs``.

    ``n_hit`` counts the words in any occurrence of a window, ``items`` are the ids of the items with one, sorted as
    strings, ``spans`` the hit runs as ``from:to`` in words. Null or empty texts have no words; items without words
    occur nowhere; items that repeat an id are reported once, and those with a null id as "null". Empty tables give
    no rows or no hits. Rows that repeat an id are answered one by one.
    """
    index = build_index(docs, id_col, text_col)
    hits = search(index, items, window, within, item_id_col, item_text_col)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                        ("items", pa.list_(pa.string())), ("spans", pa.string())])

    def report(shard: pa.Table, found: pa.Table) -> pa.Table:
        if shard.num_rows == 0:
            return schema.empty_table()
        r = shard.to_pylist()[0]
        lengths = plain(r["lengths"], "<u4").astype(np.int64)
        ids, nulls = plain(r["ids"], "<i8"), plain(r["nulls"], "u1").astype(bool)
        first = np.cumsum(lengths) - lengths
        edge = np.zeros(int(lengths.sum()) + 1, np.int64)
        named: dict[int, set] = {}
        for f in found.to_pylist():
            row, start, size, item = (plain(f[c], "<u4").astype(np.int64) for c in ("row", "start", "size", "item"))
            np.add.at(edge, first[row] + start, 1)
            np.add.at(edge, first[row] + start + size, -1)
            for d, i in np.unique(np.stack([row, item], 1), axis=0).tolist():
                named.setdefault(d, set()).add(f["names"][i] if f["names"][i] is not None else "null")
        hit = np.cumsum(edge)[:-1] > 0
        doc = np.repeat(np.arange(len(lengths)), lengths)
        from eventcal.llm.substring_dedup import runs

        return pa.Table.from_arrays([
            pa.array(ids, mask=nulls), pa.array(lengths), pa.array(np.bincount(doc[hit], minlength=len(lengths))),
            pa.array([sorted(named.get(d, ())) for d in range(len(lengths))], pa.list_(pa.string())),
            pa.array(runs(hit, doc, first, len(lengths)), pa.string())], schema=schema)

    out = (index.select("shard", "ids", "nulls", "lengths").groupBy("shard").cogroup(hits.groupBy("shard"))
           .applyInArrow(report, "id long, n_words long, n_hit long, items array<string>, spans string"))
    return out.withColumnRenamed("id", id_col)
