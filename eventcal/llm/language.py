"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes with the counts of what followed them. A byte costs
what its longest known context says; if that context never saw the byte, it costs the escape, and the next shorter
context is asked, down to all bytes alike. Statistics are frozen after training, so the code length of a text is a sum
of table entries: contexts of all languages are numbered once, and a table has the cost of each byte after
each of them in each language. The language with the shortest code length is the prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcal.llm import text as T

ORDER = 3
#: About so many labelled texts of each language are learned from, picked by a hash of their id.
SAMPLE_TEXTS = 500
#: The contexts of full length that are kept, most frequent first, over all languages.
MOST_CONTEXTS = 20_000
UNDETERMINED = "und"
#: Bytes of text scored at a time.
PART_BYTES = 1_000_000
#: Bytes over which a language's advantage is taken for the score.
SCORE_BYTES = 20


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray      # byte -> class, 0 for bytes never seen
    contexts: np.ndarray     # (class, class, class) -> number of the longest context known
    cost: np.ndarray         # (context, class) x language -> bits


def _grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` before it in its text, oldest first, as one number; before a text stand zeros."""
    low = T.LOWER[buf].astype(np.int64)
    out = low.copy()
    for k in range(1, ORDER + 1):
        back = np.zeros_like(low)
        back[k:] = low[:-k] if k else low
        for j in range(min(k, len(low))):
            at = off[:-1] + j
            back[at[at < off[1:]]] = 0
        out |= back << (8 * k)
    return out


def train(labelled: DataFrame, sample: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """A model of the languages of ``labelled``, from about ``sample`` texts of each, whole.

    Rows without language or text teach nothing. Only sums over the sample reach the driver.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
                           ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros(256, np.int64), np.zeros((1, 1, 1), np.int64), np.zeros((1, 0)))
    scale = 1_000_000
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(scale, -(-sample * scale // n))).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < share)

    def count(batches):
        for batch in batches:
            langs = np.asarray(batch["lang"].to_pylist(), object)
            for lang in np.unique(langs.astype(str)) if len(langs) else []:
                buf, off = T.flat(batch["text"].filter(pa.array(langs == lang)))
                gram, n = np.unique(_grams(buf, off), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    summed = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return _model(sorted(counts), summed.toArrow())


def _model(languages: list[str], grams: pa.Table) -> Model:
    gram, n = grams["gram"].to_numpy(), grams["n"].to_numpy()
    lang = np.searchsorted(languages, np.array(grams["lang"].to_pylist(), dtype=str)) if len(gram) else np.zeros(0, int)
    parts = np.stack([(gram >> (8 * k)) & 255 for k in range(ORDER, -1, -1)], 1)     # oldest first, the byte last
    seen = np.unique(parts[:, -1])
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    parts = classes[parts]
    # Contexts by length, numbered so that shorter ones come first; the empty one is 0.
    known = {(): 0}
    weight: dict[tuple, int] = {}
    for row, k in zip(map(tuple, parts[:, :-1].tolist()), n.tolist()):
        weight[row] = weight.get(row, 0) + k
    full = sorted(weight, key=lambda c: (-weight[c], c))[:MOST_CONTEXTS]
    for length in range(1, ORDER + 1):
        for c in sorted({c[ORDER - length:] for c in full}):
            known[c] = len(known)
    cost = np.zeros((len(known), size, len(languages)))
    cost[0] = 8.0                                            # order -1: all bytes alike
    for v in range(len(languages)):
        own = lang == v
        by_length = []
        for length in range(ORDER + 1):
            table: dict[tuple, dict[int, int]] = {}
            for row, k in zip(parts[own].tolist(), n[own].tolist()):
                c = tuple(row[ORDER - length:ORDER])
                if c in known:
                    after = table.setdefault(c, {})
                    after[row[-1]] = after.get(row[-1], 0) + k
            by_length.append(table)
        for c, i in known.items():                           # shorter contexts have their costs already
            base = cost[known[c[1:]], :, v] if c else np.full(size, 8.0)
            after = by_length[len(c)].get(c)
            if after:
                total, kinds = sum(after.values()), len(after)
                base = base - np.log2(kinds / (total + kinds))
                for s, k in after.items():
                    base[s] = -np.log2(k / (total + kinds))
            cost[i, :, v] = base
    contexts = np.zeros((size,) * ORDER, np.int32)
    for c, i in known.items():                               # longer ones overwrite what they end with
        contexts[(slice(None),) * (ORDER - len(c)) + c] = i
    return Model(languages, classes, contexts, cost.reshape(len(known) * size, len(languages)).astype(np.float32))


def code_lengths(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of each text in each language."""
    size, n = model.contexts.shape[0], len(off) - 1
    coded = np.concatenate([np.zeros(ORDER, np.int64), model.classes[T.LOWER[buf]]])
    edge = off[:-1][off[1:] > off[:-1]]
    place = np.zeros(len(buf), np.int64)
    for k in range(ORDER, 0, -1):
        back = coded[ORDER - k:len(coded) - k].copy()
        for j in range(k):
            at = edge + j
            at = at[at < len(buf)]
            back[at] = 0
        place = place * size + back
    row = model.contexts.ravel()[place].astype(np.int64) * size + coded[ORDER:]
    out = np.zeros((n, len(model.languages)))
    filled = np.flatnonzero(off[1:] > off[:-1])
    if len(filled):
        for v in range(len(model.languages)):
            out[filled, v] = np.add.reduceat(model.cost[:, v][row].astype(np.float64), off[:-1][filled])
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) of every row, and the columns named in ``keep``.

    ``score`` is the share of the prediction among the languages after about twenty bytes of typical text, from 0 to 1.
    Texts that are null or have no letter, and all texts if no language was learned, are ``und`` with score 0. Equal
    code lengths go to the first language by name. Texts are scored whole; rows that repeat an id one by one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)               # bounded: MOST_CONTEXTS and 256 classes
    letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), letter.alias("_letter"),
                       *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep) if c != text_col])
    kept = ["_text" if c == text_col else f"_keep{i}" for i, c in enumerate(keep)]
    given = rows.select("_id", *kept).schema

    def score(batches):
        model = sent.value
        for batch in batches:
            for a, b in T.parts(batch["_text"], PART_BYTES):
                part = batch.slice(a, b - a)
                buf, off = T.flat(part["_text"])
                known = np.asarray(part["_letter"]) & (len(model.languages) > 0)
                n, size = part.num_rows, np.maximum(np.diff(off), 1)
                if model.languages:
                    bits = code_lengths(model, buf, off)
                    best = bits.argmin(1)
                    least = bits[np.arange(n), best]
                    share = 1 / np.exp2(-(bits - least[:, None]) * SCORE_BYTES / np.maximum(size, SCORE_BYTES)[:, None]).sum(1)
                    names = np.array(model.languages, object)[best]
                else:
                    least, share, names = np.zeros(n), np.zeros(n), np.full(n, UNDETERMINED, object)
                yield pa.RecordBatch.from_arrays(
                    [part["_id"], *[part[c] for c in kept], pa.array(np.where(known, names, UNDETERMINED).tolist(), pa.string()),
                     pa.array(np.where(known, np.round(share, 9), 0.0)), pa.array(np.round(least / size, 6))],
                    ["_id", *kept, "lang_pred", "score", "bits_per_byte"])
            T.give_back()

    from pyspark.sql import types as S

    schema = S.StructType([*given.fields, S.StructField("lang_pred", S.StringType()), S.StructField("score", S.DoubleType()),
                           S.StructField("bits_per_byte", S.DoubleType())])
    out = rows.mapInArrow(score, schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(kept, keep)],
                      "lang_pred", "score", "bits_per_byte")


def held_out(id_col: str = "doc_id"):
    """Every fifth document by a checksum of its id; a null id is never held out, and never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(~held_out(id_col) & F.col(id_col).isNotNull())
