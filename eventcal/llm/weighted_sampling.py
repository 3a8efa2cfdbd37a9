"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The terms of a text are its runs of five words, each with the number of times it stands there. Sample k draws for each term, by hashes of
the term and k alone, r and c from a gamma distribution of shape two and b from [0, 1); with weight w it keeps
t = floor(ln w / r + b) and the rank ln c - r (t - b + 1). The term of least rank and its t are the sample. Two
texts have the same sample with the probability of their generalised Jaccard similarity, the sum of the lesser weights over the
sum of the greater ones, so the share of equal samples estimates it, with a standard error of at most 1 / (2 sqrt(samples)).

Ranks and samples are packed into one long, so that a fingerprint is a row of minima over the exploded terms. All rows of a text are made
in one task from one row, so the aggregates need no exchange of terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventcal.session import stored

#: Samples of a fingerprint, and words of a term.
SAMPLES, WORDS = 32, 5
#: The rank lies in the upper 39 bits of a sample, in steps of 2^-31 from -128 on, and a hash of term and t in the lower 24.
RANK_STEP, RANK_FROM, OWN_BITS = 1 << 31, 128, 24
HEX = OWN_BITS // 4
#: The sample of a text without words.
EMPTY = "-" * HEX


# ------------------------------------------------------------------ terms
def words_of(text: Column) -> Column:
    """What stands between ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _with_terms(df: DataFrame, text: Column, name: str, size: int, side: int = 0) -> DataFrame:
    """A column of a hash for each run of ``size`` words; of fewer words, for all of them as one; without words none.

    The lowest bit of a hash names the side.
    """
    def marked(*values) -> Column:
        hashed = F.xxhash64(*values)
        return hashed.bitwiseOR(F.lit(1)) if side else hashed.bitwiseAND(F.lit(-2))

    runs = F.transform(F.slice("_h", 1, F.size("_h") - (size - 1)), lambda h, i: marked(h, *[F.get("_h", i + k) for k in range(1, size)]))
    whole = F.when(F.size("_h") > 0, F.array(marked(F.col("_h")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", F.transform(words_of(text), lambda w: F.xxhash64(w)))
    return df.withColumn(name, F.when(F.size("_h") >= size, runs).otherwise(whole)).drop("_h")


def _entries(df: DataFrame, sides: list[str], keys: list[str]) -> DataFrame:
    """The terms of one or two sides, ordered; a row for each different term ``_t`` with its weight on each side, 0 where it is not.

    Those of one term stand together, and those of the second side last, since the lowest bit names it. A text without terms has one row
    of nulls. Only where the terms begin is found by a lambda function, which Spark does not compile; what follows from it is.
    """
    df = df.withColumn("_v", F.sort_array(F.concat(*sides) if len(sides) > 1 else F.col(sides[0]))).drop(*sides)
    differ = lambda i: F.shiftrightunsigned(F.get("_v", i - 1).bitwiseXOR(F.get("_v", i)), 1) != 0                  # noqa: E731
    later = F.when(F.size("_v") > 1, F.filter(F.sequence(F.lit(1), F.size("_v") - 1), differ)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_at", F.when(F.size("_v") > 0, F.concat(F.array(F.lit(0)), later)))
    rows = df.select(*keys, "_v", "_at", F.posexplode_outer("_at").alias("_j", "_s"))
    n = F.coalesce(F.get("_at", F.col("_j") + 1), F.size("_v")) - F.col("_s")
    rows = rows.select(*keys, "_v", "_s", n.alias("_n"), F.get("_v", "_s").alias("_first"), F.get("_v", F.col("_s") + n - 1).alias("_last"))
    is_second = lambda v: F.col(v).bitwiseAND(F.lit(1)) == 1
    # All of the second side are equal to the last.
    mixed = F.col("_n") + 1 - F.array_position(F.slice("_v", F.col("_s") + 1, F.col("_n")), F.col("_last"))
    seconds = (F.when(~is_second("_last"), F.lit(0)).when(is_second("_first"), F.col("_n")).when(F.col("_n") == 2, F.lit(1))
               .otherwise(mixed))
    return rows.select(*keys, F.shiftright("_first", 1).alias("_t"), (F.col("_n") - seconds).alias("_n0"), seconds.alias("_n1"))


def _sample(term: Column, log_weight: Column, k: int) -> Column:
    """Rank and hash of the term's sample k; null if the weight is."""
    # Of each hash 27 bits go to one uniform number and 27 to another, and the last 10 of both together to a third.
    mask, last = F.lit((1 << 27) - 1), F.lit((1 << 10) - 1)
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))

    def gamma(x: Column) -> Column:
        upper, lower = F.shiftrightunsigned(x, 37), F.shiftrightunsigned(x, 10).bitwiseAND(mask)
        return F.lit(54 * math.log(2)) - F.ln((upper + F.lit(0.5)) * (lower + F.lit(0.5)))

    r, log_c = gamma(first), F.ln(gamma(second))
    b = (F.shiftleft(first.bitwiseAND(last), 10).bitwiseOR(second.bitwiseAND(last)) + F.lit(0.5)) * F.lit(2.0 ** -20)
    t = F.floor(log_weight / r + b)
    rank = log_c - r * (t - b + F.lit(1.0))
    own = second.bitwiseXOR(t).bitwiseAND(F.lit((1 << OWN_BITS) - 1))        # second names term and k already
    return F.shiftleft(F.floor((rank + F.lit(float(RANK_FROM))) * F.lit(float(RANK_STEP))), OWN_BITS).bitwiseOR(own)


def _fingerprints(df: DataFrame, sides: list[str], keys: list[str], samples: int, made: list[str]) -> DataFrame:
    """The fingerprints of the sides' terms, as columns ``made``; a row of ``df`` for each value of its ``keys``."""
    rows = _entries(df, sides, keys)
    rows = rows.select(*keys, "_t", *[F.ln(F.col(f"_n{i}").cast("double")).alias(f"_w{i}") for i in range(len(sides))])
    least = rows.groupBy(*keys).agg(*[F.min(_sample(F.col("_t"), F.col(f"_w{i}"), k)).alias(f"_s{i}_{k}")
                                      for k in range(samples) for i in range(len(sides))])
    shown = lambda c: F.coalesce(F.lpad(F.lower(F.hex(F.col(c).bitwiseAND(F.lit((1 << OWN_BITS) - 1)))), HEX, "0"), F.lit(EMPTY))
    return least.select(*keys, *[F.concat(*[shown(f"_s{i}_{k}") for k in range(samples)]).alias(m) for i, m in enumerate(made)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints; null if one is."""
    same = [(F.substring(a, HEX * k + 1, HEX) == F.substring(b, HEX * k + 1, HEX)).cast("int") for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


# ------------------------------------------------------------------ documents
def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _own, text, n_rows): each different (id, text) once; ``_key`` orders null ids first, ``_own`` is a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"_key": F.coalesce("_id", F.lit(-(1 << 63))), "_own": F.xxhash64("text", F.col("_id").isNull())})
    rows = rows.groupBy("_key", "_own").agg(F.max("_id").alias("_id"), F.any_value("text").alias("text"), F.count("*").alias("n_rows"))
    # True of every row. It keeps all columns in use wherever the frame is, so that Spark sees that it is the same one and shuffles texts once.
    return rows.filter((F.col("n_rows") > 0) & (F.coalesce("_id", "_key") == F.col("_key")))


def fingerprint(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row.

    Equal texts have equal fingerprints, whatever their row. Null and empty texts, and texts of white space, have the fingerprint of no term, which
    is like nothing but itself. A text of fewer than ``words`` words is one term. Rows that repeat an id and text
    are taken once and returned as often as they stand; other columns are not read. Texts are taken whole.
    """
    rows = _with_terms(_keyed(docs, id_col, text_col), F.col("text"), "_a", words).select("_key", "_own", "_id", "n_rows", "_a")
    out = _fingerprints(rows, ["_a"], ["_key", "_own", "_id", "n_rows"], samples, ["fingerprint"])
    return out.select(F.col("_id").alias(id_col), "fingerprint", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("_n")).drop("_n")


def neighbours(rows: DataFrame) -> DataFrame:
    """(_key, _own, n_chars, p_key, p_own, p_chars): each row with the one before it, by key, then own; before the first stands the last.

    Rows are dealt by range and ordered in their parts, then the last row of each part goes to the next one: no task
    holds more than its share, and only a row for each part meets in one.
    """
    dealt = stored(rows.repartitionByRange("_key", "_own").withColumn("_part", F.spark_partition_id()), "order")
    row = F.struct("_key", "_own", "n_chars")
    lasts = dealt.groupBy("_part").agg(F.max(row).alias("_last"))
    parts = Window.orderBy("_part")                          # a row for each part
    lasts = lasts.select("_part", F.lag("_last").over(parts).alias("_lag"), F.max("_last").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"))
    lasts = lasts.select("_part", F.coalesce("_lag", "_end").alias("_edge"))
    before = F.lag(row).over(Window.partitionBy("_part").orderBy("_key", "_own"))
    chained = dealt.withColumn("_before", before).join(lasts, "_part").withColumn("_before", F.coalesce("_before", "_edge"))
    return chained.select("_key", "_own", "n_chars", F.col("_before._key").alias("p_key"), F.col("_before._own").alias("p_own"),
                          F.col("_before.n_chars").alias("p_chars"))


def compare_with_next(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is that of the next greater id, after the last the first; of one id's different texts each is the next of
    another, by a hash, and rows that repeat id and text are one. Null ids stand before all others. The edited text has its last
    quarter of code points replaced by as many, or all, of the first ones of the next document. Null counts as
    empty. See ``fingerprint`` for the other cases.
    """
    each = _keyed(docs, id_col, text_col)
    sizes = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull()).alias("_own"),
                        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))
    order = stored(neighbours(sizes.groupBy("_key", "_own").agg(F.max("n_chars").alias("n_chars"))), "neighbours")
    each = each.join(order.drop("n_chars"), ["_key", "_own"])
    # Each text sends what the one before it needs.
    begin = each.select(F.col("p_key").alias("_key"), F.col("p_own").alias("_own"), F.substring(
        F.col("text"), F.lit(1), F.floor(F.col("p_chars") / 4).cast("int")).alias("begin"))
    n = F.char_length("text")
    both = each.join(begin, ["_key", "_own"]).select("_key", "_own", "_id", "n_rows", "p_key", "p_own", n.cast("long").alias("n_chars"), "text", F.concat(
        F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), "begin").alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["_key", "_own", "_id", "n_rows", "p_key", "p_own", "n_chars", "edited_sha256"]
    both = _with_terms(_with_terms(both, F.col("text"), "_a", words), F.col("edited"), "_b", words, 1).select(*keys, "_a", "_b")
    found = stored(_fingerprints(both, ["_a", "_b"], keys, samples, ["fingerprint", "edited_fingerprint"]), "fingerprints")
    after = found.select(F.col("p_key").alias("_key"), F.col("p_own").alias("_own"), F.col("fingerprint").alias("_next"))
    return found.join(after, ["_key", "_own"]).select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next"), samples).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("_n")).drop("_n")
