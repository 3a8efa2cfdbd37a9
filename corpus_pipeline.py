"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventcal.llm import decontamination, jaccard_join, language, secrets, sentencepiece_codec
from eventcal.llm.text import small_batches
from eventcal.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits a byte above which no learned language fits a text: what its bytes take if all were alike. Shorter texts
#: than so many bytes are not judged by it.
MOST_BITS, LEAST_BYTES = 8.0, 20


def row_key():
    """A number for each row by all its columns, so that stages decide by row: ids may be null or repeat."""
    return F.xxhash64(*COLUMNS, *[F.isnull(c) for c in COLUMNS])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or in nothing like a learned language, go. A missing language is filled in."""
    docs = small_batches(docs)
    model = language.train(language.learnable(docs))
    rated = language.predict(docs, model, keep=COLUMNS[1:])
    known = (F.col("lang_pred") != language.UNDETERMINED) & (
        (F.col("bits_per_byte") <= MOST_BITS) | (F.octet_length("text") < LEAST_BYTES))
    return rated.filter(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that link, directly or not, one row of least id stays; of equal rows, one. Rows without an id stay."""
    docs = small_batches(docs).select(*COLUMNS).withColumn("_row", row_key())
    known = docs.filter(F.col("doc_id").isNotNull())
    groups = stored(jaccard_join.jaccard_components(known, id_col="_row").select("_row", "component_id").distinct(), "groups")
    others = groups.filter(F.col("component_id") != F.col("_row"))
    # The row that gives a group its number joins the others; a group is never sent anywhere as a whole.
    heads = groups.filter(F.col("component_id") == F.col("_row")).join(others.select("component_id").distinct(), "component_id", "left_semi")
    linked = others.unionByName(heads)
    ids = known.groupBy("_row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    linked = stored(linked.join(ids.select("_row", "doc_id"), "_row"), "linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row"))
    gone = stored(linked.select("_row").join(first.select("_row"), "_row", "left_anti"), "copies")
    left = docs.join(gone, "_row", "left_anti").select(*COLUMNS)
    if stored(ids.filter("n > 1").select("_row"), "again").isEmpty():
        return left
    return left.filter(F.col("doc_id").isNotNull()).distinct().unionByName(left.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold ten words in a row of a benchmark item go, row by row, whatever their id."""
    docs = small_batches(docs).select(*COLUMNS).withColumn("_row", row_key())
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(docs, items, id_col="_row")
    gone = stored(found.filter("n_hit > 0").select("_row").distinct(), "contaminated")
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every text stays."""
    docs = small_batches(docs)
    found = secrets.scan(docs, keep=COLUMNS[1:])
    return found.withColumn("n_chars", F.when(F.col("redacted").isNull(), F.col("n_chars")).otherwise(
        F.length("redacted").cast("long"))).withColumn("text", F.coalesce("redacted", "text")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text, as packed 32-bit numbers, with merge-dropout; and that they decode to it."""
    docs = small_batches(docs)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: No SQL has a context tree, a dropout by keyed hash or a guess cost; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
