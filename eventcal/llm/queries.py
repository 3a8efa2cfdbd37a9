"""Registered queries of the folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventcal.llm import (decontamination, jaccard_join, language, license_scan, oracles, periodic_runs, quality, secrets,
                          sentencepiece_codec, substring_dedup, suffix_dedup, text, token_counts, weighted_sampling, whitening)

_QUERIES: dict = {}


def query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text.small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _sha(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


@query
def op3_substring_dedup(spark, sf_dir):
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha("kept_text").alias("kept_sha256"))


@query
def op10_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", _sha("kept").alias("kept_sha256"))


@query
def op6_decontamination(spark, sf_dir):
    out = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_jaccard_join(spark, sf_dir):
    out = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@query
def op9_quality_rules(spark, sf_dir):
    out = quality.supervise(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.round("posterior", 6).alias("posterior"))


@query
def op4_secret_scan(spark, sf_dir):
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", _sha("base_spans").alias("base_sha256"), "spans", "n_guess")


@query
def op5_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = language.train(language.learnable(docs))
    out = language.predict(docs.withColumn("held_out", language.held_out()), model, keep=("held_out",))
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


@query
def op7_sentencepiece(spark, sf_dir):
    out = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_pieces", _sha("ids").alias("ids_sha256"), "lossless")


@query
def op2_license_scan(spark, sf_dir):
    out = license_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"),
                      F.array_join("licenses", ",").alias("licenses"), "places")


@query
def op11_whitening(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors, whitening.fit(vectors))


@query
def op12_fingerprints(spark, sf_dir):
    return weighted_sampling.compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, of which about every tenth repeats some of its words to its end, by a checksum of its id; a null id plants none."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(hashed % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    # Columns of their own: a lambda would work out again for each word what stands in it.
    docs = docs.withColumn("_words", F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    docs = docs.withColumns({"_n": F.size("_words").cast("long"), "_g": F.floor(hashed / 10)})
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    docs = docs.withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)))
    own = F.transform("_words", lambda w, i: F.when(i >= F.col("_a"), F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))).otherwise(w))
    return docs.withColumn("text", F.when(F.col("_n") > 0, F.array_join(own, " ")).otherwise(F.col("text")))


@query
def op13_periodic_runs(spark, sf_dir):
    out = periodic_runs.find_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    best = periodic_runs.longest()
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best")["length"] * 1000 / F.col("best")["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.listed().cast("binary"), 256).alias("runs_sha256"), _sha("collapsed").alias("collapsed_sha256"))


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
