"""The registered queries, and the pipeline stage by stage against plain versions."""

import re

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from eventcal.llm import queries, secrets
from eventcal.session import stored
from test_repeats import plain_components
from test_text_operators import plain_hits, plain_spans
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_the_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run and set(queries.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "secrets", "encoding"]


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, docs, folder), name)
        out.append((name, docs, kept))
        docs = kept
    return {name: (before, after) for name, before, after in out}


@pytest.fixture(scope="module")
def small(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    more = spark.createDataFrame([(200, "a clean text with a token = abcdef0123456789abcdef in it", "en", "c", 3),
                                  (201, " ".join(f"w{k}" for k in range(4000, 4015)), None, "c", 3)], odd.schema)
    odd.unionByName(more).withColumn("chunk", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"W{k}" for k in range(4002, 4013))), (2, None)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, small):
    made = stages(spark, small)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    for name, (_, after) in made.items():
        if name != "encoding":
            assert after.columns == COLUMNS
    before, after = made["language"]
    letters = [r.doc_id for r in before.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    assert set(ids(after)) <= set(letters) and {1, 3, 8, 9, 200, 201} <= set(ids(after))
    assert after.filter("lang IS NULL").count() == 0

    before, after = made["near_copies"]
    keep = {i for i, _, c in plain_components([(r.doc_id, r.text) for r in before.collect()]) if i == c and i is not None}
    assert ids(after.filter("doc_id IS NOT NULL")) == sorted(keep, key=str)
    assert after.filter("doc_id IS NULL").count() == before.filter("doc_id IS NULL").count()

    before, after = made["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = [i for i, _, n, _ in plain_hits([(r.doc_id, r.text) for r in before.collect()], items, 10) if not n]
    assert ids(after) == sorted(clean, key=str) and 201 in ids(before) and 201 not in ids(after)

    before, after = made["secrets"]
    assert ids(before) == ids(after)
    for r in after.collect():
        assert not plain_spans(r.text).replace("hex", "") or secrets.MARK in r.text
        assert secrets.MARK not in r.text or r.n_chars == len(r.text)
    assert after.filter("doc_id = 200").first().text == f"a clean text with a {secrets.MARK} in it"

    before, after = made["encoding"]
    assert ids(before) == ids(after) and after.filter("NOT lossless").count() == 0
    run = corpus_pipeline.run(spark, small)
    assert sorted(map(str, run.collect())) == sorted(map(str, after.collect()))


@pytest.fixture(scope="module")
def benchmark(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("benchmark"))
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_decontamination_decides_by_row(spark, benchmark, odd):
    held = "before " + " ".join(f"b{k}" for k in range(12)) + " behind"
    rows = [(None, held, "en", "a", 1), (None, "a clean text", "en", "a", 1), (7, held, "en", "a", 1), (7, "another clean text", "en", "a", 1),
            (8, None, "en", "a", 1), (None, None, None, None, None), (9, "clean", None, "a", None), (9, "clean", None, "a", None)]
    after = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, odd.schema), benchmark)
    assert after.columns == COLUMNS
    assert sorted(map(str, map(tuple, after.collect()))) == sorted(str(r) for r in rows if r[1] != held)


def test_near_copies_decide_by_row(spark, odd):
    text = lambda a: " ".join(f"v{a}x{k}" for k in range(40))
    keep = [(5, text(1), "en", "a", 1), (5, text(2), "en", "a", 1), (3, text(3), "en", "a", 1), (None, text(1), "en", "a", 1),
            (7, None, "en", "a", 1), (7, "", "en", "a", 1), (2, text(4), "de", "b", None)]
    drop = [(6, text(1), "en", "a", 1), (5, text(3) + " end", "en", "a", 1), (9, text(4), "de", "b", None), (5, text(2), "en", "a", 1)]
    after = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(keep + drop, odd.schema), "")
    assert after.columns == COLUMNS
    assert sorted(map(str, map(tuple, after.collect()))) == sorted(map(str, keep))


def test_empty_tables(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op11_whitening"}))
def test_queries_return_a_row_for_each_document(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    rows = out.select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_whitening_returns_sixteen_rows_for_each_vector(spark, sf):
    rows = queries.queries()["op11_whitening"](spark, sf).groupBy("vec_id").count().collect()
    assert {r["count"] for r in rows} == {16} and len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
