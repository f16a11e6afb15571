import pytest

import corpus_pipeline
from cytolake.llm.queries import queries
from cytolake.llm.sql import oracle_sql
from tests.oracle import SF, check, connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    check(spark, connection(), queries()[name], oracle_sql()[name])


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.cache()
        now = docs.count()
        assert 0 < now <= before
        before = now


def test_near_duplicates_keep_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text), (2, text + " more"), (None, text), (9, "quite another text of some words here"), (9, "the same id again but yet another text"), (7, None), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "src0", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect())
    assert got == [-1, 1, 7, 8, 9, 9]


def test_a_row_stays_when_another_of_its_id_goes(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (5, text), (5, "a clean text that only shares the id of a copy"), (6, text + " more")]
    docs = spark.createDataFrame([(d, t, "en", "src0", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, text), rows[2]]


def test_clashing_names_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, hit string, id long, _hit int"
    rows = [(i, t, "en", None, 0, "r", 1, "h", 2, 3) for i, t in [(1, text), (1, text), (2, text), (3, None), (3, None), (4, "")]]
    docs = spark.createDataFrame(rows, names)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 3, 4]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_on_an_empty_table_and_nulls(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "some words of a text that is long enough to be kept by all of the rules", None, None, None), (2, None, "en", "src0", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    kept = corpus_pipeline.quality_rules(spark, nulls, SF).collect()
    assert [r["doc_id"] for r in kept] == [1]
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nulls, SF).filter("doc_id = 1").count() >= 1


def test_run_is_its_stages(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "domain", "lang", "source", "epoch", "n_tokens"] and out.count() > 0
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids
