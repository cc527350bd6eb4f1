"""The pipeline over the small corpus, stage by stage."""

import corpus_pipeline
import numpy as np
import pytest
from barloom.llm import queries
from barloom.llm.common import settled
from tests.llm.reference_rules import personal, shingle_set


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settled(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def test_stages_keep_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_good_documents_stay(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    assert np.mean([i in kept for i in labels[labels.quality == 1].doc_id]) > 0.97
    assert np.mean([i in kept for i in labels[labels.quality == 0].doc_id]) < 0.3


def test_no_two_near_duplicates_stay(stages):
    sets = [shingle_set(r["text"]) for r in stages[2].collect()]
    seen = {}
    for k, s in enumerate(sets):
        near = {}
        for x in s:
            for j in seen.get(x, ()):
                near[j] = near.get(j, 0) + 1
            seen.setdefault(x, []).append(k)
        assert all(100 * n < 75 * (len(s) + len(sets[j]) - n) for j, n in near.items())


def test_no_personal_data_stays(stages):
    assert stages[3].count() == stages[2].count()
    assert not [r for r in stages[3].collect() if personal(r["text"]) or r["n_chars"] != len(r["text"])]


def test_mixed_documents_are_packed_whole(stages):
    pieces = stages[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    copies = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["sum(length)"] for r in pieces} == {r["doc_id"]: copies[r["doc_id"]] * r["max(doc_tokens)"] for r in pieces}
    assert set(copies) == {r["doc_id"] for r in pieces}


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, name, stage):
    """An empty table, and one with nulls, repeats and columns named as the operators' own."""
    base = spark.createDataFrame([(1, "some words of text here", "en", "a", 1), (1, "some words of text here", "en", "a", 1), (None, None, None, None, None), (3, "", "en", None, 0), (4, "mail a@b.com now", "de", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.selectExpr("*", "'mine' AS score", "7 AS predicted", "'c' AS `class`", "'k' AS keys", "1 AS spans", "2 AS mix_size")
    out = stage(spark, docs, "/root/testdata/sf0.001")
    if name == "pack":
        assert out.select("doc_id").distinct().count() == 4
    else:
        assert out.columns == docs.columns
        assert {(r["score"], r["predicted"], r["class"], r["keys"], r["spans"], r["mix_size"]) for r in out.collect()} <= {("mine", 7, "c", "k", 1, 2)}
        assert out.count() == {"near_duplicates": 4, "personal_data": 5}.get(name, out.count())
    none = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
    assert none.count() == 0 and none.columns == out.columns


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
