import pytest
from compare import BASE, both

from folivane import catalogue
from folivane.operators import search


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, name):
    ours, theirs = both(spark, catalogue.QUERIES[name], catalogue.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, BASE).count() > 0


def test_every_stated_query_is_asked(spark):
    log, vec = spark.read.parquet(f"{BASE}/query_log.parquet"), spark.read.parquet(f"{BASE}/embeddings.parquet")
    requests = {r[0] for r in log.where("request_id % 100 = 0").select("request_id").distinct().collect()}
    vectors = {r[0] for r in vec.where("vec_id % 100 = 0").select("vec_id").collect()}
    assert len(requests) > 1 and len(vectors) > 1
    for name in ("bm25_topk_asked", "rrf_fusion_asked", "hybrid_search_asked", "build_prompt_asked", "diagram_context_asked", "shaped_answers"):
        assert {r[0] for r in catalogue.QUERIES[name](spark, BASE).select("qid").distinct().collect()} == requests, name
    for name in ("dense_topk_asked", "dense_topk_kind_asked"):
        assert {r[0] for r in catalogue.QUERIES[name](spark, BASE).select("qid").distinct().collect()} == vectors, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["bm25_topk_asked", "rrf_fusion_asked", "hybrid_search_asked", "build_prompt_asked", "diagram_context_asked"])
def test_every_request_is_asked(spark, name):
    requests = {r[0] for r in spark.read.parquet(f"{BASE}/query_log.parquet").select("request_id").distinct().collect()}
    assert len(requests) > 100
    assert {r[0] for r in catalogue.QUERIES[name](spark, BASE).select("qid").distinct().collect()} == requests


def test_many_questions(spark, monkeypatch):
    monkeypatch.setattr(search, "ASKED", 1)
    monkeypatch.setattr(search, "CHUNKS_AT_ONCE", 100)
    ours, theirs = both(spark, catalogue.QUERIES["bm25_topk_asked"], catalogue.SQL["bm25_topk_asked"])
    assert ours == theirs and ours
