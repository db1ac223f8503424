import math
import random

import numpy as np
import pyarrow as pa
import pytest
from compare import both
from pyspark.sql import functions as F

from folivane import catalogue
from folivane.operators import answer, evaluate, index, search


def chunks(spark, texts):
    return spark.createDataFrame([(f"c{i}", None, t) for i, t in enumerate(texts)], "id string, heading string, text string")


def test_bm25_by_formula(spark):
    texts = ["pump valve pump", "pump seal", "pump rotor rotor shaft", None, "pump"]
    toks = [(t or "").split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    q = ["rotor", "pump", "rotor", "unseen"]
    want = {}
    for i, t in enumerate(toks):
        s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q)
        if s > 0:
            want[f"c{i}"] = round(s, 6)
    ix = index.keyword_index(chunks(spark, texts))
    got = {r.id: r.score for r in search.bm25(ix, search.questions(spark, [(1, " ".join(q))]), 10).collect()}
    assert got == pytest.approx(want)
    assert search.bm25(ix, search.questions(spark, [(1, "")]), 10).count() == 0
    empty = index.keyword_index(chunks(spark, texts).where("false"))
    assert search.bm25(empty, search.questions(spark, [(1, "pump")]), 10).count() == 0


def test_bm25_moves_the_best_only(spark, monkeypatch):
    ix = index.keyword_index(chunks(spark, [f"pump seal{i % 3}" for i in range(600)] + ["rotor"] * 900))
    moved, top = [], search._top
    monkeypatch.setattr(search, "_top", lambda scored, *a: moved.append(scored.count()) or top(scored, *a))
    got = search.bm25(ix, search.questions(spark, [(1, "pump seal1"), (2, "pump")]), 5)
    assert moved[0] <= 2 * 5 * 2 * spark.sparkContext.defaultParallelism
    assert [r.id for r in got.where("qid = 1").orderBy("rank").collect()] == ["c1", "c10", "c100", "c103", "c106"]
    assert [r.id for r in got.where("qid = 2").orderBy("rank").collect()] == ["c0", "c1", "c10", "c100", "c101"]


def test_index_is_written_where_chunks_are(spark):
    assert "Exchange" not in index.blocks_of(chunks(spark, ["pump seal"]))._jdf.queryExecution().executedPlan().toString()


def test_segments_are_scored_as_one_index():
    rng = random.Random(1)
    texts = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(12))] for _ in range(300)]
    avg = sum(map(len, texts)) / len(texts)
    cuts = [(0, 1), (1, 120), (120, 121), (121, 300)]
    rows = [index._segment(k, pa.array([f"c{i}" for i in range(a, b)]), pa.array(texts[a:b], pa.list_(pa.string()))) for k, (a, b) in enumerate(cuts)]
    assert sum(len(r) for r in rows) == sum(1 + len({w for t in texts[a:b] for w in t}) for a, b in cuts)
    terms = {"w3": ([0, 1], [1.5, 2.0]), "w7": ([1], [-0.5]), "none": ([0], [9.0])}
    sent = type("Sent", (), {"value": (np.array([10, 11]), terms, avg)})
    whole = pa.Table.from_batches(rows).combine_chunks()
    for size in (1, 7, 10_000):
        got = {(r["qid"], r["id"]): r["score"] for b in search._scored(sent, 400, 1.5, 0.75)(iter(whole.to_batches(size))) for r in b.to_pylist()}
        want = {}
        for q, weights in ((10, {"w3": 1.5}), (11, {"w3": 2.0, "w7": -0.5})):
            for i, t in enumerate(texts):
                s = sum(w * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for x, w in weights.items())
                if s > 0:
                    want[q, f"c{i}"] = s
        assert got == pytest.approx(want)


def test_first_of_ties():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 60)
        ids = np.array(rng.sample([f"c{i}" for i in range(100)], n), object)
        s = np.array([rng.choice([0.1, 0.2, 0.2 + 1e-13, 0.2000004, 0.30000050001]) for _ in range(n)])
        order = lambda i, s: sorted(zip(-np.round(s, 6), i))[:5]
        got = search._first(ids, s, 5)
        assert order(*got) == order(ids, s) and len(got[0]) <= 5 + int((s > 0.3).sum())


def test_fusion_ties_keep_list_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid long, id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "qid long, id string, rank int")
    f = search.fuse({"dense": a, "bm25": b})
    order = [r.id for r in f.orderBy(*search.fused_order(["dense", "bm25"])).collect()]
    assert order == ["y", "x", "z"]
    assert {r.id: r.found_by for r in f.collect()} == {"x": ["dense"], "y": ["dense", "bm25"], "z": ["bm25"]}


def test_dense_zero_vector_and_kind(spark):
    v = spark.createDataFrame([("a", "text", [1.0, 0.0]), ("b", "image", [0.0, 0.0]), ("c", "image", [2.0, 2.0])], "id string, kind string, vector array<float>")
    q = spark.createDataFrame([(1, [3.0, 0.0])], "qid long, vector array<float>")
    assert [(r.id, r.score) for r in search.dense(v, q, 5).orderBy("rank").collect()] == [("a", 1.0), ("c", pytest.approx(math.sqrt(0.5), abs=1e-6)), ("b", 0.0)]
    assert [r.id for r in search.dense(v, q, 1, "image").collect()] == ["c"]


def test_upsert_and_version(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "point_id string, v int")
    assert sorted(map(tuple, index.upsert(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    x, y = chunks(spark, ["a", "b"]), chunks(spark, ["a", "c"])
    assert index.content_version(x) != index.content_version(y)
    assert index.content_version(x) == index.content_version(x.orderBy(F.desc("id")))
    assert index.content_version(x.where("false")).startswith("0-")


def test_index_snapshot(spark, tmp_path):
    given = chunks(spark, ["pump seal", "seal"])
    ix = index.keyword_index(given)
    index.write_index(given, str(tmp_path))
    back = index.read_index(spark, str(tmp_path))
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, ix.postings.collect())) and back.totals.first() == ix.totals.first()
    assert sorted(map(tuple, back.vocab.collect())) == sorted(map(tuple, ix.vocab.collect()))


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "qid long, expect_kind string, rank int")
    r = evaluate.metrics(none, "m").first()
    assert (r.n, r.hit_rate, r.mrr, r.image_hit_rate) == (0, 0.0, 0.0, None)
    assert evaluate.sample_shares(3, 20, 40) == {"text": 3, "image": 10} and evaluate.sample_shares(100, 2, 8) == {"text": 6, "image": 2}


def test_answers(spark):
    hits = spark.createDataFrame(
        [(1, "q", "image", 1, "i1", 4, None, "fig", "p.png", 0.0123456, ["bm25"]), (1, "q", "text", 1, "t1", 2, "H", "x" * 2000, None, 0.5, ["dense"])],
        "qid long, question string, kind string, kind_rank int, id string, page int, heading string, text string, image_path string, score double, found_by array<string>",
    )
    said = "qid long, answer string, used_image_ids array<string>, used_pages array<int>, model string, attached boolean"
    r = answer.shaped(spark.createDataFrame([(1, " ok ", [" image-1", "IMAGE-9"], None, "gemini-x", True)], said), hits).first()
    assert r.answer == "ok" and r.used_pages == [4] and r.saw_images and r.images[0].cited_by_model and r.images[0].caption == "figure" and r.images[0].score == 0.01235
    r = answer.shaped(spark.createDataFrame([(1, None, None, [9, 2, 9], "other", True)], said), hits).first()
    assert r.answer == "" and r.used_pages == [2, 9] and not r.saw_images and not r.images[0].cited_by_model
    p = answer.prompts(hits, "R").first().prompt
    assert "[T1] page 2 - H\n" + "x" * 1800 + "\n" in p and "[IMAGE-1] page 4 - figure\nDescription: fig" in p and p.startswith("R\n\n====")
    none = spark.createDataFrame([(1, "q", None, None, None, None, None, None, None, None, None)], hits.schema)
    assert answer.prompts(none, "R").first().prompt.count("(none)") == 2
    assert answer.diagram_context(none).first().context == "(no relevant text found)"


def test_more_words_than_are_pushed_down(spark, monkeypatch):
    monkeypatch.setattr(search, "PUSHED", 1)
    ours, theirs = both(spark, catalogue.QUERIES["bm25_topk"], catalogue.SQL["bm25_topk"])
    assert ours == theirs and ours
