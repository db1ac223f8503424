"""Answers, drawings, pages and collections over stand-ins."""

import json

from folivane import providers
from folivane.operators import asking, blocks, collection, evaluate, ingest, pages

HITS = "qid long, question string, kind string, kind_rank int, id string, page int, heading string, text string, image_path string, score double, found_by array<string>"


def hits(spark):
    rows = [(1, None, "text", 1, "d:p2:t0", 2, "H", "The seal rests.", None, 0.5, ["bm25"]), (1, None, "image", 1, "d:p4:i0", 4, "Fig", "A pump", "gone.png", 0.25, ["dense"]), (3, None, "text", 1, "d:p9:t0", 9, None, "Stages", None, 0.5, ["dense"])]
    return spark.createDataFrame(rows, HITS)


def reply(prompt):
    if prompt.startswith(asking.INTENT):
        return json.dumps({"intent": " DRAW "})
    if prompt.startswith(asking.DRAW):
        return json.dumps({"title": "T", "dot": "```dot\ndigraph G { a }\n```"})
    return json.dumps({"answer": " said ", "used_image_ids": None if "QUESTION: none" in prompt else ["image-1"]})


def test_answers_end_to_end(spark):
    requests = spark.createDataFrame([(1, "Where is the seal?"), (2, " \n"), (3, "Draw the stages"), (4, "none")], "qid long, question string")
    got = {r.qid: r for r in asking.answer_questions(requests, hits(spark), providers.Chain([providers.Scripted("gemini-x", answer=reply)]), load=lambda p: open(p, "rb").read()).collect()}
    assert set(got) == {1, 3, 4}  # a blank question is refused
    assert (got[1].answer, got[1].intent, got[1].used_pages, got[1].saw_images, got[1].diagram) == ("said", "find", [4], False, None)  # its figure can't be loaded
    assert got[1].images[0].cited_by_model and got[1].text_sources[0].page == 2
    assert got[3].intent == "draw" and got[3].diagram.source == "digraph G { a }" and got[3].diagram.pages_used == [9] and got[3].diagram.origin == "generated"
    assert got[4].answer == "said" and got[4].images is None and got[4].used_pages == []
    failed = asking.answer_questions(requests, hits(spark), providers.Chain([providers.Scripted("mute", answer=lambda p: "")]), draw=False).where("qid = 1").first()
    assert failed.answer == "" and "mute: empty reply" in failed.failure
    seen = asking.answer_questions(requests, hits(spark), providers.Chain([providers.Scripted("gemini-x", answer=reply)]), load=lambda p: b"png", draw=False).where("qid = 1").first()
    assert seen.saw_images
    for blank in (None, "", " \t"):
        try:
            asking.require_question(blank)
            raise AssertionError
        except ValueError:
            pass


def test_drawings_need_source_and_a_model_that_says_so(spark):
    one = spark.createDataFrame([(3, "Sketch the stages")], "qid long, question string")

    def chain(dot, intent='{"intent": "draw"}'):
        return providers.Chain([providers.Scripted("m", answer=lambda p: intent if p.startswith(asking.INTENT) else json.dumps({"dot": dot}))])

    assert asking.diagrams(one, hits(spark), chain("digraph { a")).count() == 0
    assert asking.diagrams(one, hits(spark), chain("digraph { a }", "nonsense")).count() == 0
    assert asking.diagrams(one, hits(spark), chain("digraph { a }")).first().diagram.title == "Generated diagram"


def reader(content):
    lines = [(0, 0, 0, 14.0, "Seals"), (0, 1, 0, 10.0, "The seal rests beside the wall. " * 9)]
    yield pages.Page(text="The seal rests. " * 20, spans=lines, render=b"p1", images=[None, pages.Image(200, 100, bytes(range(60)), b"pump"), pages.Image(10, 10, bytes(range(60)), b"small"), pages.Image(200, 100, bytes(60), b"flat"), pages.Image(200, 100, bytes(range(60)), b"pump")])
    yield pages.Page(render=b"p2")


def test_documents_to_chunks(spark):
    files = spark.createDataFrame([("/in/My Book.pdf", b"%PDF")], "path string, content binary")
    read = pages.read_pages(files, reader)
    asked = []

    def see(prompt):
        asked.append(prompt)
        return json.dumps({"caption": "Pump", "extracted_text": "P1"} if prompt.startswith("Describe this figure") else {"markdown": "# Scan\nfour words are here", "page_summary": "A scan"})

    none = spark.createDataFrame([], "doc_id string, cache_key string, result string")
    chunks, cache = pages.chunk_documents(read, none, providers.Chain([providers.Scripted("blind", sees_images=False), providers.Scripted("sees", answer=see)]), "out")
    got = {r.id: (r.heading, r.text, r.image_path) for r in chunks.collect()}
    assert set(got) == {"my-book:p1:t0", "my-book:p1:i1", "my-book:p2:t0", "my-book:p2:i0"}
    assert got["my-book:p1:t0"][0] == "Seals" and got["my-book:p1:i1"] == ("Pump", "Pump\nText shown in the figure: P1", "out/my-book/page_001_img_01.png")
    assert got["my-book:p2:t0"][:2] == ("Scan", "four words are here") and got["my-book:p2:i0"] == ("A scan", "A scan", "out/my-book/page_002.png")
    kept = spark.createDataFrame(cache.collect(), cache.schema)
    assert {r.cache_key for r in kept.collect()} == {"img:1:1", "page:2"}
    again, _ = pages.chunk_documents(read, kept, None, "out")
    assert {r.id: r.text for r in again.collect()} == {k: v[1] for k, v in got.items()}
    m = pages.manifests(read, chunks).first()
    assert (m.doc_id, m.source, m.pages, m.text_pages, m.vision_pages, m.images, m.chunk_count) == ("my-book", "My Book.pdf", 2, 1, 1, 2, 4)
    assert [r.path for r in pages.render_paths(read, "out").orderBy("path").collect()] == ["out/my-book/page_001.png", "out/my-book/page_002.png"]
    assert pages.pages_done(spark.createDataFrame([("o/page_001.png",), ("o/page_001_img_00.png",), ("o/x.png",)], "path string")) == 1
    assert [r.doc_id for r in pages.clashing(spark.createDataFrame([("/a/My Book.pdf",), ("/a/my_book.PDF",), ("/a/x.pdf",)], "path string")).collect()] == ["my-book"]
    files = spark.createDataFrame([("d", '{"page:1": {"markdown": "x"}}'), ("e", "{damaged"), ("f", None)], "doc_id string, content string")
    assert [tuple(r) for r in pages.from_cache_files(files).collect()] == [("d", "page:1", '{"markdown":"x"}')]


def test_collections(spark, tmp_path):
    path = f"{tmp_path}/points"
    assert collection.count(spark, path) == 0
    collection.ensure(spark, path)
    row = lambda k, text: (k, k, "d", 1, "text", text, "", None, [1.0])
    schema = "point_id string, id string, doc_id string, page int, kind string, text string, heading string, image_path string, vector array<float>"
    collection.put(spark, path, spark.createDataFrame([row("a", "old"), row("b", "old")], schema))
    collection.put(spark, path, spark.createDataFrame([row("b", "new")], schema))
    assert collection.count(spark, path) == 2 and {r.id: r.text for r in collection.scan(spark, path).collect()} == {"a": "old", "b": "new"} and "vector" not in collection.scan(spark, path).columns
    collection.ensure(spark, path)
    assert collection.count(spark, path) == 2
    collection.ensure(spark, path, recreate=True)
    assert collection.count(spark, path) == 0
    # A snapshot is built once for a version, and another version isn't read for it.
    made = []
    chunks = spark.createDataFrame([("a", "d", 1, "text", "pump seal", "", None)], "id string, doc_id string, page int, kind string, text string, heading string, image_path string")
    for version in ("v1", "v1", "v2"):
        kept = collection.snapshot(spark, version, lambda: made.append(version) or chunks, lambda c: c.selectExpr("id", "kind", "array(1.0D) AS vector"), str(tmp_path))
        assert kept.index.vocab.count() == 2
    assert made == ["v1", "v2"]
    spark.range(3).write.parquet(f"{tmp_path}/t")
    first = collection.source_version(spark, spark.read.parquet(f"{tmp_path}/t"))
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert first != collection.source_version(spark, spark.read.parquet(f"{tmp_path}/t"))


def test_golden_files(spark, tmp_path):
    sample = spark.createDataFrame([("a", "d", 1, "text", "x" * 3000, None), ("b", "d", 2, "image", None, "H")], "id string, doc_id string, page int, kind string, text string, heading string")
    asked = evaluate.question_prompts(sample.withColumn("qid", sample.page)).collect()
    assert "x" * 2000 in asked[0].prompt and "x" * 2001 not in asked[0].prompt and 'section "(none)"' in asked[0].prompt
    chain = providers.Chain([providers.Scripted(answer=lambda p: json.dumps({"question": " Why é? " if "page 1" in p else " "}))])
    made = evaluate.golden_questions(sample, chain)
    evaluate.write_golden(made, f"{tmp_path}/g")
    with open(f"{tmp_path}/g/more.json", "w") as f:
        f.write("\n  \n")
    assert [tuple(r) for r in evaluate.read_golden(spark, f"{tmp_path}/g").collect()] == [("Why é?", 1, "a", "text", "d")]


def test_models_are_waited_for_and_caches_kept(spark, tmp_path):
    assert providers.wait_seconds("429: please retry in 34.5s", 1) == 36.5 and providers.wait_seconds("retry in 500 s", 1) == 120 and providers.wait_seconds("no", 8) == 8

    def model(texts, task):
        if task == "query" and not slept:
            raise RuntimeError("Retry in 3s")
        return [[3.0, 4.0] for _ in texts]

    slept = []
    rows = spark.createDataFrame([("a", "x")], "id string, t string")
    assert providers.embed(rows, "t", 2, model=model, task="query", sleep=slept.append).first().vector == [0.6, 0.8]
    path, chain = f"{tmp_path}/cache", providers.Chain([providers.Scripted(answer=lambda p: json.dumps({"p": p}))])
    wanted = spark.createDataFrame([("d", f"page:{k}", f"q{k}", b"") for k in range(9)], "doc_id string, cache_key string, prompt string, image binary")
    for _ in range(2):
        assert providers.keep_answers(spark, wanted, path, ["doc_id", "cache_key"], chain, 3).count() == 9
    assert providers.self_test(providers.Chain([providers.Scripted("a"), providers.Scripted("b", answer=lambda p: "")])) == {"a": "ok", "b": "empty reply"}
    (tmp_path / "p.png").write_bytes(b"raw")
    try:
        assert providers.load_scaled(f"{tmp_path}/p.png") == b"raw"
    except Exception as e:  # noqa: BLE001 - with an imaging library these bytes are no picture
        assert "image" in str(e).lower()


def test_sources_and_markup(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nx", encoding="utf-8")
    assert ingest.markdown_files(spark, f"{tmp_path}/a.md").first().text == "# T\n\nx"
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    assert ingest.pdf_files(spark, f"{tmp_path}/b.pdf", f"{tmp_path}/none.pdf").count() == 1 and ingest.pdf_files(spark, f"{tmp_path}/none").count() == 0
    df = spark.createDataFrame([("a **b c** `d` → e **", ["ab", "long header"], [["x", "y" * 40], ["z"]])], "t string, h array<string>, r array<array<string>>")
    got = df.select(blocks.inline(df.t).alias("i"), blocks.column_shares(df.h, df.r).alias("w")).first()
    assert [tuple(x) for x in got.i] == [("a ", ""), ("b c", "b"), (" ", ""), ("d", "code"), (" -> e **", "")]
    assert abs(sum(got.w) - 1) < 1e-9 and got.w[0] < got.w[1]
