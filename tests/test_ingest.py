import json

from pyspark.sql import functions as F

from folivane import providers
from folivane.operators import blocks, ingest


def test_spans(spark):
    rows = [("d", 1, 0, 0, 0, 11.5, " Big "), ("d", 1, 0, 1, 0, 10.0, "a"), ("d", 1, 0, 1, 1, 10.0, "b"), ("d", 1, 1, 0, 0, 10.0, "c"), ("d", 1, 1, 1, 0, 10.0, "  ")]
    md = ingest.spans_to_markdown(spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, size double, text string"))
    assert md.first().markdown == "## Big\nab\n\nc\n"  # 11.5 is exactly 1.15 times the median


def test_images(spark):
    flat = ingest.flat_colour_ratio
    px = spark.createDataFrame([(bytes([1, 2, 3] * 19 + [0, 0, 0]),), (b"",), (None,)], "p binary")
    assert [r.r for r in px.select(flat("p").alias("r")).collect()] == [0.95, None, None]
    rows = [("a", 1, 0, 100, 100, 0.95, b"x"), ("a", 2, 0, 200, 100, 0.1, b"x"), ("b", 1, 0, 100, 100, 0.1, b"x"), ("a", 1, 1, 99, 100, 0.1, b"y"), ("a", 1, 2, 500, 500, 0.951, b"z")]
    kept = ingest.keep_images(spark.createDataFrame(rows, "doc_id string, page int, idx int, width int, height int, flat_ratio double, png binary"))
    assert sorted((r.doc_id, r.page, r.idx) for r in kept.collect()) == [("a", 1, 0), ("b", 1, 0)]


def test_page_images(spark):
    schema = "doc_id string, page int, markdown string, page_summary string, figures array<struct<caption:string,description:string,kind:string>>"
    rows = [("d", 1, "m", "s", [(None, "x", None), ("c", "", None)]), ("d", 2, " ".join("w" * 130), None, []), ("d", 3, None, "s", None)]
    got = {r.id: (r.text, r.heading) for r in ingest.transcribed_pages(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"d:p1:i0": ("s\n\nx\n\nc", ""), "d:p2:i0": (" ".join("w" * 120), ""), "d:p3:i0": ("s", "s")}


def test_manifests(spark, tmp_path):
    c = spark.createDataFrame([("d:p1:t0", "d", 1, "text", "é", "", None)], "id string, doc_id string, page int, kind string, text string, heading string, image_path string")
    d = spark.createDataFrame([("d", "d.pdf", 1, 1, 0, None), ("e", "e.pdf", 0, 0, 0, 0)], "doc_id string, source string, pages int, text_pages int, vision_pages int, images int")
    for r in ingest.to_manifests(c, d).toJSON().collect():
        (tmp_path / json.loads(r)["doc_id"]).mkdir()
        (tmp_path / json.loads(r)["doc_id"] / "manifest.json").write_text(r, encoding="utf-8")
    back = ingest.read_manifests(spark, f"{tmp_path}/*/manifest.json")
    assert [(r.doc_id, r.chunk_count) for r in back.collect()] == [("d", 1), ("e", 0)]
    assert ingest.manifest_chunks(back).first().text == "é"


def told(spark, *texts):
    df = blocks.markdown_blocks(spark.createDataFrame(list(enumerate(texts)), "key long, md string"), "key", "md")
    return df, [tuple(r)[2:] for r in df.orderBy("key", "pos").collect()]


def test_blocks(spark):
    md = "# T\n<!-- meta: by = me -->\npara one\ngoes on\n\n## Sub\n- a\n* b\n1. x\n2) y\n> [!WARN] Mind\n> this\n| a | b |\n|---|---|\n| 1 |\n---\n```diagram Flow\nx\n```\n<!-- pagebreak -->\n```py\ncode"
    df, got = told(spark, md)
    n = None
    assert got == [
        ("title", "T", n, n, n, n), ("meta", "me", "by", n, n, n), ("p", "para one goes on", n, n, n, n), ("h2", "Sub", n, n, n, n), ("bullets", n, n, ["a", "b"], n, n), ("numbers", n, n, ["x", "y"], n, n),
        ("callout", "this", "warn: Mind", n, n, n), ("table", n, n, n, ["a", "b"], [["1", ""]]), ("rule", n, n, n, n, n), ("diagram", "x", "Flow", n, n, n), ("pagebreak", n, n, n, n, n), ("code", "code", n, n, n, n),
    ]
    whole = [tuple(r)[1:6] for r in blocks.wrapped(df, "S").orderBy("pos").collect()]
    assert whole[:3] == [(0, "cover", "T", "S", ["by: me"]), (1, "pagebreak", n, n, n), (2, "title", "T", n, n)] and len(whole) == len(got) + 2
    assert told(spark, None, "")[1] == []


def test_blocks_where_rules_meet(spark):
    n = None
    md = "one\n<!-- note -->\ntwo\n<!-- meta: a = b = c -->\nthree\n> quoted\n| no table |\nfour\n# Late\n### Deep\n##### Deeper\n- a\n<!-- x -->\n- b\n> before\n> [!other] T\n>> in\n> [!key] still in\n|a|\n|b|c|\n|:-|-:|\n|1|2|3|\n```\n# not a heading\n\n> nor this\n```\n```\n```\nlast"
    assert told(spark, md)[1] == [
        ("meta", "b = c", "a", n, n, n), ("p", "one two three > quoted | no table | four", n, n, n, n), ("h1", "Late", n, n, n, n), ("h3", "Deep", n, n, n, n), ("h3", "Deeper", n, n, n, n),
        ("bullets", n, n, ["a"], n, n), ("bullets", n, n, ["b"], n, n), ("p", "> before", n, n, n, n), ("callout", "in [!key] still in", "info: T", n, n, n), ("p", "|a|", n, n, n, n),
        ("table", n, n, n, ["b", "c"], [["1", "2"]]), ("code", "# not a heading\n\n> nor this", n, n, n, n), ("code", "", n, n, n, n), ("p", "last", n, n, n, n),
    ]
    assert told(spark, "\n\n".join(f"# {k}" for k in range(2)))[1] == [("title", "0", n, n, n, n), ("h1", "1", n, n, n, n)]
    assert [r[0] for r in told(spark, "a\n---\nb\r\n***\n- - -\n-x\n1.y\n```diagram\nd")[1]] == ["p", "rule", "p", "rule", "bullets", "p", "diagram"]


def test_providers(spark):
    bad, good = providers.Scripted("bad", answer=lambda p: ""), providers.Scripted("good")
    said, name = providers.Chain([bad, good]).ask_json("hello")
    assert name == "good" and said["answer"] == "hello" and bad.asked
    blind = providers.Scripted("blind", sees_images=False)
    try:
        providers.Chain([blind, bad]).ask("x", needs_vision=True)
        raise AssertionError
    except providers.AllFailed as e:
        assert "bad" in str(e) and "blind" not in str(e)
    v = providers.embed(spark.createDataFrame([("a", "x y"), ("b", None)], "id string, t string"), "t", 8).collect()
    assert abs(sum(x * x for x in v[0].vector) - 1) < 1e-9 and v[1].vector == [0.0] * 8
    cache = spark.createDataFrame([("k1", "")], "key string, result string")
    want = spark.createDataFrame([("k1", "p"), ("k2", "p")], "key string, prompt string")
    assert sorted(map(tuple, providers.ask_missing(want, cache, ["key"], str.upper).collect())) == [("k1", ""), ("k2", "P")]
    long = spark.createDataFrame([("k3", "p" * 4000 + " end", "c" * 2000), ("k4", None, None)], "key string, prompt string, context string")
    assert dict(map(tuple, providers.ask_missing(long.where("key = 'k3'").select("key", "prompt"), cache, ["key"], str.upper).collect()))["k3"] == "P" * 4000 + " END"
    told = long.select(providers.figure_prompt("Around it: {context}. Describe it.", F.col("context"))).collect()
    assert [r[0] for r in told] == ["Around it: " + "c" * 1500 + ". Describe it.", "Around it: . Describe it."]


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [r.path.rsplit("/")[-1] for r in ingest.pdf_files(spark, str(tmp_path)).collect()] == ["a.PDF"]
    out = ingest.write_blobs(spark.createDataFrame([(f"{tmp_path}/o/p.png", b"abc")], "path string, content binary"))
    assert out.first().bytes == 3 and (tmp_path / "o" / "p.png").read_bytes() == b"abc"


def test_stream(spark, tmp_path):
    from folivane.streaming.incremental import keep_current, read_version

    schema = "id string, doc_id string, text string, heading string"
    for n, rows in enumerate(([("a", "d", "1", ""), ("b", "d", "1", "")], [("b", "d", "2", "")], [("c", "d", "1", "")], [("a", "d", "4", "")])):
        spark.createDataFrame(rows, schema).write.mode("append").json(f"{tmp_path}/in")
        q = keep_current(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/points", f"{tmp_path}/cp", 3).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r.id, r.text) for r in read_version(spark, f"{tmp_path}/points").collect()) == [("a", "4"), ("b", "2"), ("c", "1")]
    assert {p.name for p in (tmp_path / "points").iterdir()} == {"0-0", "1-1", "2-2", "0-2", "3-3"}  # three parts were put into one
    assert read_version(spark, f"{tmp_path}/none") is None
    assert spark.range(1).select(F.lit(1)).count() == 1
