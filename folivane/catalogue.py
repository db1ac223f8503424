"""The queries of the engine over the test tables, and the SQL that checks them.

The corpus is ``chunks``, one row of each id (the first loaded). A chunk's vector is the row of ``embeddings`` that its
id's hash picks, since the tables have no vectors of chunks; a question's is picked by its number.

The searches of one example question are kept as their SQL has them. Those named ``*_asked`` are asked every request of
``query_log`` (dense search alone: every vector whose id is divisible by STEP), against all chunks; answers are made and
shaped for the requests whose id is divisible by STEP.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from folivane.functions import text as T
from folivane.operators import answer, asking, blocks, chunking, collection, evaluate, index, ingest, pages, search
from folivane.plans.sizing import maybe_broadcast
from folivane.plans.storage import cut
from folivane.providers import Chain, Scripted, missing
from folivane.settings import DEFAULT
from folivane.sources.tables import table

QID = 7
QUESTION = "Which bearing and which lubricant need the annual inspection, and where is the spare rotor kept?"
TOP = 5
STEP = 100


def _corpus(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunks", "id", "doc_id", "page", "kind", "text", "heading", "image_path", "ingested_at")
    return ingest.earliest(rows, "id", "ingested_at").drop("ingested_at")


def _snapshot(spark: SparkSession, base: str) -> collection.Snapshot:
    """The collection of the test tables: built by the first query that needs it, read by the others."""
    version = collection.source_version(spark, table(spark, base, "chunks"), table(spark, base, "embeddings"))
    return collection.snapshot(spark, version, lambda: _corpus(spark, base), lambda chunks: _vectors(spark, base, chunks))


def _golden(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "golden").select(F.col("item_id").alias("qid"), "question", "expect_page", "expect_kind", "doc_id")


def _vector_no(id_, n):
    return F.pmod(F.conv(F.substring(F.md5(id_), 1, 8), 16, 10).cast("long"), n)


def _vectors(spark: SparkSession, base: str, corpus: DataFrame) -> DataFrame:
    vec = table(spark, base, "embeddings", "vec_id", "embedding")
    n = vec.agg(F.count("*").alias("vectors"))
    numbered = corpus.select("id", "kind").join(F.broadcast(n)).select("id", "kind", _vector_no(F.col("id"), F.col("vectors")).alias("vec_id"))
    return numbered.join(vec, "vec_id").select("id", "kind", F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, base: str, asked: DataFrame) -> DataFrame:
    vec = table(spark, base, "embeddings", "vec_id", "embedding")
    n = vec.agg(F.count("*").alias("vectors"))
    return asked.join(F.broadcast(n)).withColumn("vec_id", F.pmod("qid", "vectors")).join(vec, "vec_id").select("qid", "question", F.col("embedding").alias("vector"))


def _question(spark: SparkSession) -> DataFrame:
    return search.questions(spark, [(QID, QUESTION)])


def _requests(spark: SparkSession, base: str, step: int = STEP) -> DataFrame:
    """The requests whose id is divisible by ``step``, the last received row of each, with qid and question."""
    log = table(spark, base, "query_log")
    log = ingest.latest(log if step == 1 else log.where(F.col("request_id") % step == 0), "request_id", "received_at")
    return log.withColumn("qid", F.col("request_id")).withColumn("question", F.coalesce("question", F.lit("")))


def _stated(spark: SparkSession, base: str) -> DataFrame:
    return _requests(spark, base).select("qid", "question")


def _every(spark: SparkSession, base: str) -> DataFrame:
    return _requests(spark, base, 1).select("qid", "question")


def _stated_vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings", "vec_id", "embedding").where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def _hits(spark: SparkSession, base: str, asked: DataFrame, top_text: int = 0, top_images: int = 0) -> DataFrame:
    kept = _snapshot(spark, base)
    return search.hybrid(kept.index, kept.vectors, asked, kept.chunks, top_text, top_images)


def tokenize_stats(spark: SparkSession, base: str) -> DataFrame:
    toks = _corpus(spark, base).select("kind", T.tokens(T.keyword_text(F.col("heading"), F.col("text"))).alias("t"))
    return toks.groupBy("kind").agg(F.count("*").alias("chunks"), F.sum(F.size("t")).alias("tokens"), F.round(F.avg(F.size("t")), 6).alias("avg_tokens"))


def build_index(spark: SparkSession, base: str) -> DataFrame:
    """What the collection's keyword index holds, once it is built."""
    kept = _snapshot(spark, base).index
    sums = kept.blocks.where(F.col("tok") != index.OWN).agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).alias("postings"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words"))
    return kept.totals.select("n", F.round("avgdl", 6).alias("avgdl")).join(F.broadcast(sums)).join(F.broadcast(kept.vocab.agg(F.count("*").alias("vocabulary"))))  # one row each


def bm25_vocab(spark: SparkSession, base: str) -> DataFrame:
    return _snapshot(spark, base).index.vocab.select("tok", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    return search.bm25(_snapshot(spark, base).index, _question(spark), DEFAULT.candidates).select("id", "score", "rank")


def dense_topk(spark: SparkSession, base: str) -> DataFrame:
    vectors = _snapshot(spark, base).vectors
    return search.dense(vectors, _asked(spark, base, _question(spark)), DEFAULT.candidates).select("id", "score", "rank")


def dense_topk_kind(spark: SparkSession, base: str) -> DataFrame:
    vectors = _snapshot(spark, base).vectors
    return search.dense(vectors, _asked(spark, base, _question(spark)), DEFAULT.candidates, kind="image").select("id", "score", "rank")


def rrf_fusion(spark: SparkSession, base: str) -> DataFrame:
    kept = _snapshot(spark, base)
    lists = {"dense": search.dense(kept.vectors, _asked(spark, base, _question(spark)), DEFAULT.candidates), "bm25": search.bm25(kept.index, _question(spark), DEFAULT.candidates)}
    return search.fuse(lists).select("id", F.round("score", 6).alias("score"), F.array_join("found_by", "+").alias("found_by"), "dense_rank", "bm25_rank")


def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    hits = _hits(spark, base, _asked(spark, base, _question(spark)))
    return hits.select("id", "kind", F.round("score", 6).alias("score"), F.array_join("found_by", "+").alias("found_by"), "kind_rank")


def bm25_topk_asked(spark: SparkSession, base: str) -> DataFrame:
    return search.bm25(_snapshot(spark, base).index, _every(spark, base), DEFAULT.candidates).select("qid", "id", "score", "rank")


def dense_topk_asked(spark: SparkSession, base: str) -> DataFrame:
    vectors = _snapshot(spark, base).vectors
    return search.dense(vectors, _stated_vectors(spark, base), DEFAULT.candidates).select("qid", "id", "score", "rank")


def dense_topk_kind_asked(spark: SparkSession, base: str) -> DataFrame:
    vectors = _snapshot(spark, base).vectors
    return search.dense(vectors, _stated_vectors(spark, base), DEFAULT.candidates, kind="image").select("qid", "id", "score", "rank")


def rrf_fusion_asked(spark: SparkSession, base: str) -> DataFrame:
    kept, asked = _snapshot(spark, base), _every(spark, base)
    lists = {"dense": search.dense(kept.vectors, _asked(spark, base, asked), DEFAULT.candidates), "bm25": search.bm25(kept.index, asked, DEFAULT.candidates)}
    return search.fuse(lists).select("qid", "id", F.round("score", 6).alias("score"), F.array_join("found_by", "+").alias("found_by"), "dense_rank", "bm25_rank")


def hybrid_search_asked(spark: SparkSession, base: str) -> DataFrame:
    hits = _hits(spark, base, _asked(spark, base, _every(spark, base)))
    return hits.select("qid", "id", "kind", F.round("score", 6).alias("score"), F.array_join("found_by", "+").alias("found_by"), "kind_rank")


def page_route(spark: SparkSession, base: str) -> DataFrame:
    given = ingest.latest(table(spark, base, "page_transcripts", "page_key", "markdown", "transcribed_at"), "page_key", "transcribed_at")
    return given.select("page_key", T.route(F.col("markdown")).alias("route"))


def _pages(spark: SparkSession, base: str) -> DataFrame:
    return ingest.latest(table(spark, base, "page_transcripts"), "page_key", "transcribed_at")


def heading_sections(spark: SparkSession, base: str) -> DataFrame:
    s = chunking.sections(_pages(spark, base), "page_key", "markdown")
    return s.select(F.col("key").alias("page_key"), "section", "heading", F.size(T.split_words(F.col("body"))).alias("n_words"))


def chunk_windows(spark: SparkSession, base: str) -> DataFrame:
    c = chunking.chunk_pages(_pages(spark, base), "page_key", "markdown", 120, 20)
    return c.select(F.col("key").alias("page_key"), "idx", "heading", F.md5("text").alias("text_md5"))


def transcript_chunks(spark: SparkSession, base: str) -> DataFrame:
    given = _pages(spark, base)
    both = chunking.page_chunks(given).unionByName(ingest.transcribed_pages(given))
    return both.select("id", "kind", F.md5("text").alias("text_md5"), "heading")


def figure_texts(spark: SparkSession, base: str) -> DataFrame:
    return ingest.transcribed_pages(_pages(spark, base)).select("id", "text", "heading")


def dedup_first_seen(spark: SparkSession, base: str) -> DataFrame:
    images = _corpus(spark, base).where("kind = 'image'")
    return ingest.first_seen(images, "doc_id", F.md5("text"), ["page", "id"]).select("id", "doc_id", "page")


def slug(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "manifests", "source").distinct().select("source", T.slug(F.regexp_replace("source", r"\.[^.]*$", "")).alias("slug"))


def point_id(spark: SparkSession, base: str) -> DataFrame:
    return index.points(_corpus(spark, base).select("id")).select("id", "point_id")


def kind_counts(spark: SparkSession, base: str) -> DataFrame:
    return _corpus(spark, base).groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def doc_catalog(spark: SparkSession, base: str) -> DataFrame:
    m = ingest.latest(table(spark, base, "manifests"), "doc_id", "loaded_at")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return m.select("doc_id", "source", "pages", F.col("chunk_count").alias("chunks"), zero("images"), zero("vision_pages")).orderBy("doc_id")


def document_totals(spark: SparkSession, base: str) -> DataFrame:
    return ingest.totals(_corpus(spark, base))


def page_profile(spark: SparkSession, base: str) -> DataFrame:
    return ingest.profile(_pages(spark, base).select("doc_id", F.col("markdown").alias("text"), F.coalesce(F.size("figures"), F.lit(0)).alias("images")))


def _results(spark: SparkSession, base: str, mode: str) -> tuple[DataFrame, DataFrame]:
    kept, golden = _snapshot(spark, base), _golden(spark, base)
    asked = _asked(spark, base, golden)
    if mode == "bm25":
        hits = search.bm25(kept.index, golden, 2 * TOP)
    elif mode == "dense":
        hits = search.dense(kept.vectors, asked, 2 * TOP)
    else:
        hits = evaluate.texts_then_images(_hits(spark, base, asked, TOP, TOP))
    return _with_chunks(hits.select("qid", "id", "rank"), kept.chunks.select("id", "page", "doc_id")), golden


def _with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hits with the fields of their chunks, of which no others are read."""
    hits = cut(hits)
    return maybe_broadcast(hits, 160).join(collection.fetch(chunks, hits, "id"), "id")


def eval_hit_mrr(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.metrics(evaluate.first_match(*_results(spark, base, "bm25")), "bm25")


def eval_strict(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.metrics(evaluate.first_match(*_results(spark, base, "bm25"), strict=True), "bm25-strict")


def eval_compare(spark: SparkSession, base: str) -> DataFrame:
    out = None
    for mode in ("dense", "bm25", "hybrid"):
        one = evaluate.metrics(evaluate.first_match(*_results(spark, base, mode)), mode)
        out = one if out is None else out.unionByName(one)
    return out


def golden_sample(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.stratified_sample(_corpus(spark, base), 40, F.md5(F.concat("id", F.lit("#7")))).select("id", "kind")


def _asked_hits(spark: SparkSession, base: str) -> DataFrame:
    hits = _hits(spark, base, _asked(spark, base, _question(spark)))
    return _with_chunks(hits.drop("kind"), _snapshot(spark, base).chunks).withColumn("question", F.lit(QUESTION))


def build_prompt(spark: SparkSession, base: str) -> DataFrame:
    return answer.prompts(_asked_hits(spark, base), "Answer from the excerpts.").select("prompt")


def diagram_context(spark: SparkSession, base: str) -> DataFrame:
    return answer.diagram_context(_asked_hits(spark, base)).select("context")


def _request_hits(spark: SparkSession, base: str, step: int = 1) -> DataFrame:
    """The hits of each request, as many of each kind as it asks for; a request without hits has a null kind."""
    asked = _requests(spark, base, step).select("qid", "question", "top_text", "top_images")
    every = 2 * DEFAULT.candidates
    hits = _hits(spark, base, _asked(spark, base, asked), every, every).join(asked.select("qid", "top_text", "top_images"), "qid")
    own = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(default))
    most = F.when(F.col("kind") == "text", own("top_text", DEFAULT.top_text)).otherwise(own("top_images", DEFAULT.top_images))
    hits = hits.where(F.col("kind_rank") <= most).drop("kind", "top_text", "top_images")
    hits = _with_chunks(hits, _snapshot(spark, base).chunks)
    return asked.select("qid", "question").join(hits, "qid", "left")


def build_prompt_asked(spark: SparkSession, base: str) -> DataFrame:
    return answer.prompts(_request_hits(spark, base), "Answer from the excerpts.").select("qid", "prompt")


def diagram_context_asked(spark: SparkSession, base: str) -> DataFrame:
    return answer.diagram_context(_request_hits(spark, base)).select("qid", "context")


def shaped_answers(spark: SparkSession, base: str) -> DataFrame:
    """The answers that query_log has to the stated requests, each with the hits of its question."""
    said = _requests(spark, base).select("qid", "answer", "used_image_ids", "used_pages", "model", F.col("attach_images").alias("attached"))
    out = answer.shaped(said, _request_hits(spark, base, STEP))
    shown = F.array_join(F.transform("images", lambda x: F.concat_ws(" ", x["label"], x["id"], x["page"], x["caption"], F.coalesce(x["path"], F.lit("-")), F.format_string("%.5f", x["score"]), F.array_join(x["found_by"], "+"), x["cited_by_model"].cast("string"))), "\n")
    sources = F.array_join(F.transform("text_sources", lambda x: F.concat_ws(" ", x["page"], x["heading"], F.format_string("%.5f", x["score"]), F.array_join(x["found_by"], "+"))), "\n")
    return out.select("qid", "answer", "model", "saw_images", F.array_join("used_pages", ",").alias("used_pages"), shown.alias("images"), sources.alias("text_sources"))


def _stand_in(prompt: str) -> str:
    """What the stand-in for a model says: it depends on the kind and the length of the prompt only."""
    n = len(prompt)
    if prompt.startswith(asking.INTENT):
        return json.dumps({"intent": "draw" if n % 2 else "find"})
    if prompt.startswith(asking.DRAW):
        return json.dumps({"dot": f'```dot\ndigraph G {{ "{n}" }}\n```', "explanation": "as asked"})
    if prompt.startswith(evaluate.WRITE):
        return json.dumps({"question": f" What do {n} characters say? " if n % 7 else " "})
    return json.dumps({"answer": f" {n} characters ", "used_image_ids": ["image-1 "], "used_pages": None})


def _chain() -> Chain:
    return Chain([Scripted("silent", answer=lambda prompt: ""), Scripted("stand-in", answer=_stand_in)])


def _drawn(spark: SparkSession, base: str) -> DataFrame:
    """The stated requests, of which every other one asks for a drawing."""
    wants = F.floor(F.col("qid") / STEP) % 2 == 0
    return _stated(spark, base).withColumn("question", F.when(wants, F.concat(F.lit("Draw a diagram: "), "question")).otherwise(F.col("question")))


def answer_questions(spark: SparkSession, base: str) -> DataFrame:
    """The stated requests answered end to end, drawings included, by a stand-in for the model."""
    requests = _drawn(spark, base)
    hits = _with_chunks(_hits(spark, base, _asked(spark, base, requests)).drop("kind"), _snapshot(spark, base).chunks).withColumn("question", F.lit(None).cast("string"))
    out = asking.answer_questions(requests, hits, _chain())
    pages_ = lambda c: F.array_join(c, ",")
    shown = F.array_join(F.transform("images", lambda x: F.concat_ws(" ", x["label"], x["id"], x["page"], x["cited_by_model"].cast("string"))), ";")
    sources = F.array_join(F.transform("text_sources", lambda x: F.concat_ws(" ", x["page"], F.array_join(x["found_by"], "+"))), ";")
    return out.select("qid", "answer", "model", "intent", "saw_images", pages_(F.col("used_pages")).alias("used_pages"), shown.alias("images"), sources.alias("text_sources"), "diagram.source", pages_(F.col("diagram.pages_used")).alias("pages_drawn"))


def golden_questions(spark: SparkSession, base: str) -> DataFrame:
    sample = evaluate.stratified_sample(_snapshot(spark, base).chunks, 40, F.md5(F.concat("id", F.lit("#7"))))
    return evaluate.golden_questions(sample, _chain())


def page_totals(spark: SparkSession, base: str) -> DataFrame:
    return ingest.page_totals(_pages(spark, base).select("doc_id", F.col("markdown").alias("text")))


def routed_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Pages of even number have a text layer, whose lines with # are set larger; the transcripts of the others are cached."""
    given = _pages(spark, base)
    lines = F.split(F.coalesce("markdown", F.lit("")), "\n", -1)
    size = lambda x: F.when(F.startswith(F.trim(x), F.lit("#")), 14.0).otherwise(10.0)
    span = lambda x, n: F.struct(F.lit(0).alias("block"), n.alias("line"), F.lit(0).alias("span"), size(x).alias("size"), x.alias("text"))
    none = F.array().cast("array<struct<idx:int,width:int,height:int,pixels:binary,png:binary>>")
    read = given.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("source"), "page", F.when(F.col("page") % 2 == 0, F.col("markdown")).alias("text"), F.transform(lines, span).alias("spans"), F.lit(b"").alias("render"), none.alias("images"))
    kept = F.to_json(F.struct("markdown", "page_summary", "figures"))
    cache = given.select("doc_id", F.concat(F.lit("page:"), "page").alias("cache_key"), kept.alias("result"))
    chunks, _ = pages.chunk_documents(read, cache, None)
    return chunks.select("id", "kind", F.md5("text").alias("text_md5"), "heading", "image_path")


def answer_pages(spark: SparkSession, base: str) -> DataFrame:
    log = ingest.latest(table(spark, base, "query_log", "request_id", "used_pages", "used_image_ids", "received_at"), "request_id", "received_at")
    return log.select("request_id", F.array_join(answer.used_pages(F.col("used_pages"), F.lit(None).cast("array<int>")), ",").alias("pages"), F.array_join(answer.cited_labels(F.col("used_image_ids")), ",").alias("cited"))


def draw_intent(spark: SparkSession, base: str) -> DataFrame:
    log = ingest.latest(table(spark, base, "query_log", "request_id", "question", "answer", "received_at"), "request_id", "received_at")
    both = F.concat_ws(" ", "question", "answer")
    return log.select("request_id", T.wants_drawing(both).alias("draws"))


def dot_check(spark: SparkSession, base: str) -> DataFrame:
    log = ingest.latest(table(spark, base, "query_log", "request_id", "answer", "received_at"), "request_id", "received_at")
    made = F.concat(F.lit("```dot\ndigraph {"), F.coalesce("answer", F.lit("")), F.lit("}\n```"))
    return log.select("request_id", T.looks_like_dot(made).alias("fits"), F.md5(T.clean_dot(made)).alias("cleaned_md5"))


def retry_hint(spark: SparkSession, base: str) -> DataFrame:
    log = table(spark, base, "query_log", "request_id").distinct()
    said = F.when(F.col("request_id") % 2 == 0, F.concat(F.lit("429 Please retry in "), F.col("request_id") / 10, F.lit("s."))).otherwise("no quota")
    return log.select("request_id", T.retry_seconds(said, 30).alias("seconds"))


def embedding_texts(spark: SparkSession, base: str) -> DataFrame:
    return _corpus(spark, base).select("id", F.md5(T.embedding_text(F.col("heading"), F.col("text"))).alias("text_md5"))


def image_urls(spark: SparkSession, base: str) -> DataFrame:
    return _corpus(spark, base).where("kind = 'image'").select("id", T.artifact_url(F.col("image_path"), "artifacts").alias("url"))


def upsert_points(spark: SparkSession, base: str) -> DataFrame:
    """The first load of each id, then all second loads on top."""
    rows = table(spark, base, "chunks", "id", "doc_id", "ingested_at")
    times = rows.groupBy("id", "doc_id").agg(F.min("ingested_at").alias("first"), F.max("ingested_at").alias("last"))
    old = index.points(times.select("id", "doc_id", F.col("first").alias("ingested_at")))
    new = index.points(times.where(F.col("last") > F.col("first")).select("id", "doc_id", F.col("last").alias("ingested_at")))
    return index.upsert(old, new).select("point_id", "id", "ingested_at")


def cache_misses(spark: SparkSession, base: str) -> DataFrame:
    """Pages with chunks but without a transcript."""
    wanted = _snapshot(spark, base).chunks.select("doc_id", "page").distinct()
    return missing(wanted, table(spark, base, "page_transcripts", "doc_id", "page").withColumn("result", F.lit("")), ["doc_id", "page"])


def markdown_blocks(spark: SparkSession, base: str) -> DataFrame:
    b = blocks.markdown_blocks(_pages(spark, base), "page_key", "markdown")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return b.select(F.col("key").alias("page_key"), "pos", "kind", "text", "title", F.array_join("items", "\n").alias("items"), F.array_join("headers", "|").alias("headers"), rows.alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_stats, build_index, bm25_vocab, bm25_topk, dense_topk, dense_topk_kind, rrf_fusion, hybrid_search, page_route, heading_sections, chunk_windows, transcript_chunks, figure_texts, dedup_first_seen, slug, point_id,
        kind_counts, doc_catalog, document_totals, page_profile, eval_hit_mrr, eval_strict, eval_compare, golden_sample, build_prompt, diagram_context, shaped_answers, answer_pages, draw_intent, dot_check, retry_hint,
        bm25_topk_asked, dense_topk_asked, dense_topk_kind_asked, rrf_fusion_asked, hybrid_search_asked, build_prompt_asked, diagram_context_asked,
        embedding_texts, image_urls, upsert_points, cache_misses, markdown_blocks, answer_questions, golden_questions, page_totals, routed_chunks,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_CORPUS = "corpus AS (SELECT id, doc_id, page, kind, text, heading, image_path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS n FROM chunks) WHERE n = 1)"
_TOKS = "toks AS (SELECT id, kind, list_filter(regexp_extract_all(lower(coalesce(heading, '') || ' ' || coalesce(text, '')), '[a-z0-9_]+'), lambda t: length(t) > 1) AS t FROM corpus)"
_INDEX = f"""{_CORPUS}, {_TOKS},
postings AS (SELECT id, tok, count(*) AS tf, any_value(len) AS len FROM (SELECT id, unnest(t) AS tok, length(t) AS len FROM toks) GROUP BY id, tok),
totals AS (SELECT count(*) AS n, avg(length(t)) AS avgdl FROM toks),
raws AS (SELECT tok, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT tok, count(*) AS df FROM postings GROUP BY tok), totals),
vocab AS (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
_ONE = f"asked AS (SELECT {QID}::BIGINT AS qid, '{QUESTION}' AS question)"
_STATED = f"asked AS (SELECT request_id AS qid, coalesce(question, '') AS question, top_text, top_images FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC) AS n FROM query_log WHERE request_id % {STEP} = 0) WHERE n = 1)"
_EVERY = _STATED.replace(f" WHERE request_id % {STEP} = 0", "")
_STATED_VECTORS = f"asked AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % {STEP} = 0)"
_ALL = "asked AS (SELECT item_id AS qid, question FROM golden)"


def _bm25(asked: str, limit: int) -> str:
    return f"""{_INDEX}, {asked},
words AS (SELECT qid, tok, count(*) AS times FROM (SELECT qid, unnest(list_filter(regexp_extract_all(lower(question), '[a-z0-9_]+'), lambda t: length(t) > 1)) AS tok FROM asked) GROUP BY 1, 2),
sparse_all AS (SELECT qid, id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS score FROM postings JOIN words USING (tok) JOIN vocab USING (tok), totals GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sparse_all WHERE score > 0) WHERE rank <= {limit})"""


def _dense(limit: int, where: str = "") -> str:
    return f"""vectors AS (SELECT id, kind, embedding::DOUBLE[] AS v FROM (SELECT id, kind, ('0x' || substr(md5(id), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM corpus) JOIN embeddings USING (vec_id)),
asked_v AS (SELECT qid, embedding::DOUBLE[] AS q FROM (SELECT qid, qid % (SELECT count(*) FROM embeddings) AS vec_id FROM asked) JOIN embeddings USING (vec_id)),
dense AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(list_cosine_similarity(v, q), 6) AS score FROM vectors, asked_v {where})) WHERE rank <= {limit})"""


_FUSED = """fused AS (SELECT qid, id, sum(1::DOUBLE / (60 + rank)) AS score, max(d) AS dense_rank, max(s) AS bm25_rank, concat_ws('+', CASE WHEN max(d) IS NOT NULL THEN 'dense' END, CASE WHEN max(s) IS NOT NULL THEN 'bm25' END) AS found_by
    FROM (SELECT qid, id, rank, rank AS d, NULL AS s FROM dense UNION ALL SELECT qid, id, rank, NULL, rank FROM sparse) GROUP BY 1, 2)"""


def _quota(texts: int, images: int) -> str:
    return f"""hits AS (SELECT * FROM (SELECT f.*, c.kind, row_number() OVER (PARTITION BY qid, kind ORDER BY round(score, 9) DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST) AS kind_rank FROM fused f JOIN corpus c USING (id))
    WHERE kind_rank <= CASE kind WHEN 'text' THEN {texts} WHEN 'image' THEN {images} ELSE 0 END)"""


_HYBRID = f"{_bm25(_ONE, 40)}, {_dense(40)}, {_FUSED}, {_quota(8, 3)}"


def _metrics(mode: str, results: str, strict: bool = False) -> str:
    doc = " AND r.doc_id = g.doc_id" if strict else ""
    return f"""SELECT '{mode}' AS mode, count(*) AS n, count(rank) AS hits, round(coalesce(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 0), 6) AS hit_rate, round(coalesce(avg(coalesce(1::DOUBLE / rank, 0)), 0), 6) AS mrr,
    round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END) FILTER (WHERE expect_kind = 'image'), 6) AS image_hit_rate, count(*) FILTER (WHERE expect_kind = 'image') AS image_questions
    FROM (SELECT g.item_id, g.expect_kind, min(r.rank) AS rank FROM golden g LEFT JOIN (SELECT x.qid, x.rank, c.page, c.doc_id FROM ({results}) x JOIN corpus c USING (id)) r ON r.qid = g.item_id AND r.page = g.expect_page{doc} GROUP BY 1, 2)"""


_PAGES = "pages AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY transcribed_at DESC) AS n FROM page_transcripts) WHERE n = 1)"
_LOG = "log AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC) AS n FROM query_log) WHERE n = 1)"
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


_SECTIONS = rf"""{_PAGES}, tidy AS (SELECT page_key, regexp_replace(regexp_replace(coalesce(markdown, ''), '(^|[^\n])(#{{1,6}} [A-Z0-9])', '\1' || chr(10) || chr(10) || '\2', 'g'), '(^|[^\n])(```)', '\1' || chr(10) || '\2', 'g') AS md FROM pages),
lines AS (SELECT page_key, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT page_key, regexp_split_to_array(md, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM tidy)),
marked AS (SELECT *, regexp_matches(line, '^{_BLANKS}*#') AS is_head FROM lines),
counted AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY page_key ORDER BY line_no)::INT AS section FROM marked),
sections AS (SELECT page_key, section, coalesce(max(CASE WHEN is_head THEN {_strip("regexp_replace(line, '^#+', '')")} END), '') AS heading, {_strip("string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT is_head)")} AS body
    FROM counted GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT is_head) > 0),
worded AS (SELECT *, list_filter(regexp_split_to_array(body, '{_BLANKS}+'), lambda w: w <> '') AS words FROM sections)"""


def _windows(size: int, step: int) -> str:
    return f"""windows AS (SELECT page_key, row_number() OVER (PARTITION BY page_key ORDER BY section, k) - 1 AS idx, heading, array_to_string(words[k * {step} + 1 : k * {step} + {size}], ' ') AS text
    FROM (SELECT *, unnest(range(0, greatest(ceil((length(words) - {size}) / {step}::DOUBLE), 0)::BIGINT + 1)) AS k FROM worded WHERE length(words) >= 4))"""


_BLOCKS = rf"""{_PAGES}, texts AS (SELECT page_key, regexp_split_to_array(regexp_replace(coalesce(markdown, ''), '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM pages),
lines AS (SELECT *, {_strip("line")} AS s FROM (SELECT page_key, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM texts)),
fenced AS (SELECT *, sum(starts_with(s, '```')::INT) OVER (PARTITION BY page_key ORDER BY n) % 2 = 1 AS odd FROM lines),
kinds AS (SELECT *, CASE WHEN odd OR starts_with(s, '```') THEN 'fence' WHEN regexp_matches(s, '^<!--\s*meta:[^=]+=.*-->$') THEN 'meta' WHEN starts_with(s, '<!--') THEN CASE WHEN contains(s, 'pagebreak') THEN 'pagebreak' ELSE 'comment' END
    WHEN s LIKE '>%' THEN 'quote' WHEN s LIKE '|%' THEN 'pipe' WHEN regexp_matches(s, '^[*-]\s') THEN 'bullets' WHEN regexp_matches(s, '^[0-9]+[.)]\s') THEN 'numbers' WHEN s LIKE '#%' THEN 'heading' WHEN s IN ('---', '***', '___') THEN 'rule' WHEN s = '' THEN 'blank' ELSE 'p' END AS one FROM fenced),
beside AS (SELECT *, coalesce(one <> lag(one) OVER w, true)::INT AS turns, CASE one WHEN 'quote' THEN regexp_matches(s, '^>\s*\[!\w+\]') WHEN 'pipe' THEN coalesce(regexp_matches(lead(s) OVER w, '^[|][\s:|-]+[|]$'), false) ELSE false END AS mark FROM kinds WINDOW w AS (PARTITION BY page_key ORDER BY n)),
parts AS (SELECT *, sum(turns) OVER (PARTITION BY page_key ORDER BY n) AS run FROM beside),
marked AS (SELECT *, CASE WHEN one IN ('quote', 'pipe') THEN CASE WHEN bool_or(mark) OVER (PARTITION BY page_key, run ORDER BY n) THEN CASE one WHEN 'quote' THEN 'callout' ELSE 'table' END ELSE 'p' END ELSE one END AS kind FROM parts),
main AS (SELECT *, lag(kind) OVER w AS k0, lag(run) OVER w AS r0, lead(n) OVER w AS following FROM marked WHERE kind NOT IN ('meta', 'comment') WINDOW w AS (PARTITION BY page_key ORDER BY n)),
cut AS (SELECT *, sum(CASE WHEN kind = k0 AND (kind = 'p' OR kind = 'fence' AND NOT (odd AND starts_with(s, '```')) OR kind IN ('callout', 'table', 'bullets', 'numbers') AND run = r0) THEN 0 ELSE 1 END) OVER (PARTITION BY page_key ORDER BY n) AS block FROM main),
blocks AS (SELECT page_key, CASE WHEN min_by(kind, n) = 'p' THEN coalesce(max_by(coalesce(following, 1 << 30), n), 0) - 0.5::DOUBLE ELSE min(n)::DOUBLE END AS place, min_by(kind, n) AS kind, list(line ORDER BY n) AS l, list(s ORDER BY n) AS s, regexp_extract(min_by(s, n), '^>\s*\[!(\w+)\]', 1) AS named FROM cut WHERE kind <> 'blank' GROUP BY page_key, block
    UNION ALL SELECT page_key, n::DOUBLE, kind, [line], [s], '' FROM marked WHERE kind = 'meta')"""
_FIGURES = f"""shown AS (SELECT page_key, doc_id, page, coalesce(page_summary, '') AS summary, figures, markdown, coalesce(array_to_string(list_transform(figures, lambda f: {_strip("array_to_string(list_filter([coalesce(f.caption, ''), coalesce(f.description, '')], lambda p: p <> ''), chr(10))")}), chr(10) || chr(10)), '') AS told FROM pages),
page_images AS (SELECT doc_id || ':p' || page || ':i0' AS id, CASE WHEN summary <> '' OR told <> '' THEN array_to_string(list_filter([summary, told], lambda p: p <> ''), chr(10) || chr(10)) ELSE array_to_string(list_filter(regexp_split_to_array(coalesce(markdown, ''), '{_BLANKS}+'), lambda w: w <> '')[1:120], ' ') END AS text,
    CASE WHEN length(figures) > 0 THEN coalesce(figures[1].caption, '') ELSE summary END AS heading FROM shown)"""
_BODY = "left(coalesce(text, ''), 1800)"
_HITS = f"{_HYBRID}, told AS (SELECT h.kind_rank, h.score, h.found_by, c.* FROM hits h JOIN corpus c USING (id))"
_RULE = "'" + "=" * 60 + "'"

# Written out once more, so that the SQL doesn't lean on the engine's own values.
_DRAWING = r"(?i)\b(draw|sketch|diagram|flow chart|flowchart|visualise|visualize|visualisation|visualization|chart|graph|mindmap|mind map|(create|generate|make) an image|illustrate|plot)\b"
_LAST = 'Answer the question. In used_image_ids list only the figure labels you actually relied on (for example ["IMAGE-1"]); use an empty list if the text alone was enough.'


def _found_asked(asked: str) -> str:
    return f"{_bm25(asked, 40)}, {_dense(40)}, {_FUSED}"


def _hits_asked(asked: str) -> str:
    return f"""{_found_asked(asked)}, {_quota(80, 80)},
told AS (SELECT h.qid, h.kind_rank, c.* FROM hits h JOIN corpus c USING (id) JOIN asked a USING (qid) WHERE h.kind_rank <= CASE h.kind WHEN 'text' THEN coalesce(nullif(a.top_text, 0), 8) ELSE coalesce(nullif(a.top_images, 0), 3) END)"""


_DRAWN = _STATED.replace("coalesce(question, '') AS question", f"CASE WHEN request_id // {STEP} % 2 = 0 THEN 'Draw a diagram: ' ELSE '' END || coalesce(question, '') AS question")
_ANSWERED = f"""{_bm25(_DRAWN, 40)}, {_dense(40)}, {_FUSED}, {_quota(8, 3)}, told AS (SELECT h.qid, h.kind_rank, h.found_by, c.* FROM hits h JOIN corpus c USING (id)),
parts AS (SELECT a.qid, any_value(a.question) AS question,
    coalesce(string_agg(chr(10) || '[T' || kind_rank || '] page ' || page || ' - ' || coalesce(nullif(heading, ''), '(no heading)') || chr(10) || {_BODY}, chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'text'), '(none)') AS texts,
    coalesce(string_agg(chr(10) || '[IMAGE-' || kind_rank || '] page ' || page || ' - ' || coalesce(nullif(heading, ''), 'figure') || chr(10) || 'Description: ' || {_BODY}, chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'image'), '(none)') AS images,
    coalesce(string_agg('[page ' || page || '] ' || coalesce(nullif(heading, ''), '(no heading)') || chr(10) || {_BODY}, chr(10) || chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'text' AND kind_rank <= 6), '(no relevant text found)') AS context,
    string_agg('IMAGE-' || kind_rank || ' ' || id || ' ' || page || ' ' || (kind_rank = 1), ';' ORDER BY kind_rank) FILTER (WHERE kind = 'image') AS shown, string_agg(page || ' ' || found_by, ';' ORDER BY kind_rank) FILTER (WHERE kind = 'text') AS sources,
    coalesce(max(page) FILTER (WHERE kind = 'image' AND kind_rank = 1)::VARCHAR, '') AS cited, array_to_string(list_sort(list(DISTINCT page) FILTER (WHERE kind = 'text' AND kind_rank <= 6)), ',') AS pages
    FROM asked a LEFT JOIN told t ON t.qid = a.qid WHERE {_strip("a.question")} <> '' GROUP BY a.qid),
said AS (SELECT *, length(array_to_string(['{asking.RULES.replace("'", "''")}', '', {_RULE}, 'TEXT EXCERPTS', {_RULE}, texts, '', {_RULE}, 'FIGURES', {_RULE}, images, '', {_RULE}, 'QUESTION: ' || question, {_RULE}, '', '{_LAST}'], chr(10))) AS n,
    regexp_matches(question, '{_DRAWING}') AND ({len(asking.INTENT)} + length(question)) % 2 = 1 AS draws, {len(asking.DRAW)} + length(context) + length(chr(10) || chr(10) || 'Request: ' || question) AS m FROM parts)"""
_ROUTED = f"""{_PAGES.replace("pages AS (", "given AS (", 1)}, set_lines AS (SELECT page_key, {_strip("line")} AS line, n, CASE WHEN trim(line, ' ') LIKE '#%' THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM (SELECT page_key, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT page_key, string_split(coalesce(markdown, ''), chr(10)) AS l FROM given))),
body AS (SELECT page_key, median(size) AS mid FROM set_lines GROUP BY page_key),
layered AS (SELECT page_key, string_agg(CASE WHEN size >= mid * 1.15::DOUBLE AND length(line) < 80 THEN '## ' || line ELSE line END, chr(10) ORDER BY n) || chr(10) AS text FROM set_lines JOIN body USING (page_key) WHERE line <> '' GROUP BY page_key),
told AS (SELECT g.*, CASE WHEN page % 2 = 0 AND length({_strip("coalesce(markdown, '')")}) >= 200 THEN 'text' ELSE 'vision' END AS route, l.text AS layer FROM given g LEFT JOIN layered l USING (page_key)),
pages AS (SELECT * EXCLUDE (markdown, layer), CASE route WHEN 'text' THEN layer ELSE markdown END AS markdown FROM told)"""

SQL = {
    "answer_questions": f"""WITH {_ANSWERED} SELECT qid, n || ' characters' AS answer, 'stand-in' AS model, CASE WHEN draws THEN 'draw' ELSE 'find' END AS intent, false AS saw_images, cited AS used_pages, shown AS images, sources AS text_sources,
        CASE WHEN draws THEN 'digraph G {{ "' || m || '" }}' END AS source, CASE WHEN draws THEN pages END AS pages_drawn FROM said""",
    "golden_questions": f"""WITH {_CORPUS}, n AS (SELECT count(*) FILTER (WHERE kind = 'text') AS t, count(*) FILTER (WHERE kind = 'image') AS i FROM corpus),
        picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(id || '#7'), id) AS r FROM corpus), n WHERE r <= CASE kind WHEN 'image' THEN least(i, 10) WHEN 'text' THEN least(t, 40 - least(i, 10)) END),
        said AS (SELECT *, {len(evaluate.WRITE)} + length('Excerpt (page ' || page || ', section "' || coalesce(nullif(heading, ''), '(none)') || '"):' || chr(10) || left(coalesce(text, ''), 2000)) AS m FROM picked)
        SELECT 'What do ' || m || ' characters say?' AS question, page AS expect_page, id AS expect_chunk_id, kind AS expect_kind, doc_id FROM said WHERE m % 7 <> 0""",
    "page_totals": f"""WITH {_PAGES}, routed AS (SELECT doc_id, length({_strip("coalesce(markdown, '')")}) >= 200 AS layer FROM pages) SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE layer) AS text_pages, count(*) FILTER (WHERE NOT layer) AS vision_pages FROM routed GROUP BY doc_id""",
    "routed_chunks": f"""WITH {_SECTIONS.replace(_PAGES, _ROUTED)}, {_windows(700, 620)}, {_FIGURES.replace("heading FROM shown)", "heading, doc_id, page FROM shown WHERE route = 'vision')").replace("markdown, coalesce(array", "markdown, route, coalesce(array")}
        SELECT p.doc_id || ':p' || p.page || ':t' || idx AS id, 'text' AS kind, md5(w.text) AS text_md5, heading, NULL AS image_path FROM windows w JOIN pages p USING (page_key)
        UNION ALL SELECT id, 'image', md5(text), heading, 'artifacts/' || doc_id || '/page_' || CASE WHEN page < 1000 THEN right('00' || page, 3) ELSE page::VARCHAR END || '.png' FROM page_images""",
    "tokenize_stats": f"WITH {_CORPUS}, {_TOKS} SELECT kind, count(*) AS chunks, sum(length(t))::BIGINT AS tokens, round(avg(length(t)), 6) AS avg_tokens FROM toks GROUP BY kind",
    "build_index": f"WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM postings) AS postings, (SELECT sum(tf)::BIGINT FROM postings) AS words, (SELECT count(*) FROM vocab) AS vocabulary FROM totals",
    "bm25_vocab": f"WITH {_INDEX} SELECT tok, df, round(idf, 6) AS idf FROM vocab",
    "bm25_topk": f"WITH {_bm25(_ONE, 40)} SELECT id, score, rank::INT AS rank FROM sparse",
    "dense_topk": f"WITH {_CORPUS}, {_ONE}, {_dense(40)} SELECT id, score, rank::INT AS rank FROM dense",
    "dense_topk_kind": f"""WITH {_CORPUS}, {_ONE}, {_dense(40, "WHERE kind = 'image'")} SELECT id, score, rank::INT AS rank FROM dense""",
    "rrf_fusion": f"WITH {_bm25(_ONE, 40)}, {_dense(40)}, {_FUSED} SELECT id, round(score, 6) AS score, found_by, dense_rank::INT AS dense_rank, bm25_rank::INT AS bm25_rank FROM fused",
    "hybrid_search": f"WITH {_HYBRID} SELECT id, kind, round(score, 6) AS score, found_by, kind_rank::INT AS kind_rank FROM hits",
    "page_route": f"WITH {_PAGES} SELECT page_key, CASE WHEN length({_strip(chr(99) + 'oalesce(markdown, ' + chr(39) * 2 + ')')}) >= 200 THEN 'text' ELSE 'vision' END AS route FROM pages",
    "heading_sections": f"WITH {_SECTIONS} SELECT page_key, section, heading, length(words)::INT AS n_words FROM worded",
    "chunk_windows": f"WITH {_SECTIONS}, {_windows(120, 100)} SELECT page_key, idx::INT AS idx, heading, md5(text) AS text_md5 FROM windows",
    "transcript_chunks": f"WITH {_SECTIONS}, {_windows(700, 620)}, {_FIGURES} SELECT p.doc_id || ':p' || p.page || ':t' || idx AS id, 'text' AS kind, md5(w.text) AS text_md5, heading FROM windows w JOIN pages p USING (page_key) UNION ALL SELECT id, 'image', md5(text), heading FROM page_images",
    "figure_texts": f"WITH {_PAGES}, {_FIGURES} SELECT id, text, heading FROM page_images",
    "dedup_first_seen": f"WITH {_CORPUS} SELECT id, doc_id, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, md5(text) ORDER BY page, id) AS n FROM corpus WHERE kind = 'image') WHERE n = 1",
    "slug": r"SELECT DISTINCT source, regexp_replace(regexp_replace(lower(regexp_replace(source, '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM manifests",
    "point_id": f"""WITH {_CORPUS} SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::INT & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
        FROM (SELECT id, sha1(unhex('6f1c9d0e3f5a4b2e9a770d5b1c2e3f40') || encode(id)) AS h FROM corpus)""",
    "kind_counts": f"WITH {_CORPUS} SELECT kind, count(*) AS n FROM corpus GROUP BY kind",
    "doc_catalog": "SELECT doc_id, source, pages, chunk_count AS chunks, coalesce(images, 0) AS images, coalesce(vision_pages, 0) AS vision_pages FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) AS n FROM manifests) WHERE n = 1",
    "document_totals": f"WITH {_CORPUS} SELECT doc_id, count(DISTINCT page) AS pages, count(*) FILTER (WHERE kind = 'image') AS images, count(*) AS chunk_count FROM corpus GROUP BY doc_id",
    "page_profile": f"""WITH {_PAGES}, per AS (SELECT doc_id, count(*) AS pages, sum(length({_strip("coalesce(markdown, '')")}))::BIGINT AS chars, sum(coalesce(length(figures), 0))::BIGINT AS images FROM pages GROUP BY doc_id)
        SELECT doc_id, pages, chars, images, round(chars / pages, 6) AS avg_chars, round(images * 4.5::DOUBLE / 60, 6) AS vision_minutes, CASE WHEN chars / pages < 300 THEN 'vision' ELSE 'text' END AS verdict FROM per""",
    "eval_hit_mrr": f"WITH {_bm25(_ALL, 10)} {_metrics('bm25', 'SELECT qid, id, rank FROM sparse')}",
    "eval_strict": f"WITH {_bm25(_ALL, 10)} {_metrics('bm25-strict', 'SELECT qid, id, rank FROM sparse', True)}",
    "eval_compare": f"""WITH {_bm25(_ALL, 40)}, {_dense(40)}, {_FUSED}, {_quota(5, 5)}, listed AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY kind DESC, kind_rank) AS rank FROM hits)
        {_metrics('dense', 'SELECT qid, id, rank FROM dense WHERE rank <= 10')} UNION ALL {_metrics('bm25', 'SELECT qid, id, rank FROM sparse WHERE rank <= 10')} UNION ALL {_metrics('hybrid', 'SELECT qid, id, rank FROM listed')}""",
    "golden_sample": f"""WITH {_CORPUS}, n AS (SELECT count(*) FILTER (WHERE kind = 'text') AS t, count(*) FILTER (WHERE kind = 'image') AS i FROM corpus)
        SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(id || '#7'), id) AS r FROM corpus), n WHERE r <= CASE kind WHEN 'image' THEN least(i, 10) WHEN 'text' THEN least(t, 40 - least(i, 10)) END""",
    "build_prompt": f"""WITH {_HITS} SELECT array_to_string(['Answer from the excerpts.', '', {_RULE}, 'TEXT EXCERPTS', {_RULE},
        (SELECT coalesce(string_agg(chr(10) || '[T' || kind_rank || '] page ' || page || ' - ' || coalesce(nullif(heading, ''), '(no heading)') || chr(10) || {_BODY}, chr(10) ORDER BY kind_rank), '(none)') FROM told WHERE kind = 'text'), '', {_RULE}, 'FIGURES', {_RULE},
        (SELECT coalesce(string_agg(chr(10) || '[IMAGE-' || kind_rank || '] page ' || page || ' - ' || coalesce(nullif(heading, ''), 'figure') || chr(10) || 'Description: ' || {_BODY}, chr(10) ORDER BY kind_rank), '(none)') FROM told WHERE kind = 'image'),
        '', {_RULE}, 'QUESTION: {QUESTION}', {_RULE}, '', '{_LAST}'], chr(10)) AS prompt""",
    "diagram_context": f"""WITH {_HITS} SELECT coalesce(string_agg('[page ' || page || '] ' || coalesce(nullif(heading, ''), '(no heading)') || chr(10) || {_BODY}, chr(10) || chr(10) ORDER BY kind_rank), '(no relevant text found)') AS context FROM told WHERE kind = 'text' AND kind_rank <= 6""",
    "bm25_topk_asked": f"WITH {_bm25(_EVERY, 40)} SELECT qid, id, score, rank::INT AS rank FROM sparse",
    "dense_topk_asked": f"WITH {_CORPUS}, {_STATED_VECTORS}, {_dense(40)} SELECT qid, id, score, rank::INT AS rank FROM dense",
    "dense_topk_kind_asked": f"""WITH {_CORPUS}, {_STATED_VECTORS}, {_dense(40, "WHERE kind = 'image'")} SELECT qid, id, score, rank::INT AS rank FROM dense""",
    "rrf_fusion_asked": f"WITH {_found_asked(_EVERY)} SELECT qid, id, round(score, 6) AS score, found_by, dense_rank::INT AS dense_rank, bm25_rank::INT AS bm25_rank FROM fused",
    "hybrid_search_asked": f"WITH {_found_asked(_EVERY)}, {_quota(8, 3)} SELECT qid, id, kind, round(score, 6) AS score, found_by, kind_rank::INT AS kind_rank FROM hits",
    "build_prompt_asked": f"""WITH {_hits_asked(_EVERY)}, parts AS (SELECT a.qid, any_value(a.question) AS question,
        coalesce(string_agg(chr(10) || '[T' || kind_rank || '] page ' || page || ' - ' || coalesce(nullif(heading, ''), '(no heading)') || chr(10) || {_BODY}, chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'text'), '(none)') AS texts,
        coalesce(string_agg(chr(10) || '[IMAGE-' || kind_rank || '] page ' || page || ' - ' || coalesce(nullif(heading, ''), 'figure') || chr(10) || 'Description: ' || {_BODY}, chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'image'), '(none)') AS images
        FROM asked a LEFT JOIN told t ON t.qid = a.qid GROUP BY a.qid)
        SELECT qid, array_to_string(['Answer from the excerpts.', '', {_RULE}, 'TEXT EXCERPTS', {_RULE}, texts, '', {_RULE}, 'FIGURES', {_RULE}, images, '', {_RULE}, 'QUESTION: ' || question, {_RULE}, '', '{_LAST}'], chr(10)) AS prompt FROM parts""",
    "diagram_context_asked": f"""WITH {_hits_asked(_EVERY)} SELECT a.qid, coalesce(string_agg('[page ' || page || '] ' || coalesce(nullif(heading, ''), '(no heading)') || chr(10) || {_BODY}, chr(10) || chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'text' AND kind_rank <= 6), '(no relevant text found)') AS context
        FROM asked a LEFT JOIN told t ON t.qid = a.qid GROUP BY a.qid""",
    "shaped_answers": f"""WITH {_hits_asked(_STATED).replace("h.kind_rank, c.*", "h.kind_rank, h.score, h.found_by, c.*")}, log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC) AS n FROM query_log WHERE request_id % {STEP} = 0) WHERE n = 1),
        seen AS (SELECT t.*, list_contains(list_transform(coalesce(l.used_image_ids, []), lambda x: upper(trim(x))), 'IMAGE-' || kind_rank) AS cited FROM told t JOIN log l ON l.request_id = t.qid),
        per AS (SELECT qid, string_agg(concat_ws(' ', 'IMAGE-' || kind_rank, id, page, coalesce(nullif(heading, ''), 'figure'), coalesce(image_path, '-'), printf('%.5f', round(score, 5)), found_by, cited), chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'image') AS images,
            string_agg(concat_ws(' ', page, coalesce(heading, ''), printf('%.5f', round(score, 5)), found_by), chr(10) ORDER BY kind_rank) FILTER (WHERE kind = 'text') AS text_sources, list(DISTINCT page) FILTER (WHERE kind = 'image' AND cited) AS pages FROM seen GROUP BY qid)
        SELECT request_id AS qid, trim(coalesce(answer, ''), ' ') AS answer, model, attach_images AND starts_with(model, 'gemini') AS saw_images,
            array_to_string(list_sort(list_distinct(CASE WHEN length(coalesce(used_pages, [])) > 0 THEN used_pages ELSE coalesce(pages, []) END)), ',') AS used_pages, images, text_sources FROM log LEFT JOIN per ON qid = request_id""",
    "answer_pages": f"WITH {_LOG} SELECT request_id, array_to_string(list_sort(list_distinct(coalesce(used_pages, []))), ',') AS pages, array_to_string(list_transform(coalesce(used_image_ids, []), lambda x: upper(trim(x))), ',') AS cited FROM log",
    "draw_intent": f"""WITH {_LOG} SELECT request_id, regexp_matches(concat_ws(' ', question, answer), '{_DRAWING}') AS draws FROM log""",
    "dot_check": f"""WITH {_LOG}, made AS (SELECT request_id, '```dot' || chr(10) || 'digraph {{' || coalesce(answer, '') || '}}' || chr(10) || '```' AS s FROM log)
        SELECT request_id, length(s) - length(replace(s, '{{', '')) = length(s) - length(replace(s, '}}', '')) AS fits, md5(substr(s, 8, length(s) - 11)) AS cleaned_md5 FROM made""",
    "retry_hint": "SELECT DISTINCT request_id, CASE WHEN request_id % 2 = 0 THEN least(request_id / 10::DOUBLE + 2, 120) ELSE 30 END AS seconds FROM query_log",
    "embedding_texts": f"""WITH {_CORPUS}, h AS (SELECT id, {_strip("coalesce(heading, '')")} AS head, coalesce(text, '') AS body FROM corpus) SELECT id, md5(CASE WHEN head <> '' THEN {_strip("head || chr(10) || body")} ELSE body END) AS text_md5 FROM h""",
    "image_urls": rf"""WITH {_CORPUS} SELECT id, CASE WHEN p LIKE '%..%' OR p = '' THEN NULL WHEN p LIKE 'artifacts/%' THEN '/artifacts/' || substr(p, 11) WHEN p LIKE '/%' THEN NULL ELSE '/artifacts/' || p END AS url FROM (SELECT id, replace(image_path, '\', '/') AS p FROM corpus WHERE kind = 'image')""",
    "upsert_points": """WITH last AS (SELECT id, max(ingested_at) AS ingested_at FROM chunks GROUP BY id, doc_id)
        SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::INT & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, id, ingested_at
        FROM (SELECT *, sha1(unhex('6f1c9d0e3f5a4b2e9a770d5b1c2e3f40') || encode(id)) AS h FROM last)""",
    "markdown_blocks": f"""WITH {_BLOCKS} SELECT page_key, (row_number() OVER (PARTITION BY page_key ORDER BY place) - 1)::INT AS pos,
        CASE kind WHEN 'fence' THEN CASE WHEN starts_with(lower(info), 'diagram') THEN 'diagram' ELSE 'code' END
            WHEN 'heading' THEN CASE WHEN level = 1 AND count(*) FILTER (WHERE kind <> 'meta') OVER (PARTITION BY page_key ORDER BY place) = 1 THEN 'title' ELSE 'h' || least(level, 3) END ELSE kind END AS kind,
        CASE kind WHEN 'p' THEN array_to_string(s, ' ') WHEN 'fence' THEN array_to_string(list_filter(l, lambda x: NOT starts_with({_strip("x")}, '```')), chr(10)) WHEN 'heading' THEN {_strip("ltrim(s[1], '#')")}
            WHEN 'callout' THEN {_strip("array_to_string(list_transform(s[2:], lambda x: " + _strip("ltrim(x, '>')") + "), ' ')")} WHEN 'meta' THEN regexp_extract(s[1], '^<!--\\s*meta:[^=]+=\\s*(.*?)\\s*-->$', 1) END AS text,
        CASE kind WHEN 'fence' THEN CASE WHEN starts_with(lower(info), 'diagram') THEN coalesce(nullif({_strip("substr(info, 8)")}, ''), 'Diagram') END
            WHEN 'callout' THEN CASE WHEN lower(named) IN ('key', 'warn', 'info', 'tip') THEN lower(named) ELSE 'info' END || ': ' || {_strip("regexp_replace(s[1], '^>[^]]*]', '')")} WHEN 'meta' THEN regexp_extract(s[1], '^<!--\\s*meta:\\s*([^=]+?)\\s*=', 1) END AS title,
        CASE WHEN kind IN ('bullets', 'numbers') THEN array_to_string(list_transform(s, lambda x: regexp_replace(x, '^([*-]|[0-9]+[.)])\\s+', '')), chr(10)) END AS items,
        CASE kind WHEN 'table' THEN array_to_string(head, '|') END AS headers,
        CASE kind WHEN 'table' THEN array_to_string(list_transform(s[3:], lambda x: array_to_string((list_transform(string_split(trim(x, '|'), '|'), lambda c: {_strip("c")}) || list_transform(head, lambda c: ''))[:length(head)], '|')), chr(10)) END AS rows
        FROM (SELECT *, {_strip("substr(s[1], 4)")} AS info, length(regexp_extract(s[1], '^#+')) AS level, list_transform(string_split(trim(s[1], '|'), '|'), lambda c: {_strip("c")}) AS head FROM blocks)""",
    "cache_misses": f"WITH {_CORPUS} SELECT DISTINCT doc_id, page FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM page_transcripts p WHERE p.doc_id = c.doc_id AND p.page = c.page)",
}
