"""Retrieval scored against held-out questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folivane.functions.text import strip, text_or_empty
from folivane.operators.asking import ask
from folivane.providers import Chain
from folivane.settings import DEFAULT, GOLDEN, Settings


def first_match(results: DataFrame, golden: DataFrame, strict: bool = False) -> DataFrame:
    """Each golden question (qid, expect_page, expect_kind[, doc_id]) with the rank of the first result (qid, rank, page[,
    doc_id]) on its page, null if there is none. ``strict`` asks for the document too."""
    on = (F.col("r.qid") == F.col("g.qid")) & (F.col("r.page") == F.col("g.expect_page"))
    if strict:
        on = on & (F.col("r.doc_id") == F.col("g.doc_id"))
    joined = golden.alias("g").join(results.alias("r"), on, "left")
    return joined.groupBy("g.qid", "g.expect_kind").agg(F.min("r.rank").alias("rank"))


def metrics(matched: DataFrame, mode: str) -> DataFrame:
    """(mode, n, hits, hit_rate, mrr, image_hit_rate, image_questions); rates of no questions are 0, of no image
    questions null."""
    hit = F.col("rank").isNotNull()
    image = F.col("expect_kind") == "image"
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return matched.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), mean(hit.cast("double")).alias("hit_rate"), mean(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.round(F.avg(F.when(image, hit.cast("double"))), 6).alias("image_hit_rate"), F.count_if(image).alias("image_questions"),
    ).select(F.lit(mode).alias("mode"), "*")


def texts_then_images(hits: DataFrame, qid: str = "qid") -> DataFrame:
    """One ranked list of quota results: all texts before all images."""
    order = Window.partitionBy(qid).orderBy(F.desc("kind"), "kind_rank")
    return hits.withColumn("rank", F.row_number().over(order))


def sample_shares(n_text: int, n_image: int, wanted: int) -> dict[str, int]:
    images = min(n_image, max(6, wanted // 4))
    return {"text": min(n_text, wanted - images), "image": images}


def stratified_sample(chunks: DataFrame, wanted: int, order: Column) -> DataFrame:
    """A fixed share of texts and of images, chosen by ``order``."""
    n = {r[0]: r[1] for r in chunks.groupBy("kind").count().collect()}  # one row for each kind
    shares = sample_shares(n.get("text", 0), n.get("image", 0), wanted)
    picked = None
    for kind, share in shares.items():
        part = chunks.where(F.col("kind") == kind).orderBy(order, "id").limit(share)
        picked = part if picked is None else picked.unionByName(part)
    return picked


WRITE = 'Write one question in your own words that this excerpt answers. Reply as JSON: {"question": "..."}.\n\n'


def question_prompts(sample: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(qid, prompt) of sampled chunks (qid, page, heading, text)."""
    heading = F.when(text_or_empty(F.col("heading")) == "", "(none)").otherwise(F.col("heading"))
    body = F.substring(text_or_empty(F.col("text")), 1, settings.question_chars)
    return sample.select("qid", F.concat(F.lit(f'{WRITE}Excerpt (page '), "page", F.lit(', section "'), heading, F.lit('"):\n'), body).alias("prompt"))


def golden_questions(sample: DataFrame, chain: Chain, settings: Settings = DEFAULT) -> DataFrame:
    """(question, expect_page, expect_chunk_id, expect_kind, doc_id): a question that a model writes about each of ``sample``
    (chunks). Chunks for which it fails, or gives a blank one, have none."""
    told = sample.withColumn("qid", F.xxhash64("id"))
    said = ask(question_prompts(told, settings), chain).select("qid", strip(text_or_empty(F.get_json_object("said", "$.question"))).alias("question")).where("question <> ''")
    return told.join(said, "qid").select("question", F.col("page").alias("expect_page"), F.col("id").alias("expect_chunk_id"), F.col("kind").alias("expect_kind"), "doc_id")


def write_golden(golden: DataFrame, path: str) -> None:
    golden.write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The held-out questions of JSON lines; blank lines are none."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", GOLDEN).alias("g")).select("g.*")
