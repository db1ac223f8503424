"""Prompts of retrieved chunks, and answers put into shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folivane.functions.text import text_or_empty
from folivane.settings import DEFAULT, Settings

# The prompt's parts.
RULE = "=" * 60
CLOSING = 'Answer the question. In used_image_ids list only the figure labels you actually relied on (for example ["IMAGE-1"]); use an empty list if the text alone was enough.'


def _or(c: Column, default: str) -> Column:
    return F.when(text_or_empty(c) == "", default).otherwise(c)


def prompts(hits: DataFrame, rules: str, settings: Settings = DEFAULT) -> DataFrame:
    """(qid, prompt) of ``hits`` (qid, question, kind, kind_rank, page, heading, text). A question without any hit has to
    stand there with a null kind."""
    body = F.substring(text_or_empty(F.col("text")), 1, settings.prompt_chars)
    text = F.concat(F.lit("\n[T"), "kind_rank", F.lit("] page "), "page", F.lit(" - "), _or(F.col("heading"), "(no heading)"), F.lit("\n"), body)
    image = F.concat(F.lit("\n[IMAGE-"), "kind_rank", F.lit("] page "), "page", F.lit(" - "), _or(F.col("heading"), "figure"), F.lit("\nDescription: "), body)

    def joined(kind: str, c: Column) -> Column:
        parts = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("kind_rank").alias("n"), c.alias("s")))))
        return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: x["s"]), "\n")).otherwise("(none)")

    told = hits.groupBy("qid").agg(F.first("question").alias("question"), joined("text", text).alias("texts"), joined("image", image).alias("images"))
    lines = [F.lit(rules), F.lit(""), F.lit(RULE), F.lit("TEXT EXCERPTS"), F.lit(RULE), "texts", F.lit(""), F.lit(RULE), F.lit("FIGURES"), F.lit(RULE), "images", F.lit(""), F.lit(RULE), F.concat(F.lit("QUESTION: "), "question"), F.lit(RULE), F.lit(""), F.lit(CLOSING)]
    return told.select("qid", F.concat_ws("\n", *lines).alias("prompt"))


def diagram_context(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(qid, context): the first text hits of each question."""
    one = F.concat(F.lit("[page "), "page", F.lit("] "), _or(F.col("heading"), "(no heading)"), F.lit("\n"), F.substring(text_or_empty(F.col("text")), 1, settings.prompt_chars))
    first = (F.col("kind") == "text") & (F.col("kind_rank") <= settings.diagram_chunks)
    parts = F.sort_array(F.collect_list(F.when(first, F.struct("kind_rank", one.alias("s")))))
    context = F.array_join(F.transform(parts, lambda x: x["s"]), "\n\n")
    return hits.groupBy("qid").agg(F.when(context == "", "(no relevant text found)").otherwise(context).alias("context"))


def labelled(hits: DataFrame) -> DataFrame:
    """Image hits with their labels."""
    return hits.where("kind = 'image'").withColumn("label", F.concat(F.lit("IMAGE-"), "kind_rank"))


def cited_labels(used: Column) -> Column:
    """Labels as the model gave them, in one form; null is none."""
    return F.transform(F.coalesce(used, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x)))


def used_pages(given: Column, cited_pages: Column) -> Column:
    """The model's pages, sorted and once each; if it gave none, those of the figures it cited."""
    return F.sort_array(F.array_distinct(F.when(F.size(F.coalesce(given, F.array().cast("array<int>"))) > 0, given).otherwise(F.coalesce(cited_pages, F.array().cast("array<int>")))))


def shaped(answers: DataFrame, hits: DataFrame, digits: int = 5) -> DataFrame:
    """Responses of ``answers`` (qid, answer, used_image_ids, used_pages, model, attached) and the hits they were given."""
    cited = answers.select("qid", cited_labels(F.col("used_image_ids")).alias("cited"))
    images = labelled(hits).join(cited, "qid", "left").withColumn("cited_by_model", F.coalesce(F.array_contains("cited", F.col("label")), F.lit(False)))
    image = F.struct("kind_rank", "label", "id", "page", _or(F.col("heading"), "figure").alias("caption"), F.col("image_path").alias("path"), F.round("score", digits).alias("score"), "found_by", "cited_by_model")
    shown = images.groupBy("qid").agg(F.sort_array(F.collect_list(image)).alias("images"), F.collect_set(F.when(F.col("cited_by_model"), F.col("page"))).alias("cited_pages"))
    source = F.struct("kind_rank", "page", text_or_empty(F.col("heading")).alias("heading"), F.round("score", digits).alias("score"), "found_by")
    texts = hits.where("kind = 'text'").groupBy("qid").agg(F.sort_array(F.collect_list(source)).alias("text_sources"))
    saw = F.col("attached") & F.startswith(F.col("model"), F.lit("gemini"))
    return answers.join(shown, "qid", "left").join(texts, "qid", "left").select("qid", F.trim(text_or_empty(F.col("answer"))).alias("answer"), "model", saw.alias("saw_images"), used_pages(F.col("used_pages"), F.col("cited_pages")).alias("used_pages"), "images", "text_sources")
