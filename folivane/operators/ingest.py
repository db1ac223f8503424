"""Page material to chunks: spans to markdown, image filters, figure texts, document summaries, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType

from folivane.functions.text import figure_text, route, split_words, strip, text_or_empty
from folivane.plans.sizing import maybe_broadcast
from folivane.plans.storage import cut, exists
from folivane.settings import DEFAULT, MANIFEST, Settings


def pdf_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, content) of the PDF files that are named or in the folders named; paths that aren't there are skipped.
    Whether a file is one is told by its name."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(there).select("path", "length", "content")


def markdown_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of markdown files, each whole."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def spans_to_markdown(spans: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, page, markdown) of ``spans`` (doc_id, page, block, line, span, size, text): a line set clearly larger than
    the page's median becomes a heading; each block ends with an empty line."""
    page = ["doc_id", "page"]
    median = spans.groupBy(*page).agg(F.median("size").alias("body"))
    text = F.expr("array_join(transform(sort_array(collect_list(struct(span, text))), x -> x.text), '')")
    lines = spans.groupBy(*page, "block", "line").agg(strip(text).alias("text"), F.max("size").alias("size")).where("text <> ''").join(median, page)
    heading = (F.col("size") >= F.col("body") * settings.heading_size_ratio) & (F.length("text") < settings.heading_max_chars)
    marked = lines.select(*page, "block", "line", F.when(heading, F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    ends = spans.select(*page, "block").distinct().select(*page, "block", F.lit(1 << 30).alias("line"), F.lit("").alias("text"))
    both = marked.unionByName(ends).groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("l"))
    return both.select(*page, F.array_join(F.col("l.text"), "\n").alias("markdown"))


@F.pandas_udf(DoubleType())
def flat_colour_ratio(pixels: pd.Series) -> pd.Series:
    """The share of an image's most frequent colour; pixels as bytes of three channels each."""
    import numpy as np

    def one(p: bytes) -> float | None:
        if not p or len(p) < 3:
            return None
        c = np.frombuffer(p, "u1")[: len(p) // 3 * 3].reshape(-1, 3).astype("u4")
        return float(np.unique(c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2], return_counts=True)[1].max()) / len(c)

    return pixels.map(one).astype("float64")


def keep_images(images: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``images`` (doc_id, page, idx, width, height, flat_ratio, png) without small, flat and, within a document, repeated
    ones; cheap tests come first."""
    large = images.where(F.col("width").cast("long") * F.col("height") >= settings.min_image_pixels)
    return first_seen(large.where(F.col("flat_ratio") <= settings.max_flat_colour_ratio), "doc_id", F.md5("png"), ["page", "idx"])


def first_seen(rows: DataFrame, group: str, content, order: list[str]) -> DataFrame:
    """Of rows of equal content within a group, the first."""
    w = Window.partitionBy(group, "_content").orderBy(*order)
    return rows.withColumn("_content", content).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_content", "_n")


def described_image(images: DataFrame) -> DataFrame:
    """Image chunks of described figures (doc_id, page, idx, caption, description, extracted_text, path)."""
    return images.select(
        F.concat("doc_id", F.lit(":p"), "page", F.lit(":i"), "idx").alias("id"), "doc_id", "page", F.lit("image").alias("kind"),
        figure_text(F.col("caption"), F.col("description"), F.col("extracted_text")).alias("text"), text_or_empty(F.col("caption")).alias("heading"), F.col("path").alias("image_path"),
    )


def page_image_text(summary, figures, markdown, settings: Settings = DEFAULT):
    """What is searched of a page image: its summary and figures, else the page's first words."""
    shown = F.array_join(F.transform(figures, lambda f: figure_text(f["caption"], f["description"])), "\n\n")
    both = F.array_join(F.filter(F.array(text_or_empty(summary), F.coalesce(shown, F.lit(""))), lambda p: p != ""), "\n\n")
    return F.when(both != "", both).otherwise(F.array_join(F.slice(split_words(markdown), 1, settings.vision_text_words), " "))


def page_image_heading(summary, figures):
    """The first figure's caption if there are figures, even if it is empty; else the summary."""
    return F.when(F.size(F.coalesce(figures, F.array())) > 0, text_or_empty(F.get(figures, F.lit(0))["caption"])).otherwise(text_or_empty(summary))


def transcribed_pages(pages: DataFrame) -> DataFrame:
    """The image chunk of each transcribed page (doc_id, page, markdown, page_summary, figures)."""
    return pages.select(
        F.concat("doc_id", F.lit(":p"), "page", F.lit(":i0")).alias("id"), "doc_id", "page", F.lit("image").alias("kind"),
        page_image_text(F.col("page_summary"), F.col("figures"), F.col("markdown")).alias("text"), page_image_heading(F.col("page_summary"), F.col("figures")).alias("heading"), F.lit(None).cast("string").alias("image_path"),
    )


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the last by ``order``."""
    return _one(rows, key, order, F.max_by)


def earliest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by ``order``."""
    return _one(rows, key, order, F.min_by)


def _one(rows: DataFrame, key: str, order: str, pick) -> DataFrame:
    """Keys alone tell which occur again; only the rows of those are moved."""
    others = [c for c in rows.columns if c != key]
    again = maybe_broadcast(cut(rows.groupBy(key).count().where("count > 1").select(key)), 80)
    several = rows.join(again, key, "left_semi").groupBy(key).agg(pick(F.struct(*others), order).alias("r")).select(key, "r.*")
    return rows.join(again, key, "left_anti").select(key, *others).unionByName(several)


def page_totals(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, pages, text_pages, vision_pages) of ``pages`` (doc_id, text), by their routes."""
    kind = route(F.col("text"), settings.text_page_min_chars)
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(kind == "text").alias("text_pages"), F.count_if(kind == "vision").alias("vision_pages"))


def totals(chunks: DataFrame) -> DataFrame:
    """(doc_id, pages, images, chunk_count) of the chunks at hand."""
    return chunks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.count_if(F.col("kind") == "image").alias("images"), F.count("*").alias("chunk_count"))


def profile(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, images, avg_chars, vision_minutes, verdict) of ``pages`` (doc_id, text, images)."""
    per = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length(strip(text_or_empty(F.col("text"))))).alias("chars"), F.sum("images").alias("images"))
    avg = F.col("chars") / F.greatest(F.col("pages"), F.lit(1))
    return per.withColumn("avg_chars", F.round(avg, 6)).withColumn("vision_minutes", F.round(F.col("images") * 4.5 / 60, 6)).withColumn("verdict", F.when(avg < 300, "vision").otherwise("text"))


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """The manifests below ``pattern`` with the path of each; damaged files are empty rows."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name()).orderBy("path")


def manifest_chunks(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.explode("chunks").alias("c")).select("c.*")


def to_manifests(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Manifest rows of ``documents`` (doc_id, source, pages, text_pages, vision_pages, images) with their chunks."""
    one = F.struct("id", "doc_id", "page", "kind", "text", "heading", "image_path")
    own = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["page"] != b["page"], a["page"] - b["page"]).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("chunks"))
    return documents.join(own, "doc_id", "left").select("doc_id", "source", "pages", "text_pages", "vision_pages", "images", F.coalesce(F.size("chunks"), F.lit(0)).alias("chunk_count"), F.coalesce("chunks", F.array()).alias("chunks"))


def write_blobs(rows: DataFrame) -> DataFrame:
    """(path, bytes): writes ``rows`` (path, content) to the paths, run by an action. Paths may name any file system that
    pyarrow knows, as hdfs:// or s3://; those without a scheme are in a folder that all executors share."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from os.path import abspath

        from pyarrow.fs import FileSystem

        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                files, at = FileSystem.from_uri(path if "://" in path else "file://" + abspath(path))
                files.create_dir(at.rpartition("/")[0], recursive=True)
                with files.open_output_stream(at) as out:
                    out.write(content)
            yield pd.DataFrame({"path": part["path"], "bytes": part["content"].map(len)})

    return rows.select("path", "content").mapInPandas(run, "path string, bytes long")
