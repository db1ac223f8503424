"""Documents to chunks: pages read by a pluggable reader, routed, and each route's pages turned into chunks and figures.

A reader opens one file and gives its pages: it is where a PDF library is plugged in. What follows is on tables: text pages
give sections and described figures, pages without a text layer are transcribed by a model that sees, and what models said
is kept in a cache by document and key, so nothing is asked twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folivane.functions.text import route, slug, text_or_empty
from folivane.operators import chunking, ingest
from folivane.providers import Chain, answers, figure_prompt
from folivane.settings import DEFAULT, FIGURE_DESCRIPTION, TRANSCRIPT, Settings

TRANSCRIBE = 'Transcribe this page as markdown. Reply as JSON with "markdown", "page_summary" and "figures" (each with "caption", "description", "kind").'
DESCRIBE = 'Describe this figure. The text around it:\n{context}\n\nReply as JSON with "caption", "description", "extracted_text" and "kind".'


@dataclass
class Image:
    width: int
    height: int
    pixels: bytes
    png: bytes


@dataclass
class Page:
    """Spans are (block, line, span, size, text); an image that can't be read is None."""

    text: str = ""
    spans: list[tuple[int, int, int, float, str]] = field(default_factory=list)
    render: bytes = b""
    images: list[Image | None] = field(default_factory=list)


class Reader(Protocol):
    def __call__(self, content: bytes) -> Iterable[Page]: ...


PAGE = "doc_id string, source string, page int, text string, spans array<struct<block:int,line:int,span:int,size:double,text:string>>, render binary, images array<struct<idx:int,width:int,height:int,pixels:binary,png:binary>>"


def read_pages(files: DataFrame, reader: Reader) -> DataFrame:
    """Rows of PAGE, pages counted from 1, of ``files`` (path, content). Images that can't be read are left out."""
    named = files.select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("source"), "content").withColumn("doc_id", slug(F.regexp_replace("source", r"\.[^.]*$", "")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc, source, content in zip(part["doc_id"], part["source"], part["content"]):
                for n, p in enumerate(reader(bytes(content)), 1):
                    spans = [dict(zip(("block", "line", "span", "size", "text"), s)) for s in p.spans]
                    images = [{"idx": k, "width": i.width, "height": i.height, "pixels": i.pixels, "png": i.png} for k, i in enumerate(p.images) if i is not None]
                    yield pd.DataFrame([(doc, source, n, p.text, spans, p.render, images)], columns=["doc_id", "source", "page", "text", "spans", "render", "images"])

    return named.mapInPandas(run, PAGE)


def clashing(files: DataFrame) -> DataFrame:
    """(doc_id, sources) of files whose names give one document id, so that one would replace the other."""
    named = files.select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("source")).withColumn("doc_id", slug(F.regexp_replace("source", r"\.[^.]*$", "")))
    return named.groupBy("doc_id").agg(F.sort_array(F.collect_set("source")).alias("sources")).where(F.size("sources") > 1)


def render_paths(pages: DataFrame, root: str) -> DataFrame:
    """(path, content) of every page's picture, for ingest.write_blobs."""
    return pages.select(F.format_string(f"{root}/%s/page_%03d.png", "doc_id", "page").alias("path"), F.col("render").alias("content"))


def figures(pages: DataFrame, root: str, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, page, idx, png, path, context) of the figures of text pages: large, not flat, each once in a document."""
    each = pages.where(route(F.col("text"), settings.text_page_min_chars) == "text").select("doc_id", "page", "text", F.explode("images").alias("i")).select("doc_id", "page", F.col("text").alias("context"), "i.*")
    large = each.where(F.col("width").cast("long") * F.col("height") >= settings.min_image_pixels)
    kept = ingest.keep_images(large.withColumn("flat_ratio", ingest.flat_colour_ratio("pixels")), settings)
    return kept.select("doc_id", "page", "idx", "png", F.format_string(f"{root}/%s/page_%03d_img_%02d.png", "doc_id", "page", "idx").alias("path"), "context")


def chunk_documents(pages: DataFrame, cache: DataFrame, chain: Chain | None, root: str = "artifacts", settings: Settings = DEFAULT, pause: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The chunks (CHUNK's fields) of ``pages`` (PAGE), and the cache (doc_id, cache_key, result) with what was asked for
    them. Without a ``chain`` only what is cached is there, and figures and pages that aren't have empty texts."""
    told = pages.withColumn("route", route(F.col("text"), settings.text_page_min_chars))
    shown = figures(pages, root, settings)
    images = shown.select("doc_id", F.concat(F.lit("img:"), "page", F.lit(":"), "idx").alias("cache_key"), figure_prompt(DESCRIBE, F.col("context"), settings).alias("prompt"), F.col("png").alias("image"))
    seen = told.where("route = 'vision'")
    scans = seen.select("doc_id", F.concat(F.lit("page:"), "page").alias("cache_key"), F.lit(TRANSCRIBE).alias("prompt"), F.col("render").alias("image"))
    wanted = images.unionByName(scans)
    known = answers(wanted, cache, ["doc_id", "cache_key"], chain, pause) if chain is not None else cache.select("doc_id", "cache_key", "result")
    spans = told.where("route = 'text'").select("doc_id", "page", F.explode("spans").alias("s")).select("doc_id", "page", "s.*")
    texts = chunking.page_chunks(ingest.spans_to_markdown(spans, settings))
    said = known.select("doc_id", "cache_key", "result")
    described = shown.drop("png", "context").withColumn("cache_key", F.concat(F.lit("img:"), "page", F.lit(":"), "idx")).join(said, ["doc_id", "cache_key"], "left").withColumn("d", F.from_json("result", FIGURE_DESCRIPTION))
    described = described.select("doc_id", "page", "idx", "d.caption", "d.description", "d.extracted_text", "path")
    scanned = seen.select("doc_id", "page", F.concat(F.lit("page:"), "page").alias("cache_key")).join(said, ["doc_id", "cache_key"], "left").withColumn("t", F.from_json("result", TRANSCRIPT))
    scanned = scanned.select("doc_id", "page", text_or_empty(F.col("t.markdown")).alias("markdown"), "t.page_summary", "t.figures")
    pictures = ingest.transcribed_pages(scanned).withColumn("image_path", F.format_string(f"{root}/%s/page_%03d.png", "doc_id", "page"))
    out = texts.unionByName(chunking.page_chunks(scanned)).unionByName(ingest.described_image(described)).unionByName(pictures)
    return out, known


def manifests(pages: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Manifest rows of the documents of ``pages`` with their ``chunks``: pages by route, images, chunks."""
    kind = route(F.col("text"), settings.text_page_min_chars)
    docs = pages.groupBy("doc_id").agg(F.first("source").alias("source"), F.count("*").cast("int").alias("pages"), F.count_if(kind == "text").cast("int").alias("text_pages"), F.count_if(kind == "vision").cast("int").alias("vision_pages"))
    images = chunks.where("kind = 'image'").groupBy("doc_id").agg(F.count("*").cast("int").alias("images"))
    return ingest.to_manifests(chunks, docs.join(images, "doc_id", "left").na.fill(0, ["images"]))


def pages_done(files: DataFrame) -> int:
    """How many pages of a job are rendered, by the ``files`` (path) it has written; figures of pages don't count."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    return files.where(F.startswith(name, F.lit("page_")) & F.endswith(name, F.lit(".png")) & ~F.contains(name, F.lit("_img_"))).count()


def from_cache_files(files: DataFrame) -> DataFrame:
    """(doc_id, cache_key, result) of cache files (doc_id, content), each a JSON object of keys; a damaged file is an empty
    one."""
    entries = F.from_json("content", "map<string,string>")
    return files.select("doc_id", F.explode(F.coalesce(entries, F.create_map().cast("map<string,string>"))).alias("cache_key", "result"))
