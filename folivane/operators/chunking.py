"""Pages to chunks: sections under headings, then overlapping windows of words. All of a page is worked on in its own row,
by expressions on arrays, so pages are never moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folivane.functions.text import LINE_BREAK, split_words, strip, tidy_markdown
from folivane.settings import DEFAULT, Settings, or_default

#: The blanks that a line can begin with; line breaks are \\n alone once a page is tidied.
_INDENT = r"[\s\x1c-\x1f&&[^\n]]*"


def section_array(markdown: Column) -> Column:
    """The sections with text lines: an array of (section, heading, body). A line whose first character that isn't blank is
    # begins a section; hashes are only taken off at the line's very start. Sections count their headings from the page's
    begin."""
    lines = F.regexp_replace(tidy_markdown(markdown), LINE_BREAK, "\n")
    parts = F.split(lines, rf"(?U)(?:^|(?<=\n))(?={_INDENT}#)", -1)
    headed = lambda p: p.rlike(rf"(?U)^{_INDENT}#")

    def told(p: Column, n: Column, all_: Column) -> Column:
        # The break in front of the next heading is no line of its own.
        own = F.when(n + 1 < F.size(all_), F.regexp_replace(p, r"\n\z", "")).otherwise(p)
        first = F.regexp_extract(own, r"^[^\n]*", 0)
        has_lines = ~headed(own) | F.contains(own, F.lit("\n"))
        body = F.when(headed(own), F.substr(own, F.length(first) + 2)).otherwise(own)
        heading = F.when(headed(own), strip(F.regexp_replace(first, "^#+", ""))).otherwise("")
        number = n + F.when(headed(F.get(all_, F.lit(0))), 1).otherwise(0)
        return F.struct(number.cast("int").alias("section"), heading.alias("heading"), strip(body).alias("body"), has_lines.alias("has_lines"))

    # An array of one, so that the parts are found once.
    return F.filter(F.flatten(F.transform(F.array(parts), lambda a: F.transform(a, lambda p, n: told(p, n, a)))), lambda s: s["has_lines"])


def sections(pages: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, section, heading, body) of each section with text lines, see ``section_array``."""
    found = pages.select(F.col(key).alias("key"), F.explode(section_array(F.col(markdown))).alias("s"))
    return found.select("key", "s.section", "s.heading", "s.body")


def windows(found: Column, size: int | None = None, overlap: int | None = None, settings: Settings = DEFAULT) -> Column:
    """The windows (heading, text) of an array of sections, in order. 0 stands for the default."""
    size, overlap = or_default(size, settings.chunk_words), or_default(overlap, settings.chunk_overlap_words)
    step = max(size - overlap, 1)

    def of(heading: Column, words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - size) / F.lit(float(step))), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(heading.alias("heading"), F.array_join(F.slice(words, k * step + 1, F.lit(size)), " ").alias("text")))

    worded = F.filter(F.transform(found, lambda s: F.struct(s["heading"].alias("heading"), split_words(s["body"]).alias("words"))), lambda s: F.size(s["words"]) >= settings.min_section_words)
    return F.flatten(F.transform(worded, lambda s: of(s["heading"], s["words"])))


def chunk_pages(pages: DataFrame, key: str, markdown: str, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """(key, idx, heading, text) of each page's windows; idx counts a page's chunks from 0."""
    found = pages.select(F.col(key).alias("key"), F.posexplode(windows(section_array(F.col(markdown)), size, overlap)).alias("idx", "w"))
    return found.select("key", "idx", "w.heading", "w.text")


def page_chunks(pages: DataFrame) -> DataFrame:
    """Chunk rows (id, doc_id, page, kind, text, heading, image_path) of ``pages`` (doc_id, page, markdown)."""
    keyed = pages.withColumn("key", F.struct("doc_id", "page"))
    made = chunk_pages(keyed, "key", "markdown")
    return made.select(F.concat("key.doc_id", F.lit(":p"), "key.page", F.lit(":t"), "idx").alias("id"), "key.doc_id", "key.page", F.lit("text").alias("kind"), "text", "heading", F.lit(None).cast("string").alias("image_path"))
