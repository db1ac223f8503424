"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folivane.settings import DEFAULT, POINT_NAMESPACE

#: Blanks and line breaks in the sense of Unicode text handling.
BLANK = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# Words that ask for a drawing.
DRAW_WORDS = r"(?i)\b(draw|sketch|diagram|flow ?chart|flowchart|visuali[sz]e|visuali[sz]ation|chart|graph|mind ?map|create an image|generate an image|make an image|illustrate|plot)\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def slug(name: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(c: Column) -> Column:
    """Keywords of a text: runs of ASCII letters, digits and _ of two characters or more, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) > 1)


def split_words(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), BLANK), lambda w: w != "")


def tidy_markdown(c: Column) -> Column:
    """Breaks put back before headings and code fences that follow other text on the line."""
    heads = F.regexp_replace(text_or_empty(c), r"(?<!\n)(#{1,6} [A-Z0-9])", "\n\n$1")
    return F.regexp_replace(heads, r"(?<!\n)(```)", "\n$1")


def keyword_text(heading: Column, text: Column) -> Column:
    return F.concat(text_or_empty(heading), F.lit(" "), text_or_empty(text))


def embedding_text(heading: Column, text: Column) -> Column:
    """Heading and text on lines of their own; the bare text if there is no heading."""
    h = strip(text_or_empty(heading))
    return F.when(h != "", strip(F.concat(h, F.lit("\n"), text_or_empty(text)))).otherwise(text_or_empty(text))


def point_id(chunk_id: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """A version 5 UUID of the id in the namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(chunk_id, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def figure_text(caption: Column, description: Column, inside: Column | None = None) -> Column:
    """What is searched of a figure: the parts that aren't empty, a line each."""
    parts = [text_or_empty(caption), text_or_empty(description)]
    if inside is not None:
        parts.append(F.when(text_or_empty(inside) != "", F.concat(F.lit("Text shown in the figure: "), inside)).otherwise(""))
    return strip(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n"))


def wants_drawing(question: Column) -> Column:
    return text_or_empty(question).rlike(DRAW_WORDS)


def clean_dot(source: Column) -> Column:
    """Graph source without the code fence around it."""
    bare = F.regexp_replace(strip(text_or_empty(source)), r"^```(?:dot|graphviz)?\s*", "")
    return strip(F.regexp_replace(bare, r"\s*```$", ""))


def looks_like_dot(source: Column) -> Column:
    s = text_or_empty(source)
    count = lambda b: F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))
    return F.contains(s, F.lit("digraph")) & (count("{") == count("}")) & (count("{") >= 1)


def retry_seconds(message: Column, fallback: float) -> Column:
    """Two seconds more than the server asks to wait, 120 at most; the fallback if it doesn't say."""
    hint = F.regexp_extract(text_or_empty(message), r"(?i)retry in ([\d.]+)\s*s", 1)
    return F.when(hint != "", F.least(hint.cast("double") + 2, F.lit(120.0))).otherwise(F.lit(float(fallback)))


def artifact_url(path: Column, root: str) -> Column:
    """The address of a file below ``root``; null for others. A path without a slash in front is relative to the root."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    inside = F.when(F.startswith(p, F.lit(base)), F.substring(p, len(base) + 1, 1 << 20)).when(~F.startswith(p, F.lit("/")), p)
    return F.when((p != "") & ~F.contains(p, F.lit("..")), F.concat(F.lit("/artifacts/"), inside))


def route(text: Column, least: int = DEFAULT.text_page_min_chars) -> Column:
    """Whether a page is read by its text layer or by its image."""
    return F.when(F.length(strip(text_or_empty(text))) >= least, "text").otherwise("vision")
