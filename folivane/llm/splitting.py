"""Problem 5: items above a size limit cut at natural boundaries, with an overlap.

Recursive bisection on the whole item: the strongest boundary near the midpoint is the cut, and halves that still exceed
the limit less the overlap are cut again; each piece but the first then gets the end of the one before it as overlap,
begun at a boundary where there is one. Only rows above the limit leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folivane.sources.tables import table

LIMIT = 4000
OVERLAP = 300
#: The share of a part around its midpoint that is searched for a boundary before weaker ones are taken.
NEAR = 0.25

# Boundaries by strength, as patterns whose end is the cut: heading ahead, blank line, line, sentence, clause, blank.
BOUNDARIES = [re.compile(p, re.M) for p in (r"\n(?=#{1,6}[ \t])", r"\n[ \t]*\n+", r"\n", r"[.!?…][\"'”»)\]]*[ \t]+", r"[,;:)][ \t]+", r"[ \t ]+")]
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M)
_FENCE = re.compile(r"^[ \t]*```", re.M)

PIECE = "piece_no int, start int, length int, own_start int, heading string, piece string"


def _joins_mark(text: str, at: int) -> bool:
    """Whether a cut at ``at`` parts a letter from a mark that belongs to it, or the two halves of a line break."""
    import unicodedata

    return 0 < at < len(text) and (unicodedata.combining(text[at]) > 0 or text[at] in "‍️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n")


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Where ``text`` is cut, in order. Every part between two cuts has at most ``limit - overlap`` characters."""
    size = limit - overlap
    ends = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    fences = [m.start() for m in _FENCE.finditer(text)]
    inside = lambda at: bisect_left(fences, at) % 2 == 1
    out: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            continue
        mid, best = (a + b) // 2, None
        # Few pieces: a part of under two sizes must be cut where both halves fit.
        low, high = (max(a + 1, b - size), min(b - 1, a + size)) if b - a <= 2 * size else (a + 1, b - 1)
        reach = max(int((b - a) * NEAR), 1)
        lo, hi = max(low, mid - reach), min(high, mid + reach)
        for at in ends:
            i, j = bisect_left(at, lo), bisect_right(at, hi)
            near = [p for p in at[i:j] if not inside(p)] or at[i:j]
            if near:
                best = min(near, key=lambda p: abs(p - mid))
                break
        if best is None:
            best = mid
            while _joins_mark(text, best) and best > lo:
                best -= 1
        out.append(best)
        todo += [(a, best), (best, b)]
    return sorted(out)


def pieces(text: str, heading: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str, str]]:
    """(piece_no, start, length, own_start, heading, piece) in order; own_start is where the piece's own text begins
    after the overlap. The own parts joined give the text again. heading is the last heading line at or before the
    piece's own text, else the item's own heading."""
    at = [0, *cuts(text, limit, overlap), len(text)]
    heads = [(m.start(), m.group(1)) for m in _HEADING.finditer(text)]
    starts = [h[0] for h in heads]
    out = []
    for k, (a, b) in enumerate(zip(at, at[1:])):
        begin = a
        if k:
            earliest, aim = max(at[k - 1], b - limit), a - overlap
            begin = max(earliest, aim)
            # Begin the overlap at the sentence, else the word, that starts nearest to its aim.
            for pattern in (BOUNDARIES[3], BOUNDARIES[5]):
                starts_at = [m.end() for m in pattern.finditer(text, max(aim - overlap // 5, 0), min(aim + overlap // 5, a))]
                starts_at = [p for p in starts_at if earliest <= p < a]
                if starts_at:
                    begin = min(starts_at, key=lambda p: abs(p - aim))
                    break
            while _joins_mark(text, begin) and begin < a:
                begin += 1
        i = bisect_right(starts, a) - 1
        out.append((k + 1, begin, b - begin, a, heads[i][1] if i >= 0 else heading or "", text[begin:b]))
    return out


def _cutter(limit: int, overlap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cols: dict[str, list] = {n: [] for n in ("item_table", "item_key", "piece_no", "start", "length", "own_start", "heading", "piece")}
            for r in rows:
                for p in pieces(r["value"], r["heading"], limit, overlap):
                    for n, v in zip(cols, (r["item_table"], r["item_key"], *p)):
                        cols[n].append(v)
            yield pa.RecordBatch.from_pydict(cols, pa.schema([(n, pa.string() if n in ("item_table", "item_key", "heading", "piece") else pa.int32()) for n in cols]))

    return run


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``items`` has item_table, item_key, value, heading; the result the pieces of those above ``limit``.

    Null and shorter values give no row, a value of exactly the limit neither. A key that occurs twice is cut once, so
    equal rows give one set of pieces. A value without any boundary is cut at its midpoints. Other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be smaller than half the limit")
    long = items.where(F.length("value") > limit).select("item_table", "item_key", "value", "heading")
    long = long.groupBy("item_table", "item_key").agg(F.min(F.struct("value", "heading")).alias("v")).select("item_table", "item_key", "v.value", "v.heading")
    return long.mapInArrow(_cutter(limit, overlap), "item_table string, item_key string, " + PIECE)


def items(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks", "id", "text", "heading").select(F.lit("chunks").alias("item_table"), F.col("id").alias("item_key"), F.col("text").alias("value"), "heading")
    pages = table(spark, base, "page_transcripts", "page_key", "markdown").select(F.lit("page_transcripts").alias("item_table"), F.col("page_key").alias("item_key"), F.col("markdown").alias("value"), F.lit(None).cast("string").alias("heading"))
    return chunks.unionByName(pages)


def found(spark: SparkSession, base: str) -> DataFrame:
    return split(items(spark, base)).where("piece_no = 1").select("item_table", "item_key")


def all_pieces(spark: SparkSession, base: str) -> DataFrame:
    return split(items(spark, base))


SQL_FOUND = """
SELECT DISTINCT 'chunks' AS item_table, id AS item_key FROM chunks WHERE length(text) > 4000
UNION ALL SELECT DISTINCT 'page_transcripts', page_key FROM page_transcripts WHERE length(markdown) > 4000
"""
