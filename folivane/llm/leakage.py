"""Problem 7: held-out evaluation items in the training corpus.

The corpus is read in shards of a bounded number of words. Words are put into one form (case, punctuation, look-alike
characters aside) and coded by the vocabulary of the held-out items; a word that no item has is a separator, since no
test phrase can go over it. Each shard gets one FM-index; all phrases (whole questions, and windows of consecutive words
of the passages) are backward-searched in it, a block at once, their occurrences located by sampled suffix positions, and
overlapping occurrences of an item in a document merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folivane.llm.canonical import canonical_sql
from folivane.llm.fm_index import FMIndex
from folivane.llm.lookalike import words
from folivane.plans.storage import cut
from folivane.sources.tables import table

WINDOW = 13
#: Words of a shard, and how many test items are searched in one pass over the corpus.
SHARD_WORDS = 600_000
BLOCK_ITEMS = 20_000


def phrases(rows: list[tuple[int, str | None, str | None]], window: int = WINDOW) -> list[tuple[int, list[str]]]:
    """(item, words): the whole question, and each run of ``window`` words of the passage (a shorter passage: none)."""
    out = []
    for item, question, passage in rows:
        if q := words(question or ""):
            out.append((item, q))
        p = words(passage or "")
        out += [(item, p[i : i + window]) for i in range(len(p) - window + 1)]
    return out


def _shards(vocabulary):
    """(ids, begins, places, index) of each shard: its documents, where their words begin in it, which of its words are
    indexed, and the index of these."""

    def shard(ids: list, texts: list[list[str]], code: dict[int, int]) -> pa.RecordBatch:
        size = np.array([len(t) for t in texts], "i8")
        coded = np.zeros(int(size.sum()) + len(texts), "i8")
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        for a, t in zip(begin, texts):
            coded[a : a + len(t)] = [code.get(w, 0) for w in t]
        # Runs of separators say no more than one, so only the first of each is indexed.
        keep = np.flatnonzero((coded != 0) | (np.append(1, coded[:-1]) != 0))
        parts = np.array(ids, "i8").tobytes(), begin.tobytes(), keep.astype("i4").tobytes(), FMIndex(coded[keep], len(code) + 1).dump()
        return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["ids", "begins", "places", "index"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocabulary.value
        ids, texts, n = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(k)
                texts.append(words(t))
                n += len(texts[-1])
                if n >= SHARD_WORDS:
                    yield shard(ids, texts, code)
                    ids, texts, n = [], [], 0
        if ids:
            yield shard(ids, texts, code)

    return run


_SHARD = "ids binary, begins binary, places binary, index binary"


def _search(block):
    """The occurrences of a block's phrases in each shard, as spans of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, patterns, lengths = block.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, begin, keep = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["begins"], "i8"), np.frombuffer(row["places"], "i4")
                index = FMIndex.load(row["index"])
                low, high = index.ranges(patterns, lengths)
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                count = high[hit] - low[hit]
                which = np.repeat(hit, count)
                rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
                at = keep[index.locate(rows)].astype("i8")
                doc = np.searchsorted(begin, at, "right") - 1
                start = at - begin[doc]
                end, item = start + lengths[which], owner[which]
                # Merge what overlaps or touches, for each document and item.
                order = np.lexsort((start, item, doc))
                spans: list[list[int]] = []
                for d, i, s, e in zip(*(x[order].tolist() for x in (doc, item, start, end))):
                    if spans and spans[-1][0] == d and spans[-1][1] == i and s <= spans[-1][3]:
                        spans[-1][3] = max(spans[-1][3], e)
                    else:
                        spans.append([d, i, s, e])
                d, i, s, e = zip(*spans)
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(d)]), pa.array(i, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "item_id", "start_word", "end_word"])

    return run


def leaks(corpus: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start_word, end_word): the spans of ``corpus`` (doc_id BIGINT, text) that hold the question of
    an item of ``items`` (item_id BIGINT, question, passage) or ``window`` words of its passage.

    The items are the stated query set: their phrases go to the tasks in blocks of BLOCK_ITEMS, so any number is searched,
    all in the same index of each shard. Null or empty texts hold nothing; null or empty questions and passages, and
    passages of fewer than ``window`` words, are in no text. A document that is there twice is reported once. Other columns
    are ignored.
    """
    spark = corpus.sparkSession
    schema = "doc_id long, item_id long, start_word int, end_word int"
    given = items.select(F.col("item_id").cast("long"), "question", "passage").distinct()
    code: dict[str, int] = {}
    blocks = 0
    for block in _blocks(given):  # the words of all items are the index's alphabet
        made = phrases(block, window)
        blocks += bool(made)
        for _, p in made:
            for w in p:
                code.setdefault(w, len(code) + 1)
    out = spark.createDataFrame([], schema)
    if not code:
        return out
    shards = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text <> ''").mapInArrow(_shards(spark.sparkContext.broadcast(code)), _SHARD)
    if blocks > 1:  # the indexes are made once
        shards = cut(shards)
    for block in _blocks(given):
        if made := phrases(block, window):
            lengths = np.array([len(p) for _, p in made], "i8")
            patterns = np.zeros((len(made), int(lengths.max())), "i4")
            for row, (_, p) in enumerate(made):
                patterns[row, patterns.shape[1] - len(p) :] = [code[w] for w in p]
            sent = spark.sparkContext.broadcast((np.array([i for i, _ in made], "i8"), patterns, lengths))
            out = out.unionByName(shards.mapInArrow(_search(sent), schema))
    return out.distinct()


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items, BLOCK_ITEMS at a time."""
    block: list = []
    for r in items.toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def spans(spark: SparkSession, base: str) -> DataFrame:
    return leaks(table(spark, base, "documents", "doc_id", "text"), table(spark, base, "golden", "item_id", "question", "passage"))


def found(spark: SparkSession, base: str) -> DataFrame:
    return spans(spark, base).select("doc_id", "item_id").distinct()


def report(spark: SparkSession, base: str) -> DataFrame:
    return summary(spans(spark, base))


def summary(spans: DataFrame) -> DataFrame:
    """(doc_id, items, leaked_words) of each document with a leak: which items leaked, and how many of its words are to be
    removed; a word that several items leaked counts once."""
    before = F.max("end_word").over(Window.partitionBy("doc_id").orderBy("start_word", "end_word", "item_id").rowsBetween(Window.unboundedPreceding, -1))
    adds = F.greatest(F.lit(0), F.col("end_word") - F.greatest("start_word", F.coalesce(before, F.lit(0))))
    return spans.withColumn("adds", adds).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sum("adds").alias("leaked_words"))


_SQL_SPANS = f"""own AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE text <> '' AND doc_id IS NOT NULL GROUP BY doc_id), plain AS ({canonical_sql("text", "own")}),
    said AS (SELECT doc_id, regexp_extract_all(lower(canonical), '[\\pL\\pN]+') AS w FROM plain),
    given AS (SELECT item_id, true AS whole, question AS text FROM golden UNION ALL SELECT item_id, false, passage FROM golden), flat AS ({canonical_sql("text", "given")}),
    asked AS (SELECT item_id, whole, regexp_extract_all(lower(canonical), '[\\pL\\pN]+') AS w FROM flat WHERE canonical IS NOT NULL),
    phrases AS (SELECT DISTINCT item_id, w AS p FROM asked WHERE whole AND length(w) > 0 UNION SELECT DISTINCT item_id, w[i : i + {WINDOW} - 1] FROM (SELECT item_id, w, unnest(range(1, length(w) - {WINDOW} + 2)) AS i FROM asked WHERE NOT whole)),
    sizes AS (SELECT DISTINCT length(p) AS n FROM phrases),
    parts AS (SELECT doc_id, i, n, w[i : i + n - 1] AS p FROM (SELECT doc_id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM said, sizes WHERE n <= length(w))),
    met AS (SELECT doc_id, item_id, i, n FROM parts JOIN phrases USING (p))"""
SQL_FOUND = f"WITH {_SQL_SPANS} SELECT DISTINCT doc_id, item_id FROM met"
SQL_REPORT = f"""WITH {_SQL_SPANS}, covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM met)
    SELECT doc_id, items, leaked_words FROM (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM met GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS leaked_words FROM covered GROUP BY doc_id) USING (doc_id)"""
