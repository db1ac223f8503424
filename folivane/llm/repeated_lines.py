"""Problem 2: lines that come back throughout one source, and texts without them.

A line is parsed into a template of tokens: blanks dropped, case folded, each run of digits a wildcard slot. Every task grows
trees of fixed depth, one for each source: below the source a node for the number of tokens, then one for each of the first
DEPTH tokens, and leaves that are templates with the number of records that have them. The trees of all tasks are merged
leaf by leaf, so a line of a third of all records is one leaf of each task and never gathered anywhere. What is removed are
the lines of leaves that cover many records.

By the digits-only rule two lines have one leaf if they differ in slots only. With ``general`` a leaf also stands for its
siblings: leaves of one node that differ in a single token have the template with a slot there in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folivane.plans.filters import key_filter, may_hold
from folivane.plans.sizing import maybe_broadcast
from folivane.plans.storage import cut
from folivane.sources.tables import table

LEAST_LETTERS = 10
LEAST_RECORDS = 8
#: Tokens below the node of the token count that lead to the leaves.
DEPTH = 2
#: The wildcard of a template; no line holds it after parsing.
SLOT = "\0"
#: Tokens that a line must have, at least, to be merged with siblings.
GENERAL_TOKENS = 4
#: Leaves of a task's trees before they are given on to be merged.
LEAVES = 1 << 18

_DIGITS = re.compile(r"\d+")
_NO_LETTER = re.compile(r"[\W\d_]+")
_TOKEN = re.compile(rf"{SLOT}|[^\W\d_]+|[^\w{SLOT}]|_")

Leaf = tuple[int, int, int]


def templates(text: str) -> Iterator[tuple[int, str]]:
    """(line number from 1, template) of each line of ``text`` with at least LEAST_LETTERS letters."""
    for no, line in enumerate(_DIGITS.sub(SLOT, text.lower().replace(SLOT, " ")).split("\n"), 1):
        if len(line) < LEAST_LETTERS:
            continue
        t = "".join(line.split())
        while SLOT * 2 in t:
            t = t.replace(SLOT * 2, SLOT)
        if len(_NO_LETTER.sub("", t[:40])) >= LEAST_LETTERS or len(_NO_LETTER.sub("", t)) >= LEAST_LETTERS:
            yield no, t


def path(template: str) -> tuple[tuple, list[str]]:
    """The nodes that lead to a template, the number of its tokens and the first of them, and the tokens."""
    tokens = _TOKEN.findall(template)
    return (len(tokens), *tokens[:DEPTH]), tokens


class Trees:
    """The trees of the sources that one task has seen."""

    def __init__(self, general: bool):
        self.nodes: dict[tuple, dict[str, int]] = {}
        self.general, self.leaves = general, 0

    def add(self, source: str, own: Iterable[str]) -> None:
        """One record's templates."""
        for t in set(own):
            nodes, tokens = path(t)
            self._leaf((source, *nodes), t)
            if self.general:
                for masked in siblings(tokens):
                    self._leaf((source, len(tokens)), masked)

    def _leaf(self, node: tuple, template: str) -> None:
        leaves = self.nodes.setdefault(node, {})
        n = leaves.get(template, 0)
        self.leaves += n == 0
        leaves[template] = n + 1

    def give(self) -> pa.RecordBatch:
        keys, counts = [], []
        for node, leaves in self.nodes.items():
            keys += [leaf(node, t) for t in leaves]
            counts += leaves.values()
        self.nodes, self.leaves = {}, 0
        return pa.RecordBatch.from_arrays([*_columns(keys), pa.array(counts, pa.int64())], ["node", "high", "low", "n"])


def siblings(tokens: list[str]) -> list[str]:
    """The templates that a line has in common with siblings: a slot in place of one token that isn't one."""
    if len(tokens) < GENERAL_TOKENS:
        return []
    return ["\1".join([*tokens[:k], SLOT, *tokens[k + 1 :]]) for k, t in enumerate(tokens) if t != SLOT]


def leaf(node: tuple, template: str) -> Leaf:
    """The key of a leaf: 64 bits of its node, 128 of the template below the node's source."""
    from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

    h = xxh3_128_intdigest(template, xxh3_64_intdigest(node[0]))
    return xxh3_64_intdigest("\1".join(map(str, node))), h >> 64, h & (1 << 64) - 1


def _columns(keys: list[Leaf]) -> list[pa.Array]:
    import numpy as np

    k = np.array(keys, "u8").reshape(-1, 3).view("i8")
    return [pa.array(k[:, i]) for i in range(3)]


def _grow(general: bool):
    """(node, high, low, n): the leaves of this task's trees."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(general)
        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                trees.add(s, (line for _, line in templates(t)))
                if trees.leaves >= LEAVES:
                    yield trees.give()
        yield trees.give()

    return run


def _parse(general: bool, sent):
    """(key, line_no, node, high, low): each line with its leaves; only those that the filter lets pass, if one is given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nos, leaves = [], [], []
            for s, k, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for no, line in templates(t):
                    nodes, tokens = path(line)
                    own = [leaf((s, *nodes), line)] + ([leaf((s, len(tokens)), m) for m in siblings(tokens)] if general else [])
                    leaves += own
                    keys += [k] * len(own)
                    nos += [no] * len(own)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(nos, pa.int32()), *_columns(leaves)], ["key", "line_no", "node", "high", "low"])
            yield out if sent is None else out.filter(pa.array(may_hold(sent.value, out.column(4).to_numpy().view("u8"))))

    return run


_LINES = "key string, line_no int, node long, high long, low long"
_LEAF = ["node", "high", "low"]


def repeated(records: DataFrame, source: str, key: str, text: str, least: int = LEAST_RECORDS, general: bool = False) -> DataFrame:
    """(key, line_no): each line whose template stands in at least ``least`` different records of its source.

    A record that occurs twice under one key counts once, with the lines of all its rows. Null texts, keys and sources have
    no lines; '' has one blank line, which has no letters. Lines are counted over all records, whole. With ``general``, lines
    of at least GENERAL_TOKENS tokens that differ in one token are the same too. Other columns are ignored, whatever their
    names.
    """
    spark = records.sparkSession
    given = records.select(F.col(source).cast("string").alias("s"), F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("s IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL")
    # Trees count rows, so keys that come again are counted apart, by distinct keys.
    again = maybe_broadcast(cut(given.groupBy("s", "k").count().where("count > 1").select("s", "k")), 120)
    grown = given.join(again, ["s", "k"], "left_anti").select("s", "k", "t").mapInArrow(_grow(general), "node long, high long, low long, n long")
    others = given.join(again, ["s", "k"], "left_semi").select("s", "k", "t").mapInArrow(_parse(general, None), _LINES).select(*_LEAF, F.xxhash64("key").alias("record")).distinct()
    merged = grown.unionByName(others.select(*_LEAF, F.lit(1).cast("long").alias("n"))).groupBy(*_LEAF).agg(F.sum("n").alias("n"))
    covering = cut(merged.where(F.col("n") >= least).select(*_LEAF))
    sent = spark.sparkContext.broadcast(key_filter(covering, F.col("low")))
    lines = given.mapInArrow(_parse(general, sent), _LINES)
    return lines.join(maybe_broadcast(covering, 40), _LEAF, "left_semi").select("key", "line_no").distinct()


def found(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks", "id", "doc_id", "kind", "text").where("kind = 'text'")
    return repeated(chunks, "doc_id", "id", "text").select(F.col("key").alias("chunk_id"), F.col("line_no").cast("int"))


def clean(spark: SparkSession, base: str) -> DataFrame:
    """Each text chunk once, without its repeated lines, and how many were removed."""
    chunks = table(spark, base, "chunks", "id", "doc_id", "kind", "text").where("kind = 'text'")
    return without_lines(chunks, "doc_id", "id", "text").select(F.col("key").alias("chunk_id"), "text", "removed")


def without_lines(records: DataFrame, source: str, key: str, text: str, least: int = LEAST_RECORDS, general: bool = False) -> DataFrame:
    """(key, text, removed): every record once, its repeated lines taken out, the others as they were."""
    gone = repeated(records, source, key, text, least, general).groupBy("key").agg(F.collect_set("line_no").alias("gone"))
    once = records.groupBy(F.col(key).alias("key")).agg(F.first(F.col(text), ignorenulls=True).alias("text"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", (i + 1).cast("int"))), "\n")
    return once.join(gone, "key", "left").select("key", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


_SQL_REPEATED = """lines AS (
    SELECT DISTINCT doc_id, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM chunks WHERE kind = 'text' AND text IS NOT NULL AND doc_id IS NOT NULL
), told AS (
    SELECT doc_id, id, line_no, regexp_replace(lower(regexp_replace(line, '[\\s\\pZ\\x1c-\\x1f\\x{85}\\x0b]+', '', 'g')), '\\p{Nd}+', '#', 'g') AS t FROM lines
), counted AS (
    SELECT doc_id, t FROM told WHERE length(regexp_replace(t, '\\PL+', '', 'g')) >= 10 GROUP BY 1, 2 HAVING count(DISTINCT id) >= 8
), gone AS (SELECT DISTINCT id, line_no::INT AS line_no FROM told SEMI JOIN counted USING (doc_id, t))"""
SQL_FOUND = f"WITH {_SQL_REPEATED} SELECT id AS chunk_id, line_no FROM gone"
SQL_CLEAN = f"""WITH {_SQL_REPEATED}, own AS (SELECT id, max(text) AS text FROM chunks WHERE kind = 'text' GROUP BY id), per AS (SELECT id, list(line_no) AS l FROM gone GROUP BY id)
    SELECT id AS chunk_id, CASE WHEN l IS NULL THEN text ELSE array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(l, i::INT)], chr(10)) END AS text, coalesce(length(l), 0)::INT AS removed FROM own LEFT JOIN per USING (id)"""
