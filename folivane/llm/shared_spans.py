"""Problem 9: stretches that stand character for character in more than one document.

Sliding sentence spans: from every sentence start the run of the several sentences that follow, at least RUN characters, is
hashed, and the hashes are joined over all documents. A sentence of more than LONGEST characters counts as several, so a run
from a start depends on the text after it only; within long sentences further starts stand at content-defined places. Any
common stretch of ``least`` characters therefore holds a start within its first FIRST characters whose whole run lies in it:
no stretch is missed. Texts with one run in common are compared to both sides of it, and those that agree over ``least``
characters are a set, of which the first document and the number are kept, so what is reported and removed grows with the
documents, not with their pairs; last, the sentences that a span covers are taken out of
every document but the first that has it. Pairs are made for ``pairs`` alone, and there once for each set.

Documents of equal text are one class from the start, named by the first of them, which alone takes part.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from folivane.plans.sizing import maybe_broadcast
from folivane.plans.storage import cut
from folivane.sources.tables import table

LEAST = 400
#: Characters by whose hash starts within long sentences are chosen, and the places among which one is.
_GRAM, _REACH = 8, 90
#: Characters from which a sentence counts as several.
LONGEST = _REACH + _GRAM - 1
#: Characters of a common stretch within which a common start stands; three tell a sentence's end.
FIRST = 3 + LONGEST
#: Members of a class of equal texts up to which all their pairs are listed; beyond, each is paired with the first.
COPIES = 1000
#: Texts of a set with a window in common that one task pairs with as many others.
BLOCK = 1024

# Told by at most three characters, so that it doesn't matter what stands around a common stretch.
_END = re.compile(r"[.!?…:;][\"'”»)\]]?\s|\n")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def run_length(least: int) -> int:
    """Characters that a run has at least, so that it lies in a common stretch of ``least`` from a start in its FIRST."""
    return least - FIRST - LONGEST


def ends(text: str) -> list[int]:
    """Where sentences end and the next ones begin."""
    return [m.end() for m in _END.finditer(text)]


_MARKS, _CLOSERS = (np.array([ord(c) for c in x], "u4") for x in (".!?…:;", "\"'”»)]"))
_BLANK = np.array([chr(n).isspace() for n in range(0x3001)])


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``n`` places of ``x`` that follow each other."""
    done = 1
    while done < n:
        by = min(done, n - done)
        x = op(x[: len(x) - by], x[by:])
        done += by
    return x


class Runs:
    """The runs of sentences of many texts at once: of text ``row[k]`` the code points from ``begin[k]`` to ``end[k]``, which
    are characters ``begin[k] - first[row[k]]`` and so on of that text. ``buffer`` has four bytes for each code point."""

    def __init__(self, texts: list[str], length: int):
        self.buffer = memoryview("\0".join(texts).encode("utf-32-le", "surrogatepass"))
        c = np.frombuffer(self.buffer, "u4")
        size = np.array([len(t) for t in texts], "i8")
        self.last = np.cumsum(size + 1) - 1
        self.first = self.last - size
        n = len(c)
        # Sentences end after a blank behind a mark, with one closing sign between at most, and after a line break.
        mark = np.isin(c, _MARKS)
        after = np.append(False, mark[:-1]) | np.append([False, False], mark[:-2] & np.isin(c[1:-1], _CLOSERS))[:n] if n > 1 else np.zeros(n, bool)
        blank = (c < len(_BLANK)) & _BLANK[np.minimum(c, len(_BLANK) - 1)]
        natural = np.zeros(n + 1, bool)
        natural[1:] = blank & after | (c == 10)
        bounds = natural.copy()
        bounds[self.first] = bounds[self.last] = True
        # The next end of a sentence, or of the text, behind each place.
        places = np.arange(n + 1)
        following = np.append(np.minimum.accumulate(np.where(bounds, places, n + 1)[::-1])[::-1][1:], n + 1)
        begins = natural
        begins[self.first] = True
        if n >= LONGEST:
            h = np.zeros(n - _GRAM + 1, "u8")
            wide = c.astype("u8")
            for k in range(_GRAM):
                h = (h ^ wide[k : k + len(h)]) * _ODD
                h ^= h >> np.uint64(29)
            h |= np.uint64(1)
            least = _sliding(h, _REACH, np.minimum)
            least = np.where((following - places)[: len(least)] >= LONGEST, least, np.uint64(0))  # the window lies in one sentence
            pad = np.zeros(_REACH - 1, "u8")
            begins[: len(h)] |= _sliding(np.concatenate([pad, least, pad]), _REACH, np.maximum) == h
        p = np.flatnonzero(begins)
        row = np.searchsorted(self.last, p)
        fits = row < len(texts)
        p, row = p[fits], row[fits]
        e, open_ = p.copy(), np.arange(len(p))
        while len(open_):
            at = e[open_]
            e[open_] = np.minimum(at + LONGEST, following[at])
            open_ = open_[(e[open_] - p[open_] < length) & (e[open_] < self.last[row[open_]])]
        whole = e - p >= length
        self.row, self.begin, self.end = row[whole], p[whole], e[whole]

    def hashes(self) -> list[int]:
        b = self.buffer
        return [xxh3_64_intdigest(b[4 * p : 4 * e]) for p, e in zip(self.begin.tolist(), self.end.tolist())]


#: Characters of texts that are worked on at once.
_AT_ONCE = 1 << 20


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about _AT_ONCE characters."""
    a = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= _AT_ONCE:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, "u8").view("i8"))


def _spans(length: int):
    """(span, class): the hashes of each text's runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _parts(texts):
                own = Runs(texts[a:b], length)
                yield pa.RecordBatch.from_arrays([_signed(own.hashes()), pa.array(classes[a:b][own.row], pa.int64())], ["span", "class"])

    return run


#: Texts of one run up to which they are compared in one task; beyond, windows of them are hashed, and only equal ones meet.
GROUP = 4096
_AROUND = "span long, class long, at int, size int, left string, right string, low long"


def _around(least: int):
    """Of each wanted run of a text: its begin, its size, and the characters before and after it that a common stretch of
    ``least`` characters can take in. Of those with too many texts for one task the windows that such a stretch can begin
    with instead, with 128 bits of hash in span and low."""
    length = run_length(least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, texts, wanted, hot = (batch.column(k).to_pylist() for k in range(4))
            for a, b in _parts(texts):
                rows: list[tuple] = []
                known = [({x & (1 << 64) - 1 for x in w}, {x & (1 << 64) - 1 for x in h}) for w, h in zip(wanted[a:b], hot[a:b])]
                done: dict[int, int] = {}
                own = Runs(texts[a:b], length)
                for r, p, e, h in zip(own.row.tolist(), (own.begin - own.first[own.row]).tolist(), (own.end - own.first[own.row]).tolist(), own.hashes()):
                    if h not in known[r][0]:
                        continue
                    t, c = texts[a + r], classes[a + r]
                    if h in known[r][1]:
                        for k in range(max(done.get(r, 0), p - FIRST), min(p, len(t) - least) + 1):
                            w = xxh3_128_intdigest(own.buffer[4 * (own.first[r] + k) : 4 * (own.first[r] + k + least)])
                            rows.append((w >> 64, c, k, 0, None, None, w & (1 << 64) - 1))
                        done[r] = p + 1
                    else:
                        rows.append((h, c, p, e - p, t[max(0, p - FIRST) : p], t[e : p + least], 0))
                span, cls, at, size, left, right, low = zip(*rows) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([_signed(span), pa.array(cls, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string()), _signed(low)], ["span", "class", "at", "size", "left", "right", "low"])

    return run


def _mark(c: int, n: int) -> int:
    return xxh3_64_intdigest(c.to_bytes(8, "little", signed=True), n)


class _Sets:
    """Sets of classes as rows (first, n, x, y): the least member, the number, and two hashes of all."""

    def __init__(self):
        self.known: dict[frozenset, tuple[int, int, int, int]] = {}

    def row(self, members: frozenset) -> tuple[int, int, int, int]:
        got = self.known.get(members)
        if got is None:
            x = y = 0
            for c in members:
                x ^= _mark(c, 1)
                y ^= _mark(c, 2)
            got = self.known[members] = (min(members), len(members), x, y)
        return got


def _common(rows: list[tuple[int, int, str, str]], reach: int, sets: _Sets) -> Iterator[tuple]:
    """(class, begin, end, first, n, x, y): of texts with one run, given as (class, at, left, right), the places from begin to
    end (both included) at which common stretches can begin, ``reach`` characters of left and right being in them."""
    if len({r[0] for r in rows}) < 2:
        return
    if len(rows) == 2:
        (a, at, l1, r1), (b, at2, l2, r2) = rows
        before = len(os.path.commonprefix((l1[::-1], l2[::-1])))
        low, high = max(0, reach - len(os.path.commonprefix((r1, r2)))), min(before, reach)
        if low <= high:
            told = sets.row(frozenset((a, b)))
            yield (a, at - high, at - low, *told)
            yield (b, at2 - high, at2 - low, *told)
        return
    open_: dict[int, tuple[int, frozenset]] = {}
    for l in range(min(reach, max(len(r[2]) for r in rows)) + 2):
        groups: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, left, right) in enumerate(rows):
            if len(left) >= l and len(right) >= reach - l >= 0:
                groups.setdefault((left[len(left) - l :], right[: reach - l]), []).append(k)
        now = {}
        for own in groups.values():
            members = frozenset(rows[k][0] for k in own) if len(own) > 1 else ()
            if len(members) > 1:
                now.update(dict.fromkeys(own, members))
        for k in [k for k, (_, m) in open_.items() if now.get(k) != m]:
            begun, members = open_.pop(k)
            yield (rows[k][0], rows[k][1] - l + 1, rows[k][1] - begun, *sets.row(members))
        for k, members in now.items():
            open_.setdefault(k, (l, members))


_HELD = "class long, begin int, end int, first long, n long, x long, y long"


def _meet(least: int):
    """From rows of _AROUND sorted by span: see _HELD."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give(rows: list[tuple]) -> pa.RecordBatch:
            sets, out = _Sets(), []
            by: dict[tuple, list] = {}
            for span, cls, at, size, left, right in rows:
                # A common stretch has so much of the right side in any case.
                need = least - size - FIRST
                if len(right) >= need:
                    by.setdefault((span, size, right[: max(0, need)]), []).append((cls, at, left, right))
            for (_, size, _), group in by.items():
                out += _common(sorted(set(group)), least - size, sets)
            cols = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if k in (0, 3, 4) else pa.int32()) for k, c in enumerate(cols[:5])), _signed(cols[5]), _signed(cols[6])], ["class", "begin", "end", "first", "n", "x", "y"])

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(6)))
            last = held[-1][0] if held else None
            cut_at = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] != last), -1) + 1  # the last run may go on
            if cut_at:
                yield give(held[:cut_at])
                held = held[cut_at:]
        yield give(held)

    return run


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class, copies, n_chars): each document once. Documents of equal text, told by 128 bits, have one class, named
    by the first of them. A null text is a class of its own."""
    own = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.length("text").alias("n_chars")).dropDuplicates(["doc_id"])
    several = own.where("n_chars IS NOT NULL").groupBy("h", "g").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies")).where("copies > 1")
    several = maybe_broadcast(cut(several), 48)
    return own.join(several, ["h", "g"], "left").select("doc_id", F.coalesce("class", "doc_id").alias("class"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def held(documents: DataFrame, members: DataFrame, least: int = LEAST) -> DataFrame:
    """(class, begin, end, first, n, x, y): from begin to end (both included) the places of a text of ``documents`` (doc_id,
    text) at which ``least`` characters begin that other texts have too; the first class that has them, the number of these
    and hashes of their set. One document of each class of ``members`` takes part. A place may stand there several times,
    once with all classes that have it. Shorter, null and empty texts have none."""
    if run_length(least) <= LONGEST:
        raise ValueError(f"least must be {FIRST + 2 * LONGEST + 1} or more")
    others = maybe_broadcast(cut(members.where("doc_id <> class").select("doc_id")), 16)
    texts = documents.where(F.length("text") >= least).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(others, "doc_id", "left_anti").select(F.col("doc_id").alias("class"), "text")
    spans = cut(texts.mapInArrow(_spans(run_length(least)), "span long, class long"))
    repeated = cut(spans.groupBy("span").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("rows")).where("a <> b").select("span", (F.col("rows") > GROUP).alias("hot")))
    wanted = spans.join(maybe_broadcast(repeated, 24), "span").groupBy("class").agg(F.collect_set("span").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("span"))).alias("hot"))  # a text's own runs
    own = texts.join(maybe_broadcast(cut(wanted), 400), "class").select("class", "text", "wanted", "hot")
    around = cut(own.mapInArrow(_around(least), _AROUND))
    few = around.where("left IS NOT NULL").select("span", "class", "at", "size", "left", "right").repartition("span").sortWithinPartitions("span").mapInArrow(_meet(least), _HELD)
    windows = around.where("left IS NULL").select(F.col("span").alias("high"), "low", "class", "at").distinct()
    mark = lambda n: F.bit_xor(F.xxhash64(F.lit(n), "class"))
    sets = windows.select("high", "low", "class").distinct().groupBy("high", "low").agg(F.min("class").alias("first"), F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    many = windows.join(maybe_broadcast(cut(sets), 72), ["high", "low"]).select("class", F.col("at").alias("begin"), F.col("at").alias("end"), "first", "n", "x", "y")
    return cut(few.unionByName(many))


def found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of documents with LEAST common characters, copies of a text included (see COPIES)."""
    return pairs(table(spark, base, "documents", "doc_id", "text"))


def pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of the documents with ``least`` characters in common. Of more than COPIES documents of
    equal text each is paired with the first, which stands for all of them in pairs with others."""
    docs = cut(classes(documents))
    members = docs.where(F.col("n_chars") >= least)
    links = cut(linked(held(documents, docs, least)))
    other = members.select(F.col("doc_id").alias("doc2"), F.col("class").alias("class2"))
    listed = members.where((F.col("copies") <= COPIES) | (F.col("doc_id") == F.col("class")))
    across = links.join(listed, "class").join(listed.select(F.col("doc_id").alias("doc2"), F.col("class").alias("class2")), "class2").select("doc_id", "doc2")
    same = members.where((F.col("copies") > 1) & (F.col("copies") <= COPIES)).join(other.withColumnRenamed("class2", "class"), "class").select("doc_id", "doc2")
    star = members.where(F.col("copies") > COPIES).select(F.col("class").alias("doc_id"), F.col("doc_id").alias("doc2"))
    both = across.unionByName(same.unionByName(star).where("doc_id < doc2"))
    return both.select(F.least("doc_id", "doc2").alias("doc_a"), F.greatest("doc_id", "doc2").alias("doc_b")).distinct()


def linked(found: DataFrame) -> DataFrame:
    """(class, class2), class < class2, of the classes with a place of held() in common. Each set of classes is paired once,
    a large one in blocks."""
    # A task meets one block of a set with one other.
    cells = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    members = found.select("first", "n", "x", "y", "class").distinct().withColumn("cells", cells).withColumn("mine", F.pmod(F.xxhash64("class"), F.col("cells")).cast("int"))
    members = members.select("first", "x", "y", "class", "mine", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("to"))
    keyed = members.select("first", "x", "y", F.least("mine", "to").alias("i"), F.greatest("mine", "to").alias("j"), "class")
    return keyed.join(keyed.withColumnRenamed("class", "class2"), ["first", "x", "y", "i", "j"]).where("class < class2").select("class", "class2").distinct()


def shared(spark: SparkSession, base: str) -> DataFrame:
    """Each document once: its class of equal texts, the class's copies, the characters of it that stand in another document
    too, and their portion."""
    return portions(table(spark, base, "documents", "doc_id", "text"))


def portions(documents: DataFrame, least: int = LEAST) -> DataFrame:
    docs = cut(classes(documents))
    spans = _stretches(held(documents, docs, least), ["class"], least, least)
    cover = spans.groupBy("class").agg(F.sum(F.col("end") - F.col("begin")).alias("chars"))
    whole = (F.col("copies") > 1) & (F.col("n_chars") >= least)
    chars = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0))).cast("long")
    return docs.join(maybe_broadcast(cut(cover), 24), "class", "left").select("doc_id", F.col("class").alias("class_id"), "copies", chars.alias("shared_chars"), (chars / F.greatest("n_chars", F.lit(1))).alias("shared_portion"))


def _stretches(found: DataFrame, key: list[str], least: int, apart: int) -> DataFrame:
    """(key, begin, end, n): the characters of ``least`` from each place of ``found`` (key, begin, end, n), places at most
    ``apart`` characters apart being one stretch."""
    order = Window.partitionBy(*key).orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = found.withColumn("new", F.coalesce((F.col("begin") > before + apart).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "part").agg(F.min("begin").alias("begin"), (F.max("end") + least).alias("end"), F.max("n").alias("n")).select(*key, "begin", "end", "n")


def _first_only(found: DataFrame) -> DataFrame:
    """``found`` of held() with each place once, with all classes that have it: the least first and the largest n."""
    each = found.select("class", F.explode(F.sequence("begin", "end")).alias("at"), "first", "n")
    return each.groupBy("class", "at").agg(F.min("first").alias("first"), F.max("n").alias("n")).select("class", F.col("at").alias("begin"), F.col("at").alias("end"), "first", "n")


def places(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, begin, length, first_doc, texts): each stretch of at least ``least`` characters of a document that another
    text has too; begin counts characters from 0. first_doc is the first document that has it, which may be the document
    itself, texts how many different texts have it, or the part of it that most have. Where the first document changes a
    new stretch begins. Of documents of equal text each has its whole text as one stretch more, first_doc being the first
    of them and texts 1."""
    docs = cut(classes(documents))
    # Windows that follow each other at every character are one stretch.
    sides = cut(_stretches(_first_only(held(documents, docs, least)), ["class", "first"], least, 1))
    across = docs.join(maybe_broadcast(sides, 40), "class").select("doc_id", "begin", (F.col("end") - F.col("begin")).alias("length"), F.col("first").alias("first_doc"), F.col("n").alias("texts"))
    equal = docs.where((F.col("copies") > 1) & (F.col("n_chars") >= least))
    whole = equal.select("doc_id", F.lit(0).alias("begin"), F.col("n_chars").alias("length"), F.col("class").alias("first_doc"), F.lit(1).cast("long").alias("texts"))
    return across.unionByName(whole)


def uncovered(text: str, covered: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the sentences that lie in one of ``covered`` (begin, end) or in several that meet, and their
    number. The blanks after a sentence may lie outside."""
    spans: list[list[int]] = []
    for a, b in sorted(covered):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    at = [0, *(e for e in ends(text) if e < len(text)), len(text)]
    kept, removed, k = [], 0, 0
    for a, b in zip(at, at[1:]):
        last = a + len(text[a:b].rstrip())
        while k < len(spans) and spans[k][1] < last:
            k += 1
        if last > a and k < len(spans) and spans[k][0] <= a:
            removed += 1
        else:
            kept.append(text[a:b])
    return "".join(kept), removed


def _uncovered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.append(uncovered(text, [(s["begin"], s["end"]) for s in spans]) if spans and text else (text, 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["doc_id", "text", "removed"])


def without_repeats(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text, removed): each document once, without the sentences that lie in a stretch an earlier document (of
    smaller doc_id) has too, and their number. Of equal texts of at least ``least`` characters the first keeps its own.
    A null text stays null."""
    docs = cut(classes(documents))
    # An earlier document of equal text has no part of its own; classes are named by their first documents.
    later = held(documents, docs, least).where(F.col("first") < F.col("class"))
    spans = _stretches(later, ["class"], least, least).groupBy("class").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # of one text
    copy = (F.col("doc_id") != F.col("class")) & (F.col("n_chars") >= least)
    all_of_it = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_chars").alias("end")))
    lost = docs.join(maybe_broadcast(cut(spans), 200), "class", "left").select("doc_id", F.when(copy, all_of_it).otherwise(F.col("spans")).alias("spans")).where("spans IS NOT NULL")
    once = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    return once.join(maybe_broadcast(cut(lost), 200), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_uncovered, "doc_id long, text string, removed int")


def found_places(spark: SparkSession, base: str) -> DataFrame:
    return places(table(spark, base, "documents", "doc_id", "text"))


def clean(spark: SparkSession, base: str) -> DataFrame:
    return without_repeats(table(spark, base, "documents", "doc_id", "text"))


_SQL_WINDOWS = f"""own AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
    parts AS (SELECT doc_id, pos, md5(substr(text, pos::INT, {LEAST})) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - {LEAST} + 2)) AS pos FROM own WHERE length(text) >= {LEAST}))"""
SQL_FOUND = f"""WITH {_SQL_WINDOWS}, held AS (SELECT DISTINCT doc_id, w FROM parts)
    SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.w = b.w AND a.doc_id < b.doc_id"""
SQL_SHARED = f"""WITH {_SQL_WINDOWS}, several AS (SELECT w FROM parts GROUP BY w HAVING count(DISTINCT doc_id) > 1),
    cover AS (SELECT doc_id, sum(least({LEAST}, coalesce(following - pos, {LEAST})))::BIGINT AS chars FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM parts SEMI JOIN several USING (w)) GROUP BY doc_id),
    equal AS (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM own WHERE text IS NOT NULL GROUP BY text)
    SELECT o.doc_id, coalesce(class_id, o.doc_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(chars, 0) AS shared_chars, coalesce(chars, 0) / greatest(coalesce(length(o.text), 0), 1)::DOUBLE AS shared_portion
    FROM own o LEFT JOIN equal e ON o.text = e.text LEFT JOIN cover c ON c.doc_id = o.doc_id"""
SQL_STRETCHES = f"""WITH {_SQL_WINDOWS}, equal AS (SELECT text, min(doc_id) AS class, count(*) AS copies FROM own WHERE text IS NOT NULL GROUP BY text),
    docs AS (SELECT doc_id, class, copies, length(text) AS n FROM own JOIN equal USING (text)),
    held AS (SELECT w, min(class) AS first, count(DISTINCT class) AS texts FROM parts JOIN docs USING (doc_id) GROUP BY w HAVING count(DISTINCT class) > 1),
    marked AS (SELECT doc_id, first, texts, pos, pos - row_number() OVER (PARTITION BY doc_id, first ORDER BY pos) AS stretch FROM parts JOIN held USING (w))
    SELECT doc_id, (min(pos) - 1)::INT AS begin, (count(*) + {LEAST} - 1)::INT AS length, first AS first_doc, max(texts) AS texts FROM marked GROUP BY doc_id, first, stretch
    UNION ALL SELECT doc_id, 0, n::INT, class, 1 FROM docs WHERE copies > 1 AND n >= {LEAST}"""
