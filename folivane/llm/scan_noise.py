"""Problem 3: noise in text from scanned pages, and the text repaired into continuous paragraphs.

Words of the whole corpus are counted and grouped by the skeleton of their glyphs, in which forms that scanning confuses
are equal; a rare form that stands mostly in scanned items and whose group has a far more frequent one that it can be
misread from is a misread one. A form is rare by one ratio at all counts: by its occurrences, by its documents (so that one
document that misreads a word throughout doesn't make its form frequent), or by its occurrences beside the same neighbouring
words. Of several frequent forms that can be the right one, the nearest in glyphs is chosen, and of
those as near the one that stands most beside the same neighbours.
Words at line ends are joined if the joined form is the one in use. Running headers are lines of a title's shape whose form
(digits and chapter marks masked, glyphs as skeletons) comes back at page edges over a document's items; a form that stands
once counts where the line opens its item, carries a mark or interrupts a sentence. The document's name isn't looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folivane.llm.lookalike import canonical
from folivane.plans.filters import Passing, key_filter
from folivane.plans.sizing import maybe_broadcast
from folivane.plans.storage import cut
from folivane.sources.tables import table

#: How much more frequent the right form must be, in occurrences or in documents, whatever the counts are.
RATIO = 12
#: The share of a misread form's occurrences that stand in scanned items, at least.
SCANNED = 0.5
# Glyph forms (right to left of each pair) that scanning confuses, in lower case.
CONFUSED = "i=1 l=1 i=l l=i o=0 s=5 g=9 b=6 z=2 b=8 a=4 e=c c=e t=f f=t m=rn n=ri n=ii h=li d=cl u=ii w=vv li=h cl=d rn=m ri=n ii=u ii=n vv=w q=9 q=g g=q b=h h=b i=! l=| i=| m=iii k=lc t=7 u=v v=u a=o o=a y=v"
STROKES = {"m": "rri", "n": "ri", "h": "ii", "d": "ci", "u": "ii", "w": "vv", "k": "ic", "l": "i", "1": "i", "|": "i", "!": "i", "0": "o", "5": "s", "9": "g", "q": "g", "6": "b", "8": "b", "2": "z", "e": "c", "f": "t", "7": "t"}
HYPHENS = "-¬‐‑­"
CHAPTER = ("chapter", "kapitel", "chapitre", "capítulo", "глава", "part", "section", "teil", "partie")
# End of the fixed values.

_PAIRS = [tuple(p.split("=")) for p in CONFUSED.split()]
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _right, _wrong in _PAIRS:
    _BY_FIRST.setdefault(_right[0], []).append((_right, _wrong))
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_WORD = re.compile(r"[^\W_]+")
# In scanned text a bar that touches a letter is a misread l or i.
_SCANNED_WORD = r"(?:\|(?=[^\W\d_]))?[^\W_]+(?:\|[^\W_]+)*(?:(?<=[^\W\d_])\|)?"
_BARRED = re.compile(_SCANNED_WORD)
_BARRED_TOKEN = re.compile(rf"{_SCANNED_WORD}(?:-{_SCANNED_WORD})*")
_HALVES = re.compile(rf"[^\W_]+[{HYPHENS[1:]}-][^\S\n]*\n\s*[^\W_]+")
_ROW = re.compile(r"^\s*\|.*\|\s*$", re.M)
_STROKE_TABLE = {ord(k): v for k, v in STROKES.items()}


def skeleton(word: str) -> str:
    """The word's strokes: equal for words that scanning confuses by CONFUSED's shape rules."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)) if not word.isascii() else word.lower()
    s = plain.translate(_STROKE_TABLE)
    return s.replace("ri", "ii").replace("a", "o").replace("y", "v")


def confusable(right: str, wrong: str) -> int:
    """The least number of the confusions, of any number, by which ``wrong`` comes from ``right``; 0 if it doesn't."""
    if sorted(right) == sorted(wrong):  # letters that changed places were mistyped, not misread
        return 0
    now, seen, n = {(0, 0)}, set(), 0
    while now:
        then, todo = set(), list(now)
        while todo:
            i, j = todo.pop()
            if (i, j) in seen:
                continue
            seen.add((i, j))
            if i == len(right):
                if j == len(wrong):
                    return n
                continue
            if j < len(wrong) and right[i] == wrong[j]:
                todo.append((i + 1, j + 1))
            then.update((i + len(a), j + len(b)) for a, b in _BY_FIRST.get(right[i], ()) if right.startswith(a, i) and wrong.startswith(b, j))
        now, n = then - seen, n + 1
    return 0


# --- what the lines of an item are -----------------------------------------------------------------------------------

_ROMAN = r"[ivxlcdm]{1,7}"
_NUMBER = r"[\dOoIlSsZBbg]{1,6}"
_PAGE = re.compile(rf"^(?:(?:page|pg|p|seite|s|página|pág|стр)\.?\s*({_NUMBER})|\[\s*({_NUMBER})\s*\]|[-–—]\s*({_NUMBER}|{_ROMAN})\s*[-–—]|({_NUMBER})\s*(?:/|of|von|de|sur)\s*{_NUMBER}|({_NUMBER})\s*\.?)$", re.I)
_DIGIT = str.maketrans("OoIlSsZBbg", "0011552869")
_ENDS = re.compile(r"[.!?:;…\"”»)\]|`]$")


def _number(line: str) -> int | None:
    """The printed page number, -1 if it is a Roman one, None if the line is not only a page number."""
    m = _PAGE.match(line)
    if not m:
        return None
    got = next((g for g in m.groups() if g), "")
    if re.fullmatch(_ROMAN, got, re.I) and not re.search(r"\d", got) and m.group(3):
        return -1
    if not re.search(r"\d", got) and m.group(5):
        return None
    digits = got.translate(_DIGIT)
    return int(digits) if digits.isdigit() else None


_CHAPTERS = {skeleton(c) for c in CHAPTER}
_IN_SENTENCE = re.compile(r"[.!?]\s")


def _is_number(word: str) -> bool:
    return bool(re.fullmatch(_NUMBER, word)) and any(c.isdigit() for c in word) or bool(re.fullmatch(_ROMAN, word, re.I)) and len(word) > 1


def title_form(line: str, strays: int = 0) -> tuple[str, bool] | None:
    """(form, whether it has a chapter mark or a page number) of a line of a title's shape: no sentence, and all its words
    of more than three letters, but for ``strays`` of them, begin with a capital. In the form digits are masked, the mark is
    left out and glyphs are skeletons. None for other lines."""
    s = canonical(line).strip()
    if not s or s[-1] in ".!?:;,…" or s[0] in "#>`*•-" or s.startswith("| ") or _IN_SENTENCE.search(s):
        return None
    ws = [b for w in s.split() if _WORD.search(b := w.strip("–—-:.()[]"))]
    marked = False
    if len(ws) > 1 and skeleton(ws[0]) in _CHAPTERS:
        ws, marked = ws[1:], True
        if len(ws) > 1 and _is_number(ws[0]):
            ws = ws[1:]
    if len(ws) > 1 and _is_number(ws[-1]):
        ws, marked = ws[:-1], True
    elif len(ws) > 1 and _is_number(ws[0]):
        ws, marked = ws[1:], True
    large = [w for w in ws if len(w) > 3]
    if len(ws) < 2 and not marked or not large:
        return None
    if sum(not (w[0].isupper() or w[0].isdigit() or w[0] == "|") for w in large) > (strays if len(large) > 2 else 0):
        return None
    return " ".join(re.sub(r"\d+", "#", w) if w.isdigit() else skeleton(w) for w in ws), marked


def is_scanned(lines: list[str]) -> bool:
    """Hard-wrapped running text: lines that end inside a sentence and go on in lower case."""
    last, runs, full = "", 0, 0
    for s in lines:
        s = s.strip()
        if s:
            if len(s) > 25 and " " in s:
                full += 1
            if last and s[0].islower() and not _ENDS.search(last) and " " in last and last[0] not in "|#`>" and len(last) > 25:
                runs += 1
            last = s
    return runs >= 2 or runs == 1 and full <= 4


def roles(lines: list[str], page: int | None) -> list[str]:
    """For each line of a scanned item: 'blank', 'title' (of a title's shape), 'page_number', or 'text'."""
    out = []
    filled = [i for i, s in enumerate(lines) if s.strip()]
    edge = {*filled[:2], *filled[-2:]}
    for i, s in enumerate(lines):
        s = s.strip()
        if not s:
            out.append("blank")
        elif (n := _number(s)) is not None:
            bare = s.strip(" .").translate(_DIGIT).isdigit()
            beside = [lines[k].strip() for k in (i - 1, i + 1) if 0 <= k < len(lines)]
            column = any(x.isdigit() for x in beside)  # numbers below each other are data
            out.append("page_number" if not bare or i in edge and not column or page is not None and abs(n - page) <= 1 and not column else "text")
        else:
            out.append("title" if title_form(s, 1) else "text")
    return out


def titles(lines: list[str], role: list[str]) -> Iterator[tuple[int, str, bool, bool, bool]]:
    """(line, form, strict, at an edge, surely) of the lines of a title's shape. 'strict': without strays; 'at an edge':
    among the first or last two lines that aren't blank, or beside a page number; 'surely': the line opens the item,
    carries a mark, or interrupts a sentence."""
    filled = [i for i, r in enumerate(role) if r != "blank"]
    for f, i in enumerate(filled):
        if role[i] != "title":
            continue
        form, marked = title_form(lines[i], 1)
        before, after = (filled[f - 1] if f else None), (filled[f + 1] if f + 1 < len(filled) else None)
        edge = f < 2 or f >= len(filled) - 2 or any(k is not None and role[k] == "page_number" for k in (before, after))
        text = [k for k in filled[:f] if role[k] == "text"][-1:]
        breaks = bool(text) and after is not None and not _ENDS.search(lines[text[0]].strip()) and lines[after].strip()[:1].islower()
        yield i, form, title_form(lines[i]) is not None, edge, f == 0 or marked or breaks


def _broken(lines: list[str], role: list[str]) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(line, line that goes on, first half, hyphen, second half, whole line) where a line ends in a hyphen. The word goes on
    in the next line of text, however far."""
    following = [-1] * len(lines)
    for i in range(len(lines) - 2, -1, -1):
        following[i] = i + 1 if role[i + 1] == "text" else following[i + 1]
    for i, s in enumerate(lines):
        s = s.rstrip()
        if role[i] != "text" or not s or s[-1] not in HYPHENS or following[i] < 0:
            continue
        head = _HEAD.search(s[:-1])
        tail = _TAIL.match(lines[following[i]])
        if head and tail and any(c.isalpha() for c in head.group(0)) and (tail.group(1)[0].islower() or tail.group(1)[0].isdigit() or tail.group(1)[0] == "|" or s[-2].isupper()):
            yield i, following[i], head.group(0), s[-1], tail.group(1), s


_HEAD = re.compile(rf"(?<![^\W_]){_SCANNED_WORD}(?:-{_SCANNED_WORD})*$")
_TAIL = re.compile(rf"\s*({_SCANNED_WORD}(?:-{_SCANNED_WORD})*)")


# --- passes over the corpus ------------------------------------------------------------------------------------------


def _words_of(text: str) -> list[str]:
    """The words of a scanned text in lower case; bars between the cells of a table are no letters."""
    low = text.lower()
    if "|" not in low:
        return _WORD.findall(low)
    return [w for line in low.split("\n") for w in (_WORD if _ROW.match(line) or " | " in line else _BARRED).findall(line)]


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words (doc null): (word, n, scanned), in lower case, compounds with their hyphens, and how many of them stand in
    scanned items; parts of compounds count as words too, the halves of a word over a line end of a scanned item don't.
    Of titles: (word, the form; n, items of the document with it; scanned, those with it at an edge; sure)."""
    clean: Counter = Counter()
    scanned: Counter = Counter()
    forms: dict[tuple[str, str], list[int]] = {}

    def lower(n: Counter) -> Counter:
        low: Counter = Counter()
        for w, c in n.items():
            w = w.lower()
            low[w] += c
            if "-" in w:
                for p in w.split("-"):
                    low[p] += c
        return low

    def give() -> pa.RecordBatch:
        own = lower(scanned)
        n = lower(clean)
        n.update(own)
        cols = [[None] * len(n) + [d for d, _ in forms], [*n, *(f for _, f in forms)], [*n.values(), *(v[0] for v in forms.values())], [*(own[w] for w in n), *(v[1] for v in forms.values())], [0] * len(n) + [v[2] for v in forms.values()]]
        clean.clear()
        scanned.clear()
        forms.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(cols)], ["doc", "word", "n", "scanned", "sure"])

    for batch in batches:
        for tab, key, doc, page, t in zip(*(batch.column(k).to_pylist() for k in range(5))):
            lines = t.split("\n")
            if len(lines) < 2 or not is_scanned(lines):
                clean.update(_TOKEN.findall(t))
                continue
            bare = _HALVES.sub("\n", t)
            if "|" in bare:
                for line in bare.split("\n"):
                    scanned.update((_TOKEN if _ROW.match(line) or " | " in line else _BARRED_TOKEN).findall(line))
            else:
                scanned.update(_TOKEN.findall(bare))
            own: dict[str, list[int]] = {}
            for _, form, strict, edge, sure in titles(lines, roles(lines, page)):
                if strict:
                    v = own.setdefault(form, [1, 0, 0])
                    v[1] |= edge
                    v[2] |= sure
            for form, v in own.items():
                w = forms.setdefault((doc if doc is not None else f"\0{tab}\0{key}", form), [0, 0, 0])
                for k in range(3):
                    w[k] += int(v[k])
        if len(clean) + len(scanned) + len(forms) > 1 << 20:
            yield give()
    yield give()


def _beside(words):
    """(word, doc, beside, n) of the words that the filter lets pass: how often each stands before (beside begins with >) or
    after (<) which word; and once for each text that holds it, with its document and beside null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Passing(words.value)
        out: Counter = Counter()

        def give() -> pa.RecordBatch:
            cols = list(zip(*((*k, n) for k, n in out.items()))) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 3 else pa.string()) for k, c in enumerate(cols)], ["word", "doc", "beside", "n"])

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                said = _words_of(t)
                own = {w for w in set(said) if known[w]}
                if not own:
                    continue
                out.update((w, doc, None) for w in own)
                for k, w in enumerate(said):
                    if w in own:
                        if k:
                            out[w, None, "<" + said[k - 1]] += 1
                        if k + 1 < len(said):
                            out[w, None, ">" + said[k + 1]] += 1
            if len(out) > 1 << 18:
                yield give()
        yield give()

    return run


def _skeletons(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([skeleton(w) for w in batch.column(0).to_pylist()], pa.string()), *batch.columns], ["skeleton", *batch.schema.names])


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost = [confusable(r, w) for w, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        keep = pa.array([c > 0 for c in cost], pa.bool_())
        yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), pa.array(cost, pa.int32()).filter(keep)], [*batch.schema.names, "cost"])


def survey(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words (word, n, scanned) of all texts of ``items``, of which each key stands there once, and the running headers
    (doc, form) of its documents."""
    told = items.where("value IS NOT NULL").select("item_table", "item_key", "doc_id", "page", "value").mapInArrow(_survey, "doc string, word string, n long, scanned long, sure long")
    told = cut(told.groupBy("doc", "word").agg(*(F.sum(c).alias(c) for c in ("n", "scanned", "sure"))))
    headers = told.where("doc IS NOT NULL").where("n > 1 AND 2 * scanned >= n OR sure > 0 AND n = 1").select("doc", F.col("word").alias("form"))
    return told.where("doc IS NULL").select("word", "n", "scanned"), headers


def contexts(items: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, docs), in how many documents of ``items`` each of ``words`` stands (an item without one is its own), and
    (word, beside, n), how often beside which words."""
    known = items.sparkSession.sparkContext.broadcast(key_filter(words, F.xxhash64("word")))
    seen = items.select(F.coalesce(F.col("doc_id"), F.concat(F.lit("\0"), "item_key")).alias("doc"), "value").mapInArrow(_beside(known), "word string, doc string, beside string, n long")
    told = seen.join(maybe_broadcast(words.select("word"), 80), "word", "left_semi")
    told = cut(told.groupBy("word", "doc", "beside").agg(F.sum("n").alias("n")))
    return told.where("beside IS NULL").groupBy("word").agg(F.count("*").alias("docs")), told.where("beside IS NOT NULL").select("word", "beside", "n")


def misread_forms(words: DataFrame, items: DataFrame) -> DataFrame:
    """(word, right): forms with the frequent form of their skeleton group that they are misread from."""
    told = words.where("(length(word) >= 3 OR length(word) = 2 AND word RLIKE '[0-9|]') AND NOT contains(word, '-') AND word RLIKE '[^0-9]'").mapInArrow(_skeletons, "skeleton string, word string, n long, scanned long")
    told = cut(told)
    # Every form meets all of its group that occur often enough to be right for a form of one occurrence or document.
    best = told.where(F.col("n") >= RATIO).where("NOT word RLIKE '[0-9|]'").select("skeleton", F.col("word").alias("right"), F.col("n").alias("right_n"))
    pairs = told.where(F.col("scanned") >= SCANNED * F.col("n")).join(best, "skeleton").where("word <> right").select("word", "right", "right_n", "n")
    pairs = cut(pairs.mapInArrow(_confirm, "word string, right string, right_n long, n long, cost int"))
    rare = F.col("right_n") >= RATIO * F.col("n")
    # A form is no right one if it is itself misread from another of its candidates.
    wrong = maybe_broadcast(cut(pairs.where(rare).select(F.col("word").alias("right")).distinct()), 80)
    sure = pairs.where(rare)
    roots = cut(sure.join(wrong, "right", "left_anti").select(*pairs.columns))
    several = roots.groupBy("word").count().where("count > 1").select("word")
    # What counts can't settle: forms that aren't rare by their occurrences, and forms with several candidates.
    open_ = pairs.where(~rare)
    unsettled = cut(open_.unionByName(roots.join(several, "word", "left_semi")))
    asked = cut(unsettled.select("word").union(unsettled.select("right")).distinct())
    support = F.lit(0).cast("long").alias("support")
    if asked.isEmpty():
        judged = sure.withColumn("support", support)
    else:
        docs, beside = contexts(items, asked)
        docs = maybe_broadcast(cut(docs), 80)
        other = beside.select(F.col("word").alias("right"), "beside", F.col("n").alias("m"))
        # How often the right form stands beside the words that the form stands beside.
        shared = unsettled.select("word", "right").join(beside, "word").join(other, ["right", "beside"]).groupBy("word", "right").agg(F.sum("m").alias("support"), F.sum("n").alias("own"))
        told = unsettled.join(shared, ["word", "right"], "left").join(docs, "word").join(docs.select(F.col("word").alias("right"), F.col("docs").alias("right_docs")), "right")
        by_context = (F.col("right_docs") >= RATIO * F.col("docs")) | (F.col("support") >= RATIO * 2 * F.col("n"))
        told = told.where(rare | by_context).select(*pairs.columns, F.coalesce("support", F.lit(0)).alias("support"))
        judged = told.unionByName(sure.join(told.select("word").distinct(), "word", "left_anti").select(*pairs.columns, support))
    return judged.groupBy("word").agg(F.max(F.struct(-F.col("cost"), "support", "right_n", "right")).alias("r")).select("word", "r.right")


_ROWS = "item_table string, item_key string, line_no int, noise string, word string, other string, doc string, form string"


def _lines(suspects):
    """Rows of scanned items (see _ROWS). 'word': a word to be looked up among the misread forms, whose filter lets it pass;
    'broken': a word over a line end, joined and as compound; 'title': a line that is a running header if
    its document has that form as one. doc and form are given for the words of such lines too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Passing(suspects.value)
        for batch in batches:
            out: list[tuple] = []
            for tab, key, doc, page, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if "\n" not in text:
                    continue
                lines = text.split("\n")
                if not is_scanned(lines):
                    continue
                role = roles(lines, page)
                of = doc if doc is not None else f"\0{tab}\0{key}"
                title = {i: (of, form) for i, form, *_ in titles(lines, role)}
                out.append((tab, key, 0, "scanned", None, None, None, None))
                for i, r in enumerate(role):
                    if r == "page_number":
                        out.append((tab, key, i + 1, r, None, None, None, None))
                    elif r == "title":
                        out.append((tab, key, i + 1, r, None, None, *title[i]))
                halves: dict[int, set[str]] = {}
                for i, j, a, hyphen, b, _ in _broken(lines, role):
                    whole, compound = (a + b).lower(), f"{a}-{b}".lower()
                    out.append((tab, key, i + 1, "broken", whole, compound if hyphen == "-" else None, None, None))
                    if known[whole]:
                        out.append((tab, key, i + 1, "word", whole, f"{j + 1} {a.lower()}", None, None))
                    halves.setdefault(i, set()).add(a.split("-")[-1].lower())
                    halves.setdefault(j, set()).add(b.split("-")[0].lower())
                for i, s in enumerate(lines):
                    if role[i] in ("text", "title") and " " in s.strip():
                        for w in set(_words_of(s)):
                            if known[w] and len(w) > 1 and w not in halves.get(i, ()):
                                out.append((tab, key, i + 1, "word", w, None, *title.get(i, (None, None))))
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.string()) for k, c in enumerate(cols)], ["item_table", "item_key", "line_no", "noise", "word", "other", "doc", "form"])

    return run


def items(spark: SparkSession, base: str) -> DataFrame:
    """(item_table, item_key, doc_id, page, value) of the texts that may come from scanned pages."""
    chunks = table(spark, base, "chunks", "id", "doc_id", "page", "text").select(F.lit("chunks").alias("item_table"), F.col("id").alias("item_key"), "doc_id", "page", F.col("text").alias("value"))
    pages = table(spark, base, "page_transcripts", "page_key", "doc_id", "page", "markdown").select(F.lit("page_transcripts").alias("item_table"), F.col("page_key").alias("item_key"), "doc_id", "page", F.col("markdown").alias("value"))
    return chunks.unionByName(pages)


def once(items: DataFrame) -> DataFrame:
    """Each key of ``items`` once; only the rows of keys that occur again are moved."""
    keys = ["item_table", "item_key"]
    given = items.where("value IS NOT NULL AND item_key IS NOT NULL").select(*keys, "doc_id", "page", "value")
    again = maybe_broadcast(cut(given.groupBy(*keys).count().where("count > 1").select(*keys)), 120)
    first = given.join(again, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("value", "doc_id", "page")).alias("r")).select(*keys, "r.doc_id", "r.page", "r.value")
    return given.join(again, keys, "left_anti").unionByName(first)


def noise(items: DataFrame) -> DataFrame:
    """(item_table, item_key, line_no, noise, word, right) of each noisy line of ``items``, whose columns are item_table,
    item_key, doc_id, page, value; word and right tell what was misread or broken.

    Null and empty values and values of one line have no lines to judge. A key that occurs twice counts once. A null page
    only weakens the evidence for bare page numbers; an item with a null doc_id is a document of its own. Whole texts, lines
    and words are read, of any length.
    """
    return _judged(_rows(items))


def _rows(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What _lines gives, the words' counts, and the misread forms."""
    given = once(items)
    words, headers = survey(given)
    forms = cut(misread_forms(words, given))
    suspects = items.sparkSession.sparkContext.broadcast(key_filter(forms, F.xxhash64("word")))
    rows = cut(given.select("item_table", "item_key", "doc_id", "page", "value").mapInArrow(_lines(suspects), _ROWS).distinct())
    # Of lines of a title's shape: running headers, whose words are no case of their own, or text.
    shaped, others = rows.where("form IS NOT NULL"), rows.where("form IS NULL").drop("doc", "form")
    told = shaped.join(maybe_broadcast(headers.withColumn("header", F.lit(True)), 160), ["doc", "form"], "left").drop("doc", "form")
    header = told.where("header AND noise = 'title'").drop("header").withColumn("noise", F.lit("running_header"))
    return cut(others.unionByName(header).unionByName(told.where("header IS NULL AND noise <> 'title'").drop("header"))), words, forms


def _judged(told: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    rows, words, forms = told
    sure = rows.where(F.col("noise").isin("running_header", "page_number")).select("item_table", "item_key", "line_no", "noise", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("right"))
    seen = rows.where("noise = 'word'").join(maybe_broadcast(forms, 120), "word")
    # A misread word over a line end belongs to the line whose half differs from the right form.
    second = F.col("other").isNotNull() & F.startswith("right", F.substring_index("other", " ", -1))
    misread = seen.select("item_table", "item_key", F.when(second, F.substring_index("other", " ", 1).cast("int")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("noise"), "word", "right")
    broken = rows.where("noise = 'broken'")
    asked = maybe_broadcast(cut(broken.select("word").union(broken.select("other")).where("word IS NOT NULL").distinct()), 80)
    told = cut(words.join(asked, "word", "left_semi"))
    told = maybe_broadcast(told, 80)
    both = broken.join(told.select("word", F.col("n").alias("joined_n")), "word", "left").join(told.select(F.col("word").alias("other"), F.col("n").alias("compound_n")), "other", "left")
    is_one = F.coalesce("compound_n", F.lit(0)) <= F.coalesce("joined_n", F.lit(0))
    broken = both.where(is_one).select("item_table", "item_key", "line_no", F.lit("broken_word").alias("noise"), F.col("word"), F.col("word").alias("right"))
    return sure.unionByName(misread).unionByName(broken)


def repair(items: DataFrame) -> DataFrame:
    """(item_table, item_key, text): each scanned item once, in continuous paragraphs: printed lines taken out, broken
    words joined, misread ones set right, lines of a paragraph joined by blanks. Other items aren't returned.

    A paragraph begins after a blank line, at an indented line, and at headings, list entries, tables and code.
    """
    told = _rows(items)
    rows = told[0]
    found = cut(_judged(told))
    scanned = maybe_broadcast(cut(rows.where("noise = 'scanned'").select("item_table", "item_key").distinct()), 100)
    keys = ["item_table", "item_key"]
    texts = items.join(scanned, keys, "left_semi").groupBy(*keys).agg(F.min("value").alias("value"))
    lines = texts.select(*keys, F.posexplode(F.split("value", "\n", -1)).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    marks = found.groupBy(*keys, "line_no").agg(F.bool_or(F.col("noise").isin("running_header", "page_number")).alias("printed"), F.bool_or(F.col("noise") == "broken_word").alias("broken"))
    lines = lines.join(marks, [*keys, "line_no"], "left").where("NOT coalesce(printed, false)")
    order = Window.partitionBy(*keys).orderBy("line_no")
    lines = lines.withColumn("next", F.lead("line").over(order)).withColumn("before", F.lag("line").over(order))
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    own = r"^\s*(#|[-*•] |\d+[.)] |\||```)"
    # A printed line between two halves leaves its blank line; the sentence goes on after it.
    goes_on = F.col("next").rlike(r"^[\p{Ll}]") & ~F.col("line").rlike(own)
    gap = (F.col("line").rlike(r"^\s*$") & ~(F.col("next").rlike(r"^\p{Ll}") & F.col("before").rlike(r"[\p{L}\p{N},-]\s*$")))
    piece = F.when(gap, F.lit("\n")).when(bare == "", F.lit(""))
    piece = piece.when(F.coalesce("broken", F.lit(False)), F.regexp_replace(bare, "[" + HYPHENS.replace("-", "\\-") + "]$", ""))
    piece = piece.when(F.col("line").rlike(own) | F.col("next").rlike(own), F.concat(bare, F.lit("\n"))).when(F.col("next").rlike(r"^(\s{2,}|\t)\S") & ~goes_on, F.concat(bare, F.lit("\n\n"))).otherwise(F.concat(bare, F.lit(" ")))
    whole = lines.withColumn("piece", piece).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "piece"))).alias("p"))
    whole = whole.select(*keys, F.regexp_replace(F.regexp_replace(F.array_join(F.col("p.piece"), ""), r" *\n *(\n *)+", "\n\n"), r"^\s+|\s+$", "").alias("text"))
    words = found.where("noise = 'misread'").groupBy(*keys).agg(F.collect_set(F.struct("word", "right")).alias("w"))
    fixed = F.aggregate("w", F.col("text"), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), x["word"], F.lit(r"\E(?![\p{L}\p{N}])")), x["right"]))
    return whole.join(words, keys, "left").select(*keys, F.when(F.col("w").isNull(), F.col("text")).otherwise(fixed).alias("text"))


def found(spark: SparkSession, base: str) -> DataFrame:
    return noise(items(spark, base)).select("item_table", "item_key", "line_no", "noise").distinct()


def repaired(spark: SparkSession, base: str) -> DataFrame:
    return repair(items(spark, base))
