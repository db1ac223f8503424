import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folivane.llm import fm_index, leakage, mixing, near_duplicates, queries, shared_spans
from folivane.llm.lookalike import words
from folivane.llm.word_hashes import word_hashes

BASE = "/root/testdata/sf0.001"


def text(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 6 ---
def edited(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def brute(rows):
    s = {}
    for i, t in rows:
        w = words(t or "")
        if i and len(w) >= 40:
            s[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(s)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b]) - 1e-9}


@pytest.mark.parametrize("boundary,longest", [(None, 16), (90, 4), (10**6, 10**6)])
def test_alike(spark, boundary, longest, monkeypatch):
    # Lists are split from 4 entries; their lengths are told beforehand, or taken down where they would meet.
    monkeypatch.setattr(near_duplicates, "LIST", 4)
    monkeypatch.setattr(near_duplicates, "LONGEST_LIST", longest)
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = text(rng, rng.choice([40, 45, 120, 200]), 400)
        rows += [(f"g{g}-{k}", edited(rng, base, rng.randrange(12))) for k in range(6)]
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("copy2", rows[0][1]), ("case", rows[0][1].upper()), ("null", None), ("empty", ""), (None, rows[0][1]), ("short", "a b c"), ("same", "word " * 60), ("same2", "word " * 70), ("long", text(rng, 30_000))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, class string")
    if boundary is not None:
        monkeypatch.setattr(near_duplicates, "choose_boundary", lambda *a: boundary)
    got = {tuple(r) for r in near_duplicates.pairs(df).collect()}
    assert got == brute(dict(rows).items())
    if boundary is None:
        assert near_duplicates.pairs(df.where("false")).count() == 0


def test_boundary_by_cost():
    sizes = {40: 1000, 100: 1000, 400: 1000}
    assert near_duplicates.choose_boundary(sizes, 1.0) == 0
    assert near_duplicates.choose_boundary(sizes, 500.0) >= 40
    assert near_duplicates.choose_boundary({}, 1.0) == 0


def test_long_lists_are_taken_down(monkeypatch):
    monkeypatch.setattr(near_duplicates, "LONGEST_LIST", 3)
    role = near_duplicates._PROBE | near_duplicates._INDEX
    rows = [(m, 10 * m + k, 50 << 32 | role) for m, n in ((1, 2), (2, 9), (3, 3), (4, 4), (5, 2), (6, 11)) for k in range(n)]
    for size in (1, 2, 3, 5, 40):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + size])], ["member", "class", "packed"]) for a in range(0, len(rows), size)]
        out = [r for b in near_duplicates._meet(0.6)(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["class"], r["n"]) for r in out if r["class2"] is None) == [(2, 9), (4, 4), (6, 11)]
        assert {(r["class"], r["class2"]) for r in out if r["class2"] is not None} == {(11, 10), (31, 30), (32, 30), (32, 31), (51, 50)}


def peak(run, batch):
    """MB that ``run`` allocates over ``batch`` at most, beside what it gives out."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_memory_of_tasks():
    # Batches as full as Arrow makes them of large inputs; a task has some 250 MB.
    rng = random.Random(3)
    texts = pa.array([text(rng, 140) for _ in range(3000)])
    ids = pa.array(range(3000), pa.int64())
    pairs = pa.RecordBatch.from_arrays([ids, pa.array(range(3000, 6000), pa.int64()), texts, texts.take(pa.array(list(reversed(range(3000)))))], ["class", "class2", "text", "text2"])
    assert peak(near_duplicates._compare, pairs) < 60
    list_ = pa.RecordBatch.from_arrays([pa.array(np.zeros(4000, "i8")), pa.array(range(4000), pa.int64()), pa.array(np.full(4000, 50 << 32 | near_duplicates._PROBE | near_duplicates._INDEX))], ["member", "class", "packed"])
    assert peak(near_duplicates._meet(0.6), list_) < 60
    hints = type("Sent", (), {"value": (np.zeros(0, "u8"), np.zeros(0), 0.0, np.zeros(0, "u8"), np.zeros(0, "i8"))})
    many = pa.RecordBatch.from_arrays([pa.array(range(30_000), pa.int64()), pa.chunked_array([texts] * 10).combine_chunks()], ["class", "text"])
    assert peak(near_duplicates._members(hints, 0.6, 40, 0), many) < 120


def test_many_copies_and_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPIES", 3)
    rng = random.Random(12)
    base = text(rng, 60)
    rows = [(f"a{i}", base) for i in range(5)] + [("b", base + " end"), ("c", base + " stop")]
    df = spark.createDataFrame(rows, "id string, text string")
    # Five copies are paired with the first, which stands for them in other pairs.
    assert {tuple(r) for r in near_duplicates.pairs(df).collect()} == {("a0", f"a{i}") for i in range(1, 5)} | {("a0", "b"), ("a0", "c"), ("b", "c")}
    told = {r.chunk_id: r for r in near_duplicates.grouped(df).collect()}
    assert {r.group_id for r in told.values()} == {"a0"} and told["a3"].links == 2
    short = spark.createDataFrame([("s1", "a b c"), ("s2", "a b c"), ("n1", None), ("n2", None), ("l1", "w " * 39 + "x" * 40), ("l2", "w " * 39 + "x" * 40), (None, base)], "id string, text string")
    assert {(r.chunk_id, r.group_id, r.links) for r in near_duplicates.grouped(short.where("id NOT LIKE 'l%'")).collect()} == {(k, k, 0) for k in ("s1", "s2", "n1", "n2")}
    assert {(r.chunk_id, r.group_id) for r in near_duplicates.grouped(short.where("id LIKE 'l%'")).collect()} == {("l1", "l1"), ("l2", "l1")}
    real = near_duplicates.F.xxhash64
    monkeypatch.setattr(near_duplicates.F, "xxhash64", lambda *c: near_duplicates.F.lit(7).cast("long") if [type(x) for x in c] == [str] else real(*c))
    assert {tuple(r) for r in near_duplicates.pairs(df).collect()} == {("a0", f"a{i}") for i in range(1, 5)} | {("a0", "b"), ("a0", "c"), ("b", "c")}


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101)]
    ways = spark.createDataFrame(chain + [(b, a) for a, b in chain], "class long, class2 long")
    label = {r["class"]: r.label for r in near_duplicates.components(ways).collect()}
    assert all(label[i] == 0 for i in range(31)) and label[100] == label[101] == 100


def test_word_hashes():
    texts = ["Plain ASCII text_x 12", "Größe naïve CAFÉ ² x½y", "a b Τest", "“quoted” – text’s…", "журнал и Δ", "", None, "x" * 10_000, "_a_ b__c"]
    h, at, rows = word_hashes(pa.array(texts, pa.string()))
    told, back = {}, {}
    for k, r in enumerate(rows):
        own = h[at[k] : at[k + 1]].tolist()
        w = words(texts[r] or "")
        assert len(own) == len(w)
        assert all(told.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(w, own))
    assert sorted(rows) == list(range(len(texts)))


# --- 7 ---
def test_fm_index():
    rng = random.Random(1)
    for _ in range(60):
        n, sigma = rng.randint(0, 200), rng.choice([2, 3, 4, 9, 20])
        t = [rng.randrange(sigma) for _ in range(n)]
        f = fm_index.FMIndex(np.array(t), sigma)
        pats = [[rng.randrange(1, sigma) for _ in range(rng.randint(1, 4))] for _ in range(10)]
        width = max(map(len, pats))
        p = np.zeros((10, width), "i4")
        for i, q in enumerate(pats):
            p[i, width - len(q) :] = q
        f = fm_index.FMIndex.load(f.dump())
        low, high = f.ranges(p, np.array([len(q) for q in pats]))
        for i, q in enumerate(pats):
            assert sorted(f.locate(np.arange(low[i], high[i])).tolist() if high[i] > low[i] else []) == [j for j in range(n) if t[j : j + len(q)] == q]


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 2)
    rng = random.Random(2)
    passage = text(rng, 20)
    items = [(1, "Where does the Pump rest?", passage), (2, "why not", None), (3, None, text(rng, 12)), (4, "", text(rng, 30)), (1, "Where does the Pump rest?", passage)]
    p = passage.split()
    docs = [
        (1, "x where, does\nthe PUMP rest y"), (2, " ".join(p[3:16])), (3, " ".join(p[3:15])), (4, None), (5, ""), (6, " ".join(items[2][2].split())), (7, "where does the pump not rest"),
        (8, "why​ not " * 3), (9, text(rng, 5000) + " " + items[3][2] + " " + passage), (9, text(rng, 30)),
    ]
    corpus = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    golden = spark.createDataFrame([(*i, 0) for i in items], "item_id long, question string, passage string, doc_id int")
    got = leakage.leaks(corpus, golden)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 1), (8, 2), (9, 4), (9, 1)}
    assert [(r.start_word, r.end_word) for r in got.where("doc_id = 9 AND item_id = 4").collect()] == [(5000, 5030)]
    # Words that two items leaked count once.
    twice = golden.unionByName(spark.createDataFrame([(9, None, " ".join(passage.split()[2:]), 0)], golden.schema))
    told = {r.doc_id: (r["items"], r.leaked_words) for r in leakage.summary(leakage.leaks(corpus, twice)).collect()}
    assert told[9] == ([1, 4, 9], 50) and told[2] == ([1, 9], 13)
    assert leakage.leaks(corpus.where("false"), golden).count() == 0 and leakage.leaks(corpus, golden.where("false")).count() == 0


# --- 8 ---
def test_rates():
    r = mixing.rates({"a": 100, "b": 100, "c": 1}, {"a": (0.2, 1), "b": (0.4, 9), "c": (0.4, 3), "none": (0.0, 1), "gone": (0.1, 2)})
    assert r["c"] == 3 and r["none"] == r["gone"] == 0 and r["a"] * 100 + r["b"] * 100 + r["c"] == pytest.approx(201)
    assert r["b"] == pytest.approx(2 * r["a"])
    assert mixing.rates({}, {"a": (1.0, 1)}) == {"a": 0.0} and mixing.rates({}, {}) == {}


def test_mix(spark):
    docs = [(i, "a" if i % 3 else "b", f"text number {i} " * 5) for i in range(600)] + [(900, None, "x"), (901, "unlisted", "x"), (902, "a", None), (903, "a", "")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, source string, text string, tokens int")
    mix = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4), ("gone", 0.0, None)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.shares(df, mix).collect()}
    assert abs(got["a"].actual_share - 0.5) < 0.05 and got["gone"].tokens == 0
    rows = mixing.combine(df, mix).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.combine(df.repartition(7), mix).collect()), key=repr)
    n = {}
    for r in rows:
        n[r.source, r.doc_id] = n.get((r.source, r.doc_id), 0) + 1
    assert all(1 <= v <= 2 for (s, _), v in n.items() if s == "b") and sum(n.values()) == sum(r.copies for r in got.values())
    assert mixing.combine(df.where("false"), mix).count() == 0 and mixing.combine(df, mix.where("false")).count() == 0


# --- 9 ---
@pytest.mark.parametrize("block_size,group", [(None, None), (2, None), (2, 3), (None, 0)])
def test_shared(spark, monkeypatch, block_size, group):
    if block_size:
        monkeypatch.setattr(shared_spans, "BLOCK", block_size)
    if group is not None:
        monkeypatch.setattr(shared_spans, "GROUP", group)
    rng = random.Random(4)
    sent = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + ". "
    doc = lambda k: "".join(sent(rng.randint(4, 18)) for _ in range(k))
    block, hot, near, blob = doc(12)[:700], doc(9)[:405], doc(9)[:385], "".join(rng.choice("abcdefghijklmnop") for _ in range(600))
    docs = [(1, doc(5) + block + doc(3)), (2, "x" + block[100:520] + doc(4)), (3, doc(2) + block[300:699]), (4, doc(3) + blob + "z"), (5, "q" + blob[50:470] + doc(1))]
    docs += [(10 + i, doc(4) + hot + f"{i}x " + doc(3)) for i in range(6)] + [(20 + i, doc(4) + near + f"{i}x " + doc(3)) for i in range(6)]
    docs += [(30, docs[0][1]), (31, docs[0][1]), (32, "short"), (33, "short"), (34, None), (35, ""), (1, docs[0][1]), (40, doc(3000)), (41, "y" * 399), (42, "y" * 400), (43, "y" * 401)]
    want = set()
    once = {d: t for d, t in docs if t}
    for a in once:
        for b in once:
            if a < b and any(once[b][i : i + 400] in once[a] for i in range(len(once[b]) - 399)):
                want.add((a, b))
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, class int")
    assert {tuple(r) for r in shared_spans.pairs(df).collect()} == want and (10, 15) in want and (4, 5) in want
    told = {r.doc_id: r for r in shared_spans.portions(df).collect()}
    assert told[30].copies == 3 and told[30].shared_portion == 1.0 and told[20].shared_chars == 0

    def covered(d):
        t = once[d]
        at = [i for i in range(len(t) - 399) if any(t[i : i + 400] in u for e, u in once.items() if e != d)]
        return len({k for i in at for k in range(i, i + 400)})

    assert all(told[d].shared_chars == covered(d) for d in (2, 3, 4, 5, 12, 20))
    assert shared_spans.pairs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        shared_spans.held(df, shared_spans.classes(df), 200)


def test_runs_are_those_of_single_texts():
    rng = random.Random(6)
    texts = ["", "x", "\n", ". a", "a" * 300, "".join(rng.choice("ab .!\n\"") for _ in range(900)), "".join(rng.choice("abcdefgh é😀") for _ in range(700)), "One. " * 99, "\u3000" * 250]
    runs = lambda ts: [(r, p - f.first[r], e - f.first[r]) for f in [shared_spans.Runs(ts, 203)] for r, p, e in zip(f.row, f.begin, f.end)]
    alone = [(k, p, e) for k, t in enumerate(texts) for _, p, e in runs([t])]
    assert runs(texts) == alone and {r for r, _, _ in alone} >= {4, 5, 6, 7, 8}
    assert all(203 <= e - p <= 300 for _, p, e in alone) and {p for r, p, _ in alone if r == 7} == {*range(0, 495 - 203, 5)}
    # Wherever a stretch of 400 stands, both texts have a run in it from one of its first 100 characters.
    for _ in range(60):
        block = "".join(rng.choice("abcdefg  .\n\"") for _ in range(400))
        sides = ["".join(rng.choice("abcdefg .") for _ in range(rng.randrange(200))) for _ in range(4)]
        a, b = sides[0] + block + sides[1], sides[2] + block + sides[3]
        own = lambda t, x: {(p - len(x), e - len(x)) for _, p, e in runs([t])}
        assert any(0 <= p <= 100 and e <= 400 for p, e in own(a, sides[0]) & own(b, sides[2]))


@pytest.mark.parametrize("group", [None, 2])
def test_stretches_and_removal(spark, monkeypatch, group):
    if group is not None:
        monkeypatch.setattr(shared_spans, "GROUP", group)
    rng = random.Random(8)
    sent = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + ". "
    doc = lambda k: "".join(sent(rng.randint(4, 18)) for _ in range(k))
    block, hot = doc(22), doc(9)[:420]
    docs = [(1, doc(3) + block + doc(2)), (2, "X. " + block + doc(2)), (3, doc(2) + block[200:900] + doc(2)), (7, doc(30)), (8, "short. "), (9, "short. "), (10, None)]
    docs += [(4, docs[1][1]), (4, docs[1][1])] + [(20 + i, doc(4) + hot + f"{i}x " + doc(3)) for i in range(5)]
    once = {d: t for d, t in docs if t}

    def held(d):
        """{at: (first document, texts)} of the windows of ``d`` that other texts have."""
        t = once[d]
        all_ = {i: {u: min(e for e in once if once[e] == u) for u in once.values() if t[i : i + 400] in u} for i in range(len(t) - 399)}
        return {i: (min(h.values()), len(h)) for i, h in all_.items() if len(h) > 1}

    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, class int")
    got = {(r.doc_id, r.begin, r.length, r.first_doc, r.texts) for r in shared_spans.places(df).collect()}
    want = {(2, 0, len(once[2]), 2, 1), (4, 0, len(once[4]), 2, 1)}
    for d in once:
        part = []
        for i, (first, n) in [*sorted(held(d).items()), (10**9, (0, 0))]:
            if part and (i != part[-1][0] + 1 or first != part[-1][1]):
                want.add((d, part[0][0], len(part) + 399, part[0][1], max(x[2] for x in part)))
                part = []
            part.append((i, first, n))
    assert got == want and len(block) > 800
    rows = shared_spans.without_repeats(df).collect()
    told = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(told) == len(once) + 1 and told[10] is None
    assert all(told[d] == once[d] for d in (1, 7, 8, 9, 20)) and told[4] == ""

    def left(d):
        t, own = once[d], {k for i, (first, _) in held(d).items() if first < d for k in range(i, i + 400)}
        at = [0, *(e for e in shared_spans.ends(t) if e < len(t)), len(t)]
        return "".join(t[a:b] for a, b in zip(at, at[1:]) if not set(range(a, a + len(t[a:b].rstrip()))) <= own)

    assert all(told[d] == left(d) != once[d] for d in (2, 3, 21, 24))


def test_a_block_of_a_thousand_documents(spark):
    rng = random.Random(9)
    sent = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + ". "
    licence = "".join(sent(9) for _ in range(12))[:450]
    docs = [(i, sent(12) + chr(0x4E00 + i) + licence + chr(0x4E00 + i) + sent(9)) for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(licence) == 450 and shared_spans.places(df).count() == 1000 and shared_spans.portions(df).where("shared_chars >= 450").count() == 1000
    kept = {r.doc_id: r.removed for r in shared_spans.without_repeats(df).collect()}
    assert kept[0] == 0 and all(kept[i] > 2 for i in range(1, 1000))
    assert shared_spans.pairs(df).count() == 1000 * 999 // 2


@pytest.mark.parametrize("name", [n for n in queries.SQL if n[:2] in ("p6", "p7", "p8", "p9")])
def test_same_as_sql(spark, name):
    from compare import both

    ours, theirs = both(spark, queries.QUERIES[name], queries.SQL[name])
    assert ours == theirs and ours


def test_all_queries_run(spark):
    for name, q in queries.QUERIES.items():
        assert q(spark, BASE).count() > 0, name
