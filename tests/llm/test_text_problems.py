import re

import pytest
from pyspark.sql import functions as F

from folivane.llm import answer_defects, canonical, lookalike, repeated_lines, scan_noise, splitting


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- 1 ---
TOLD = {
    "en": "The pump of the station rests beside the wall and the operators walk through the {} after the night shift. They check which of the valves is closed and why it does not open.",
    "de": "Die Pumpe der Station ruht neben der Wand und die Leute gehen nach der Nachtschicht durch den {}. Sie prüfen, welches der Ventile geschlossen ist und warum es sich nicht öffnet.",
    "fr": "La pompe de la station repose près du mur et les ouvriers traversent le {} après l’équipe de nuit. Ils vérifient quelle vanne est fermée et pourquoi elle ne doit pas être ouverte.",
    "es": "La bomba de la estación descansa junto al muro y los obreros cruzan el {} después del turno de noche. Revisan qué válvula está cerrada y por qué no debe abrirse, salvo que lo haya dicho el jefe.",
    "und": "The pump Die Pumpe La pompe La bomba {}.",
}


def labelled(spark):
    return frame(spark, [(lang, t.format(x)) for lang, t in TOLD.items() for x in range(80)] + [(None, "x"), ("en", None), ("xx", "alone")], "lang string, text string")


def test_languages(spark):
    model = answer_defects.fit_languages(labelled(spark))
    assert model.names == ["de", "en", "es", "fr"]  # und names none, and one text is too few
    other = lambda q, a: answer_defects.is_other_language(model, q, a)
    es, fr = "¿Por qué no debe abrirse la válvula de la estación después del turno de noche?", "La vanne de la station ne doit pas être ouverte après l’équipe de nuit, les ouvriers la vérifient."
    assert other(es, fr) and not other(es, es) and not other(fr, fr) and not other(es, "73") and not other("", fr)
    assert not other(es, fr + " La bomba de la estación descansa junto al muro después del turno de noche.")
    assert not other(es, "«" + fr + "»") and not answer_defects.is_other_language(answer_defects.Languages([]), es, fr)


def test_refusals_align_with_heads_and_what_is_refused():
    for no in ("I'm not able to discuss the diaphragm, and I hope you understand.", "It would not be appropriate for me to advise on the clarifier.", "I'd rather not say.", "I won't discuss this topic.", "Unfortunately that request is something I have to turn down."):
        assert answer_defects.is_refusal(no), no
    for told in ("I could not find the scanner on the pages supplied; page 7 comes closest.", "I can confirm the following from page 166.", "Operators are not able to discuss the plan."):
        assert not answer_defects.is_refusal(told), told


def test_contexts_are_those_of_single_sentences():
    told = [["The", "pump", "of", "Varna", "rests", "now"], ["A", "b"], ["Night", ",", "the", "2", "pumps", "of", "Varna", "rest", "beside", "the", "long", "wall", "of", "stone"]]
    both = answer_defects.Contexts()
    for t in told:
        both.add(t)
    keys, place, of = both.keys()
    for k, t in enumerate(told):
        alone = answer_defects.Contexts()
        alone.add(t)
        assert (alone.keys()[0] == keys[:, of == k]).all() and (place[of == k] == range(len(t) + 1)).all()
    same = answer_defects.Contexts()
    same.add(["The", "fan", "of", "Odo", "turns", "now"])
    # Content words are masked but for the last: of the five keys at "now" all agree.
    assert (same.keys()[0][:, -1] == keys[:, of == 0][:, -1]).all() and (same.keys()[0][0, -2] != keys[0, of == 0][-2])


def test_defects(spark):
    said = "The pump of Varna rests beside the wall after the night shift."
    good = [(100 + i, f"Why does pump {i} rest?", said) for i in range(6)]
    rows = good + [
        (1, "Why does it stop?", None), (2, "Why?", " \n"), (3, "Why?", "**N/A**"), (4, "Why does the pump stop at night?", "Q: why does the pump stop at night"),
        (5, "Why does the pump stop at night?", "I'm sorry, but I can't help with that request."), (6, "Why does the pump stop at night?", "Die Pumpe ist nach der Nachtschicht neben der Wand und wird geprüft."),
        (7, "Why does the pump stop at night?", "The pump of Varna rests beside the"), (8, "Why?", "Run this:\n```\npump --stop"), (9, "Why?", "No."), (10, "How much?", "73"),
        (11, "Why does the pump stop?", "The sources do not mention the pump."), (12, None, said), (1, "Why does it stop?", None), (13, "Why does the pump stop?", said[:-1]),
        (14, "Why does the pump stop?", 'The label reads “Die Pumpe ist nach der Nachtschicht neben der Wand.” beside the wall.'),
        (15, "Why does the pump stop at night?", "Why does the pump stop at night?\nWhy does the pump stop at night?"), (16, "Why does the pump stop?", said + " " + "The pump rests. " * 3000), (None, "q", None),
    ]
    df = frame(spark, [(*r, "clash") for r in rows], "request_id long, question string, answer string, defect string")
    got = [tuple(r) for r in answer_defects.defects(df, labelled(spark)).collect()]
    want = {1: "empty", 2: "empty", 3: "empty", 4: "copied_question", 5: "refusal", 6: "other_language", 7: "truncated", 8: "truncated", 15: "copied_question"}
    assert dict(got) == want and len(got) == len(want)
    assert answer_defects.defects(df.where("false"), labelled(spark)).count() == 0
    assert {r.request_id for r in answer_defects.defects(df, labelled(spark).where("false")).collect()} == set(want) - {6}


def test_long_refusals():
    no = "I'm sorry, but I can't help with that request."
    polite = "Thank you for your question about the pump beside the wall, and for telling me what the night shift saw there. I understand that the matter is urgent for all of you and that the pump should run again before the morning. "
    reason = " Requests of this kind touch the safety rules of the station, which only the manufacturer may interpret. Please contact your supervisor or a qualified engineer, who will look at the pump together with you."
    assert len(polite + no + reason) > 400 and answer_defects.is_refusal(polite + no + reason)
    assert answer_defects.is_refusal(polite * 30 + no + reason * 30)
    told = "The pump rests beside the wall after the night shift and starts again at dawn. "
    assert answer_defects.is_refusal(no) and not answer_defects.is_refusal(told * 40 + no) and not answer_defects.is_refusal(told * 40)


def test_lcs_and_containment():
    assert answer_defects.lcs("a b c d".split(), "b x d".split()) == 2
    assert answer_defects.contained("a b c".split(), "x a b c".split()) == 1.0


# --- 2 ---
def test_repeated_lines(spark):
    line = "Printed on page {} of this handbook"
    rows = [(f"c{i}", "d", line.format(i) + f"\nown line number of record {chr(97 + i) * 12}\n12345") for i in range(8)]
    rows += [("c0", "d", rows[0][2]), ("e1", "e", line.format(1)), ("n", "d", None), ("m", "d", ""), (None, "d", line.format(2)), ("k", None, line.format(2)), ("c8", "d", "PRINTED  on page 7 of THIS handbook\t"), ("long", "d", "x y " * 50_000 + "\n" + line.format(3))]
    df = frame(spark, [(*r, 1) for r in rows], "id string, doc_id string, text string, key int")
    got = sorted((r.key, r.line_no) for r in repeated_lines.repeated(df, "doc_id", "id", "text").collect())
    assert got == sorted([(f"c{i}", 1) for i in range(9)] + [("long", 2)])
    clean = {r.key: (r.text, r.removed) for r in repeated_lines.without_lines(df.where("id IS NOT NULL"), "doc_id", "id", "text").collect()}
    assert clean["c1"] == ("own line number of record bbbbbbbbbbbb\n12345", 1) and clean["e1"] == (line.format(1), 0) and clean["n"] == (None, 0) and clean["m"] == ("", 0)
    assert repeated_lines.repeated(df.where("false"), "doc_id", "id", "text").count() == 0


def test_trees_of_tasks_are_merged(spark):
    # Eight records over eight tasks; a general leaf takes lines that differ in one token.
    rows = [(f"c{i}", "d", f"Share this, dear reader: page {i}\nwritten, then: signed by {'abcdefgh'[i] * 12}, staff") for i in range(8)]
    df = frame(spark, rows, "id string, doc_id string, text string").repartition(8)
    assert {r.line_no for r in repeated_lines.repeated(df, "doc_id", "id", "text").collect()} == {1}
    got = repeated_lines.repeated(df.unionByName(df), "doc_id", "id", "text", general=True).collect()
    assert sorted((r.key, r.line_no) for r in got) == sorted((f"c{i}", n) for i in range(8) for n in (1, 2))
    trees = repeated_lines.Trees(False)
    for i in range(3):
        trees.add("d", [t for _, t in repeated_lines.templates(rows[i][2])])
    assert sorted(n for leaves in trees.nodes.values() for n in leaves.values()) == [1, 1, 1, 3]
    assert repeated_lines.path("ab,\0c")[0] == (4, "ab", ",")


def test_repeated_lines_same_as_sql(spark):
    from compare import both

    ours, theirs = both(spark, repeated_lines.found, repeated_lines.SQL_FOUND)
    assert ours == theirs and ours


# --- 3 ---
def test_scan_noise(spark):
    clean = "The container rests beside the northern corridor after the inspection of the station. " * 12
    page = "\n".join([
        "MARNE PUMP MANUAL  7", "The contairier rests beside the northern corridor after the inspec-", "tion of the station, and the container rests beside the low-", "pressure northern corridor after the",
        "inspection of the station. The c0ntainer rests beside the north-", "ern corridor after the inspection of", "the station.", "- 7 -",
    ])
    low = "the low-pressure station rests. " * 9
    rows = [("chunks", f"k{i}", "other-1", 1, clean + low) for i in range(3)] + [("page_transcripts", "p", "marne-pump-manual-3", 7, page)] * 2
    rows += [("chunks", "n", None, None, None), ("chunks", "e", "d", 1, ""), ("chunks", "one", "d", None, "x " * 100_000), ("chunks", "nums", "d", 4, "4\n5\n6")]
    df = frame(spark, [(*r, "x") for r in rows], "item_table string, item_key string, doc_id string, page int, value string, word string").drop("word")
    got = sorted((r.item_key, r.line_no, r.noise) for r in scan_noise.noise(df).select("item_key", "line_no", "noise").distinct().collect())
    assert got == sorted([("p", 1, "running_header"), ("p", 2, "misread"), ("p", 2, "broken_word"), ("p", 5, "misread"), ("p", 5, "broken_word"), ("p", 8, "page_number")])
    fixed = scan_noise.repair(df).collect()
    assert [r.item_key for r in fixed] == ["p"]
    assert fixed[0].text.startswith("The container rests beside the northern corridor after the inspection of the station, and") and "MARNE" not in fixed[0].text and "northern corridor after the inspection of the station." in fixed[0].text
    assert scan_noise.noise(df.where("false")).count() == 0


def test_misread_at_every_size(spark):
    clean = "The container rests beside the corridor and the operators rotate the handle. " * 2
    scan = "The {} rests beside the corridor and the operators\nwalk along the northern corridor until the {}\nstands beside the wall of the station and they\nrest there."
    rows = [(f"k{i}", f"d{i % 30}", clean) for i in range(60)]
    # Misread three times in 123; in one row that comes again; throughout a document with a third of the rows.
    rows += [(f"r{i}", f"s{i}", scan.format("handle", "r0tate")) for i in range(3)] + [("a", "s9", scan.format("handle", "operat0rs"))] * 20
    rows += [(f"m{i}", "hot", scan.format("contairier", "handle")) for i in range(30)]

    def misread(rows):
        df = frame(spark, [("chunks", k, d, 1, v) for k, d, v in rows], "item_table string, item_key string, doc_id string, page int, value string")
        return {(r.item_key, r.line_no) for r in scan_noise.noise(df).where("noise = 'misread'").collect()}

    want = {("r0", 2), ("r1", 2), ("r2", 2), ("a", 2)} | {(f"m{i}", 1) for i in range(30)}
    assert misread(rows) == want
    copies = [(f"{k}-{c}", f"{d}-{c}", v) for c in range(4) for k, d, v in rows]
    assert misread(copies) == {(f"{k}-{c}", n) for c in range(4) for k, n in want}
    # A word of its own stands in clean text too.
    assert ("r0", 2) not in misread([*rows, *((f"o{i}", f"e{i}", "The r0tate rests.") for i in range(4))])


def test_right_form_of_a_large_group(spark):
    # Four forms of one skeleton; the misread one comes from the least frequent.
    forms = {"briraris": 40, "briroris": 38, "brirolis": 36, "briralis": 30}
    assert len({scan_noise.skeleton(w) for w in [*forms, "6rira1i5"]}) == 1 and min(forms, key=lambda w: scan_noise.confusable(w, "6rira1i5") or 99) == "briralis"
    rows = [(f"{w}{i}", f"d{i}", f"The pump of {w} rests.") for w, n in forms.items() for i in range(n)]
    rows.append(("p", "d", "The container of 6rira1i5 rests beside the corridor and the operators\nwalk along the northern corridor until the handle\nstands beside the wall of the station and they\nrest there."))
    df = frame(spark, [("chunks", k, d, 1, v) for k, d, v in rows], "item_table string, item_key string, doc_id string, page int, value string")
    assert [(r.item_key, r.line_no, r.word, r.right) for r in scan_noise.noise(df).where("noise = 'misread'").collect()] == [("p", 1, "6rira1i5", "briralis")]


def test_headers_are_told_by_their_document(spark):
    # The title isn't in the doc_id; a chapter line has a title of its own.
    body = "The container rests beside the corridor and the operators\nwalk along the northern corridor until the handle\nstands beside the wall of the station and they\nrest there."
    rows = [(f"p{n}", "doc-0042", n, f"NORTH SEA HANDBOOK   {n}\n{body}") for n in range(1, 60)] + [(f"q{n}", None, n, f"Chapter {n} - Tides and Currents\n{body}") for n in range(1, 4)]
    rows += [("mid", "other", 1, body.replace("\nstands", "\nNorth Sea Readings Of June\nStands")), ("title", "other", 2, "North Sea Handbook")]
    df = frame(spark, [("chunks", *r) for r in rows], "item_table string, item_key string, doc_id string, page int, value string")
    got = {(r.item_key, r.line_no) for r in scan_noise.noise(df).where("noise = 'running_header'").collect()}
    assert got == {(f"p{n}", 1) for n in range(1, 60)} | {(f"q{n}", 1) for n in range(1, 4)}


def test_long_words_and_far_halves(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    clean = f"The {long} walks beside the corridor and the simple container rests. "
    between = "\n".join(["", "", "", "Page 7", "", "", "", ""])
    scan = f"The {long.replace('l', '1')} walks beside the corr-\n{between}\nidor and the simp|e container\nrests there while the operators walk on and\nrest there."
    rows = [(f"k{i}", f"d{i}", clean) for i in range(20)] + [("p", "d", scan)]
    df = frame(spark, [("chunks", k, d, 1, v) for k, d, v in rows], "item_table string, item_key string, doc_id string, page int, value string")
    assert {(r.line_no, r.noise, r.right) for r in scan_noise.noise(df).where("noise in ('misread', 'broken_word')").collect()} == {(1, "misread", long), (1, "broken_word", "corridor"), (10, "misread", "simple")}
    assert "simple container" in scan_noise.repair(df).first().text


def test_neighbours_choose_the_right_form(spark):
    # "ta1l" is as near to tall, the more frequent form, as to tail; but only tail stands between its neighbours.
    rows = [(f"a{i}", f"d{i}", "They are tall now.") for i in range(40)] + [(f"b{i}", f"d{i}", "The tail of repair rises.") for i in range(20)]
    rows.append(("p", "d", "The ta1l of repair rests beside the corridor and the operators\nwalk along the northern corridor until the handle\nstands beside the wall of the station and they\nrest there."))
    assert scan_noise.confusable("tall", "ta1l") == scan_noise.confusable("tail", "ta1l") == 1
    df = frame(spark, [("chunks", k, d, 1, v) for k, d, v in rows], "item_table string, item_key string, doc_id string, page int, value string")
    assert [(r.word, r.right) for r in scan_noise.noise(df).where("noise = 'misread'").collect()] == [("ta1l", "tail")]


def test_confusable():
    assert scan_noise.confusable("narrow", "riarrow") and scan_noise.confusable("delivers", "dehvers") and scan_noise.confusable("system", "5y5tem")
    assert not scan_noise.confusable("shaft", "shatf") and not scan_noise.confusable("pump", "pump") and not scan_noise.confusable("pump", "dump")
    assert scan_noise.skeleton("assembles") == scan_noise.skeleton("assernb1es")


# --- 4 ---
CASES = {"ﬁnal": "final", "a b": "a b", "Ｗｏｒｋ　１": "Work 1", "u​p": "up", "café": "café", "Mеtеr": "Meter", "ο one": "o one", "low‑grade": "low-grade", "жyрнал": "журнал", "Τrats": "Trats"}
SAME = ["café", "m² ½ …", "– “x” ’", "«журнал» и в", "(Δ below λ)", "«λόγος»", "С 1965 года", "tab\there", "", "x" * 100_000]


def test_canonical(spark):
    rows = [(k, "a") for k in [*CASES, *SAME, None]]
    df = frame(spark, rows, "value string, canonical string")
    got = {r.value: r.canonical for r in canonical.canonicalise(df).collect()}
    assert got == CASES | {s: s for s in SAME} | {None: None}
    assert all(lookalike.canonical(k) == v for k, v in got.items() if k is not None)
    assert all(lookalike.canonical(v) == v for v in CASES.values())
    assert canonical.canonicalise(df.where("false")).count() == 0 and canonical.canonicalise(df).columns == ["value", "canonical"]


def test_both_canonical_forms_agree(spark):
    base = "/root/testdata/sf0.01"
    values = None
    for name, column in (("chunks", "text"), ("chunks", "heading"), ("page_transcripts", "markdown"), ("documents", "text"), ("query_log", "answer"), ("golden", "passage")):
        one = spark.read.parquet(f"{base}/{name}.parquet").select(F.col(column).alias("value")).where(F.col("value").rlike(r"[^\x00-\x7F]"))
        values = one if values is None else values.unionByName(one)
    rows = canonical.canonicalise(values.distinct()).collect()
    assert len(rows) > 500 and all(lookalike.canonical(r.value) == r.canonical for r in rows)
    odd = "a\U000e0041b\U000e0101c\ufe0fd"  # tags and variation marks
    assert lookalike.canonical(odd) == "abcd" == canonical.canonicalise(frame(spark, [(odd,)], "value string")).first().canonical


# --- 5 ---
@pytest.mark.parametrize("text", ["word " * 3000, "x" * 9001, "A sentence ends. " * 900, "# H\n\npara one two\n\n" * 400, "a\n" * 5000, "é́" * 6000, "😀" * 4001])
def test_pieces_round_trip(text):
    p = splitting.pieces(text, "own")
    assert "".join(x[5][x[3] - x[1] :] for x in p) == text
    assert all(len(x[5]) <= 4000 for x in p) and [x[0] for x in p] == list(range(1, len(p) + 1))
    assert all(200 <= x[3] - x[1] <= 400 for x in p[1:])


def test_split(spark):
    text = "# First\n" + "word " * 700 + "\n## Second\n" + "word " * 700
    rows = [("chunks", "a", text, "own"), ("chunks", "a", text, "own"), ("chunks", "b", "x" * 4000, None), ("chunks", "c", None, None), ("chunks", "d", "", None), ("chunks", "e", "y" * 4001, None)]
    df = frame(spark, [(*r, 1) for r in rows], "item_table string, item_key string, value string, heading string, piece int")
    got = splitting.split(df).collect()
    assert {(r.item_key, r.piece_no) for r in got} == {("a", 1), ("a", 2), ("a", 3), ("e", 1), ("e", 2)} or {r.item_key for r in got} == {"a", "e"}
    heads = [r.heading for r in sorted(got, key=lambda r: r.piece_no) if r.item_key == "a"]
    assert heads[0] == "First" and heads[-1] == "Second" and all(r.heading == "" for r in got if r.item_key == "e")
    assert splitting.split(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, 100, 60)


def test_split_same_as_sql(spark):
    from compare import both

    ours, theirs = both(spark, splitting.found, splitting.SQL_FOUND)
    assert ours == theirs and ours


def test_templates():
    assert [n for n, _ in repeated_lines.templates("short\n1234567890\nabcdefghij")] == [3]
    assert re.sub("\0", "#", next(repeated_lines.templates("Page 12 34 of the book"))[1]) == "page#ofthebook"
