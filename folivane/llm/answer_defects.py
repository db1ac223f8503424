"""Problem 1: question-answer pairs that don't serve, each with its defect type.

Copies are found by aligning question and answer tokens: shingle containment in both directions, then the longest common
subsequence. Refusals are found by aligning the answer's clauses with refusal templates in the same way. Languages are told
by a model of character trigrams that is fitted on a bounded sample of labelled texts. For breaks in mid-sentence the corpus
says how sentences end: over all answers it is counted how often each context (the last words, content words masked) is
followed by the end of its sentence, and an answer's last words are held against that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from xxhash import xxh3_64_intdigest

from folivane.llm.lookalike import canonical
from folivane.plans.filters import key_filter, may_hold
from folivane.plans.sizing import maybe_broadcast
from folivane.plans.storage import cut
from folivane.sources.tables import table

# What stands for nothing.
PLACEHOLDERS = {
    "n/a", "na", "none", "null", "nil", "nan", "undefined", "empty", "blank", "tbd", "tba", "todo", "missing", "placeholder", "-", "no data", "no answer", "(no answer)", "[no answer]", "no response", "not available",
    "not applicable", "not answered", "unknown answer", "keine antwort", "k. a.", "k.a.", "sans réponse", "aucune réponse", "sin respuesta", "ninguna respuesta", "нет ответа",
}
LABEL_WORDS = [
    "answer", "response", "reply", "a", "antwort", "réponse", "respuesta", "ответ", "question", "q", "query", "frage", "pregunta", "вопрос", "you asked", "your question", "the question was", "sie fragten", "vous avez demandé",
    "preguntaste", "usted preguntó",
]
# Function words; the others are masked in contexts.
FUNCTION = {
    "en": "the a an of and or to in on at for with by from as is are was were be been it its that which who this these those if when while after before because not no must may can will should how what why where once until there their each every than so into through during without between neither nor all any both over under within beside behind along across around near outside inside more he she they we you i my your our do does did has have had but about among them two one",
    "de": "der die das ein eine einer eines einem einen und oder zu in im an am auf für mit von vom bei aus als ist sind war wird werden wurde sein es dass welche wer dieser diese dieses wenn während nach vor weil nicht kein nur muss darf kann soll wie was warum wo bis ihre jede jeder jedes jeden durch zwischen ohne unter über neben hinter seit laut mehr sich den dem des er sie wir ihr ich mein dazu kurz wann alle außerdem sofern gilt zur zum so auch",
    "fr": "le la les l un une des du de d et ou à au aux en dans sur pour avec par ce cette ces est sont était être il elle on que qui qu quoi si quand lorsque après avant parce ne pas non seul seule doit peut comment pourquoi où jusqu son sa ses leur chaque entre sans sous depuis selon plus nous vous je mon ma puis fait faut y s n c j sauf soit près mais toutes tous très cela",
    "es": "el la los las un una unos unas de del y o a al en para con por este esta estos es son era ser se que quien qué si cuando después antes porque no solo debe puede cómo por cuál dónde hasta su sus cada entre sin bajo desde según más nosotros usted yo mi lo le hay está esté queda junto pero muy todo todas fuera",
    "ru": "и в во не на я с со как а то все она так его но да к у же вы за бы по только её мне было вот от меня ещё нет о из ему когда даже ну если или до через под за это при после более снова",
}
REFUSALS = """
i am sorry but i can not help with that
i am sorry i can not assist with this request
sorry i will not be able to answer this
i am unable to assist with this question
i am not able to answer this question
i can not help with the *
i can not provide guidance on the *
i will not be giving advice about the *
i must decline to comment on the *
i have to decline this request
i must decline to answer
i have chosen not to answer this one
i prefer not to answer this
i do not feel comfortable answering this
that is not something i am allowed to discuss
this is a subject i have been asked to avoid
it is not possible for me to respond to this kind of question
my role does not allow me to comment here
my guidelines do not permit me to respond to questions of this type
answering this would go against the rules i operate under
this falls outside what i may answer so i will stop here
no comment on that from my side
it is better if i leave the * to a qualified person
i am not permitted to discuss this
i will not discuss this topic
i would rather not say
i would rather not answer that
that request is something i have to turn down
i have to turn this request down
i am going to pass on this question
i must refuse to answer this
i can not answer that question
i can not comment on this matter
as an assistant i can not * 
as a language model i can not *
es tut mir leid dabei kann ich nicht helfen
diese frage darf ich leider nicht beantworten
dazu möchte ich mich nicht äußern
ich kann diese frage leider nicht beantworten
darüber darf ich keine auskunft geben
je suis désolé je ne peux pas répondre à cette question
il ne m est pas permis de traiter ce sujet
je préfère ne pas me prononcer là dessus
je ne peux pas vous aider
lo siento no puedo ayudar con eso
no me está permitido responder a esta pregunta
prefiero no opinar sobre este asunto
no puedo responder a esta pregunta
извините я не могу ответить на этот вопрос
мне нельзя отвечать на этот вопрос
я не могу с этим помочь
""".strip().split("\n")
# Heads of refusals, each followed by one of the words for what is refused.
HEADS = """
i am not able to
i am unable to
i can not
i am not permitted to
i am not allowed to
i am not in a position to
it would not be appropriate for me to
it is not possible for me to
i would rather not
i prefer not to
i must decline to
i have to decline to
i must refuse to
i will not
i do not want to
i have been asked not to
""".strip().split("\n")
REFUSED = """
discuss the *
talk about the *
speak about the *
comment on the *
advise on the *
give advice about the *
give an answer about the *
provide guidance on the *
provide information about the *
answer the question
answer questions about the *
respond to the question
help with the *
assist with the *
share details about the *
offer an opinion on the *
say anything about the *
""".strip().split("\n")
# Words of the courtesies, reasons and referrals that come with a refusal, by their beginnings; what has none of them and
# isn't in the first person is content.
ASIDES = "thank question request message topic subject apolog sorry regret understand appreciat honest please contact consult advis advice assist help supervisor manufacturer engineer specialist professional expert qualified policy policies rule guideline instruct permi allow danke frage bitte leider fachkraft hersteller richtlinie regel verständnis merci demande question désolé responsable règle consigne gracias pregunta favor siento consulte responsable fabricante regla norma спасибо вопрос пожалуйста извин обратитесь правил специалист"
# Labels that name no language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "")
# End of the fixed values.

FIRST_PERSON = {"i", "me", "my", "mir", "ich", "mich", "je", "m", "me", "puedo", "prefiero", "siento", "я", "мне"}
_WORD = re.compile(r"[^\W_]+")
_CONTRACTED = [(re.compile(p), r) for p, r in ((r"\bcan['’]t\b|\bcannot\b", "can not"), (r"\bwon['’]t\b", "will not"), (r"n['’]t\b", " not"), (r"['’]m\b", " am"), (r"\bthat['’]s\b", "that is"), (r"['’]d\b", " would"), (r"['’]ll\b", " will"), (r"['’]ve\b", " have"), (r"\bit['’]s\b", "it is"))]
_ALL = {w for ws in FUNCTION.values() for w in ws.split()}
_ASIDE = re.compile(r"\b(?:" + "|".join(ASIDES.split()) + ")")
_LABELS = [tuple(x.split()) for x in LABEL_WORDS]
_LABEL = re.compile(rf"^[\s>*_#\"“«'-]*(?:{'|'.join(LABEL_WORDS)})\s*(?:\*\*|__)?\s*(?:[:–—]|-(?=\s))[\s*_]*", re.I)
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]*\"|„[^“”]*[“”]|```.*?(?:```|$)|`[^`]*`", re.S)


def tokens(text: str) -> list[str]:
    text = canonical(text).lower()
    for p, r in _CONTRACTED:
        text = p.sub(r, text)
    return _WORD.findall(text)


def lcs(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def contained(a: list[str], b: list[str], k: int = 2) -> float:
    """The share of the runs of ``k`` tokens of ``a`` that ``b`` has too."""
    k = min(k, len(a)) or 1
    of = lambda t: Counter(zip(*(t[i:] for i in range(k))))
    x, y = of(a), of(b)
    return sum(min(n, y[s]) if s in y else 0 for s, n in x.items()) / max(1, sum(x.values()))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    left = canonical(answer).strip()
    left = _LABEL.sub("", left + " ").strip() if _LABEL.match(left + " ") else left
    if not _WORD.search(left):
        return True
    bare = left.strip(" \t\n.:;*_`'\"()[]{}<>-–—").lower()
    return bare in PLACEHOLDERS or left.strip(" .").lower() in PLACEHOLDERS


def is_copy(question: str, answer: str) -> bool:
    """Nothing but the question: once or several times over, labelled, or with a few words changed."""
    q = tokens(question)
    if len(q) < 2:
        return False
    a, p = tokens(_LABEL.sub("", answer)), 0
    while len(a) - p > 1.5 * len(q) and contained(q, a[p : p + len(q)]) > 0.5:  # doubled: look at what follows the first copy
        then = p + len(q)
        label = max((len(x) for x in _LABELS if tuple(a[then : then + len(x)]) == x), default=0)
        if contained(a[then : then + len(q)], q) < 0.5 and contained(a[then + label : then + label + len(q)], q) < 0.5:
            break
        p = then
    n = len(a) - p
    if not 0.6 * len(q) <= n <= 1.35 * len(q) + 2 or contained(a[p:], q) < 0.5 and contained(q, a[p:]) < 0.5:
        return False
    same = lcs(a[p:], q)
    return same >= 0.75 * len(q) and same >= 0.75 * n


_TEMPLATES = [[w for w in t.split() if w != "*"] for t in (*REFUSALS, *(f"{h} {r}" for h in HEADS for r in REFUSED))]
_OWN = [(t, frozenset(t)) for t in _TEMPLATES]


def _refuses(c: list[str]) -> bool:
    """A clause's tokens align with a refusal template; what an answer states about pages doesn't."""
    if len(c) < 3 or not FIRST_PERSON & set(c) and not {"comment"} & set(c) or {"page", "pages", "seite", "seiten", "página", "páginas"} & set(c):
        return False
    own = set(c)
    for sure, kinds in _OWN:
        if len(kinds & own) < 0.8 * len(kinds) or contained(sure, c) < 0.5 and contained(c, sure) < 0.5:
            continue
        if lcs(sure, c) >= 0.8 * len(sure) and (len(sure) > 3 or len(c) < 8):
            return True
    return False


def is_refusal(answer: str) -> bool:
    """A clause of the answer refuses, and the clauses with content aren't the greater part of it, by their tokens: what is
    neither refused nor said in the first person nor a courtesy, a reason or a referral."""
    clauses = [c for s in re.split(r"(?<=[.!?])\s+|;\s|\n", _QUOTED.sub(" ", answer)) if (c := tokens(s))]
    refusing = [_refuses(c) for c in clauses]
    if not any(refusing):
        return False
    content = sum(len(c) for c, no in zip(clauses, refusing) if not no and not FIRST_PERSON & set(c) and not _ASIDE.search(" ".join(c)))
    return 2 * content <= sum(map(len, clauses))


# --- languages -------------------------------------------------------------------------------------------------------

#: Labelled texts of each language that the model is fitted on, at most, and the least; pairs that it is adapted to, at most.
SAMPLE, FEWEST, PAIRS = 400, 5, 6000
#: By how much a text of one language must be likelier than one of another, as logarithm of the ratio; for a whole answer, and
#: for one sentence of it.
SURE, SURE_SENTENCE = 8.0, 5.0
#: Trigrams of all languages together that each language's own are smoothed with.
POOL = 2000.0
_LETTERS = re.compile(r"[^\W\d_]+")


def telling(text: str) -> list[str]:
    """The words that tell a text's language, in lower case: capitalised ones within sentences are often names, which say
    little, and are left out if others are there."""
    ws = _LETTERS.findall(text)
    return [w for w in ws if w[0].islower()] or [w.lower() for w in ws]


def trigrams(word: str) -> list[str]:
    """The character trigrams of a word, its begin and end marked."""
    p = f" {word.lower()} "
    return [p[i : i + 3] for i in range(len(p) - 2)]


class Languages:
    """Naive Bayes over character trigrams, smoothed by those of all languages together."""

    def __init__(self, labelled: list[tuple[str, str]]):
        self.labelled = labelled
        counts: dict[str, Counter] = {}
        for lang, text in labelled:
            counts.setdefault(lang, Counter()).update(g for w in telling(canonical(text)) for g in trigrams(w))
        self.names = sorted(counts)
        pooled: Counter = Counter()
        for own in counts.values():
            pooled.update(own)
        whole, size = sum(pooled.values()), np.array([sum(counts[n].values()) for n in self.names])
        self.known = {g: np.log((np.array([counts[n][g] for n in self.names]) + POOL * k / whole) / (size + POOL)) for g, k in pooled.items()}
        self.words: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 100_000:
                self.words.clear()
            got = self.words[word] = sum((v for g in trigrams(word) if (v := self.known.get(g)) is not None), np.zeros(len(self.names)))
        return got

    def scores(self, text: str) -> np.ndarray:
        """The log-likelihood of ``text`` in each language. What no language has says nothing."""
        out = np.zeros(len(self.names))
        for w, n in Counter(telling(text)).items():
            out += n * self._word(w)
        return out


def adapted(model: Languages, pairs: list[tuple[str, str]]) -> Languages:
    """``model`` fitted on question-answer pairs too, each under the language that its question surely has: by far most
    answers are in that language, and the model learns how such pairs are worded."""
    more = list(model.labelled)
    for q, a in pairs:
        s = np.sort(model.scores(canonical(q or "")))
        if len(s) > 1 and s[-1] - s[-2] >= SURE:
            more.append((model.names[int(model.scores(canonical(q)).argmax())], f"{q} {a or ''}"))
    return Languages(more)


def is_other_language(model: Languages, question: str, answer: str) -> bool:
    """The whole answer is surely in another language than the question; quotations don't count."""
    if len(model.names) < 2 or not question:
        return False
    said = canonical(_QUOTED.sub(" ", answer))
    q, a = model.scores(canonical(_QUOTED.sub(" ", question))), model.scores(said)
    own, other = int(q.argmax()), int(a.argmax())
    if own == other or a[other] - a[own] < SURE or q[own] - q[other] < SURE / 2:
        return False
    for sentence in re.split(r"(?<=[.!?])\s+|\n", said):
        s = model.scores(sentence)
        if s[own] - s[other] >= SURE_SENTENCE:
            return False
    return True


# --- breaks ---------------------------------------------------------------------------------------------------------

#: Last words of a context, and whether its last word is kept as it is; the first one that occurs often enough decides.
CONTEXTS = ((9, True), (6, True), (9, False), (6, False), (4, True))
_PIECE = re.compile(r"[^\W_]+(?:[-’'][^\W_]+)*|[,;:()]")
_REFERENCE = re.compile(r"(?:\s*\[[A-Z]?\d+\]|\s*\((?:p|page|seite|página)\.? ?\d+\)|\s*(?:see page|siehe seite|voir page|voir la page|véase página|véase la página|vgl\. seite|page|seite|página) \d+\.?)\s*$", re.I)
_FINAL = re.compile(r"[.!?…][\"'”»)\]*_]*$")
DANGLING = set("the a an of and or to for with by from as that which if when while because nor than into between der die das ein eine einer einem einen und oder zu für mit von dass wenn weil le la les un une des du de et ou à pour avec par que qui si el los las del y o con por".split())


def sentences(answer: str) -> Iterator[tuple[str, bool]]:
    """(sentence, whether it ends with its mark or line)."""
    text = re.sub(r"```.*?```", "\n", answer, flags=re.S)
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s+", "", line).strip()
        parts = re.split(r"(?<=[.!?])\s+(?=[\w¿¡«“])", line)
        for p in parts:
            if p:
                yield _REFERENCE.sub("", p), bool(_FINAL.search(p))


_START = "^"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([xxh3_64_intdigest(f"place {k}") | 1 for k in range(16)], "u8")


class Contexts:
    """The contexts of words as 64-bit keys, for many sentences at once."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int]] = {}
        self.masks: list[int] = []
        self.words: list[int] = []
        self.begin = [0]

    def add(self, pieces: list[str]) -> None:
        """A sentence. Function words stand as they are, numbers as 0, capitalised words as N, others as *."""
        start = _hash(_START)
        self.masks.append(start)
        self.words.append(start)
        for k, w in enumerate(pieces):
            got = self.known.get(w)
            if got is None:
                low = w.lower()
                plain = w if not w[0].isalnum() else low if low in _ALL else "0" if w.isdigit() else None
                first, later = plain or "*", plain or ("N" if w[0].isupper() else "*")
                got = self.known[w] = (_hash(first), _hash(later), _hash(low))
            mask = got[k > 0]
            self.masks.append(mask)
            self.words.append(got[2] if mask == _STAR else mask)
        self.begin.append(len(self.masks))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, place in its sentence, sentence) of each place, a row of ``keys`` for each of CONTEXTS: the last words up to
        there, of which the very last is kept as it is or masked too."""
        mask, word = np.array(self.masks, "u8"), np.array(self.words, "u8")
        size = np.diff(self.begin)
        place = np.arange(len(mask)) - np.repeat(self.begin[:-1], size)
        out = np.zeros((len(CONTEXTS), len(mask)), "u8")
        for level, (n, kept) in enumerate(CONTEXTS):
            key = (word if kept else mask) * _FACTORS[0]
            for k in range(1, n):
                key[k:] += np.where(place[k:] >= k, mask[:-k] * _FACTORS[k], 0)
            key ^= key >> np.uint64(29)
            out[level] = (key + np.uint64(level + 1)) * _MIX
        return out, place, np.repeat(np.arange(len(size)), size)


def _hash(word: str) -> int:
    return xxh3_64_intdigest(word)


_STAR = _hash("*")


def open_end(answer: str) -> str | None:
    """The last sentence of an answer, if nothing but its words can tell whether it is whole; '' if it surely breaks off;
    None if it ends well."""
    text = canonical(answer).rstrip()
    if text.count("```") % 2:
        return ""
    if text.endswith("```") or _FINAL.search(text) and not text.endswith((" …", "...")):
        return None
    while m := _REFERENCE.search(text):
        if not text[: m.start()].strip():
            return None
        text = text[: m.start()].rstrip()
        if _FINAL.search(text):
            return None
        break
    if _FINAL.search(text) and not text.endswith((" …", "...")):
        return None
    last = text.split("\n")[-1]
    if re.fullmatch(r"\s*(?:[-*•]|\d+[.)])\s*", last) or text[-1] in ",;:(-–—":
        return ""
    bare = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s+", "", last)
    parts = re.split(r"(?<=[.!?])\s+(?=[\w¿¡«“])", bare)
    s = parts[-1].strip()
    ws = _WORD.findall(s)
    if not ws or re.fullmatch(r"[\d.,]+( ?[^\W\d_]+)?", s) or s.startswith("|"):
        return None
    if s.count("(") > s.count(")") or ws[-1].lower() in DANGLING and len(ws) > 1:
        return ""
    if len(ws) < 3:
        return "" if len(text.split("\n")) > 1 or len(parts) > 1 else None
    return s


def _judge(model):
    """Each pair with its defect, or with its last sentence's contexts and last word if only the corpus can tell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = model.value
        for batch in batches:
            defects, words, said, of = [], [], Contexts(), []
            for k, (q, a) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                defect, word, q = None, None, q or ""
                if is_empty(a):
                    defect = "empty"
                elif is_copy(q, a):
                    defect = "copied_question"
                elif is_refusal(a):
                    defect = "refusal"
                elif is_other_language(languages, q, a):
                    defect = "other_language"
                else:
                    end = open_end(a)
                    if end == "":
                        defect = "truncated"
                    elif end:
                        said.add(_PIECE.findall(end))
                        of.append(k)
                        word = _hash(_WORD.findall(end)[-1])
                defects.append(defect)
                words.append(word)
            contexts: list = [None] * len(defects)
            if of:
                told = said.keys()[0][:, np.array(said.begin[1:]) - 1].view("i8").T.tolist()
                for k, own in zip(of, told):
                    contexts[k] = own
            signed = [None if w is None else w - (1 << 64) if w >> 63 else w for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(defects, pa.string()), pa.array(contexts, pa.list_(pa.int64())), pa.array(signed, pa.int64())], ["request_id", "defect", "contexts", "word"])

    return run


#: The level of whole words beside those of CONTEXTS.
WORD = len(CONTEXTS)


def _endings(wanted):
    """(level, key, n, ends): how often each context stands in sentences and how often it ends them, how often each word
    stands; of keys that the filter lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = wanted.value
        for batch in batches:
            said, count, words = Contexts(), [], []
            for a in batch.column(0).to_pylist():
                own = list(sentences(canonical(a)))
                for at, (s, marked) in enumerate(own):
                    unsure = at == len(own) - 1 and not marked  # whether this one is whole is the question
                    said.add(_PIECE.findall(s))
                    count.append(not unsure)
                    ws = _WORD.findall(s)
                    words += map(_hash, ws[: len(ws) - unsure])
            if not count:
                continue
            keys, place, sentence = said.keys()
            end = place == np.diff(said.begin)[sentence] - 1
            use = (place >= 3) & (~end | np.array(count)[sentence])
            for level in range(WORD + 1):
                key, ends = (keys[level][use], end[use]) if level < WORD else (np.array(words, "u8"), np.zeros(len(words), bool))
                found = may_hold(asked, key)
                key, ends = key[found], ends[found]
                kinds, at, n = np.unique(key, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), level, "i4")), pa.array(kinds.view("i8")), pa.array(n.astype("i8")), pa.array(np.bincount(at, ends, len(kinds)).astype("i8"))], ["level", "key", "n", "ends"])

    return run


def fit_languages(labelled: DataFrame) -> Languages:
    """The model of languages of at most SAMPLE texts of each label of ``labelled`` (lang, text), chosen by hash; labels of
    fewer than FEWEST texts are left out. Null and empty texts and null labels say nothing."""
    given = labelled.where("lang IS NOT NULL AND length(text) > 0").where(~F.col("lang").isin(*NO_LANGUAGE)).select("lang", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = given.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
    kept = chosen.withColumn("most", F.count("*").over(Window.partitionBy("lang"))).where(F.col("most") >= FEWEST).select("lang", "h").distinct()
    kept = maybe_broadcast(cut(kept), 40)
    texts = labelled.where("length(text) > 0").withColumn("h", F.xxhash64("text")).join(kept, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return Languages([(r.lang, r.text) for r in texts.collect()])  # SAMPLE rows for each language


def defects(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(request_id, defect) of the defective ones of ``pairs`` (request_id BIGINT, question, answer); ``labelled`` (lang, text)
    has texts to tell languages by.

    A null or blank answer is ``empty``, a null question is like an empty one (nothing can copy it or be in another
    language). A request that occurs twice counts once. Texts of any length are judged whole. Without labelled texts of two
    languages no answer is in another one. Other columns are ignored.
    """
    spark = pairs.sparkSession
    once = pairs.where("request_id IS NOT NULL").select(F.col("request_id").cast("long").alias("request_id"), "question", "answer").groupBy("request_id").agg(F.min(F.struct("question", "answer")).alias("p")).select("request_id", "p.question", "p.answer")
    sample = once.orderBy(F.xxhash64("request_id"), "request_id").limit(PAIRS).select("question", "answer").collect()
    told = adapted(fit_languages(labelled), [tuple(r) for r in sample])
    told.labelled = []
    model = spark.sparkContext.broadcast(told)
    judged = cut(once.mapInArrow(_judge(model), "request_id long, defect string, contexts array<long>, word long"))
    sure = judged.where("defect IS NOT NULL").select("request_id", "defect")
    open_ = judged.where("contexts IS NOT NULL")
    asked = cut(open_.select("request_id", F.posexplode(F.array_append("contexts", F.col("word"))).alias("level", "key")))
    kinds = cut(asked.select("level", "key").distinct())
    wanted = spark.sparkContext.broadcast(key_filter(kinds, F.col("key")))
    corpus = once.where("answer IS NOT NULL").select("answer").mapInArrow(_endings(wanted), "level int, key long, n long, ends long")
    told = cut(corpus.groupBy("level", "key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).join(maybe_broadcast(kinds, 40), ["level", "key"], "left_semi"))
    seen = asked.join(maybe_broadcast(told, 40), ["level", "key"], "left").groupBy("request_id").agg(
        *[F.max(F.when(F.col("level") == k, F.col(c))).alias(f"{c}{k}") for k in range(WORD) for c in ("n", "ends")],
        F.max(F.when(F.col("level") == WORD, F.col("n"))).alias("word_n"),
    )
    share = F.lit(None).cast("double")
    for k in range(WORD - 1, -1, -1):
        share = F.when(F.coalesce(F.col(f"n{k}"), F.lit(0)) >= 3, F.col(f"ends{k}") / F.col(f"n{k}")).otherwise(share)
    unknown = F.coalesce("word_n", F.lit(0)) == 0
    broken = seen.where((F.coalesce(share, F.lit(0.0)) < 0.5) | unknown).select("request_id", F.lit("truncated").alias("defect"))
    return sure.unionByName(broken)


def found(spark: SparkSession, base: str) -> DataFrame:
    return defects(table(spark, base, "query_log", "request_id", "question", "answer"), table(spark, base, "documents", "lang", "text"))
