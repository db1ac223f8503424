"""Questions answered end to end: hits to prompts, prompts to models, replies to responses; drawings beside them.

Models are asked in the tasks, one prompt after the other, behind the provider interface; what they say comes back as JSON text
and is read by a schema in which everything may be missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folivane.functions.text import clean_dot, looks_like_dot, strip, text_or_empty, wants_drawing
from folivane.operators import answer
from folivane.providers import AllFailed, Chain
from folivane.settings import ANSWER, DEFAULT, DIAGRAM, Settings

RULES = "Answer from the excerpts and figures only, and say so if they don't hold the answer."
INTENT = 'Does this request ask for a new drawing? Reply as JSON: {"intent": "draw"} or {"intent": "find"}.\n\n'
DRAW = 'Draw what is asked for from these excerpts. Reply as JSON with "title", "dot" (Graphviz source) and "explanation".\n\n'
# Fixed values of a drawing.
TITLE, FORMAT, ORIGIN = "Generated diagram", "dot", "generated"


def checked(requests: DataFrame, question: str = "question") -> DataFrame:
    """``requests`` whose question isn't blank; a single blank one is refused by ``require_question``."""
    return requests.where(strip(text_or_empty(F.col(question))) != "")


def require_question(question: str | None) -> str:
    if not (question or "").strip():
        raise ValueError("the question is empty")
    return question


def ask(prompts: DataFrame, chain: Chain, needs_vision: bool = False, attempts: int = 1, fits: Callable[[dict], bool] | None = None, load: Callable[[str], bytes] | None = None) -> DataFrame:
    """``prompts`` (qid, prompt[, image_paths]) with (said, model, saw, failure): the reply as JSON text, who gave it, whether
    it came with images. A reply that doesn't fit is asked for again, up to ``attempts`` times. Images that can't be
    loaded are left out; without ``load`` none are sent."""
    with_images = load is not None and "image_paths" in prompts.columns
    given = prompts.select("qid", "prompt", *(["image_paths"] if with_images else []))

    def images_of(paths) -> list[bytes]:
        out = []
        for p in paths if paths is not None else []:
            try:
                out.append(load(p))
            except Exception:  # noqa: BLE001 - an unreadable figure is none
                continue
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, prompt in enumerate(part["prompt"]):
                images = images_of(part["image_paths"].iloc[k]) if with_images else []
                said = model = failure = None
                for _ in range(attempts):
                    try:
                        got, model = chain.ask_json(prompt, images or None, needs_vision)
                        said, failure = got, None
                        if fits is None or fits(got):
                            break
                        said, failure = None, "no reply fits"
                    except AllFailed as e:
                        said, failure = None, str(e)
                        break
                rows.append((None if said is None else chain.dump(said), model if said is not None else None, bool(images), failure))
            told = pd.DataFrame(rows, columns=["said", "model", "saw", "failure"])
            told.insert(0, "qid", part["qid"].to_numpy())
            yield told

    return given.mapInPandas(run, "qid long, said string, model string, saw boolean, failure string")


def intents(requests: DataFrame, chain: Chain) -> DataFrame:
    """(qid, draws) of ``requests`` (qid, question): only questions with a drawing word are put to a model, and one that can't
    be asked means no."""
    hinted = requests.select("qid", "question", wants_drawing(F.col("question")).alias("hint"))
    asked = ask(hinted.where("hint").select("qid", F.concat(F.lit(INTENT), "question").alias("prompt")), chain)
    said = asked.select("qid", (F.lower(strip(text_or_empty(F.get_json_object("said", "$.intent")))) == "draw").alias("yes"))
    return hinted.join(said, "qid", "left").select("qid", F.coalesce("yes", F.lit(False)).alias("draws"))


def _draws(reply: dict) -> bool:
    source = str(reply.get("dot") or "").strip()
    return "digraph" in source and source.count("{") == source.count("}") > 0


def diagrams(requests: DataFrame, hits: DataFrame, chain: Chain, settings: Settings = DEFAULT) -> DataFrame:
    """(qid, diagram) of the requests that ask for a drawing and get one: title, format, source, explanation, model, origin and
    the pages of the excerpts. Replies without usable source are asked for once more."""
    wanted = intents(requests, chain).where("draws").select("qid")
    first = (F.col("kind") == "text") & (F.col("kind_rank") <= settings.diagram_chunks)
    own = hits.join(wanted, "qid", "left_semi")
    pages = own.groupBy("qid").agg(F.sort_array(F.collect_set(F.when(first, F.col("page")))).alias("pages_used"))
    context = answer.diagram_context(own, settings)
    prompts = requests.join(wanted, "qid", "left_semi").join(context, "qid").select("qid", F.concat(F.lit(DRAW), "context", F.lit("\n\nRequest: "), "question").alias("prompt"))
    drawn = ask(prompts, chain, attempts=2, fits=_draws).where("said IS NOT NULL").withColumn("d", F.from_json("said", DIAGRAM))
    source = clean_dot(F.col("d.dot"))
    made = drawn.where(looks_like_dot(source)).join(pages, "qid")
    one = F.struct(F.coalesce("d.title", F.lit(TITLE)).alias("title"), F.lit(FORMAT).alias("format"), source.alias("source"), text_or_empty(F.col("d.explanation")).alias("explanation"), "model", F.lit(ORIGIN).alias("origin"), "pages_used")
    return made.select("qid", one.alias("diagram"))


def answer_questions(requests: DataFrame, hits: DataFrame, chain: Chain, rules: str = RULES, attach: bool = True, draw: bool = True, load: Callable[[str], bytes] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The responses to ``requests`` (qid, question) with ``hits`` (see answer.prompts, with id, image_path, score and found_by):
    what answer.shaped gives, with the question, the intent ('draw' if a drawing was made) and the drawing. Blank questions
    get none; where no model answers, failure says why and the answer is ''."""
    asked = checked(requests.select("qid", "question"))
    own = asked.join(hits.drop("question"), "qid", "left")
    paths = F.expr("transform(sort_array(collect_list(CASE WHEN kind = 'image' AND image_path IS NOT NULL THEN struct(kind_rank, image_path) END)), x -> x.image_path)")
    prompts = answer.prompts(own, rules, settings).join(own.groupBy("qid").agg(paths.alias("image_paths")), "qid")
    said = ask(prompts, chain, load=load if attach else None)
    read = said.select("qid", F.from_json("said", ANSWER).alias("a"), "model", "saw", "failure").select("qid", "a.*", "model", F.col("saw").alias("attached"), "failure")
    out = answer.shaped(read, own.where("kind IS NOT NULL")).join(read.select("qid", "failure"), "qid").join(asked, "qid")
    if draw:
        out = out.join(diagrams(asked, own, chain, settings), "qid", "left")
    else:
        out = out.withColumn("diagram", F.lit(None))
    return out.withColumn("intent", F.when(F.col("diagram").isNotNull(), "draw").otherwise("find"))
