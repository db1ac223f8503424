"""Models behind a small interface: ordered fallback, caches, and deterministic stand-ins for tests and queries."""

from __future__ import annotations

import io
import json
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import blake2b
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folivane.plans.storage import exists
from folivane.settings import DEFAULT, Settings


class Provider(Protocol):
    name: str
    sees_images: bool

    def ask(self, prompt: str, images: Sequence[bytes] | None = None) -> str: ...


class AllFailed(RuntimeError):
    """No provider answered; the message has each one's failure."""


@dataclass
class Chain:
    """Providers asked in order until one gives an answer that isn't empty."""

    providers: Sequence[Provider]

    def ask(self, prompt: str, images: Sequence[bytes] | None = None, needs_vision: bool = False, read: Callable[[str], object] = str) -> tuple[object, str]:
        failures = []
        for p in self.providers:
            if needs_vision and not p.sees_images:
                continue
            try:
                said = p.ask(prompt, images if p.sees_images else None)
                if not said:
                    raise ValueError("empty reply")
                return read(said), p.name
            except Exception as e:  # noqa: BLE001 - any failure leads to the next one
                failures.append(f"{p.name}: {e}")
        raise AllFailed("; ".join(failures) or "no provider fits")

    @staticmethod
    def dump(said: dict) -> str:
        return json.dumps(said, ensure_ascii=False)

    def ask_json(self, prompt: str, images: Sequence[bytes] | None = None, needs_vision: bool = False) -> tuple[dict, str]:
        return self.ask(prompt, images, needs_vision, json.loads)  # type: ignore[return-value]


@dataclass
class Scripted:
    """A provider that answers by a function of the prompt."""

    name: str = "scripted"
    sees_images: bool = True
    answer: Callable[[str], str] = lambda prompt: json.dumps({"answer": prompt[-80:], "used_image_ids": [], "used_pages": []})
    asked: list[str] = field(default_factory=list)

    def ask(self, prompt: str, images: Sequence[bytes] | None = None) -> str:
        self.asked.append(prompt)
        return self.answer(prompt)


def hashed_vector(text: str, dim: int) -> list[float]:
    """A deterministic embedding: words hashed to signed dimensions, at length 1."""
    v = [0.0] * dim
    for w in text.lower().split():
        h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def wait_seconds(failure: object, fallback: float) -> float:
    """How long to wait after a failure: as long as the service says and two seconds more, but 120 at most, or the fallback."""
    said = re.search(r"retry in ([0-9.]+)\s*s", str(failure), re.I)
    return min(float(said.group(1)) + 2.0, 120.0) if said else fallback


#: A model of texts: their vectors for a task, 'document' or 'query', which a model may embed differently.
Model = Callable[[list[str], str], list[list[float]]]


def embed(rows: DataFrame, text: str, dim: int, batch: int = 16, pause: float = 0.0, attempts: int = 6, model: Model | None = None, task: str = "document", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with a vector of length 1 of each text. A failing batch is tried again, after as long as the service says or
    1, 2, 4, ... seconds, never with another model, since vectors of different models can't be compared. ``pause`` seconds
    pass between batches."""
    model = model or (lambda texts, task: [hashed_vector(t, dim) for t in texts])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list[list[float]] = []
            texts = part[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                for n in range(attempts):
                    try:
                        got = model(texts[i : i + batch], task)
                        break
                    except Exception as e:
                        if n == attempts - 1:
                            raise
                        sleep(wait_seconds(e, 2.0**n))
                if any(len(v) != dim for v in got):
                    raise ValueError(f"vectors of other than {dim} dimensions")
                vectors += [[x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for v in got]
                if pause:
                    sleep(pause)
            yield part.assign(vector=vectors)

    schema = rows.withColumn("vector", F.array(F.lit(0.0))).schema
    return rows.mapInPandas(run, schema)


def missing(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't in the cache yet. An empty result that is cached counts as there."""
    return wanted.join(cache.where("result IS NOT NULL").select(*keys), keys, "left_anti")


def figure_prompt(template: str, context: Column, settings: Settings = DEFAULT) -> Column:
    """``template`` with the beginning of the text around a figure in place of ``{context}``."""
    before, _, after = template.partition("{context}")
    return F.concat(F.lit(before), F.substring(F.coalesce(context, F.lit("")), 1, settings.context_chars), F.lit(after))


def ask_missing(wanted: DataFrame, cache: DataFrame, keys: list[str], ask: Callable[[str], str]) -> DataFrame:
    """The cache with an answer for every row of ``wanted`` (keys, prompt). Prompts are asked whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[keys].assign(result=part["prompt"].map(ask))

    new = missing(wanted, cache, keys).mapInPandas(run, wanted.select(*keys).withColumn("result", F.lit("")).schema)
    return cache.select(*keys, "result").unionByName(new)


def answers(wanted: DataFrame, cache: DataFrame, keys: list[str], chain: Chain, pause: float = 0.0) -> DataFrame:
    """The cache with what a provider that sees says of every image of ``wanted`` (keys, prompt, image) that isn't in it,
    ``pause`` seconds apart. An image that no provider can be asked about has a null result and isn't cached."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said = []
            for prompt, image in zip(part["prompt"], part["image"]):
                try:
                    said.append(chain.dump(chain.ask_json(prompt, [bytes(image)], needs_vision=True)[0]))
                except AllFailed:
                    said.append(None)
                if pause:
                    time.sleep(pause)
            yield part[keys].assign(result=said)

    new = missing(wanted, cache, keys).mapInPandas(run, wanted.select(*keys).withColumn("result", F.lit(None).cast("string")).schema)
    return cache.select(*keys, "result").unionByName(new)


def keep_answers(spark: SparkSession, wanted: DataFrame, path: str, keys: list[str], chain: Chain, blocks: int = 1, pause: float = 0.0) -> DataFrame:
    """``answers`` for a cache of parquet files at ``path``, written after each of ``blocks`` parts of ``wanted``, so that a
    job that ends early asks for nothing twice."""
    schema = wanted.select(*keys).withColumn("result", F.lit(None).cast("string")).schema
    for k in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == k)
        cache = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        new = missing(part, cache, keys)
        answers(new, spark.createDataFrame([], schema), keys, chain, pause).where("result IS NOT NULL").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def load_scaled(path: str, most: int = DEFAULT.answer_image_px) -> bytes:
    """A picture as PNG, no side longer than ``most``; as it is where no imaging library is there."""
    with open(path, "rb") as f:
        raw = f.read()
    try:
        from PIL import Image
    except ImportError:
        return raw
    picture = Image.open(io.BytesIO(raw)).convert("RGB")
    picture.thumbnail((most, most))
    out = io.BytesIO()
    picture.save(out, format="PNG")
    return out.getvalue()


def self_test(chain: Chain) -> dict[str, str]:
    """Each provider's name with 'ok' or why it doesn't answer."""
    out = {}
    for p in chain.providers:
        try:
            out[p.name] = "ok" if p.ask("Reply with one word.") else "empty reply"
        except Exception as e:  # noqa: BLE001 - the failure is the result
            out[p.name] = str(e)
    return out
