"""Problem 8: documents of several sources combined so that each source has its target share of all tokens.

Tokens are counted by a public tokenizer in Arrow batches and summed by source; from the sums follow the sources' rates, and
each document is given out floor(rate) times plus once more with the probability of the fraction, decided by a hash of
its id and the seed. The documents themselves are never shuffled.

Rates: the whole is to be as large as the listed sources are now. A source that would need more than ``max_repeats``
is held there, and what it lacks goes to the others in proportion to their targets, until none is above its cap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folivane.plans.storage import cut
from folivane.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEED = 20250101

# Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _counter(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each row; a null text has none. The vocabulary file is read where the job is started and
    sent to the tasks, so the machines they run on need none."""
    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(_counter(sent), "doc_id long, source string, tokens long")


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """How often each source is to be given out, by its tokens and its (target share, most repeats)."""
    whole = sum(tokens.get(s, 0) for s in targets)
    free = {s for s, (share, _) in targets.items() if tokens.get(s, 0) and share > 0}
    out = dict.fromkeys(targets, 0.0)
    left = float(whole)
    while free:
        parts = sum(targets[s][0] for s in free)
        now = {s: left * targets[s][0] / parts / tokens[s] for s in free}
        over = {s for s in free if now[s] > targets[s][1]}
        if not over:
            return out | now
        for s in over:
            out[s] = float(targets[s][1])
            left -= out[s] * tokens[s]
        free -= over
    return out


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    """The listed sources, one row each (the parameter table); a source listed twice has the sum of its shares."""
    rows = mix.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))), F.max(F.coalesce("max_repeats", F.lit(1)))).collect()
    return {r[0]: (max(r[1], 0.0), max(r[2], 0)) for r in rows}


def _plan(documents: DataFrame, mix: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The listed documents' token counts, and (source, target_share, max_repeats, source_tokens, rate)."""
    spark, targets = documents.sparkSession, _targets(mix)
    listed = documents.where(F.col("source").isin(sorted(targets)) if targets else F.lit(False))
    counted = cut(token_counts(listed, tokenizer))
    tokens = {r[0]: r[1] for r in counted.groupBy("source").agg(F.sum("tokens")).collect()}  # a row for each listed source
    rate = rates(tokens, targets)
    rows = [(s, share, most, tokens.get(s, 0), rate[s]) for s, (share, most) in sorted(targets.items())]
    return counted, spark.createDataFrame(rows, "source string, target_share double, max_repeats int, source_tokens long, rate double")


def _repeats(doc_id, rate, seed: int):
    unit = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def combine(documents: DataFrame, mix: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(doc_id, copy_no, source, text): the documents of the listed sources, each as often as its source's rate says.

    Sources that aren't listed, null among them, are left out; a listed source without tokens gives nothing. The choice
    depends on doc_id and seed only, so it is the same for any partitioning and after a lost executor. Null texts have no
    tokens and are given out like others of their source.
    """
    _, plan = _plan(documents, mix, tokenizer)
    rate = F.broadcast(plan.select("source", "rate"))  # a row for each row of mix, which is a parameter
    times = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").join(rate, "source").withColumn("repeats", _repeats(F.col("doc_id"), F.col("rate"), seed))
    return times.where("repeats > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy_no"), "source", "text")


def shares(documents: DataFrame, mix: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """A row for each listed source: its rate, the copies and tokens given out, the actual share beside the target."""
    counted, plan = _plan(documents, mix, tokenizer)
    given = counted.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("repeats", _repeats(F.col("doc_id"), F.col("rate"), seed))
    by = given.groupBy("source").agg(F.count("*").alias("docs"), F.sum("repeats").alias("copies"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"))
    out = plan.join(by, "source", "left").na.fill(0, ["docs", "copies", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over a row for each row of mix
    return out.withColumn("whole", whole).withColumn("actual_share", F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0)).drop("whole")


def _tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, base, "documents", "doc_id", "source", "text"), table(spark, base, "mix_targets")


def mix(spark: SparkSession, base: str) -> DataFrame:
    return combine(*_tables(spark, base))


def mix_shares(spark: SparkSession, base: str) -> DataFrame:
    return shares(*_tables(spark, base))
