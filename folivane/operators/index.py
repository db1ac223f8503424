"""The keyword index and the collection of points, as tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from folivane.functions.text import keyword_text, point_id, tokens
from folivane.plans.storage import cut
from folivane.settings import DEFAULT, Settings


#: A segment's row of its chunks, beside those of its words; no word is empty.
OWN = ""
BLOCKS = "seg long, tok string, docs array<smallint>, tfs array<int>, ids array<string>"
#: Chunks of one segment, which have 16 bits, and its words after which no further chunk is put into it.
SEGMENT_CHUNKS, SEGMENT_WORDS = 8192, 3 << 19


@dataclass(frozen=True)
class KeywordIndex:
    """blocks (BLOCKS), vocab (tok, df, idf), totals (one row: n, avgdl).

    A segment is some chunks that were read together. Of each of its words it has one row: the chunks that hold it, by
    their numbers in the segment, and how often; and a row with the word OWN: its chunks' ids, and their lengths in ``tfs``.
    """

    blocks: DataFrame
    vocab: DataFrame
    totals: DataFrame
    path: str | None = None  # where it is written, if it is

    @property
    def postings(self) -> DataFrame:
        """(id, tok, tf, len), a row of each word of a chunk."""
        own = self.blocks.where(F.col("tok") == OWN).select("seg", F.posexplode(F.arrays_zip("ids", "tfs")).alias("doc", "c")).select("seg", "doc", F.col("c.ids").alias("id"), F.col("c.tfs").alias("len"))
        words = self.blocks.where(F.col("tok") != OWN).select("seg", "tok", F.explode(F.arrays_zip("docs", "tfs")).alias("w"))
        return words.select("seg", F.col("w.docs").cast("int").alias("doc"), "tok", F.col("w.tfs").alias("tf")).join(own, ["seg", "doc"]).select("id", "tok", "tf", "len")


def _segment(seg: int, ids: pa.Array, toks: pa.Array) -> pa.RecordBatch:
    n, size = len(ids), toks.value_lengths().to_numpy(zero_copy_only=False)
    told = toks.flatten().dictionary_encode()
    order = pa.compute.sort_indices(told.dictionary).to_numpy()
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    key = place[told.indices.to_numpy()] << 16 | np.repeat(np.arange(n), size)
    key, tf = np.unique(key, return_counts=True)
    upto = np.searchsorted(key >> 16, np.arange(len(order) + 1))
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    docs = lists(np.append(0, upto), pa.array((key & 0xFFFF).astype("i2")))
    tfs = lists(np.append(0, n + upto), pa.array(np.concatenate([size, tf]).astype("i4")))
    own = lists(np.append(0, np.full(len(order) + 1, n)), ids)
    words = pa.concat_arrays([pa.array([OWN], pa.string()), told.dictionary.take(pa.array(order)).cast(pa.string())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), seg)), words, docs, tfs, own], ["seg", "tok", "docs", "tfs", "ids"])


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seg = TaskContext.get().partitionId() << 32
    ids, toks = pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))
    for batch in batches:
        ids = pa.concat_arrays([ids, batch.column(0).cast(pa.string())])
        toks = pa.concat_arrays([toks, batch.column(1).cast(pa.list_(pa.string()))])
        while len(ids):
            upto = np.cumsum(toks.value_lengths().to_numpy(zero_copy_only=False), dtype="i8")
            n = min(SEGMENT_CHUNKS, int(np.searchsorted(upto, SEGMENT_WORDS)) + 1)
            if n > len(ids):
                break
            yield _segment(seg, ids[:n], toks[:n])
            ids, toks, seg = ids[n:], toks[n:], seg + 1
    if len(ids):
        yield _segment(seg, ids, toks)


def blocks_of(chunks: DataFrame) -> DataFrame:
    """BLOCKS of ``chunks`` (id, heading, text), each id once. Neither the chunks nor their words are moved: words are counted
    where their chunk is read."""
    return chunks.select("id", tokens(keyword_text(F.col("heading"), F.col("text"))).alias("toks")).mapInArrow(_segments, BLOCKS)


def _with_statistics(blocks: DataFrame, settings: Settings) -> KeywordIndex:
    own, words = blocks.where(F.col("tok") == OWN), blocks.where(F.col("tok") != OWN)
    told = own.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("words"))
    totals = told.select("n", (F.col("words") / F.when(F.col("n") > 0, F.col("n"))).alias("avgdl"))
    df = words.groupBy("tok").agg(F.sum(F.size("docs")).alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    told = df.join(F.broadcast(totals.select("n"))).select("tok", "df", raw.alias("raw"))  # one row
    mean = told.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(settings.bm25_epsilon) * F.col("mean")).otherwise(F.col("raw"))
    return KeywordIndex(blocks, told.join(F.broadcast(mean)).select("tok", "df", idf.alias("idf")), totals)


def keyword_index(chunks: DataFrame, settings: Settings = DEFAULT) -> KeywordIndex:
    """Index of ``chunks`` (id, heading, text). Idf below zero becomes epsilon times the mean idf of all words.

    The blocks are computed once and kept, since the vocabulary and every search read them.
    """
    return _with_statistics(cut(blocks_of(chunks)), settings)


def write_index(chunks: DataFrame, path: str, settings: Settings = DEFAULT) -> None:
    """The index of ``chunks`` as tables below ``path``. The rows of a segment are sorted by word, so a reader of few words
    skips most pages."""
    blocks_of(chunks).write.mode("overwrite").parquet(f"{path}/blocks")
    made = _with_statistics(chunks.sparkSession.read.parquet(f"{path}/blocks"), settings)
    made.totals.write.mode("overwrite").parquet(f"{path}/totals")
    made.vocab.sortWithinPartitions("tok").write.mode("overwrite").parquet(f"{path}/vocab")


def read_index(spark: SparkSession, path: str) -> KeywordIndex:
    return KeywordIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("blocks", "vocab", "totals")), path)


def read_blocks(path: str) -> Iterator[pa.RecordBatch]:
    """The written blocks of an index, read in a task from the folder that all tasks share: a segment's rows come together."""
    fs, at = pa.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    files = fs.get_file_info(pa.fs.FileSelector(f"{at}/blocks"))
    for f in sorted(f.path for f in files if f.base_name.endswith(".parquet")):
        with fs.open_input_file(f) as given:
            yield from pq.ParquetFile(given).iter_batches(8192, columns=["seg", "tok", "docs", "tfs", "ids"])


def content_version(chunks: DataFrame) -> str:
    """Changes with any id, heading or text, whatever the order of rows."""
    h = F.xxhash64("id", F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit("")))
    row = chunks.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    return f"{row.n}-{(row.x or 0) & (1 << 64) - 1:016x}-{row.s or 0:x}"


def points(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(point_id, payload fields, vector) of ``chunks``; ``vectors`` has id and vector."""
    out = chunks.withColumn("point_id", point_id(F.col("id")))
    return out.join(vectors, "id") if vectors is not None else out


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; nothing is deleted."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
