"""A collection kept as tables: built once for a version of its sources, then read by every search.

A snapshot below ``root/version`` has the chunks (sorted by id within a file), the vectors, and the keyword index (sorted by word within
a segment), so a search skips pages that have none of its words and hits. Versions follow the files of the sources: any change of a file
gives another version, and a snapshot counts as there only once it is complete.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession, functions as F

from folivane.operators.index import KeywordIndex, content_version, read_index, upsert, write_index
from folivane.plans.sizing import maybe_broadcast
from folivane.plans.storage import checkpoint_dir, exists
from folivane.settings import CHUNK

#: Counts the layouts of snapshots, so that none of another layout is read.
LAYOUT = 3
#: Ids or words up to which they are pushed down to the scan; more are joined.
PUSHED = 2000


@dataclass(frozen=True)
class Snapshot:
    chunks: DataFrame
    vectors: DataFrame
    index: KeywordIndex


def source_version(spark: SparkSession, *tables: DataFrame) -> str:
    """Names the state of the files behind ``tables`` by their paths, lengths and times; of their rows if there are none."""
    told = blake2b(digest_size=12)
    hadoop = spark._jsc.hadoopConfiguration()
    for df in tables:
        files = sorted(df.inputFiles())
        for f in files:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            s = path.getFileSystem(hadoop).getFileStatus(path)
            told.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
        if not files:
            told.update(content_version(df).encode())
    return told.hexdigest()


def snapshot(spark: SparkSession, version: str, chunks: Callable[[], DataFrame], vectors: Callable[[DataFrame], DataFrame], root: str | None = None) -> Snapshot:
    """The snapshot of ``version``, built of ``chunks`` (CHUNK's fields) and ``vectors`` (id, kind, vector) if it isn't there."""
    path = f"{root or checkpoint_dir(spark) + '/collections'}/{version}-{LAYOUT}"
    if not exists(spark, f"{path}/complete/_SUCCESS"):
        rows = chunks()
        rows.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/chunks")
        kept = spark.read.parquet(f"{path}/chunks")
        vectors(kept).write.mode("overwrite").parquet(f"{path}/vectors")
        write_index(kept, path)
        spark.range(0).write.mode("overwrite").parquet(f"{path}/complete")
    return Snapshot(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"), read_index(spark, path))


def fetch(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``wanted``: by a pushed-down list if these are few, else by a join."""
    keys = wanted.select(key).distinct()
    few = [r[0] for r in keys.limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        return rows.where(F.col(key).isin(few)) if few else rows.where(F.lit(False))
    return rows.join(maybe_broadcast(keys, 64), key, "left_semi")


# --- the collection as a store -----------------------------------------------------------------------------------------


def ensure(spark: SparkSession, path: str, recreate: bool = False) -> None:
    """The collection at ``path``, empty if it wasn't there or is to be made anew; filed by kind."""
    if recreate or not exists(spark, f"{path}/_SUCCESS"):
        empty = spark.createDataFrame([], f"point_id string, {CHUNK}, vector array<float>")
        empty.write.mode("overwrite").partitionBy("kind").parquet(path)


def scan(spark: SparkSession, path: str, vectors: bool = False) -> DataFrame:
    """All points; without their vectors unless these are asked for."""
    rows = spark.read.schema(f"point_id string, {CHUNK}, vector array<float>").parquet(path)
    return rows if vectors else rows.drop("vector")


def count(spark: SparkSession, path: str) -> int:
    """The number of points; 0 if there is no such collection."""
    return scan(spark, path).count() if exists(spark, f"{path}/_SUCCESS") else 0


def put(spark: SparkSession, path: str, points: DataFrame) -> None:
    """Upserts ``points`` (point_id, CHUNK's fields, vector): written beside the old collection, then put in its place."""
    ensure(spark, path)
    both = upsert(scan(spark, path, vectors=True), points.select("point_id", "id", "doc_id", "page", "kind", "text", "heading", "image_path", F.col("vector").cast("array<float>").alias("vector")))
    both.write.mode("overwrite").partitionBy("kind").parquet(f"{path}.new")
    fs = spark._jvm.org.apache.hadoop.fs
    old, new = fs.Path(path), fs.Path(f"{path}.new")
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{path}.new can't be put in place")
