"""An extension: a collection kept current from a stream of chunk rows.

Each micro-batch is written as a part of its own, so its cost is that of its rows; a point's newest part holds it. Now and
then the parts are put together into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folivane.operators.index import points

#: Parts that come together before they are put into one.
TOGETHER = 20


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) batch of each complete part below ``path`` that counts: no other holds its batches too."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    told = (s.getPath().getName() for s in files.listStatus(root) if files.exists(fs.Path(s.getPath(), "_SUCCESS")))
    spans = sorted((tuple(map(int, n.split("-"))) for n in told), key=lambda p: (p[0], -p[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _newest(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    rows = None
    for a, b in parts:
        part = spark.read.parquet(f"{path}/{a}-{b}").withColumn("_part", F.lit(b))
        rows = part if rows is None else rows.unionByName(part)
    if len(parts) == 1:
        return rows.drop("_part")
    fields = [c for c in rows.columns if c not in ("point_id", "_part")]
    return rows.groupBy("point_id").agg(F.max_by(F.struct(*fields), "_part").alias("r")).select("point_id", "r.*")


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The collection below ``path`` as of its last batch, none at first."""
    parts = _parts(spark, path)
    return _newest(spark, path, parts) if parts else None


def keep_current(chunks: DataFrame, path: str, checkpoint: str, together: int = TOGETHER):
    """A query that upserts each micro-batch of the stream ``chunks`` into the collection below ``path``. A batch that is
    given again writes the same part again."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        points(batch.dropDuplicates(["id"])).write.mode("overwrite").parquet(f"{path}/{number}-{number}")
        parts = _parts(spark, path)
        if len(parts) >= together:
            _newest(spark, path, parts).write.mode("overwrite").parquet(f"{path}/{parts[0][0]}-{parts[-1][1]}")

    return chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
