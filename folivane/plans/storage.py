"""Where intermediate results are kept so that a lost executor costs no recomputation of the whole lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) a folder of this machine is used; a session on
    a real cluster without the setting is refused, since a machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    # Checkpoints are removed once nothing refers to them.
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="folivane-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
