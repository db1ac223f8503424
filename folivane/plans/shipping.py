"""Making the package importable in Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context, unless PYTHONPATH (which workers inherit) names
    it. The archive is read from the driver by Spark's own file server."""
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_folivane_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="folivane-"), "folivane.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((_ROOT / "folivane").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(archive))
    sc._folivane_shipped = True
