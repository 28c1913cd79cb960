"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


#: Spark 4.1 takes a union to be partitioned by a key if all its inputs are. Adaptive execution may coalesce the inputs differently;
#: then rows of one key stand in different partitions, and joins and windows over the union give wrong rows (see test_unions).
_UNION = "spark.sql.unionOutputPartitioning"


def sound_unions(spark: SparkSession) -> None:
    """Joins and windows over a union shuffle it, in this session."""
    spark.conf.set(_UNION, "false")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application. In one process with PYTHONPATH leading to it there is nothing to send."""
    sound_unions(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if spark.sparkContext.master.split("[")[0] == "local" and str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
