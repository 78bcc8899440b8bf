"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Put this library on the Python path of workers that start from now on.

    On a cluster the library comes with --py-files or in the image; this serves sessions begun elsewhere.
    """
    held = spark.sparkContext.environment
    if ROOT not in held.get("PYTHONPATH", "").split(":"):
        held["PYTHONPATH"] = ":".join(filter(None, [ROOT, held.get("PYTHONPATH", "")]))
    return spark
