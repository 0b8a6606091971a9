"""Sessions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that the package lies in.
ROOT = str(Path(__file__).resolve().parents[2])


def session(name: str = "millwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; on a cluster, spark-submit's settings come first."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return (builder.master(master) if master else builder).getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Python workers import this package; where it isn't installed, they find it as the driver did."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark
