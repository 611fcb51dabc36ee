"""Session defaults shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, app: str = "pagemill") -> SparkSession:
    """A local session for tests and benches. A cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=DEFAULTS)
    return builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one parquet table by Spark's reader, from any store that Spark knows."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
