"""Session construction and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for: UTC, AQE, skew-join splitting.

    Partition counts are left to AQE; on a cluster only ``spark.sql.shuffle.partitions`` (its upper
    bound) has to follow the data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; ``sf_dir`` may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in a local session without one, a temporary folder.

    Raises on a cluster that names none, as a folder of the driver's machine isn't seen by executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: there is no folder that all executors share")
        path = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")
