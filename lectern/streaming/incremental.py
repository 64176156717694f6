"""Incremental processing: what has been done stands in a stream's checkpoint, not in a file of offsets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.session import shared_folder

Transform = Callable[[DataFrame], DataFrame]


def resumable(spark: SparkSession, source: str, transform: Transform, sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process the files of ``source`` that this checkpoint hasn't seen, append the result to ``sink``, then stop.

    A second run takes up where the first has ended, or failed; every file counts once.
    """
    schema = spark.read.format(fmt).load(source).schema
    # A table may be one file; a stream reads its folder by the file's name.
    folder, _, name = source.rstrip("/").rpartition("/")
    single = name.endswith(f".{fmt}") and not _is_folder(spark, source)
    reader = spark.readStream.format(fmt).schema(schema)
    stream = reader.option("pathGlobFilter", name).load(folder) if single else reader.load(source)
    return transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def drained(spark: SparkSession, source: str, transform: Transform) -> DataFrame:
    """All of ``source`` through a stream into a fresh sink, read back."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = resumable(spark, source, transform, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
