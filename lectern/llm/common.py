"""What several operators of this package share: tables, scratch tables, words, row slices.

Column names that begin with two underscores are reserved for the operators; any other may be in an input.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: every ASCII character that is no digit and no small letter (after lower-casing A-Z).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows, and bytes, of one Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: A key that holds more than one row in so many is joined by broadcast, of at most so many rows; the others by a shuffle.
HEAVY = 1000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut a lineage: ``spark.checkpoint.dir``, else, in a local session, one of our own.

    Raises on a cluster that names none.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: there is no folder that all executors share")
        path = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    The written table ends the lineage, so that a lost executor costs no recomputation of what stands
    before, and values that depend on the run's partitioning are fixed. ``forget`` removes it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}


def forget(*tables: DataFrame) -> None:
    """Delete the files of settled tables, when all that was read from them is written elsewhere."""
    for df in tables:
        path = _paths.pop(id(df), None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def joined(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``left`` joined with ``right`` (key, n, ...), one row for each key, which ``n`` rows of ``left`` have at most.

    Keys that hold more than a HEAVY-th of the sum of n are at most HEAVY rows and broadcast; no other key is large.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    heavy = F.col(n) * HEAVY > F.lit(total)
    hot = F.broadcast(right.where(heavy))
    return left.join(hot, key).unionByName(left.join(F.broadcast(right.where(heavy).select(key)), key, "left_anti").join(right.where(~heavy), key))


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, unless the session itself sets these, be it to the defaults.

    Rows are whole texts here, some very long; ten thousand of them, or 64 MB, at once would fill a worker's memory and an
    executor's beside its heap.
    """
    own = spark._jsparkSession.sessionState().conf()
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not own.contains(f"spark.sql.execution.arrow.{key}"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased as far as ASCII words can tell.

    ``lower`` is much faster than ``translate`` and makes ASCII letters out of two other characters
    only, the Kelvin sign and the dotted capital I; texts with one of them go the slow way. Other
    letters may be lower-cased too; they stay what they are here, characters of words.
    """
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def plain_lower(text: str) -> str:
    """A-Z to a-z, everything else as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def slices(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with at most ``most`` characters in all, or one longer text each."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once for each row, here.

    As the output of a generator that makes one row from each, they are neither merged into expressions
    above, which would evaluate them anew for every use, inside lambdas for every element, nor copied
    into filters that the optimizer moves below.
    """
    row = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select("*", F.inline(F.array(row)))
