"""JSON, text, folder and audio sources, and the sinks that mirror them."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAPTERS = "title string, content string"
CHECKPOINT = "completed_chapters array<string>, current_chapter int, current_chunk int"
META = "slug string, title string, author string, series string, tom int, generated_at string, chapters array<struct<index:int,filename:string,label:string>>"


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters from JSON arrays of {title, content}; raises if there are none or a file isn't JSON."""
    rows = spark.read.schema(CHAPTERS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"{path}: no chapters")
    return rows


def write_chapters(chapters: DataFrame, path: str) -> None:
    """One JSON object for each chapter, UTF-8, line by line."""
    chapters.select("title", "content").write.json(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint, one row; the start of everything where it is missing or broken."""
    start = spark.createDataFrame([([], 0, 0)], CHECKPOINT)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return start
    found = spark.read.schema(CHECKPOINT).option("multiLine", True).json(path).where("current_chapter IS NOT NULL AND current_chunk IS NOT NULL")
    found = found.withColumn("completed_chapters", F.coalesce("completed_chapters", F.array().cast("array<string>")))
    return found if not found.isEmpty() else start


def write_checkpoint(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").json(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder, such as the checkpoint of a book that is done; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


JOB = "running boolean, pid int, cmd array<string>, output_dir string, returncode int, error string, stopped boolean"


class AlreadyRunning(Exception):
    """There is a job that hasn't ended."""


def read_job(spark: SparkSession, path: str) -> DataFrame:
    """The job's state, one row; of a missing or broken file: not running."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    idle = spark.createDataFrame([(False,) + (None,) * 6], JOB)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return idle
    found = spark.read.schema(JOB).option("multiLine", True).json(path).where("running IS NOT NULL")
    return found if not found.isEmpty() else idle


def start_job(spark: SparkSession, path: str, cmd: list[str], output_dir: str, pid: int | None = None) -> None:
    """Note a job as running; raises AlreadyRunning while another one is."""
    if read_job(spark, path).first()["running"]:
        raise AlreadyRunning(path)
    spark.createDataFrame([(True, pid, cmd, output_dir, None, None, False)], JOB).coalesce(1).write.mode("overwrite").json(path)


def end_job(spark: SparkSession, path: str, returncode: int | None, error: str | None = None, stopped: bool = False) -> bool:
    """Note that the job has ended or was stopped; whether one was running."""
    job = read_job(spark, path).first()
    if job["running"]:
        row = (False, job["pid"], job["cmd"], job["output_dir"], returncode, error, stopped)
        spark.createDataFrame([row], JOB).coalesce(1).write.mode("overwrite").json(path)
    return bool(job["running"])


def replace_in_place(spark: SparkSession, path: str, content: bytes, backup: bool = False) -> None:
    """Write a file anew through a temporary one beside it, so that it is whole at any time.

    backup: keep what stood there as ``{path}.backup``, unless there is a backup from before.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    at, new, old = hadoop.Path(path), hadoop.Path(path + ".tmp"), hadoop.Path(path + ".backup")
    fs = at.getFileSystem(conf)
    out = fs.create(new, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if fs.exists(at):
        if backup and not fs.exists(old):
            fs.rename(at, old)
        else:
            fs.delete(at, False)
    fs.rename(new, at)


def wav_files(audio: DataFrame, name: Column) -> DataFrame:
    """(name, content): a WAV file's bytes for each row (frame_rate, samples)."""

    @F.pandas_udf("binary")
    def content(rates: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else wav_bytes(int(r), np.frombuffer(s, "<i2")) for r, s in zip(rates, samples, strict=True)])

    return audio.select(F.concat(name, F.lit(".wav")).alias("name"), content("frame_rate", "samples").alias("content"))


def write_wav(audio: DataFrame, folder: str, name: Column) -> int:
    """Write one WAV file into a folder for each row (frame_rate, samples); how many. One chapter at a time is on the driver."""
    spark, n = audio.sparkSession, 0
    for row in wav_files(audio.where("samples IS NOT NULL"), name).toLocalIterator():
        replace_in_place(spark, f"{folder.rstrip('/')}/{row['name']}", bytes(row["content"]))
        n += 1
    return n


def read_catalogue(spark: SparkSession, pattern: str) -> DataFrame:
    """The books' meta.json under a pattern, in the order of their paths; malformed ones are left out."""
    rows = spark.read.schema(META + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(pattern)
    return rows.select("*", F.col("_metadata.file_path").alias("path")).where("_bad IS NULL AND slug IS NOT NULL").drop("_bad").orderBy("path")


AUDIO = "path string, name string, bytes bigint, skipped string"


def list_audio(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, bytes, skipped) of the given files and of the files right in given folders; contents aren't read.

    Files whose names end in exactly .mp3 or .wav, in the order of their names within a folder, have a null in skipped; for every
    other entry it says why it is left out. Folders are listed on the driver, as their files are named one by one.
    """
    rows = []
    for given in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(given)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            rows.append((given, given.rstrip("/").rpartition("/")[2], None, "missing"))
            continue
        found = fs.listStatus(at)
        for status in sorted(found, key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            why = "folder" if status.isDirectory() else None if name.endswith((".mp3", ".wav")) else "not audio"
            rows.append((status.getPath().toString(), name, status.getLen(), why))
    return spark.createDataFrame(rows, AUDIO)


def first_existing(candidates: list[tuple[Column, str]]) -> Column:
    """The name of the first candidate (exists, name) that is there; null if none."""
    return F.coalesce(*(F.when(there, F.lit(name)) for there, name in candidates))


def samples_of(content: bytes) -> tuple[int, np.ndarray]:
    """Frame rate and 16-bit mono samples of a WAV file; channels are averaged."""
    with wave.open(io.BytesIO(content)) as file:
        if file.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        data = np.frombuffer(file.readframes(file.getnframes()), "<i2").reshape(-1, file.getnchannels())
        return file.getframerate(), data.mean(axis=1).astype(np.int16)


def wav_bytes(rate: int, samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_rate, duration_ms, samples, error) of ``*.wav`` files; samples are 16-bit little-endian bytes, null with an error in a broken file."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rate, samples = samples_of(content)
                    rows.append((name, rate, len(samples) * 1000 // rate, samples.astype("<i2").tobytes(), None))
                except (wave.Error, ValueError, EOFError) as error:
                    rows.append((name, 0, 0, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "frame_rate", "duration_ms", "samples", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, frame_rate int, duration_ms bigint, samples binary, error string")
