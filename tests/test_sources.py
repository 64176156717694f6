from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.interactive import wizard
from lectern.operators import waveform as W
from lectern.register import register
from lectern.sources import epub, files


def book(path, spine=("c2", "c1"), title="Noc"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in (1, 2, 3))
        refs = "".join(f'<itemref idref="{x}"/>' for x in spine)
        meta = f'<dc:title xmlns:dc="d">{title}</dc:title>' if title else ""
        z.writestr("O/c.opf", f"<package><metadata>{meta}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>")
        for i in (1, 2, 3):
            z.writestr(f"O/c{i}.xhtml", f'<html><title>T</title><h1>Rozdział {i}</h1><p><span class="inicjal">W</span>isła<sup>1</sup></p></html>')


def test_epub(spark, tmp_path):
    book(tmp_path / "a.epub")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    items = epub.read_items(spark, str(tmp_path)).cache()
    order = epub.in_reading_order(items).orderBy("pos").collect()
    assert [r.filename for r in order] == ["c2.xhtml", "c1.xhtml", "c3.xhtml"]
    assert items.where("error IS NOT NULL").count() == 1
    docs = epub.documents(items).orderBy("pos").collect()
    assert docs[0].title == "Rozdział 2" and "Wisła" in docs[0].content and "[PAUZA]" in docs[0].content
    assert {(r.title, r.author) for r in epub.metadata(items.where("error IS NULL")).collect()} == {("Noc", "Unknown author")}


def test_json_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"title": "A", "content": "ł"}]))
    assert [tuple(r) for r in files.read_chapters(spark, str(tmp_path / "c.json")).collect()] == [("A", "ł")]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_chapters(spark, str(tmp_path / "e.json"))
    assert files.read_checkpoint(spark, str(tmp_path / "none")).first().current_chapter == 0
    for name, text in {"a": '{"slug": "s1", "chapters": []}', "b": "{broken", "c": '{"slug": "s2"}'}.items():
        (tmp_path / "g" / name).mkdir(parents=True)
        (tmp_path / "g" / name / "meta.json").write_text(text)
    assert [r.slug for r in files.read_catalogue(spark, f"{tmp_path}/g/*/meta.json").collect()] == ["s1", "s2"]


def test_wav_and_audio_listing(spark, tmp_path):
    tone = (np.sin(np.arange(8000)) * 9000).astype(np.int16)
    (tmp_path / "a.wav").write_bytes(files.wav_bytes(8000, tone))
    (tmp_path / "b.wav").write_bytes(b"broken")
    (tmp_path / "c.MP3").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].duration_ms == 1000 and rows["a.wav"].samples == tone.astype("<i2").tobytes() and rows["b.wav"].error
    (tmp_path / "d").mkdir()
    listed = {r.name: r.skipped for r in files.list_audio(spark, [str(tmp_path), str(tmp_path / "a.wav"), str(tmp_path / "gone")]).collect()}
    assert listed == {"a.wav": None, "b.wav": None, "c.MP3": "not audio", "d": "folder", "gone": "missing"}
    assert files.write_wav(files.read_wav(spark, str(tmp_path)), str(tmp_path / "d"), F.lit("out")) == 1
    assert files.samples_of((tmp_path / "d" / "out.wav").read_bytes())[1].tolist() == tone.tolist()


def test_jobs_checkpoints_and_files_in_place(spark, tmp_path):
    job, state, file = str(tmp_path / "job"), str(tmp_path / "state"), str(tmp_path / "x.bin")
    assert not files.read_job(spark, job).first().running and not files.end_job(spark, job, 0)
    files.start_job(spark, job, ["a", "b"], "/out", 7)
    with pytest.raises(files.AlreadyRunning):
        files.start_job(spark, job, ["c"], "/out")
    assert files.end_job(spark, job, None, stopped=True)
    row = files.read_job(spark, job).first()
    assert (row.running, row.stopped, row.cmd, row.pid) == (False, True, ["a", "b"], 7)
    files.start_job(spark, job, ["c"], "/out")
    files.write_checkpoint(spark.createDataFrame([(["A"], 2, 3)], files.CHECKPOINT), state)
    assert files.read_checkpoint(spark, state).first().current_chapter == 2
    assert files.delete(spark, state) and not files.delete(spark, state)
    for content in (b"one", b"two", b"three"):
        files.replace_in_place(spark, file, content, backup=True)
    assert (tmp_path / "x.bin").read_bytes() == b"three" and (tmp_path / "x.bin.backup").read_bytes() == b"one"


def test_waveforms(spark):
    rate = 1000
    speech, silence = np.full(500, 9000, np.int16), np.zeros(2000, np.int16)
    audio = np.concatenate([silence, speech, silence])
    assert W.nonsilent(audio, rate, -65, 800) == [(2000, 2500)]
    assert len(W.trimmed(audio, rate)) == 2900
    assert len(W.stretched(audio, rate, 1.5)) == 3000 + 500 + 3000
    assert len(W.trimmed(speech, rate)) == 500 and W.nonsilent(silence, rate, -65, 800) == []
    rows = spark.createDataFrame([("b", i, rate, bytearray(np.array([i], "<i2").tobytes())) for i in range(120)], "book string, seq int, frame_rate int, samples binary")
    a, b, c = (np.full(20, 1000, "<i2") for _ in range(3))
    three = spark.createDataFrame([("b", i, rate, bytearray(x.tobytes())) for i, x in enumerate((a, b, c))] + [("b", 9, rate, None)], "book string, seq int, frame_rate int, samples binary")
    joined = np.frombuffer(W.combined(three, ["book"]).first().samples, "<i2").tolist()
    down, up = [800, 600, 400, 200, 0], [0, 200, 400, 600, 800]
    assert joined == [1000] * 15 + down + up + [1000] * 10 + down + up + [1000] * 15
    chunk = W.prepared(np.concatenate([speech, silence]), rate)
    assert len(chunk) == 900 and chunk[:3].tolist() == [0, 900, 1800] and chunk[499] == 9000 and chunk[-1] == 0
    assert np.frombuffer(W.combined(rows, ["book"], crossfade=0).first().samples, "<i2").tolist() == list(range(120))


def test_wizard():
    answers = iter(["9", "2", "/md", "", ""])
    assert wizard(lambda _: next(answers)) == {"input_type": "markdown", "path": "/md", "title": "Unknown title", "author": "Unknown author"}
    answers = iter(["1", "/a.epub"])
    assert wizard(lambda _: next(answers))["input_type"] == "epub"


def test_registered_functions(spark):
    register(spark)
    assert spark.sql("SELECT ordinal_word(3, 'f')").first()[0] == "trzecia"
    assert [r.part for r in spark.sql("SELECT * FROM split_oversize('aa bb cc', 5)").collect()] == ["aa", "bb cc"]


def test_stream_is_resumable(spark, tmp_path):
    from lectern.streaming.incremental import resumable

    spark.range(5).write.parquet(f"{tmp_path}/in/a")
    run = lambda: resumable(spark, f"{tmp_path}/in/*", lambda df: df, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    spark.range(5, 8).write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(8))


def test_streamed_positions(spark, tmp_path):
    from lectern.streaming.playback import positions

    spark.createDataFrame([(1, 5, "a", 0, 1.0), (1, 9, "b", 2, 3.0), (2, 1, "a", 1, 0.5)], "user_id bigint, ms bigint, slug string, chapter int, at double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id bigint, ms bigint, slug string, chapter int, at double").parquet(f"{tmp_path}/in")
    query = positions(stream).writeStream.format("memory").queryName("positions").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("positions").collect()) == [(1, "b", 2, 3.0), (2, "a", 1, 0.5)]
