from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions.names import title_from_filename
from lectern.functions.text import md_clean_text
from lectern.sources.markdown import load_folder, split_chapters


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return str(tmp_path)


def rows(df):
    return [(r.chapter_idx, r.title, r.content) for r in df.orderBy("chapter_idx").collect()]


def test_folder_is_sorted_and_headings_become_titles(spark, tmp_path):
    path = folder(tmp_path, **{"02_b__md": "# Second\nContent B", "01_a__md": "# First\nContent A"})
    assert rows(load_folder(spark, path)) == [(0, "First", "Content A"), (1, "Second", "Content B")]


@pytest.mark.parametrize(("name", "title"), [("01_intro.md", "intro"), ("03-my-great-chapter.md", "my great chapter"), ("12.md", "12.md"), ("plain.md", "plain")])
def test_title_from_filename(spark, name, title):
    assert spark.range(1).select(title_from_filename(F.lit(name))).first()[0] == title


def test_empty_and_other_files_are_left_out(spark, tmp_path):
    path = folder(tmp_path, **{"a__md": "# Real\nText", "b__md": "", "c__md": "  \n \t", "d__txt": "no", "e__png": "no"})
    assert rows(load_folder(spark, path)) == [(0, "Real", "Text")]


def test_empty_and_missing_folder(spark, tmp_path):
    found = load_folder(spark, str(tmp_path))
    assert found.count() == 0 and [c for c, _ in found.dtypes] == ["chapter_idx", "title", "content"]
    with pytest.raises(FileNotFoundError):
        load_folder(spark, str(tmp_path / "none"))


def test_artifacts_go_and_freed_spaces_stay(spark):
    text = "Some &nbsp; text   with  <b>html</b>  artifacts.\r\n\n\n\nEnd "
    got = spark.range(1).select(md_clean_text(F.lit(text))).first()[0]
    assert got == "Some   text with html artifacts.\n\nEnd"


def test_split_keeps_a_preamble_and_drops_headings_without_body(spark):
    md = "Intro\nwords\n# Chapter One\nFirst content.\n\n# Empty\n  \n# Chapter Two\nSecond content."
    df = split_chapters(spark.createDataFrame([(1, md), (2, None), (3, "")], "id int, md string"), ["id"], "md")
    assert [(r.id, r.chapter_idx, r.title, r.content) for r in df.orderBy("chapter_idx").collect()] == [(1, 0, "Intro", "words"), (1, 1, "Chapter One", "First content."), (1, 2, "Chapter Two", "Second content.")]
