from __future__ import annotations

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import decontamination, neardup, quality, toxicity
from lectern.llm.common import table


def test_run_equals_its_stages_by_brute_force(spark, sf_dir):
    """The learned models are taken as they are; everything that they decide on is recomputed in Python."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    rules = quality.fit(docs, labels)
    good = quality.judged(docs, rules).where("kept").select(*docs.columns)
    rows = {r.doc_id: r.text for r in good.collect()}
    scorer = toxicity.Scorer(toxicity.fit(good, labels))
    rows = {i: t for i, t in rows.items() if scorer.score(t)[0] < 0.5}
    ids = sorted(rows)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = {i: set(neardup.shingles(neardup.words_of(rows[i])).tolist()) for i in ids}
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if bags[i] & bags[j] and neardup.overlap(rows[i], rows[j]) >= neardup.SIMILARITY:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    rows = {i: rows[i] for i in ids if find(i) == i}
    windows = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        w = decontamination.words_of(r.text)
        k = min(10, len(w))
        windows |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    clean = {i: t for i, t in rows.items() if not any(tuple(w[j : j + k]) in windows for w in [decontamination.words_of(t)] for k in {len(x) for x in windows} for j in range(len(w) - k + 1))}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in found} == {i: library.encode(t, add_special_tokens=False).ids for i, t in clean.items()}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in found)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_nothing_else_imports_the_package():
    from pathlib import Path

    top = Path(corpus_pipeline.__file__).parent
    for file in top.glob("lectern/**/*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"lectern\.llm|from \.+llm", file.read_text()), file


def test_run_on_awkward_tables(spark, sf_dir, docs, tmp_path):
    from pyspark.sql import functions as F

    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    good = "Ordinary words stand here in a row, one after the other, and none of them is said twice before the end of it. " + "".join(f"Sentence number {chr(97 + k)} differs. " for k in range(9))
    more = spark.createDataFrame([(50, good, "en", "a", 1), (50, good, "en", "a", 1), (None, good + "x", "en", "a", 1), (51, good * 2000, "en", "a", 1)], docs.schema)
    rows = docs.union(more).select("*", *(F.lit("x").alias(c) for c in ("n_words", "kept", "rule", "toxicity", "spans", "items", "ids", "class_id", "key")))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= {None, *(r.doc_id for r in rows.collect())} and all(r.exact for r in found)
    assert len(found) == len({r.doc_id for r in found})
    (tmp_path / "empty").mkdir()
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
