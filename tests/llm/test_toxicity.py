from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.llm import toxicity

NICE = "the river runs under old stones while birds sing over green fields and people walk home".split()


def text(rng, bad):
    sentences = [" ".join(rng.choice(NICE) for _ in range(8)) + "." for _ in range(6)]
    if bad:
        at = rng.randrange(6)
        sentences[at] = f"you are a {rng.choice(['zorgo', 'blargish', 'blargous', 'blargy'])} person."
    return " ".join(sentences)


def test_sentences_are_located_though_only_documents_are_labelled():
    rng = random.Random(2)
    toxic = [i % 4 == 0 for i in range(800)]
    model = toxicity.train([text(rng, y) for y in toxic], toxic)
    scorer = toxicity.Scorer(model)
    right = 0
    for i in range(200):
        own = text(rng, i % 4 == 0)
        score, spans = scorer.score(own)
        right += (score >= 0.5) == (i % 4 == 0)
        if i % 4 == 0:
            worst = max(spans, key=lambda s: s[2])
            assert "you are a" in own[worst[0] : worst[1]]
    assert right >= 198


def test_fit_and_score_edges(spark, clashing, empty):
    rng = random.Random(3)
    rows = [(i, text(rng, i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (600, None), (601, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(602)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, sample=200)
    held = docs.withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").drop("held")
    found = toxicity.scored(held, model).collect()
    assert len(found) > 60 and sum((r.toxicity >= 0.5) != (r.doc_id % 3 == 0) for r in found if r.text) <= 2
    scored = toxicity.scored(clashing, model)
    assert scored.count() == 10 and all(0 <= r.toxicity <= 1 for r in scored.collect()) and "score" in scored.columns
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.fit(clashing, labels.limit(0))
    assert none.weights == {} and toxicity.scored(clashing, none).where("toxicity >= 0.5").count() == 0
