from __future__ import annotations

import numpy as np
import pytest

from lectern.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 65, 1000, 4097])
def test_permutation(n):
    places = sharding.permuted(np.arange(n), n, seed=7)
    assert sorted(places.tolist()) == list(range(n))
    if n == 1000:
        other = sharding.permuted(np.arange(n), n, seed=8)
        assert (places != other).mean() > 0.9 and abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.1


def test_shards_are_even_gapless_and_reproducible(spark, clashing):
    rows = sharding.document_keys(clashing)
    keys = ["doc_id", "size", "text_crc32", "text_hash"]
    found = sharding.sharded(rows.repartition(3), 4, keys).collect()
    assert len(found) == 10
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    again = sharding.sharded(rows.repartition(2), 4, keys).collect()
    plain = lambda x: sorted((str(r.doc_id), r.text_hash, r.shard, r.slot) for r in x)
    assert plain(found) == plain(again)
    nulls = [r for r in found if r.doc_id == 2]
    assert nulls[0].size == 16 and nulls[0].text_crc32 == 0


def test_many_equal_rows_and_none(spark, empty):
    df = spark.range(3000).selectExpr("1 AS doc_id")
    found = sharding.sharded(df, 7, ["doc_id"])
    assert sorted(r["count"] for r in found.groupBy("shard").count().collect()) == [428] * 3 + [429] * 4
    assert sharding.sharded(sharding.document_keys(empty), 3, ["doc_id"]).count() == 0
