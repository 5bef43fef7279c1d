import zlib

import cases
import pytest

from tallygrain.llm.shards import kd_shards


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_bytes_are_near_equal_and_slots_gapless(spark, shards):
    rng = __import__("random").Random(4)
    hot = cases.sentence(rng, 40)
    rows = [(i, hot if i % 3 == 0 else cases.sentence(rng, rng.randint(1, 80))) for i in range(600)]
    found = kd_shards(cases.documents(spark, rows), shards).toPandas()
    size = dict((i, len(t.encode()) + 1) for i, t in rows)
    assert all(size[i] == s for i, s in zip(found.doc_id, found["size"]))
    assert all(zlib.crc32(dict(rows)[i].encode()) == c for i, c in zip(found.doc_id, found.text_crc32))
    bytes_ = found.groupby("shard")["size"].sum()
    assert len(bytes_) == shards
    assert bytes_.max() - bytes_.min() <= 2 * max(size.values())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    # small groups of equal texts stay together, but for one at most for each cut
    split = found.groupby("text_crc32").shard.nunique()
    assert (split > 1).sum() <= shards - 1


def test_edges(spark):
    docs = cases.documents(spark)
    rows = kd_shards(docs).collect()
    assert len(rows) == docs.count()
    assert {r["law"] for r in rows} == {"bytes"} and all(0 <= r["shard"] < 8 for r in rows)
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (4, 5))
    assert kd_shards(docs.limit(0)).collect() == []
