import random

import cases
import pytest

from tallygrain.llm import quality as Q


def rows(n=240):
    rng = random.Random(6)
    out, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        out.append((i, cases.sentence(rng, 60) if good else " | ".join(cases.sentence(rng, 1, "abcdxyz") for _ in range(60))))
        marks.append((i, int(good)))
    return out, marks


def labels(spark, marks):
    return spark.createDataFrame([(i, q, 0, "x") for i, q in marks], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark):
    docs, marks = rows()
    found = Q.quality_scores(cases.documents(spark, docs), labels(spark, marks)).toPandas()
    truth = dict(marks)
    held = found[found.held_out]
    assert len(held) > 20 and found.score.between(0, 1).all()
    assert (held.predicted == [truth[i] for i in held.doc_id]).mean() > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    docs, marks = rows()
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in marks]
    table = cases.documents(spark, docs)
    a, b = (Q.quality_scores(table, labels(spark, m)).toPandas().sort_values("doc_id") for m in (marks, flipped))
    assert a.score.tolist() == b.score.tolist()


@pytest.mark.parametrize("marks", [[], [(1, 1), (2, 1), (3, 1)], [(1, None), (None, 1)], [(1, 0), (1, 1), (2, 0), (3, 1), (7, 0), (9, 1)]])
def test_edges(spark, marks):
    docs = cases.documents(spark)
    found = Q.quality_scores(docs, labels(spark, marks)).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert found.predicted.isin([0, 1]).all() and (found.difference[found.doc_id.isin([4, 5])] == 0).all()


def test_empty_tables(spark):
    docs, marks = rows(30)
    docs = cases.documents(spark, docs)
    assert Q.quality_scores(docs.limit(0), labels(spark, marks)).collect() == []


def test_long_texts_are_read_to_the_end():
    gauge = Q.Gauge(b"good words of prose " * 50, b"bad | junk | rows | " * 50)
    text = cases.sentence(random.Random(1), 20_000).encode()
    assert gauge.difference(text + b"bad | junk | rows | " * 20_000) < gauge.difference(text)


def test_share_of_labels_does_not_depend_on_the_sample(spark):
    rng, docs, marks = random.Random(2), [], []
    for i in range(1200):
        good = i % 6 > 0
        # one in four looks like the other kind, so that the curve cannot part them
        looks = good if rng.random() < 0.75 else not good
        docs.append((i, cases.sentence(rng, 30) if looks else " | ".join(cases.sentence(rng, 1, "abcdxyz") for _ in range(30))))
        marks.append((i, int(good)))
    table = cases.documents(spark, docs)
    for per_label in (1500, 100):
        found = Q.quality_scores(table, labels(spark, marks), per_label).toPandas()
        assert abs(found.score.mean() - 5 / 6) < 0.06, per_label
