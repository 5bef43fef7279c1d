import random
from itertools import product

import cases
import numpy as np
import pytest

from tallygrain.llm import toxicity as T

BAD = ["grimble", "snarfoo", "blutwurg"]


def rows(n=300, seed=4):
    rng, docs, marks = random.Random(seed), [], []
    for i in range(n):
        words = cases.sentence(rng, 60).split()
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "ä", "en"]))
        docs.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    return docs, marks


def labels(spark, marks):
    return spark.createDataFrame([(i, 1, x, "t") for i, x in marks], "doc_id long, quality int, toxic int, text string")


def test_marginals_equal_the_sum_over_all_taggings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        score, trans, first = 2 * rng.normal(size=n), rng.normal(size=(2, 2)), rng.random(n) < 0.3
        first[0] = True
        z, toxic, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in product((0, 1), repeat=n):
            w = np.exp(score @ np.array(tags) + sum(trans[tags[i - 1], tags[i]] for i in range(n) if not first[i]))
            z, toxic = z + w, toxic + w * np.array(tags)
            for i in range(n):
                if not first[i]:
                    pairs[tags[i - 1], tags[i]] += w
        found = T.marginals(score, trans, first)
        assert np.allclose(found[0], toxic / z) and np.allclose(found[1], pairs / z)


def test_long_chains_do_not_overflow():
    found, pairs = T.marginals(np.tile([50.0, -50.0, 0.0], 40_000), np.array([[3.0, -3.0], [-3.0, 3.0]]), np.arange(120_000) == 0)
    assert np.isfinite(found).all() and abs(pairs.sum() - 119_999) < 1e-3


def test_held_out_accuracy_and_spans(spark):
    docs, marks = rows()
    found = T.toxicity(cases.documents(spark, docs), labels(spark, marks)).toPandas()
    truth, texts = dict(marks), dict(docs)
    held = found[found.held_out]
    assert len(held) > 30 and found.score.between(0, 1).all()
    assert (held.predicted == [truth[i] for i in held.doc_id]).mean() > 0.95
    spans = [texts[i][s["begin"] : s["end"]] for i, row in zip(found.doc_id, found.spans) for s in row]
    assert len(spans) > 200
    assert sum(w.startswith(tuple(BAD)) for s in spans for w in s.split()) > 0.95 * sum(len(s.split()) for s in spans)


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    docs, marks = rows()
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, x in marks]
    table = cases.documents(spark, docs)
    a, b = (T.toxicity(table, labels(spark, m)).toPandas().sort_values("doc_id") for m in (marks, flipped))
    assert a.score.tolist() == b.score.tolist()


@pytest.mark.parametrize("marks", [[], [(1, 1), (2, 1), (3, 1)], [(1, None), (None, 1)], [(1, 0), (1, 1), (2, 0), (3, 1), (7, 0), (9, 1)]])
def test_edges(spark, marks):
    docs = cases.documents(spark)
    found = T.toxicity(docs, labels(spark, marks)).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all() and found.predicted.isin([0, 1]).all()
    assert (found.toxic_words[found.doc_id.isin([4, 5, 6])] == 0).all()
    assert found[found.doc_id == 9].score.nunique() == 1


def test_empty_tables(spark):
    docs, marks = rows(30)
    docs = cases.documents(spark, docs)
    assert T.toxicity(docs.limit(0), labels(spark, marks)).collect() == []


def test_the_end_of_a_long_text_counts(spark):
    docs, marks = rows()
    model = T.fit(cases.documents(spark, docs), labels(spark, marks))
    clean = cases.sentence(random.Random(1), 20_000)
    long = clean + " İ“" + BAD[0] + "” end"
    (_, n, before), (_, m, after) = T.tagged(model, [clean, long])
    new = [s for s in after if s["begin"] >= len(clean)]
    assert m == n + 3 and [long[s["begin"] : s["end"]] for s in new] == [BAD[0]]


def test_pieces_keep_every_character():
    text = "ab cd\nef " * 50 + "x" * 300
    parts = T.pieces(text, 40)
    assert "".join(parts) == text and max(map(len, parts)) == 40
