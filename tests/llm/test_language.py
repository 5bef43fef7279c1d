import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrain.llm import language as L


def brute_bits(rows, text, language, contexts):
    """Code length by walking the trees byte by byte."""
    counts = {}
    for lang, t in rows:
        if lang != language:
            continue
        t = L.START + t
        for i in range(L.ORDER, len(t)):
            for k in range(L.ORDER + 1):
                c = t[i - k : i]
                if k < L.ORDER or c in contexts:
                    counts.setdefault(c, {}).setdefault(t[i], 0)
                    counts[c][t[i]] += 1
    total, t = 0.0, L.START + text
    for i in range(L.ORDER, len(t)):
        gone = set()
        for k in range(L.ORDER, -1, -1):
            own = {x: n for x, n in counts.get(t[i - k : i], {}).items() if x not in gone}
            n, kinds = sum(own.values()), len(own)
            if t[i] in own:
                total += np.log2((n + kinds) / own[t[i]])
                break
            if n:
                total += np.log2((n + kinds) / kinds)
            gone |= set(own)
        else:
            total += np.log2(256 - min(len(gone), 255))
    return total


def model_and_rows():
    rng = random.Random(1)
    rows = [("aa", cases.sentence(rng, 30, "abcde").encode()) for _ in range(4)] + [("bb", cases.sentence(rng, 30, "defgé").encode()) for _ in range(4)]
    grams = {}
    for lang, t in rows:
        s = L.START + t
        for i in range(len(s) - 3):
            g = int.from_bytes(s[i : i + 4], "big")
            grams[lang, g] = grams.get((lang, g), 0) + 1
    keys = list(grams)
    return L.freeze(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([grams[k] for k in keys]), 10**6), rows


@pytest.mark.parametrize("text", ["abc de", "x", "éé a", "abcdefg\nabc zz", ""])
def test_code_lengths_are_those_of_the_trees(text):
    model, rows = model_and_rows()
    contexts = {(L.START + t)[i : i + 3] for _, t in rows for i in range(len(t))}
    got = L.code_lengths(model, [text.encode(), b"ab"])[0]
    want = [brute_bits(rows, text.encode(), lang, contexts) for lang in model.languages]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_chunks_do_not_change_lengths(monkeypatch):
    model, _ = model_and_rows()
    text = cases.sentence(random.Random(3), 500, "abcdefg").encode()
    whole = L.code_lengths(model, [text])
    monkeypatch.setattr(L, "CHUNK", 97)
    assert np.allclose(L.code_lengths(model, [text]), whole, rtol=1e-6)


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, cases.sentence(rng, 20, ("abcdef", "efghij")[i % 2])) for i in range(200)]
    found = L.language_id(cases.documents(spark, rows)).toPandas()
    known = found[found.held_out & (found.doc_id % 5 != 4)]
    assert len(known) > 20
    assert (known.lang_pred == [("xx", "yy")[i % 2] for i in known.doc_id]).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_edges(spark):
    docs = cases.documents(spark)
    rows = L.language_id(docs).collect()
    assert len(rows) == docs.count()
    by_text = {r["doc_id"]: r for r in rows}
    assert all(by_text[i]["lang_pred"] == "und" and by_text[i]["score"] == 0 for i in (4, 5, 6, 11))
    assert L.language_id(docs.limit(0)).collect() == []
    unlabelled = L.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_languages_with_most_texts_get_trees(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    rows = [(i, "zz", f"zed {i}") for i in range(30)] + [(100 + i, "yy", f"why {i}") for i in range(20)] + [(200 + i, f"a{i}", f"dirt {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert L.fit(docs).languages == ["yy", "zz"]


def test_every_language_keeps_contexts():
    lang = np.array(["big"] * 50 + ["small"] * 5)
    gram = np.concatenate([np.arange(50), 1000 + np.arange(5)])
    n = np.array([1000] * 50 + [1] * 5)
    kept = L._most_frequent(gram, np.searchsorted(["big", "small"], lang), n, 10)
    assert len(kept) == 10 and sum(k >= 1000 for k in kept) == 5


def test_a_small_table_still_gives_finite_lengths(monkeypatch):
    model, rows = model_and_rows()
    monkeypatch.setattr(L, "TABLE_BYTES", 4 * model.symbols * len(model.languages) * (model.symbols + 9))
    grams = {}
    for lang, t in rows:
        s = L.START + t
        for i in range(len(s) - 3):
            g = int.from_bytes(s[i : i + 4], "big")
            grams[lang, g] = grams.get((lang, g), 0) + 1
    small = L.freeze(np.array([k[0] for k in grams]), np.array([k[1] for k in grams]), np.array([*grams.values()]))
    bits = L.code_lengths(small, [b"abc de", b"gfed fed"])
    assert small.bits.nbytes <= 2 * L.TABLE_BYTES and np.isfinite(bits).all()
    assert bits[0].argmin() == 0 and bits[1].argmin() == 1
