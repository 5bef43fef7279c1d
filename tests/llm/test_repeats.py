import hashlib
import random
import re

import cases
import numpy as np
import pytest

from tallygrain.llm import repeats as R


def brute(rows, window=20):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def mixed_rows(seed, n=120):
    rng = random.Random(seed)
    passages = [cases.sentence(rng, k) for k in (19, 20, 21, 25, 40, 70)]
    rows = []
    for i in range(n):
        parts = [cases.sentence(rng, rng.randint(0, 15)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 3)
            parts.insert(rng.randrange(3), " ".join(p[a:]))
        rows.append((i, "\n".join(parts) if i % 10 else rows[-1][1] if rows else ""))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(R, "FOLD", 50)
    rows = mixed_rows(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.repeated_spans(cases.documents(spark, rows)).collect()}
    assert got == brute(rows)
    assert sum(x[1] for x in got.values()) > 100


@pytest.mark.parametrize(("window", "base"), [(4, 4), (6, 3), (24, 3)])
def test_other_lengths(spark, window, base):
    rows = mixed_rows(3, 60)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.repeated_spans(cases.documents(spark, rows), window, base).collect()}
    assert got == brute(rows, window)


def test_window_must_be_base_doubled():
    with pytest.raises(ValueError):
        R.Repeats(20, 6)


def test_sliding_and_words():
    x = np.random.default_rng(0).integers(1, 100, 50).astype(np.uint64)
    for width in (1, 2, 5, 11, 16):
        low = R.sliding(x, width, True, 0)[: 50 - width + 1]
        assert low.tolist() == [x[i : i + width].min() for i in range(50 - width + 1)]
    for _, t in cases.texts():
        raw = (t or "").encode()
        assert len(R.word_hashes(raw)) == len(raw.split())
    a, b = R.word_hashes(b" xy ab xy"), R.word_hashes("é\x0bxy".encode())
    assert a[0] == a[2] == b[1] != a[1]


def test_edges(spark):
    docs = cases.documents(spark)
    rows = R.repeated_spans(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[-13]["n_removed"] == 0 and by[1]["n_removed"] == 60 == by[2]["n_removed"]
    assert by[3]["n_removed"] == 60 and by[3]["n_words"] == 80
    # rows that share id and text are one document
    assert [r["n_removed"] for r in rows if r["doc_id"] == 9] == [60, 60]
    assert by[12]["n_removed"] > 0 and by[5]["n_words"] == 0
    assert by[4]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert R.repeated_spans(docs.limit(0)).collect() == []
    kept = R.without_repeats(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    left = {r["doc_id"]: r for r in kept.collect()}
    assert 1 not in left and 4 in left and 5 in left and left[9]["text"] == "tail" and left[9]["n_chars"] == 4
    assert left[7]["text"] == cases.texts()[6][1]
    assert R.without_repeats(docs.limit(0)).collect() == []
