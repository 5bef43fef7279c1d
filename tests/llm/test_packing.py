import random
import zlib

import cases
import numpy as np
import pytest

from tallygrain.llm import packing as P
from tallygrain.llm.wordpiece import encoded_ids

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [t or "" for _, t in cases.texts()] + ["It's 'Style", "É́x é", "x" * 300 + ",y", "Ä.Ö;ß", "a\x85b\xa0c d", "<|startoftext|>a", "1½²", "ΑΣ ΑΣ. İ", "a’s b"])
def test_ids_are_the_librarys(library, text):
    assert encoded_ids(text).tolist() == library(text)
    assert encoded_ids(text).tolist() == library(text)  # once more, from the cache


def test_places_of_ids_are_not_worked_out(monkeypatch):
    from tallygrain.llm import wordpiece as W

    class Fast:
        def __init__(self, tokenizer):
            self.encode_batch_fast = tokenizer.encode_batch_fast  # and no ``encode``

    tokenizer, ends = W._library()
    ids = tokenizer.encode("It's brand-new", add_special_tokens=False).ids
    monkeypatch.setattr(W, "_tokenizer", (Fast(tokenizer), ends))
    assert W.encoded_ids("It's brand-new").tolist() == ids


def checked(rows, texts, library, length):
    """Every id in one piece, offsets gapless, all windows full but the last."""
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts:
        ids = np.array([*library(text or ""), P.END], "<u4")
        own = sorted((r for r in got[doc]), key=lambda r: r["start"])
        if sum(r["length"] for r in own) != len(ids):  # repeated rows
            continue
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for w in sorted(windows):
        at = 0
        for offset, n in sorted(windows[w]):
            assert offset == at and n > 0
            at += n
        sizes.append(at)
    assert sorted(windows) == list(range(len(windows)))
    assert all(n == length for n in sizes[:-1]) and 0 < sizes[-1] <= length
    return windows


@pytest.mark.parametrize("length", [64, 2048])
def test_windows_hold_the_corpus_proportions(spark, library, length):
    rng = random.Random(8)
    texts = [(i, cases.sentence(rng, rng.randint(0, 60))) for i in range(6, 150)]
    rows = P.pack(cases.documents(spark, texts).repartition(5), length=length).collect()
    checked(rows, texts, library, length)
    total = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + r["length"]
    every = sum(total.values())
    last = max(r["sequence_id"] for r in rows)
    for s, n in total.items():
        for w in range(last):
            own = sum(r["length"] for r in rows if r["source"] == s and r["sequence_id"] <= w)
            assert abs(own - n * (w + 1) * length / every) <= 2  # the deficit never passes two tokens


def test_targets_hold_until_a_queue_runs_short(spark, library):
    rng = random.Random(9)
    texts = [(i, cases.sentence(rng, 30)) for i in range(120)]
    rows = P.pack(cases.documents(spark, texts), shares={"s0": 3, "s1": 1}, length=64).collect()
    windows = checked(rows, texts, library, 64)
    first = {r["source"]: 0 for r in rows}
    for r in rows:
        if r["sequence_id"] < 5:
            first[r["source"]] += r["length"]
    assert len(windows) > 20 and first["s2"] == 0 and abs(first["s0"] - 240) <= 2


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 10_000}, {"a": 5, "b": 5, "c": 7}, {}])
@pytest.mark.parametrize("shares", [None, {"a": 1}, {"a": 1, "b": 9}, {"z": 4}])
def test_schedule_uses_every_token_once(sizes, shares):
    phases = P.schedule(sizes, shares, 16)
    seen = set()
    for q, n in sizes.items():
        begins = [p.given.get(q, 0) for p in phases]
        at = 0
        while at < n:
            step = min(3, n - at)
            for start, size, window, offset in P.pieces(phases, begins, q, at, step, 16):
                for k in range(size):
                    assert (window, offset + k) not in seen
                    seen.add((window, offset + k))
            at += step
    total = sum(sizes.values())
    assert seen == {(i // 16, i % 16) for i in range(total)}


def test_many_small_sources_share_a_queue(spark, library):
    rng = random.Random(10)
    texts = [(i, cases.sentence(rng, 5)) for i in range(200)]
    docs = cases.documents(spark, texts)
    docs = docs.withColumn("source", docs["doc_id"].cast("string"))
    checked(P.pack(docs, length=16).collect(), texts, library, 16)


def test_edges(spark, library):
    docs = cases.documents(spark)
    rows = P.pack(docs).collect()
    checked(rows, [x for x in cases.texts() if x[0] not in (8, 9, None)], library, 2048)
    assert sum(r["length"] for r in rows) == sum(len(library(t or "")) + 1 for _, t in cases.texts())
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 5] == [1]
    assert P.pack(docs.limit(0)).collect() == []
