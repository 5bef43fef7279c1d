import hashlib
import random
import zlib

import cases
import pytest
from pyspark.sql import functions as F

from tallygrain.llm import manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def root_and_proofs(nodes):
    """The root, and for each node its siblings level by level."""
    ways, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for j in run:
                for i in groups[j]:
                    ways[i].append(("".join(nodes[k] for k in run if k < j), "".join(nodes[k] for k in run if k > j)))
        groups = [[i for j in run for i in groups[j]] for run in runs]
        nodes = [h(*[nodes[j] for j in run]) for run in runs]
    return (nodes or [None])[0], ways


def brute(rows):
    by = {}
    for r in rows:
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        cut = r["text"].replace("\n", "") if tampered and r["text"] is not None else r["text"]
        key = b"" if r["source"] is None else b"s" + r["source"].encode()
        by.setdefault(key, []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, cut), r["source"]))
    for group in by.values():
        group.sort(key=lambda x: x[:4])
    names = sorted(by)
    subs = [root_and_proofs([x[2] for x in by[n]]) for n in names]
    root, ups = root_and_proofs([s[0] for s in subs])
    out = []
    for name, (sub, ways), up in zip(names, subs, ups):
        for (known, doc, own, altered, source), way in zip(by[name], ways):
            node = altered
            for left, right in way + up:
                node = h(left, node, right)
            out.append((doc if known else None, source, own, sub, root, h(*[a + b for a, b in way + up]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equals_brute_force(spark, levels):
    rng = random.Random(3)
    rows = cases.texts() + [(100 + i, cases.sentence(rng, 5) + ("\n" if i % 3 else " ") + "x") for i in range(90)]
    docs = cases.documents(spark, rows)
    found = M.manifest(docs, levels).collect()
    assert sorted(map(tuple, found), key=repr) == brute(docs.collect())
    assert {r["verified"] for r in found} == {True, False}


def test_many_sources_and_sizes(spark):
    # sources of 1 to 30 rows: lone leaves, whole blocks, last runs of one node
    rows = [(1000 * k + i, f"t{i}\n") for k in range(1, 31) for i in range(k)]
    docs = cases.documents(spark, rows).withColumn("source", F.concat(F.lit("ß"), (F.col("doc_id") / 1000).cast("int").cast("string")))
    assert sorted(map(tuple, M.manifest(docs, 1).collect()), key=repr) == brute(docs.collect())


def test_one_leaf_and_empty_table(spark):
    docs = cases.documents(spark, [(7, "a\nb")])
    (r,) = M.manifest(docs).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("")
    assert M.manifest(docs.limit(0)).collect() == []


def test_any_change_of_a_column_shows(spark):
    docs = cases.documents(spark)
    before = M.manifest(docs).first()["root"]
    for column, value in (("lang", F.lit("-")), ("n_chars", F.col("n_chars") + 1), ("text", F.concat("text", F.lit(" "))), ("source", F.lit("")), ("doc_id", F.col("doc_id") + 1)):
        assert M.manifest(docs.withColumn(column, value)).first()["root"] != before, column
    # columns outside the leaf do not count
    assert M.manifest(docs.withColumn("value", F.lit(9))).first()["root"] == before
