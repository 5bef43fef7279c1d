import random

import cases
import pytest

import corpus_pipeline as P
from tallygrain.llm.queries import ORACLES, QUERIES
from tallygrain.llm.shared import saved


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    item, passage = cases.sentence(rng, 30), cases.sentence(rng, 60)
    rows = [(i, cases.sentence(rng, 80, ("abcdef", "efghij")[i % 2])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1])]  # copies
    rows += [(110, cases.sentence(rng, 40) + " " + passage), (111, passage + " " + cases.sentence(rng, 40))]  # a shared passage
    rows += [(120, cases.sentence(rng, 20) + " " + item + " " + cases.sentence(rng, 20))]  # a leak
    rows += [(130, "123 456"), (131, None)]  # no language
    cases.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), dict(rows), passage


def test_each_decision_takes_effect_and_clean_documents_stay(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after = {}
    for name, stage in P.STAGES[:-1]:
        columns = docs.columns
        docs = saved(stage(spark, docs, path), name)
        assert docs.columns == columns
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) - set(after["language"]) == {130, 131}
    assert set(after["language"]) - set(after["near_duplicates"]) == {100, 101}
    assert set(after["near_duplicates"]) == set(after["repeated_text"])
    changed = {i for i, t in after["repeated_text"].items() if t != rows[i]}
    assert changed == {111} and len(after["repeated_text"][111].split()) == 40
    assert set(after["repeated_text"]) - set(after["decontamination"]) == {120}
    assert all(after["decontamination"][i] == rows[i] for i in range(60))
    packed = P.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in packed} == set(after["decontamination"])
    again = P.run(spark, path).collect()
    assert sum(r["length"] for r in again) == sum(r["length"] for r in packed)


def test_stages_stand_edges(spark, folder):
    path, docs = folder[0], cases.documents(spark)
    for _, stage in P.STAGES:
        stage(spark, docs, path).collect()
        assert stage(spark, docs.limit(0), path).collect() == []


def test_documents_stay_where_no_language_is_named(spark):
    docs = spark.createDataFrame([(1, None, "some words"), (2, None, "слова"), (3, None, "12 34"), (4, None, None)], "doc_id long, lang string, text string")
    assert {r.doc_id for r in P.language_stage(spark, docs, "").collect()} == {1, 2}


def test_registered_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES) and [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_text", "decontamination", "packing"]
