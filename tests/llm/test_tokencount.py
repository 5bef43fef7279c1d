import cases
import pytest

from tallygrain.llm import tokencount as T

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda t: len(p.encode(t))


def test_counts(spark, library):
    docs = cases.documents(spark)
    got = cases.plain(T.token_counts(docs).collect())
    want = cases.plain([(i, len((t or "").encode()), library(t or ""), library(t or "") > 4096) for i, t in cases.texts()])
    assert got == want
    assert any(r[3] for r in got)
    assert T.token_counts(docs.limit(0)).collect() == []


def test_only_distinct_misses_are_encoded_and_appended(spark, library, tmp_path):
    docs, path = cases.documents(spark), str(tmp_path / "cache")
    distinct = {t or "" for _, t in cases.texts()}
    T.token_counts(docs.where("doc_id < 7"), path).collect()
    first = spark.read.parquet(path)
    assert first.count() == len({t or "" for i, t in cases.texts() if i is not None and i < 7})
    kept = {tuple(r) for r in first.collect()}
    got = T.token_counts(docs, path).collect()
    assert len(got) == docs.count()
    rows = spark.read.parquet(path).collect()
    assert len(rows) == len(distinct) and kept <= {tuple(r) for r in rows}


def test_counts_of_another_tokenizer_are_not_used(spark, library, tmp_path):
    docs, path = cases.documents(spark, [(1, "some words")]), str(tmp_path / "cache")
    T.token_counts(docs, path).collect()
    import pyspark.sql.functions as F

    other = spark.read.parquet(path).withColumns({"tokenizer": F.lit("other"), "n_tokens": F.lit(99).cast("long")}).collect()
    spark.createDataFrame(other, T.CACHE_SCHEMA).write.mode("append").parquet(path)
    assert [r["n_tokens"] for r in T.token_counts(docs, path).collect()] == [library("some words")]
