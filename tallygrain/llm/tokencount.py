"""Token counts with a cache keyed by digests.

A text is known by the digest of its content (a null text is an empty one) and
a tokenizer by the digest of its model file.  Counts that the cache holds for
both are joined; of what is missing each distinct text is encoded once and
appended.  Texts travel compressed, and each task sends a text once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrain.llm.shared import raw_texts, tidy
from tallygrain.session import work_dir

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
SEEN = 500_000  # digests a task remembers when it drops copies before the shuffle
_processor = None


def model_digest(model: str = MODEL) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    import public_tokenizers
    import sentencepiece

    return hashlib.sha256(Path(public_tokenizers.path(model)).read_bytes() + sentencepiece.__version__.encode()).hexdigest()


def _library():
    global _processor
    if _processor is None:
        import public_tokenizers
        import sentencepiece

        _processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    return _processor


def cached(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer; a cache that is not there yet is empty."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    # two runs that met the same text may both have appended it, with equal counts
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _content(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def encode_missing(docs: DataFrame, path: str) -> None:
    """Append the counts of all texts that the cache does not hold, each distinct text encoded once."""
    tokenizer = model_digest()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            digests, blobs = [], []
            for d, t in zip(b["digest"].to_pylist(), raw_texts(b["text"])):
                if d not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    digests.append(d)
                    blobs.append(press.compress(t))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["digest", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = zstandard.ZstdDecompressor(), None
        for b in batches:
            digests, texts = [], []
            for d, blob in zip(b["digest"].to_pylist(), b["blob"].to_pylist()):
                if d != last:  # copies follow each other
                    digests.append(d)
                    texts.append(open_.decompress(blob).decode())
                last = d
            n = [len(_library().encode(t, num_threads=1)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokenizer] * len(n), pa.string()), pa.array(digests, pa.binary()), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"]
            )

    known = cached(docs.sparkSession, path, tokenizer).select("digest")
    texts = _content(docs).select("digest", "text").mapInArrow(tidy(squeeze), "digest binary, blob binary")
    misses = texts.join(known, "digest", "left_anti").repartition("digest").sortWithinPartitions("digest")
    misses.mapInArrow(tidy(count), CACHE_SCHEMA).write.mode("append").parquet(path)


def token_counts(docs: DataFrame, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for every row of ``docs``.

    ``cache`` is a table folder that later runs may share; without it a fresh
    one below the shared folder is used.  A null text counts as empty and has
    no tokens.  Rows with null ids and repeated rows are counted like others.
    """
    path = cache or work_dir(docs.sparkSession, "token-cache")
    encode_missing(docs, path)
    counts = cached(docs.sparkSession, path, model_digest())
    rows = _content(docs).drop("text").join(counts, "digest")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
