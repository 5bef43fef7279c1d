"""From raw documents to packed training sequences; each stage's table is written and read again.

The near-duplicate stage follows the dealt fingerprint contract (three-word
shingles, at most three differing bits); the decontamination stage takes
five-token windows and a coverage of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrain.llm import language, packing, repeats, simhash, templates
from tallygrain.llm.shared import documents, quoted, saved, table
from tallygrain.session import configure

# a text that no language's trees code in fewer bits a byte than this is no text in any of them
MOST_BITS = 7.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that no language can code, go.

    Where no document names its language there is nothing to learn from, and all
    documents with letters stay.
    """
    model = language.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model, docs.columns)
    language_, _, bits = quoted(found.columns[len(docs.columns) :])
    return found.where((language_ != language.UNKNOWN) & (bits <= MOST_BITS)).select(*quoted(docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.one_of_each_group(docs)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier window are cut; a document of which nothing is left goes."""
    return repeats.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left in windows of mixed sources."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_text", repeated_text_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # models, fingerprints and tokenizers are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    configure(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
