"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrain.session import work_dir

# 64-bit constants of the multiply-and-shift mixers below
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LETTER = r"[^\W\d_]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Cuts lineage in a way that survives lost executors; the columns become
    nullable, the rows stay as they are.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of phases that are done.

    It does so once the driver's garbage collectors have found that nothing
    refers to them; a phase whose result is written says when that is.  What the
    first round lets go of keeps other things alive until the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key written as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % n


def batches_of(texts: Iterator[bytes | None], limit: int) -> Iterator[list[bytes]]:
    """Groups of texts of about ``limit`` bytes; one longer text is a group of its own."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    return (x ^ (x >> np.uint64(27))) * MIX_A


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until no name in ``taken`` equals one, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and blanks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives free memory back when it ends.

    Spark keeps idle Python workers for the next task, so what allocators hold
    on to would count against the executor for as long.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
