"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of every key, with their rank from 1.

    Catalyst turns ``row_number() <= n`` into a group limit that runs before
    the shuffle, so a task never sends more than ``n`` rows of a key.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def dense_sequence(df: DataFrame, key: str, bucket: Column, order: list[Column], out: str = "seq") -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in order.

    Rows are numbered inside (key, bucket) and moved up by the size of the
    key's earlier buckets.  ``bucket`` must grow with ``order``, for example the
    day of the timestamp.  A key that holds a third of the table is thereby
    spread over its buckets; only the bucket counts are windowed per key.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(key, "_bucket").orderBy(*order)
    return (
        rows.join(offsets, [key, "_bucket"])
        .withColumn(out, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("long"))
        .drop("_bucket", "_offset")
    )


def previous_row(df: DataFrame, key: str, seq: str, fields: dict[str, str]) -> DataFrame:
    """Attach fields of the row with the preceding sequence number.

    An equi-join on (key, seq) in place of ``lag``: all rows of one key need
    not meet in one task.
    """
    prior = df.select(
        F.col(key), (F.col(seq) + 1).alias(seq), *[F.col(src).alias(dst) for src, dst in fields.items()]
    )
    return df.join(prior, [key, seq], "left")
