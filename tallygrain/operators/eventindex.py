"""A stored index from hashes to the events that hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrain.functions.digest import Digest, claim_key, sha2_digest
from tallygrain.operators.explorer import HASHES, interpret, search_events

BUCKETS = 256


@dataclass(frozen=True)
class EventIndex:
    """The log of sealed events and its hashes, both as tables below ``folder``.

    The log lies in buckets by claim key.  The hashes are rows (hash in small
    letters, bucket of the log, claim_key, seq; texts as 64-bit digests) in buckets
    by hash, one for each different hash of an event, whichever of the five columns
    it stands in.  A search for a hash reads one bucket of hashes and then only the
    log's buckets of the claims found there, where the texts themselves are compared;
    one for a claim reads one bucket of the log.  Null hashes are not indexed.  The
    rebalance hint lets Spark split the bucket of a hash that every first record
    holds, or of a very long trail, when it is written.
    """

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def append(self, events: DataFrame, epoch: int) -> None:
        """Add events under the number of their batch; the same number again replaces them."""
        rows = events.withColumn("part", self._bucket(F.lower("claim_key")))
        log = f"{self.folder}/log/epoch={epoch}"
        rows.hint("rebalance", "part").write.partitionBy("part").mode("overwrite").parquet(log)
        # from what was written, so that events that are costly to make are made once
        events = self.spark.read.schema(events.schema).parquet(log)
        each = F.explode(F.array_distinct(F.transform(F.array_compact(F.array(*[F.lower(c) for c in HASHES])), lambda h: F.xxhash64(h))))
        entries = events.select(each.alias("hash"), *self._place()).withColumn("bucket", self._bucket(F.col("hash")))
        entries.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/hashes/epoch={epoch}")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log").drop("epoch")

    def _place(self) -> list[Column]:
        """Where the log has an event: its bucket, a digest of its claim key, its number."""
        return [self._bucket(F.lower("claim_key")).alias("part"), F.xxhash64("claim_key").alias("key"), F.col("seq")]

    def found(self, query: str) -> DataFrame:
        """(part, key, seq) of the events that hold a hash; digests may bring a few others."""
        value = F.xxhash64(F.lit(query.strip().lower()))
        entries = self.spark.read.parquet(f"{self.folder}/hashes").where((F.col("bucket") == self._bucket(value)) & (F.col("hash") == value))
        return entries.select("part", "key", "seq")

    def search(self, query: str, digest: Digest = sha2_digest) -> DataFrame:
        """What ``search_events`` finds in the whole log."""
        kind, pool = interpret(query), self.log()
        if kind == "claimId":
            pool = pool.where(F.col("part") == self._bucket(F.lower(claim_key(F.lit(query.strip().upper()), digest))))
        elif kind == "hash":
            pool = pool.withColumn("key", F.xxhash64("claim_key")).join(self.found(query), ["part", "key", "seq"], "left_semi").drop("key")
        return search_events(pool.drop("part"), query, digest=digest)
