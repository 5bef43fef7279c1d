"""The near-duplicate search as stored tables that grow with each batch of pictures.

``entries`` keeps, for every hash, the two earliest claims that a batch brought;
``groups`` keeps every hash by either half of its bits, for hashes that differ in
one chunk only; ``blocks`` keeps it by each of the first blocks of its choices.
All are partitioned by batch and by a digest of the key.  A batch writes only its
own partitions, so a repeated batch writes the same rows again, and a search reads
only the buckets its own keys fall into: what it shuffles follows the batch and not
the archive.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrain import constants as C
from tallygrain.operators import neardup as ND
from tallygrain.operators.spread import first_per_key
from tallygrain.session import shuffles_removed

ENTRIES = "code long, created_at timestamp, claim_id string, file_id string, epoch int, bucket int"
GROUPS = "mask long, code long, epoch int, bucket int"
BLOCKS = "key long, code long, epoch int, bucket int"
WHOLE = -1  # the mask that looks at every bit
FEW_KEYS = 100_000  # keys of a batch that go to every task instead of shuffling what is stored


def _chunk_masks() -> list[int]:
    """Every bit, then all bits but those of one chunk; as signed numbers."""
    return [WHOLE, *(mask for _, mask in ND.chunk_masks())]


@dataclass(frozen=True)
class PhotoIndex:
    """Pictures stored so far, below ``folder``; ``blocks`` and ``buckets`` stay as they are for its whole life.

    ``upto`` hides later batches: a batch that is repeated sees what it saw at first.
    """

    spark: SparkSession
    folder: str
    blocks: int = 9
    buckets: int = 64
    upto: int | None = None

    def until(self, epoch: int) -> PhotoIndex:
        return replace(self, upto=epoch)

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _touched(self, asked: DataFrame) -> dict[int, int]:
        """How many keys fall into each bucket: at most ``buckets`` small numbers, whatever the number of pictures."""
        return {r["bucket"]: r["count"] for r in asked.groupBy("bucket").count().collect()}

    def _read(self, name: str, schema: str, asked: DataFrame | dict[int, int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        if self.upto is not None:
            rows = rows.where(F.col("epoch") <= self.upto)
        if asked is not None:
            rows = rows.where(F.col("bucket").isin([*(asked if isinstance(asked, dict) else self._touched(asked))]))
        return rows

    def _few(self, touched: dict[int, int], most: int | None = None) -> bool:
        """Whether keys go to every task.  Spark takes exploded keys for as few as the hashes they come from."""
        return sum(touched.values()) <= (FEW_KEYS if most is None else most)

    def _met(self, asked: DataFrame, rows: DataFrame, on: list[str], few: bool) -> DataFrame:
        return asked.hint("broadcast").join(rows, on) if few else asked.hint("merge").join(rows, on)

    def _write(self, table: DataFrame, name: str, epoch: int, *order: str) -> None:
        """One file a bucket and batch; a bucket is a fixed share of the batch's keys."""
        with shuffles_removed(self.spark):
            out = table.repartition("bucket").sortWithinPartitions("bucket", *order)
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def append(self, photos: DataFrame, epoch: int) -> None:
        """Store a batch (claim_id, file_id, p_hash, created_at); the same epoch again replaces it."""
        rows = photos.select("claim_id", "file_id", "created_at", ND.code(F.col("p_hash")).alias("code"))
        # of a hash the two earliest claims are enough to leave out one's own
        entries = _two_earliest(rows, ["code"]).withColumn("bucket", self._bucket("code"))
        self._write(entries, "entries", epoch, "code")
        at = f"{self.folder}/entries/epoch={epoch}"
        self._write_keys(self.spark.read.schema("code long").parquet(at).distinct(), epoch)

    def _write_keys(self, codes: DataFrame, epoch: int) -> None:
        # two rows a hash, and as many as there are first blocks
        codes = ND.stored(codes.where(F.col("code").isNotNull()), "index-codes")
        groups = ND.halves(codes).select("mask", "code", self._bucket("mask", "bits").alias("bucket"))
        self._write(groups, "groups", epoch, "mask", "code")
        keys = codes.select(F.explode(ND.first_block_keys(F.col("code"), self.blocks)).alias("key"), "code")
        self._write(keys.withColumn("bucket", self._bucket("key")), "blocks", epoch, "key", "code")

    def compacted(self, folder: str) -> PhotoIndex:
        """The same pictures as one batch in another folder, so that files stay few; go on with the result."""
        new = replace(self, folder=folder, upto=None)
        entries = _two_earliest(self._read("entries", ENTRIES).drop("epoch", "bucket"), ["code"])
        new._write(entries.withColumn("bucket", self._bucket("code")), "entries", -1, "code")
        new._write_keys(self._read("entries", ENTRIES).select("code").distinct(), -1)
        return new

    def duplicates(self, photos: DataFrame, runs: DataFrame | None = None) -> DataFrame:
        """What ``neardup.near_duplicates`` finds for these pictures among all that are stored.

        ``photos`` must be stored already if they are to find each other.
        """
        extra = ["seq"] if "seq" in photos.columns else []
        mine = photos.select("claim_id", "file_id", *extra, ND.code(F.col("p_hash")).alias("code"))
        asked = mine.select("claim_id", "code").distinct()
        if runs is None:
            asked = asked.withColumn("run_at", F.lit(None).cast("timestamp"))
        else:
            asked = asked.hint("merge").join(runs.select("claim_id", "run_at"), "claim_id")
        asked = ND.stored(asked, "index-asked")

        # where one claim alone asks about a hash, its own entries go no further than the cut to two
        alone = F.when(F.min("claim_id") == F.max("claim_id"), F.min("claim_id"))
        codes = ND.stored(asked.groupBy("code").agg(alone.alias("only")), "index-hashes")
        own = _two_earliest(self._groups_met(codes, [WHOLE]).drop("mask"), ["bucket", "other", "only"])
        own = own.where(F.col("only").isNull() | (F.col("only") != F.col("claim_id"))).withColumn("tier", F.lit(0))
        chunks = self._groups_met(codes.select("code"), _chunk_masks()[1:]).withColumn("tier", F.lit(1))
        first = ND.stored(self._best(asked, own.drop("only").unionByName(chunks.drop("mask"))), "index-first")
        left = ND.stored(asked.hint("merge").join(first.select("claim_id", "code"), ["claim_id", "code"], "left_anti"), "index-left")
        open_ = ND.stored(left.select("code").distinct(), "index-open")
        second = self._best(left, self._blocks_met(open_).withColumn("tier", F.lit(2)))
        found = mine.hint("merge").join(first.unionByName(second), ["claim_id", "code"])
        return found.select(
            "claim_id", "file_id", *extra, "tier",
            F.col("hit.claim_id").alias("match_claim_id"), F.col("hit.file_id").alias("match_file_id"),
            F.bit_count(F.col("code").bitwiseXOR(F.col("hit.code"))).alias("distance"),
        )

    def _groups_met(self, codes: DataFrame, masks: list[int]) -> DataFrame:
        """(code, mask, created_at, claim_id, file_id, other): entries that share the bits under a mask.

        Of the masks of chunks, those under which another hash is found.
        """
        found = []
        if WHOLE in masks:
            found.append(codes.withColumns({"mask": F.lit(WHOLE).cast("long"), "other": F.col("code")}))
        if rest := [m for m in masks if m != WHOLE]:
            others = self._chunks_met(codes.select("code")).where(F.col("mask").isin(rest))
            # a hash belongs to its own group
            found += [others, others.select("code", "mask", F.col("code").alias("other")).distinct()]
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more, allowMissingColumns=True)
        return self._entries_of(pairs)

    def _entries_of(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the entries of ``other``."""
        asked = pairs.withColumn("bucket", self._bucket("other"))
        touched = self._touched(asked)
        entries = self._read("entries", ENTRIES, touched).drop("epoch").withColumnRenamed("code", "other")
        return self._met(asked, entries, ["bucket", "other"], self._few(touched))

    def _chunks_met(self, codes: DataFrame) -> DataFrame:
        """(code, mask, other): different hashes that agree outside one chunk.

        They share the half without the chunk.  Of many hashes only those that share
        a half with another one are laid out by chunks: a chunk has few values, so a
        crowd that shares a half does not meet in pairs.
        """
        asked = ND.halves(codes)
        place = self._bucket("mask", "bits").alias("bucket")
        touched = self._touched(asked.select(place))
        stored = self._read("groups", GROUPS, touched).select("bucket", "mask", F.col("code").bitwiseAND(F.col("mask")).alias("bits"), "code")
        if self._few(touched):
            pairs = self._met(asked.select("*", place), stored.withColumnRenamed("code", "other"), ["bucket", "mask", "bits"], True)
            apart = F.col("code").bitwiseXOR(F.col("other"))
            masks = [m for m in _chunk_masks() if m != WHOLE]
            pairs = pairs.where(apart != 0).select("code", F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(m).cast("long")) for m in masks]).alias("mask"), "other")
            return ND.stored(pairs.where(F.col("mask").isNotNull()).distinct(), "index-chunks")
        stored = stored.drop("bucket")
        least, most = F.min("code").alias("least"), F.max("code").alias("most")
        shared = asked.unionByName(stored).groupBy("mask", "bits").agg(least, most).where("least < most").select("mask", "bits")
        shared = ND.stored(shared, "index-shared")
        some = lambda rows: ND.stored(rows.hint("merge").join(shared, ["mask", "bits"], "left_semi").distinct(), "index-halves")
        others = ND.by_chunk(some(stored)).withColumnRenamed("code", "other")
        pairs = ND.by_chunk(some(asked)).hint("merge").join(others, ["mask", "bits"]).where(F.col("code") != F.col("other"))
        return ND.stored(pairs.select("code", "mask", "other"), "index-chunks")

    def _blocks_met(self, codes: DataFrame) -> DataFrame:
        """(code, created_at, claim_id, file_id, other): entries of other hashes within the threshold."""
        asked = codes.select("code", F.explode(ND.first_block_keys(F.col("code"), self.blocks)).alias("key"))
        asked = asked.withColumn("bucket", self._bucket("key"))
        touched = self._touched(asked)
        # one block tells hashes apart less than a whole choice, so fewer of them may meet the archive one by one
        if self._few(touched, FEW_KEYS * (C.PHASH_CROSS + 1) // comb(self.blocks, C.PHASH_CROSS)):
            rows = self._read("blocks", BLOCKS, touched).drop("epoch").withColumnRenamed("code", "other")
            apart = F.bit_count(F.col("code").bitwiseXOR(F.col("other")))
            pairs = self._met(asked, rows, ["bucket", "key"], True).where(apart <= C.PHASH_CROSS).select("code", "other").distinct()
        else:
            # every hash once: by one half and over all batches
            half = ND.chunk_masks()[0][0]
            rows = self._read("groups", GROUPS).where(F.col("mask") == half).select("code").distinct()
            pairs = ND.block_matches(codes, rows).select("code", "other")
        pairs = ND.stored(pairs.where(F.col("code") != F.col("other")), "index-pairs")
        return self._entries_of(pairs)

    def _best(self, asked: DataFrame, near: DataFrame) -> DataFrame:
        """(claim_id, code, tier, hit): the earliest known entry of another claim in the lowest tier."""
        near = near.withColumnRenamed("claim_id", "of").select("code", "tier", "created_at", "of", "file_id", "other")
        # a hash's own crowd is cut to two claims before it meets the claims that ask
        two = _two_earliest(near.withColumnRenamed("of", "claim_id").withColumnRenamed("code", "asked").withColumnRenamed("other", "code"), ["asked", "tier"])
        two = two.select(F.col("asked").alias("code"), "tier", F.struct("created_at", "claim_id", "file_id", "code").alias("e"))
        met = asked.hint("merge").join(two, "code").where(
            (F.col("e.claim_id") != F.col("claim_id")) & (F.col("run_at").isNull() | (F.col("e.created_at") <= F.col("run_at")))
        )
        best = met.groupBy("claim_id", "code").agg(F.min(F.struct("tier", "e")).alias("b"))
        return best.select("claim_id", "code", "b.tier", F.col("b.e").alias("hit"))


def _two_earliest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the earliest entry of each of its two earliest claims."""
    rest = [c for c in ("created_at", "file_id", "code") if c not in keys]
    one = rows.groupBy(*keys, "claim_id").agg(F.min(F.struct(*rest)).alias("e")).select(*keys, "claim_id", "e.*")
    return first_per_key(one, keys, [F.col("created_at"), F.col("claim_id"), F.col("file_id")], 2).drop("rn")
