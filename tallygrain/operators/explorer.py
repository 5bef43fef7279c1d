"""The log of sealed events: newest rows, search, readable claim ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.digest import Digest, claim_key, sha2_digest
from tallygrain.functions.timefn import epoch_to_iso


HASHES = ("claim_key", "state_hash", "record_hash", "prev_record_hash", "tx_hash")


def sealed_events(trail: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """Trail rows as log events: claim id hashed, with tx_hash, block_number and log_index.

    Of these three the trail's own columns are taken.  Where it has none, the
    transaction is the record's digest, blocks follow time, one a minute, and the
    index is the record's number.
    """
    stand_ins = {
        "tx_hash": digest(F.concat(F.col("record_hash"), F.lit("tx"))),
        "block_number": F.floor(F.col("ts") / 60).cast("long"),
        "log_index": F.col("seq").cast("long"),
    }
    return trail.select(
        claim_key(F.col("claim_id"), digest).alias("claim_key"),
        *[c for c in trail.columns if c != "claim_id"],
        *[value.alias(name) for name, value in stand_ins.items() if name not in trail.columns],
    )


def recent_events(events: DataFrame, limit: int = C.RECENT_DEFAULT, from_block: int | None = None) -> DataFrame:
    """Newest events first; the limit stays within 1..100 and looks at 10 000 blocks."""
    n = min(max(limit, 1), C.RECENT_MAX)
    if from_block is None:
        # one number, computed once and used as a scalar
        head = events.agg((F.max("block_number") - (C.RECENT_BLOCKS - 1)).alias("b")).scalar()
        lowest: Column = F.greatest(F.lit(0), head)
    else:
        lowest = F.lit(from_block)
    return (
        events.where(F.col("block_number") >= lowest)
        .orderBy(F.desc("block_number"), F.desc("log_index"), F.desc("claim_key"))
        .limit(n)
        .withColumn("sealed_at_iso", epoch_to_iso(F.col("ts")))
    )


def interpret(query: str) -> str:
    q = query.strip()
    if re.match(r"(?i)^CLM-", q):
        return "claimId"
    return "hash" if re.match(r"^0x[0-9a-fA-F]{64}$", q) else "unknown"


def search_events(
    events: DataFrame, query: str, newest: int | None = None, digest: Digest = sha2_digest
) -> DataFrame:
    """Events that match a claim id or any of the five hash columns.

    ``newest=100`` searches only the hundred newest events; by default the whole
    log is searched.
    """
    pool = events if newest is None else recent_events(events, newest)
    q, kind = query.strip(), interpret(query)
    if kind == "claimId":
        hit = F.lower("claim_key") == F.lower(claim_key(F.lit(q.upper()), digest))
        ref = F.lit(q.upper())
    elif kind == "hash":
        hit = F.lit(False)
        for c in HASHES:
            hit = hit | (F.lower(c) == q.lower())
        ref = F.lit(None).cast("string")
    else:
        hit, ref = F.lit(False), F.lit(None).cast("string")
    return pool.where(hit).withColumn("claim_ref", ref).withColumn("interpreted_as", F.lit(kind))


def with_claim_ref(events: DataFrame, claims: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """Readable claim id of every event whose key belongs to a known claim."""
    keys = claims.select(F.col("id").alias("claim_ref"), claim_key(F.col("id"), digest).alias("claim_key"))
    return events.drop("claim_ref").join(keys, "claim_key", "left")
