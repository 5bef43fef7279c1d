"""Hash-chained trails: sealing, checking, heads and counters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.digest import Digest, record_hash, record_payload, sha2_digest
from tallygrain.operators.spread import previous_row

PythonDigest = Callable[[str], str]


def sha2_text(text: str) -> str:
    return "0x" + hashlib.sha256(text.encode("utf-8")).hexdigest()


def payload_column(digest: Digest = sha2_digest):
    return record_payload(
        F.col("state_hash"), F.col("status"), F.col("ts"), F.col("recorded_by"), F.col("note"), digest
    )


def chain_hashes(
    payloads: DataFrame, heads: DataFrame | None = None, python_digest: PythonDigest = sha2_text
) -> DataFrame:
    """Record hashes of (claim_id, seq, payload), each covering its predecessor.

    A chain is sequential by nature, so a claim is walked in order by one task.
    The walk keeps a single running hash: rows stream through in Arrow batches
    out of Spark's external sort, and no claim is ever held whole.  ``heads``
    (claim_id, head_hash) continues existing chains.
    """
    rows = payloads.select("claim_id", "seq", "payload")
    if heads is None:
        rows = rows.withColumn("head_hash", F.lit(None).cast("string"))
    else:
        rows = rows.join(heads.select("claim_id", "head_hash"), "claim_id", "left")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, head = None, C.ZERO_HASH
        for batch in batches:
            prevs, hashes = [], []
            for claim, payload, start in zip(batch["claim_id"], batch["payload"], batch["head_hash"]):
                if claim != current:
                    current, head = claim, start or C.ZERO_HASH
                prevs.append(head)
                head = python_digest(head + "|" + payload)
                hashes.append(head)
            yield pd.DataFrame(
                {"claim_id": batch["claim_id"], "seq": batch["seq"], "prev_record_hash": prevs, "record_hash": hashes}
            )

    return (
        rows.repartition("claim_id")
        .sortWithinPartitions("claim_id", "seq")
        .mapInPandas(walk, "claim_id string, seq long, prev_record_hash string, record_hash string")
    )


def sealable(records: DataFrame) -> DataFrame:
    """Records with a claim id and a state hash; others are refused."""
    def filled(name: str):
        return F.col(name).isNotNull() & ~F.col(name).isin("", C.ZERO_HASH)

    return records.where(filled("claim_id") & filled("state_hash"))


def seal(
    records: DataFrame,
    heads: DataFrame | None = None,
    digest: Digest = sha2_digest,
    python_digest: PythonDigest = sha2_text,
) -> DataFrame:
    """Trail rows for records (claim_id, seq, state_hash, status, ts, recorded_by, note).

    ``digest`` and ``python_digest`` must be the same hash.  Payloads, which
    carry all the text, are digested in parallel; only the short chain itself is
    walked.  The hashes come back by an equi-join on (claim_id, seq).
    """
    good = sealable(records)
    chained = chain_hashes(good.withColumn("payload", payload_column(digest)), heads, python_digest)
    return good.join(chained, ["claim_id", "seq"]).select(
        "claim_id", "seq", "state_hash", "prev_record_hash", "record_hash", "status", "ts", "recorded_by", "note"
    )


def check_records(trail: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """Per record: does its hash reproduce, does it link to the one before?"""
    expected = record_hash(F.col("prev_record_hash"), payload_column(digest), digest)
    linked = previous_row(trail, "claim_id", "seq", {"record_hash": "_before"})
    link = F.when(F.col("seq") == 0, F.col("prev_record_hash") == C.ZERO_HASH).otherwise(
        F.col("_before").isNotNull() & (F.col("prev_record_hash") == F.col("_before"))
    )
    return linked.select(
        "claim_id",
        "seq",
        F.coalesce(expected == F.col("record_hash"), F.lit(False)).alias("hash_ok"),
        F.coalesce(link, F.lit(False)).alias("link_ok"),
    )


def chain_breaks(trail: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """Per claim: record count and the first record that fails, null when intact."""
    bad = ~(F.col("hash_ok") & F.col("link_ok"))
    return (
        check_records(trail, digest)
        .groupBy("claim_id")
        .agg(F.count("*").alias("records"), F.min(F.when(bad, F.col("seq"))).alias("break_at"))
        .withColumn("valid", F.col("break_at").isNull())
    )


def checkpoints(trail: DataFrame, checked: DataFrame) -> DataFrame:
    """(claim_id, mark, head): the last record of every claim that ``checked`` found intact."""
    intact = checked.where("valid").select("claim_id")
    heads = trail.groupBy("claim_id").agg(F.max("seq").alias("mark"), F.max_by("record_hash", "seq").alias("head"))
    return heads.join(intact, "claim_id", "left_semi")


def check_since(newer: DataFrame, marks: DataFrame, prefix: DataFrame | None = None, turn: int = 0, parts: int = 16, digest: Digest = sha2_digest) -> DataFrame:
    """Chain check that goes on from checkpoints (claim_id, mark, head).

    ``newer`` holds the records appended since, all of them; they are checked, the
    first against the stored head.  A record at or below its claim's mark does not
    belong there and breaks the chain.  ``prefix`` holds the older records: their
    number and the record at the mark are compared with the checkpoint, and one
    part in ``parts`` is checked again, another one at every ``turn``, so that
    ``parts`` checks in a row cover the whole prefix.  Only these and the records
    before them are shuffled.  A claim whose prefix lacks records that nothing
    else names breaks where it ends.

    Returns claim_id, records, break_at, valid and how many records were checked.
    """
    after = F.coalesce("mark", F.lit(-1))
    rows = newer.join(marks, "claim_id", "left")
    before = newer.select("claim_id", (F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("_before"))
    linked = rows.join(before, ["claim_id", "seq"], "left")
    expected = record_hash(F.col("prev_record_hash"), payload_column(digest), digest)
    whole = F.coalesce(expected == F.col("record_hash"), F.lit(False))
    link = F.coalesce(F.col("prev_record_hash") == F.when(F.col("seq") == after + 1, F.coalesce("head", F.lit(C.ZERO_HASH))).otherwise(F.col("_before")), F.lit(False))
    good = whole & link & (F.col("seq") > after)
    found = linked.groupBy("claim_id").agg(
        F.count("*").alias("n_new"), F.count("*").alias("checked"), F.min(F.when(~good, F.col("seq"))).alias("break_at")
    )
    out = marks.select("claim_id", "mark").join(found, "claim_id", "full_outer").select(
        "claim_id", (after + 1 + F.coalesce("n_new", F.lit(0))).alias("records"), "break_at", F.coalesce("checked", F.lit(0)).alias("checked")
    )
    if prefix is not None:
        again = _checked_again(prefix, marks, turn % parts, parts, digest)
        out = out.join(again, "claim_id", "left").select(
            "claim_id", "records", F.least("break_at", "prefix_break").alias("break_at"), (F.col("checked") + F.coalesce("again", F.lit(0))).alias("checked")
        )
    return out.withColumn("valid", F.col("break_at").isNull())


def _checked_again(prefix: DataFrame, marks: DataFrame, turn: int, parts: int, digest: Digest) -> DataFrame:
    """(claim_id, again, prefix_break) for every checkpoint: one part of the records before it."""
    def drawn(seq):
        return F.pmod(F.xxhash64("claim_id", seq.cast("long")), F.lit(parts)) == turn

    rows = prefix.join(marks, "claim_id")
    seq = F.col("seq")
    # what stands at the mark, and how many there are, costs no digest
    last = rows.groupBy("claim_id").agg(
        F.count("*").alias("n"), F.max("seq").alias("top"), F.first("mark").alias("mark"),
        F.max(F.when(seq == F.col("mark"), F.col("record_hash") == F.col("head"))).alias("same"),
    )
    picked = rows.where(drawn(seq))
    before = prefix.where(drawn(seq + 1)).select("claim_id", (seq + 1).alias("seq"), F.col("record_hash").alias("_before"))
    linked = picked.join(before, ["claim_id", "seq"], "left")
    expected = record_hash(F.col("prev_record_hash"), payload_column(digest), digest)
    link = F.col("prev_record_hash") == F.when(seq == 0, F.lit(C.ZERO_HASH)).otherwise(F.col("_before"))
    good = F.coalesce(expected == F.col("record_hash"), F.lit(False)) & F.coalesce(link, F.lit(False)) & (seq <= F.col("mark"))
    bad = linked.groupBy("claim_id").agg(F.count("*").alias("again"), F.min(F.when(~good, seq)).alias("sampled_break"))
    wrong = F.when(F.col("n").isNull(), 0).when(
        (F.col("n") != F.col("mark") + 1) | (F.col("top") != F.col("mark")) | ~F.coalesce("same", F.lit(False)), F.col("mark")
    )
    all_marks = marks.select("claim_id").join(last, "claim_id", "left").join(bad, "claim_id", "left")
    return all_marks.select("claim_id", F.coalesce("again", F.lit(0)).alias("again"), F.least("sampled_break", wrong).alias("prefix_break"))


def verify_claims(claim_ids: DataFrame, trail: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """Chain check for a list of claims; a claim without records is valid."""
    checked = chain_breaks(trail, digest)
    return claim_ids.join(checked, "claim_id", "left").select(
        "claim_id",
        F.coalesce("records", F.lit(0)).alias("records"),
        "break_at",
        F.coalesce("valid", F.lit(True)).alias("valid"),
    )


def integrity_report(stored: DataFrame, replayed: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """Break index of the stored trail next to that of an independent copy."""
    left = chain_breaks(stored, digest).select(
        "claim_id", F.col("valid").alias("off_chain_valid"), F.col("break_at").alias("off_chain_break_at")
    )
    right = chain_breaks(replayed, digest).select(
        "claim_id", F.col("valid").alias("on_chain_valid"), F.col("break_at").alias("on_chain_break_at")
    )
    return left.join(right, "claim_id", "full_outer").select(
        "claim_id",
        F.coalesce("off_chain_valid", F.lit(True)).alias("off_chain_valid"),
        "off_chain_break_at",
        F.coalesce("on_chain_valid", F.lit(True)).alias("on_chain_valid"),
        "on_chain_break_at",
    )


def chain_heads(trail: DataFrame) -> DataFrame:
    """Newest record per claim: its status, state hash and record hash."""
    head = F.max_by(F.struct("status", "state_hash", "record_hash"), "seq")
    return trail.groupBy("claim_id").agg(
        F.count("*").alias("trail_length"), F.max("seq").alias("last_seq"), head.alias("h")
    ).select("claim_id", "trail_length", "last_seq", "h.status", "h.state_hash", F.col("h.record_hash").alias("head_hash"))


def total_records(trail: DataFrame) -> DataFrame:
    return trail.agg(F.count("*").alias("total_records"), F.countDistinct("claim_id").alias("claims"))
