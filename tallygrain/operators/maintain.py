"""Keeping the relational tables: upserts, appends, decisions and payouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallygrain import constants as C
from tallygrain.functions.digest import Digest, packed, sha2_digest, state_hash
from tallygrain.operators.guard import may_reopen, payout_code, walk_requests
from tallygrain.operators.memory import human_label
from tallygrain.operators.merkle import merkle_roots
from tallygrain.operators.spread import dense_sequence, first_per_key

KEPT_ON_UPDATE = ["submitted_at", "assigned_to"]
PLACES = 256  # file numbers that are sorted together


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row per key.  ``max_by`` folds before the shuffle."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def oldest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def upsert_claims(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` win, but an existing claim keeps when it came and whose it is.

    ``new`` holds each id once (see ``newest``).
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, "id", "full_outer")
    columns = []
    for c in old.columns:
        if c == "id":
            columns.append(F.col("id"))
        elif c in KEPT_ON_UPDATE:
            columns.append(F.when(F.col("o.status").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*columns)


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Only rows whose key is new; of several new ones the first stays.

    Known keys go first and rows are ranked column by column, not packed, so that
    only the columns somebody reads are shuffled and sorted.
    """
    return first_per_key(new.join(old.select(key), key, "left_anti"), [key], order, 1).select(*old.columns)


def fill_gaps(stored: DataFrame, spare: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` plus the rows of ``spare`` whose key is missing there."""
    return stored.unionByName(spare.join(stored.select(key), key, "left_anti").select(*stored.columns))


def assign(claims: DataFrame, assignments: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One inspector per claim, the last one set; unknown inspectors are refused.

    Returns the assignment table and the claims with ``assigned_to`` in step.
    """
    staff = users.select(F.col("id").alias("assigned_to"))
    valid = assignments.join(staff, "assigned_to", "left_semi").select(*assignments.columns)
    current = newest(valid, ["claim_id"], [F.col("assigned_at"), F.col("assigned_to")])
    synced = (
        claims.join(current.select(F.col("claim_id").alias("id"), F.col("assigned_to").alias("_to")), "id", "left")
        .withColumn("assigned_to", F.coalesce("_to", "assigned_to"))
        .select(*claims.columns)
    )
    return current, synced


def distinct_audit(records: DataFrame) -> DataFrame:
    """First of several audit rows with the same claim, hash, status and time."""
    keys = ["claim_id", "state_hash", "status", "ts"]
    order = [F.col("event_id")] if "event_id" in records.columns else [F.col("recorded_by"), F.col("note")]
    return oldest(records, keys, order)


def claim_digests(evidence: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """One commitment over all file and picture hashes of each claim, in evidence order.

    It is the Merkle root of a digest of each file: its number, name, content and
    picture with their lengths, a missing one told from every other.  So it binds
    every file and its place, and no group holds more than one fan of nodes.
    Places are counted in stretches of PLACES numbers, so that one claim's files
    need not meet in one task.
    """
    entry = digest(packed(F.col("seq"), F.col("file_id"), F.col("sha256"), digest(F.col("p_hash"))))
    files = evidence.select("claim_id", F.col("seq").alias("number"), "file_id", entry.alias("record_hash"))
    stretch = F.coalesce(F.floor(F.col("number") / PLACES), F.lit(-(2**62)))
    files = dense_sequence(files, "claim_id", stretch, [F.col("number"), F.col("file_id"), F.col("record_hash")])
    return merkle_roots(files, digest, counted=evidence).select("claim_id", F.col("leaves").alias("n_files"), F.col("root").alias("evidence_digest"))


def claim_states(claims: DataFrame, digests: DataFrame, sealed_at: Column, run: Column | None = None) -> DataFrame:
    """State hash of each claim as it stands."""
    joined = claims.join(digests.withColumnRenamed("claim_id", "id"), "id", "left")
    value = state_hash(
        F.col("id"), F.col("loss_type"), F.col("claimant_name"), F.col("amount_requested"),
        F.coalesce("evidence_digest", F.lit("")), sealed_at, run,
    )
    return joined.select(F.col("id").alias("claim_id"), value.alias("state_hash"))


def _record(status: Column, note: Column, by: Column, ts: Column) -> list[Column]:
    return [
        status.alias("status"),
        F.substring(note, 1, C.MAX_NOTE).alias("note"),
        by.alias("recorded_by"),
        ts.alias("ts"),
    ]


def pay(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Payout requests (claim_id, reference, amount?, ts) with their outcome.

    The first request of a payable claim, by ts, reference and amount, is
    accepted; those after it meet a paid claim.  Accepted rows carry the record
    to seal; refused rows carry the code.
    """
    now = claims.select(F.col("id").alias("claim_id"), F.col("status").alias("before"), "amount_requested")
    turn = F.row_number().over(W.partitionBy("claim_id").orderBy("ts", "reference", "amount"))
    joined = requests.join(now, "claim_id").withColumn("turn", turn)
    paid = (F.col("turn") > 1) & (payout_code(F.col("before")) == "OK")
    joined = joined.withColumn("current", F.when(paid, "PAID").otherwise(F.col("before")))
    code = payout_code(F.col("current"))
    amount = F.coalesce(F.col("amount"), F.col("amount_requested"))
    note = F.format_string("UPI payout ₹%d · ref %s · sealed by disbursement", amount, "reference")
    return joined.select(
        "claim_id", "current", code.alias("code"), amount.alias("paid_inr"),
        *_record(F.when(code == "OK", "PAID").otherwise(F.col("current")), note, F.lit("disbursement"), F.col("ts")),
    )


def rerun_records(claims: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records to append for a second run (claim_id, verdict, score, run_at), and claims with the new verdict.

    Terminal claims are left alone.
    """
    open_claims = claims.where(may_reopen(F.col("status")))
    fresh = runs.select(F.col("claim_id").alias("id"), F.col("verdict").alias("_verdict"), F.col("score").alias("_score"), "run_at")
    joined = open_claims.join(fresh, "id")
    note = F.format_string("RETRY · AI %s · score %d (re-run appended, history intact)", "_verdict", "_score")
    records = joined.select(
        F.col("id").alias("claim_id"), *_record(F.col("_verdict"), note, F.lit("pipeline"), F.col("run_at"))
    )
    updated = (
        claims.join(fresh, "id", "left")
        .withColumn(
            "status",
            F.when(may_reopen(F.col("status")) & F.col("_verdict").isNotNull(), F.col("_verdict")).otherwise(F.col("status")),
        )
        .select(*claims.columns)
    )
    return records, updated


def human_decisions(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Decision requests (claim_id, requested, note, reviewer, ts) with outcome,
    the record to seal and the label for the memory.  Requests of one claim
    follow each other: each meets the status that the one before it left."""
    note = F.format_string("[%s] %s: %s", "reviewer", "requested", "note")
    accepted = F.col("code") == "OK"
    return walk_requests(claims, requests).select(
        "claim_id",
        "current",
        "requested",
        "code",
        F.when(accepted, human_label(F.col("requested"))).alias("label"),
        *_record(F.when(accepted, F.col("requested")).otherwise(F.col("current")), note, F.col("reviewer"), F.col("ts")),
    )


def addenda(claims: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Late files: rows to append and one ADDENDUM record per claim.

    Files of terminal claims are refused; nothing is ever edited.
    """
    open_ids = claims.where(may_reopen(F.col("status"))).select(F.col("id").alias("claim_id"))
    rows = late.join(open_ids, "claim_id", "left_semi").select(*late.columns)
    note = F.format_string(
        "ADDENDUM · +%d evidence file(s) appended (immutable addendum, re-verification queued)", "n"
    )
    records = (
        rows.groupBy("claim_id")
        .agg(F.count("*").alias("n"), F.max("created_at").alias("ts"))
        .select("claim_id", "n", *_record(F.lit("SUBMITTED"), note, F.lit("addendum"), F.col("ts")))
    )
    return rows, records


def resync(old_claims: DataFrame, claims: DataFrame, old_evidence: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mirror everything again; running it twice changes nothing."""
    merged = upsert_claims(old_claims, claims)
    added = insert_absent(old_evidence, evidence, "file_id", [F.col("seq"), F.col("claim_id")])
    return merged, old_evidence.unionByName(added)
