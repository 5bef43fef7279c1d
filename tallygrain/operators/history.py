"""Filtered claim history, lookups and similar cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.text import ascii_lower
from tallygrain.operators.spread import first_per_key


def with_inspector(claims: DataFrame, users: DataFrame) -> DataFrame:
    staff = users.select(
        F.col("id").alias("assigned_to"), F.col("name").alias("inspector_name"), F.col("district").alias("inspector_district")
    )
    return claims.join(staff, "assigned_to", "left")


def status_filter(column: Column, wanted: str) -> Column:
    """A group name stands for its statuses, anything else for itself."""
    group = C.STATUS_GROUPS.get(wanted.lower())
    return column.isin(*group) if group else column == wanted


def like_ascii(column: Column, needle: str) -> Column:
    """Substring search that ignores ASCII case; ``%`` and ``_`` are wildcards."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle).replace("\\", "\\\\")
    return ascii_lower(column).like(f"%{lowered}%")


def history(
    claims: DataFrame,
    users: DataFrame,
    status: str | None = None,
    inspector: str | None = None,
    search: str | None = None,
    loss_type: str | None = None,
) -> DataFrame:
    """Claims that pass every given filter, newest first."""
    out = claims
    if status:
        out = out.where(status_filter(F.col("status"), status))
    if inspector:
        out = out.where(F.col("assigned_to") == inspector)
    if search:
        out = out.where(
            like_ascii(F.col("id"), search)
            | like_ascii(F.col("claimant_name"), search)
            | like_ascii(F.col("policy_number"), search)
        )
    if loss_type:
        out = out.where(F.col("loss_type") == loss_type)
    return with_inspector(out, users).orderBy(F.desc("submitted_at"))


def live_only(claims: DataFrame, seeded: DataFrame) -> DataFrame:
    return claims.join(seeded.select("id"), "id", "left_anti")


def decided(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("status") != "SUBMITTED")


def roster(users: DataFrame) -> DataFrame:
    return users.drop("password_hash").orderBy("created_at")


def run_status(claims: DataFrame, runs: DataFrame) -> DataFrame:
    done = runs.select(F.col("claim_id").alias("id"), F.lit(True).alias("_done")).dropDuplicates(["id"])
    return claims.join(done, "id", "left").select(
        "id", F.when(F.col("_done").isNull(), "RUNNING").otherwise("COMPLETE").alias("run_status")
    )


def claim_by_id(claims: DataFrame, claim_id: str) -> DataFrame:
    return claims.where(F.col("id") == claim_id)


def evidence_by_file(evidence: DataFrame, file_id: str) -> DataFrame:
    return evidence.where(F.col("file_id") == file_id)


def evidence_of_claim(evidence: DataFrame, claim_id: str) -> DataFrame:
    return evidence.where(F.col("claim_id") == claim_id)


def user_by(users: DataFrame, email: str | None = None, user_id: str | None = None) -> DataFrame:
    return users.where(F.col("email") == email) if email is not None else users.where(F.col("id") == user_id)


def best_similar(similar: DataFrame) -> DataFrame:
    """Best similarity per (claim, matched claim); the earlier row wins a tie.

    ``similar`` has claim_id, matched_claim_id, label, similarity, file_id, pos.
    """
    return (
        similar.groupBy("claim_id", "matched_claim_id")
        .agg(
            F.max_by(
                F.struct("label", "similarity", "file_id", "pos"), F.struct(F.col("similarity"), -F.col("pos"))
            ).alias("b")
        )
        .select("claim_id", "matched_claim_id", "b.label", "b.similarity", "b.file_id", "b.pos")
    )


def similar_cases(similar: DataFrame, claims: DataFrame, n: int = C.SIMILAR_SHOWN) -> DataFrame:
    """Top ``n`` similar claims of each claim with their present facts."""
    top = first_per_key(
        best_similar(similar), ["claim_id"], [F.desc("similarity"), F.asc("pos"), F.asc("matched_claim_id")], n, "rank"
    )
    facts = claims.select(
        F.col("id").alias("matched_claim_id"),
        F.col("loss_type").alias("matched_loss_type"),
        F.col("amount_requested").alias("matched_amount"),
        F.col("status").alias("matched_status"),
    )
    return top.join(facts, "matched_claim_id", "left")
