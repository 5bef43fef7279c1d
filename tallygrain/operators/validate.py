"""Intake checks: claim fields, files and the photo rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C


def claim_issues() -> Column:
    """All problems of a claim row, as an array of codes in field order."""
    name, amount = F.col("claimant_name"), F.col("amount_requested")
    pct = F.col("destruction_pct_claimed")
    return F.array_compact(
        F.array(
            F.when(name.isNull() | ~F.length(name).between(1, C.MAX_NAME), "claimant_name"),
            F.when(F.col("loss_type").isNull() | ~F.col("loss_type").isin(*C.LOSS_TYPES), "loss_type"),
            F.when(amount.isNull() | ~amount.between(1, C.MAX_AMOUNT), "amount_requested"),
            F.when(F.length("note") > C.MAX_NOTE, "note"),
            F.when(F.length("policy_number") > C.MAX_POLICY, "policy_number"),
            F.when(~pct.between(0, 100), "destruction_pct_claimed"),
        )
    )


def check_claims(claims: DataFrame) -> DataFrame:
    """Claims with ``issues``; a missing ``note`` column counts as no note."""
    if "note" not in claims.columns:
        claims = claims.withColumn("note", F.lit(None).cast("string"))
    return claims.withColumn("issues", claim_issues())


def split_claims(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_claims(claims)
    return checked.where(F.size("issues") == 0).drop("issues"), checked.where(F.size("issues") > 0)


def file_issues() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("size_bytes") > C.MAX_FILE_BYTES, "too_large"),
            F.when(F.col("mime_type").isNull() | ~F.col("mime_type").isin(*C.ALLOWED_MIME), "mime_type"),
            F.when(~F.col("kind").isin(*C.MAX_PER_KIND), "unexpected_field"),
        )
    )


def check_files(evidence: DataFrame) -> DataFrame:
    """One row per claim: bad files and slots that hold too many."""
    per_kind = [
        F.when(F.count_if(F.col("kind") == kind) > limit, kind) for kind, limit in C.MAX_PER_KIND.items()
    ]
    return evidence.groupBy("claim_id").agg(
        F.count("*").alias("n_files"),
        F.count_if(F.array_contains(file_issues(), "too_large")).alias("n_too_large"),
        F.count_if(F.array_contains(file_issues(), "mime_type")).alias("n_bad_type"),
        F.array_compact(F.array(*per_kind)).alias("overfull_kinds"),
        (F.count("*") > C.MAX_FILES).alias("too_many_files"),
    ).withColumn(
        "accepted",
        (F.col("n_too_large") == 0) & (F.col("n_bad_type") == 0) & (F.size("overfull_kinds") == 0) & ~F.col("too_many_files"),
    )


def with_photo(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims that have at least one photo."""
    photos = evidence.where(F.col("kind") == "photo").select(F.col("claim_id").alias("id"))
    return claims.join(photos, "id", "left_semi")
