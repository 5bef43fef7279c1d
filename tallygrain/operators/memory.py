"""The memory of decided cases: enrolment, labels, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.numeric import round_vector
from tallygrain.operators.spread import first_per_key
from tallygrain.operators.vectors import with_intervals

PARTS = 64


def cap_memory(memory: DataFrame, per_label: int = C.MEMORY_PER_LABEL) -> DataFrame:
    """Newest ``per_label`` vectors of each label.

    Parts of a label are cut first, so a label of any size is spread over PARTS
    tasks and at most PARTS times ``per_label`` rows of it meet in the end.
    """
    order = [F.desc("at"), F.desc("seq"), F.desc("file_id")]
    parts = memory.withColumn("_part", F.spark_partition_id() % PARTS)
    parts = first_per_key(parts, ["label", "_part"], order, per_label, "_rn").drop("_rn", "_part")
    return first_per_key(parts, ["label"], order, per_label, "_rn").drop("_rn")


def latest_batches(entries: DataFrame) -> DataFrame:
    """Of several enrolments of one claim keep the newest batch, whole."""
    newest = entries.groupBy("claim_id").agg(F.max("batch").alias("batch"))
    return entries.join(newest, ["claim_id", "batch"])


def upsert_memory(memory: DataFrame, new: DataFrame, per_label: int = C.MEMORY_PER_LABEL) -> DataFrame:
    """A claim's new vectors replace all its old ones; then the cap applies.

    ``new`` may hold several enrolments of one claim, told apart by ``batch``.
    """
    if "batch" not in new.columns:
        new = new.withColumn("batch", F.lit(0))
    kept = latest_batches(new).select(*memory.columns)
    old = memory.join(kept.select("claim_id").distinct(), "claim_id", "left_anti").select(*memory.columns)
    return cap_memory(old.unionByName(kept), per_label)


def advance_intervals(
    standing: DataFrame, new: DataFrame, numbers: DataFrame, per_label: int = C.MEMORY_PER_LABEL
) -> tuple[DataFrame, DataFrame]:
    """Entries that stand (until is null) after the ``new`` ones came, with those that
    end now, and the next number of each label.

    ``numbers`` has label and next.  A claim's new entries end all its old ones; of
    the rest an entry ends when ``per_label`` newer ones of its label stand.
    """
    fields = new.columns
    later = new.groupBy("claim_id").agg(F.unix_micros(F.min("at")).alias("_at"))
    replaced = standing.join(later, "claim_id").withColumn("until", F.greatest("since", "_at")).drop("_at")
    kept = standing.join(later, "claim_id", "left_anti").select(*fields, "n")
    counted = with_intervals(new, per_label).join(numbers, "label", "left")
    fresh = counted.select(*fields, (F.col("n") + F.coalesce("next", F.lit(0))).alias("n"))
    capped = with_intervals(kept.unionByName(fresh).withColumnRenamed("n", "number"), per_label)
    rows = replaced.unionByName(capped.drop("n").withColumnRenamed("number", "n"))
    come = new.groupBy("label").agg(F.count("*").alias("_come"))
    nexts = numbers.join(come, "label", "full_outer")
    total = F.coalesce("next", F.lit(0)) + F.coalesce("_come", F.lit(0))
    return rows, nexts.select("label", total.cast("long").alias("next"))


def verdict_label(verdict: Column) -> Column:
    """Label after a computed verdict."""
    return F.when(verdict == "AI_APPROVED", "genuine").otherwise("fraud")


def human_label(status: Column) -> Column:
    """Label after a human decision; null for any other status."""
    return F.when(status == "HUMAN_APPROVED", "genuine").when(status == "HUMAN_REJECTED", "fraud")


def bulk_label(status: Column) -> Column:
    """Label in a bulk pass over stored claims; null when undecided."""
    return F.when(status.isin(*C.GENUINE_STATUSES), "genuine").when(status.isin(*C.FRAUD_STATUSES), "fraud")


def untrained_claims(claims: DataFrame, evidence: DataFrame, memory: DataFrame) -> DataFrame:
    """Decided claims with a photo that the memory does not know, with a label."""
    photos = evidence.where(F.col("kind") == "photo").select(F.col("claim_id").alias("id"))
    known = memory.select(F.col("claim_id").alias("id"))
    return (
        claims.withColumn("label", bulk_label(F.col("status")))
        .where(F.col("label").isNotNull())
        .join(photos, "id", "left_semi")
        .join(known, "id", "left_anti")
    )


def enrol(labelled: DataFrame, vectors: DataFrame, source: str, at: Column) -> DataFrame:
    """Memory rows for labelled claims (claim_id, label) from their image vectors."""
    rows = vectors.where(F.col("kind").isin(*C.IMAGE_KINDS)).join(labelled.select("claim_id", "label"), "claim_id")
    return rows.select(
        "claim_id",
        "file_id",
        "label",
        F.lit(source).alias("source"),
        round_vector(F.col("vec")).cast("array<float>").alias("vec"),
        at.cast("timestamp").alias("at"),
        F.col("seq").cast("long").alias("seq"),
    )
