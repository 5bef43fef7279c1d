"""Claim snapshots, relational tables, CSV and dossier exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrain.functions.digest import Digest, sha2_digest
from tallygrain.functions.timefn import epoch_to_iso
from tallygrain.operators.maintain import oldest
from tallygrain.operators.merkle import merkle_roots
from tallygrain.operators.trail import chain_breaks
from tallygrain.schemas import RELATIONAL, SNAPSHOT
from tallygrain.session import work_dir


def read_snapshot(spark: SparkSession, path: str, contract: str | None) -> DataFrame:
    """Claims of the snapshots that belong to ``contract``.

    Rows without an id are dropped; of several rows with one id the oldest
    snapshot's first stays.
    """
    files = spark.read.schema(SNAPSHOT).json(path)
    rows = (
        files.where(F.col("contract").eqNullSafe(F.lit(contract)))
        .select("savedAt", F.posexplode("claims").alias("_pos", "c"))
        .where(F.col("c.id").isNotNull())
        .select("savedAt", "_pos", "c.*")
    )
    return oldest(rows, ["id"], [F.col("savedAt"), F.col("_pos")]).drop("savedAt", "_pos")


def write_snapshot(claims: DataFrame, path: str, contract: str | None, saved_at: Column) -> None:
    """One JSON line per claim in the snapshot shape, without derived text.

    The folder is replaced as a whole; the commit protocol makes that atomic.
    """
    plain = claims.withColumn("verification", F.col("verification").dropFields("explanation"))
    plain.select(
        saved_at.cast("string").alias("savedAt"),
        F.lit(contract).cast("string").alias("contract"),
        F.array(F.struct(*plain.columns)).alias("claims"),
    ).write.mode("overwrite").json(path)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(RELATIONAL[name]).parquet(f"{root.rstrip('/')}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RELATIONAL[name].fields])
    typed.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The same tables from a database; give partitionColumn, lowerBound,
    upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def export_rows(claims: DataFrame) -> DataFrame:
    """The eleven export columns, nulls as empty text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    columns = {
        "claimId": F.col("id"),
        "claimant": F.col("claimant_name"),
        "lossType": F.col("loss_type"),
        "amountRequestedInr": F.col("amount_requested"),
        "status": F.col("status"),
        "verdict": F.col("verdict"),
        "score": F.col("score"),
        "submittedAt": iso("submitted_at"),
        "decidedAt": iso("decided_at"),
        "durationMs": F.col("duration_ms"),
        "latestStateHash": F.col("latest_state_hash"),
    }
    return claims.select(*[F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in columns.items()])


def write_csv(claims: DataFrame, path: str) -> None:
    export_rows(claims).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def csv_line(row: list[Column]) -> Column:
    """One line of text; a field with a comma, quote or line end is quoted."""
    fields = [
        F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
        for v in row
    ]
    return F.concat_ws(",", *fields)


def dossier_records(trail: DataFrame) -> DataFrame:
    """Canonical JSON of every record: keys in alphabetical order, no blanks."""
    body = F.struct(
        F.col("seq").alias("index"),
        "note",
        F.col("prev_record_hash").alias("prevRecordHash"),
        F.col("record_hash").alias("recordHash"),
        F.col("recorded_by").alias("recordedBy"),
        epoch_to_iso(F.col("ts")).alias("sealedAtIso"),
        F.col("state_hash").alias("stateHash"),
        "status",
    )
    return trail.select("claim_id", "seq", F.to_json(body).alias("record"))


def dossier_headers(trail: DataFrame, generated_at: Column, digest: Digest = sha2_digest) -> DataFrame:
    """One canonical document per claim and its digest.

    The records enter through the Merkle root of their canonical JSON, so a
    claim with very many records needs no single huge document; the records
    themselves are written as lines beside it.  The trail is written once and
    read for both trees and the chain check, since sealing it is dear.
    """
    path = work_dir(trail.sparkSession, "dossier-trail")
    trail.write.parquet(path)
    trail = trail.sparkSession.read.schema(trail.schema).parquet(path)
    records = dossier_records(trail)
    content = merkle_roots(records.select("claim_id", "seq", F.col("record").alias("record_hash")), digest, counted=trail)
    marks = merkle_roots(trail, digest)
    breaks = chain_breaks(trail, digest)
    joined = (
        breaks.join(marks, "claim_id")
        .join(content.select("claim_id", F.col("root").alias("records_root")), "claim_id")
    )
    body = F.to_json(
        F.struct(
            F.col("claim_id").alias("claimId"),
            F.lit("trail-dossier").alias("format"),
            generated_at.cast("string").alias("generatedAt"),
            F.struct(F.col("break_at").alias("breakAtIndex"), F.col("valid").alias("valid")).alias("integrity"),
            F.struct(F.col("leaves").alias("leafCount"), F.col("root").alias("root")).alias("merkle"),
            F.col("records").alias("recordCount"),
            F.col("records_root").alias("recordsRoot"),
            F.lit(1).alias("version"),
        )
    )
    return joined.select("claim_id", F.col("records").alias("record_count"), "valid", "root", body.alias("document")).withColumn(
        "canonical_hash", digest(F.col("document"))
    )


def write_dossiers(trail: DataFrame, path: str, generated_at: Column, digest: Digest = sha2_digest) -> None:
    dossier_headers(trail, generated_at, digest).write.mode("overwrite").json(f"{path}/headers")
    dossier_records(trail).write.mode("overwrite").json(f"{path}/records")
