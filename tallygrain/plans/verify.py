"""All claims of a batch through all stages, as one plan.

Every branch ends in one row per claim, hash-partitioned by claim id, so the
final joins are one-to-one and add no shuffle of the large tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.digest import Digest, run_digest, sha2_digest
from tallygrain.operators import documents as D, neardup, stages as S, vectors as V
from tallygrain.operators.geo import geo_reasons
from tallygrain.operators.neardup import stored
from tallygrain.operators.photoindex import PhotoIndex
from tallygrain.operators.policy import with_policy
from tallygrain.operators.spread import first_per_key


@dataclass
class ClaimTables:
    """Inputs of a verification batch.

    ``claims`` may carry ``run_at``; where it does not, the decision time or
    else the time of submission stands for it.
    """

    claims: DataFrame
    evidence: DataFrame
    ocr: DataFrame
    image_vectors: DataFrame
    prompts: DataFrame
    memory: DataFrame
    policies: DataFrame
    # all stored evidence, where ``evidence`` holds only that of the batch
    archive: DataFrame | None = None
    # pictures stored by earlier batches and by this one, in place of ``archive``
    index: PhotoIndex | None = None

    def only(self, claims: DataFrame) -> ClaimTables:
        """The same tables cut down to the files of some claims; pictures are
        still compared with the whole archive."""
        ids = claims.select(F.col("id").alias("claim_id"))
        evidence = self.evidence.join(ids, "claim_id", "left_semi")
        return replace(
            self,
            claims=claims,
            evidence=evidence,
            ocr=self.ocr.join(evidence.select("file_id"), "file_id", "left_semi"),
            image_vectors=self.image_vectors.join(ids, "claim_id", "left_semi"),
            archive=self.evidence if self.archive is None else self.archive,
        )


def with_run_time(claims: DataFrame) -> DataFrame:
    if "run_at" in claims.columns:
        return claims
    return claims.withColumn("run_at", F.coalesce("decided_at", "submitted_at"))


def image_signals(tables: ClaimTables, exclude_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """Per claim: prompt scores, the neighbour vote and the satellite reading; and
    the neighbours of every scored photo as rows."""
    runs = with_run_time(tables.claims).select(F.col("id").alias("claim_id"), "run_at")
    # three photos and one satellite picture per claim at most
    chosen = first_per_key(
        tables.image_vectors.where(F.col("kind").isin(*C.IMAGE_KINDS)),
        ["claim_id", "kind"],
        [F.col("seq"), F.col("file_id")],
        3,
        "rank",
    ).where((F.col("kind") == "photo") | (F.col("rank") == 1))
    scored = V.prompt_scores(chosen.select("claim_id", "file_id", "kind", "rank", "vec"), tables.prompts)
    photo = F.col("kind") == "photo"
    per_claim = scored.groupBy("claim_id").agg(
        *[F.max(F.when(photo, F.col(f"rel_{loss}"))).alias(f"rel_{loss}") for loss in C.LOSS_TYPES],
        F.max(F.when(photo & (F.col("rank") <= 2), F.col("staged"))).alias("staged"),
        F.max(F.when(photo, F.col("ai_gen"))).alias("ai_gen"),
        F.max(F.when(~photo, F.struct("destruction_pct", "rung"))).alias("sat"),
    )
    asked = chosen.where(photo & (F.col("rank") <= 2)).join(runs, "claim_id")
    votes = stored(V.knn_votes(asked, tables.memory, exclude_self=exclude_self), "votes")
    matched = F.transform(
        F.slice("matches", 1, 2), lambda m: F.concat(m["claim_id"], F.lit(":"), m["label"], F.lit("@"), m["similarity"].cast("string"))
    )
    vote = votes.groupBy("claim_id").agg(
        F.max("knn").alias("knn"),
        F.max("fraud_score").alias("knn_fraud"),
        F.max_by(matched, F.struct(F.col("fraud_score"), -F.col("seq"))).alias("knn_matched"),
    )
    signals = per_claim.join(vote, "claim_id", "left").select(
        "*", F.col("sat.destruction_pct").alias("satellite_pct"), F.col("sat.rung").alias("satellite_rung")
    ).drop("sat")
    return signals, V.similar_rows(votes)


def duplicate_rows(tables: ClaimTables) -> DataFrame:
    runs = with_run_time(tables.claims).select(F.col("id").alias("claim_id"), "run_at")
    if tables.index is not None:
        return tables.index.duplicates(neardup.photo_hashes(tables.evidence), runs)
    return neardup.near_duplicates(
        neardup.photo_hashes(tables.evidence if tables.archive is None else tables.archive), runs
    )


def collision_text() -> Column:
    return F.format_string("%s≈%s/%s (d=%d)", "file_id", "match_claim_id", "match_file_id", "distance")


def file_reasons(geo: DataFrame, duplicates: DataFrame) -> DataFrame:
    """All reasons that name a file, as rows: claim_id, rule, seq, file_id, reason, collision."""
    r4 = geo.select(
        "claim_id", F.lit(1).alias("rule"), "seq", "file_id", "reason", F.lit(None).cast("string").alias("collision")
    )
    r2 = duplicates.select(
        "claim_id",
        F.lit(2).alias("rule"),
        "seq",
        "file_id",
        F.format_string(
            "R2 duplicate-evidence: %s matches archived %s/%s", "file_id", "match_claim_id", "match_file_id"
        ).alias("reason"),
        collision_text().alias("collision"),
    )
    return r4.unionByName(r2)


def reason_summary(rows: DataFrame) -> DataFrame:
    """Per claim: how many file reasons and collisions, and the first few of each.

    The full list stays in ``rows``; a run shows REASONS_SHOWN of them.
    """
    counts = rows.groupBy("claim_id").agg(
        F.count("*").alias("n_file_reasons"), F.count_if(F.col("rule") == 2).alias("n_dup")
    )
    # at most REASONS_SHOWN rows of each of the two rules are collected
    first = (
        first_per_key(rows, ["claim_id", "rule"], [F.col("seq"), F.col("file_id")], C.REASONS_SHOWN)
        .groupBy("claim_id")
        .agg(F.array_sort(F.collect_list(F.struct("rule", "rn", "reason", "collision"))).alias("_t"))
        .select(
            "claim_id",
            F.slice(F.transform("_t", lambda t: t["reason"]), 1, C.REASONS_SHOWN).alias("file_reasons"),
            F.array_compact(F.transform("_t", lambda t: t["collision"])).alias("dup_shown"),
        )
    )
    return counts.join(first, "claim_id")


def photo_facts(tables: ClaimTables) -> DataFrame:
    """Per claim: how many pictures it has, how many of other claims they were compared
    with (not counted where an index stands for the archive), and those that repeat
    within the claim, the first few of them as text."""
    runs = with_run_time(tables.claims).select(F.col("id").alias("claim_id"), "run_at")
    own = neardup.photo_hashes(tables.evidence)
    if tables.index is not None:
        counts = own.groupBy("claim_id").agg(F.count("*").alias("n_hashes")).withColumn("n_foreign", F.lit(None).cast("long"))
    else:
        archive = own if tables.archive is None else neardup.photo_hashes(tables.archive)
        counts = neardup.foreign_counts(archive, own, runs)
    text = F.format_string("%s≈%s (d=%d)", "earlier_file_id", "file_id", "distance").alias("text")
    again = neardup.within_claim(own).select("claim_id", "file_id", text)
    first = first_per_key(again, ["claim_id"], [F.col("file_id")], C.REASONS_SHOWN)
    shown = first.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda t: t["text"]).alias("inner_shown"))
    inner = again.groupBy("claim_id").agg(F.count("*").alias("n_inner")).join(shown, "claim_id")
    return counts.join(inner, "claim_id", "full_outer")


def claim_rows(tables: ClaimTables, signals: DataFrame, reason_rows: DataFrame) -> DataFrame:
    """The wide row of every claim that the stage expressions read."""
    claims = with_run_time(tables.claims).withColumnRenamed("id", "claim_id")
    reasons = reason_summary(reason_rows)
    features = D.with_cross_check(D.claim_features(tables.evidence, tables.ocr))
    wide = (
        claims.join(features, "claim_id", "left")
        .join(signals, "claim_id", "left")
        .join(reasons, "claim_id", "left")
        .join(stored(photo_facts(tables), "photo-facts"), "claim_id", "left")
    )
    return with_policy(wide.withColumn("paper_number", S.paper_number()), tables.policies, "paper_number")


def run_stages(rows: DataFrame, strict_exif: bool = False, digest: Digest = sha2_digest) -> DataFrame:
    """Verdict, score, stage logs, reasons and document summary per claim."""
    out = (
        rows.withColumns(
            {
                "s_exif": S.exif_integrity(strict_exif),
                "s_dup": S.duplicate_phash(),
                "s_ocr": S.ocr_extract(),
                "s_policy": S.policy_match(),
                "s_docs": S.doc_cross(),
                "s_damage": S.damage_assess(),
                "summary": D.document_summary(),
            }
        ).withColumn("s_fraud", S.fraud_rules(F.col("s_policy")))
    )
    names = ["s_exif", "s_dup", "s_ocr", "s_policy", "s_docs", "s_damage", "s_fraud"]
    fails = sum(((F.col(f"{n}.result") == "FAIL").cast("int") for n in names), F.lit(0))
    warns = sum(((F.col(f"{n}.result") == "WARN").cast("int") for n in names), F.lit(0))
    out = (
        out.withColumns(
            {
                "fails": fails,
                "run_score": S.stage_score(fails, warns),
                "run_reasons": S.decision_reasons(
                    F.col("s_fraud.reasons"), F.col("s_policy.reasons"), F.col("s_damage.reasons"), F.col("s_docs.reasons")
                ),
            }
        )
        .withColumn("run_verdict", S.verdict(F.col("fails"), F.col("run_score")))
        .withColumn("s_decision", S.decision(F.col("run_score"), F.col("run_verdict"), F.col("run_reasons")))
        .withColumn("stages", F.array(*names, "s_decision"))
    )
    return out.select(
        "claim_id",
        F.concat(F.lit("ver_"), F.col("claim_id"), F.lit("-"), F.unix_millis("run_at").cast("string")).alias("run_id"),
        "run_at",
        "claimant_name",
        "loss_type",
        "amount_requested",
        F.col("run_verdict").alias("verdict"),
        F.col("run_score").alias("score"),
        F.col("run_reasons").alias("reasons"),
        "stages",
        "summary",
        run_digest(F.col("claim_id"), F.col("run_verdict"), F.col("run_score"), F.col("stages"), digest).alias("run_digest"),
    )


@dataclass(frozen=True)
class Verification:
    """What a batch of runs yields: one row per claim, per stage, per reason that
    names a file (all of them), and per similar remembered case."""

    runs: DataFrame
    logs: DataFrame
    reasons: DataFrame
    similar: DataFrame


def verification(tables: ClaimTables, strict_exif: bool = False, exclude_self: bool = True) -> Verification:
    """All outputs of one batch.

    The reasons that name files, and with them the near-duplicate search, are
    computed once and kept in the shared folder, as are the votes.  The signals of
    images and the facts on pictures are kept as well: they are small, and what is
    shuffled for them is gone before the texts are.
    """
    signals, similar = image_signals(tables, exclude_self)
    signals = stored(signals, "signals")
    reasons = stored(file_reasons(geo_reasons(tables.evidence, tables.claims), duplicate_rows(tables)), "file-reasons")
    runs = run_stages(claim_rows(tables, signals, reasons), strict_exif)
    return Verification(runs, stage_logs(runs), reasons, similar)


def verify_claims(tables: ClaimTables, strict_exif: bool = False, exclude_self: bool = True) -> DataFrame:
    """Runs of all claims in the batch."""
    return verification(tables, strict_exif, exclude_self).runs


def stage_logs(runs: DataFrame) -> DataFrame:
    """Long format: claim_id, position, stage, result, details, reasons."""
    return runs.select("claim_id", F.posexplode("stages").alias("position", "s")).select("claim_id", "position", "s.*")
