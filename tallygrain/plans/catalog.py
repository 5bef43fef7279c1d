"""Named queries over the benchmark tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrain import constants as C
from tallygrain.functions import digest as H, extract as E, numeric as N, text as X, timefn as DT
from tallygrain.functions.identity import with_identity
from tallygrain.operators import (
    documents as D,
    explorer as EX,
    geo as G,
    guard as GU,
    history as HI,
    kpi as K,
    maintain as MT,
    memory as ME,
    merkle as MK,
    neardup as ND,
    photoindex as PI,
    plots as PL,
    policy as PO,
    spread as SP,
    stages as S,
    trail as TR,
    validate as VA,
    vectors as VE,
)
from tallygrain.operators.eventindex import EventIndex
from tallygrain.plans import explain as EP, verify as VP
from tallygrain.session import configure, work_dir
from tallygrain.schemas import EVENTS_RAW, LINEITEM_RAW, ORDERS_RAW
from tallygrain.sources import driver_views as V, files as SF, snapshots as SN
from tallygrain.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _now() -> Column:
    """The moment at which the key figures are taken."""
    return F.lit("2001-08-01 12:00:00").cast("timestamp")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _ts(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _join(c: Column | str) -> Column:
    return F.array_join(c, "|")


# --- sources and sinks ---------------------------------------------------------

@query
def src1_file_manifest(spark, d):
    return SF.evidence_manifest(spark, d, "*.parquet").select("file_id", "filename", "mime_type", "size_bytes", "sha256")


@query
def src2_integrity_audit(spark, d):
    now = SF.evidence_manifest(spark, d, "*.parquet")
    recorded = now.withColumn("sha256", F.when(F.col("filename").startswith("o"), "0x00").otherwise(F.col("sha256")))
    return SF.integrity_audit(recorded, now).select("file_id", "intact")


@query
def src4_src5_snapshot(spark, d):
    claims = V.claims(spark, d)
    path = work_dir(spark, "snapshot")
    iso = lambda c: F.date_format(c, DT.ISO_MILLIS)
    nested = claims.select(
        "id",
        F.col("claimant_name").alias("claimantName"),
        F.col("loss_type").alias("lossType"),
        F.col("amount_requested").alias("amountRequested"),
        "status",
        iso("submitted_at").alias("submittedAt"),
        F.col("policy_number").alias("policyNumber"),
        F.when(
            F.col("verdict").isNotNull(),
            F.struct(
                F.col("duration_ms").alias("durationMs"),
                F.col("verdict").alias("verdict"),
                F.col("score").alias("score"),
                F.lit("derived").alias("explanation"),
            ),
        ).alias("verification"),
    )
    SN.write_snapshot(nested, path, "ledger-1", F.lit("2024-01-01T00:00:00Z"))
    back = SN.read_snapshot(spark, path, "ledger-1")
    return back.select(
        "id",
        "claimantName",
        _long("amountRequested").alias("amount"),
        "status",
        "submittedAt",
        F.coalesce("verification.verdict", F.lit("")).alias("verdict"),
        F.coalesce("verification.explanation", F.lit("")).alias("explanation"),
    )


@query
def src6_relational_tables(spark, d):
    root = work_dir(spark, "tables")
    SN.write_table(V.claims(spark, d), root, "claims")
    SN.write_table(V.users(spark, d), root, "users")
    claims, users = SN.read_table(spark, root, "claims"), SN.read_table(spark, root, "users")
    return claims.join(users.select(F.col("id").alias("assigned_to"), "role"), "assigned_to", "left").groupBy(
        "status", F.coalesce("role", F.lit("none")).alias("role")
    ).agg(F.count("*").alias("n"), F.sum(_long("amount_requested")).alias("amount"))


def _sealed(spark, d) -> DataFrame:
    return TR.seal(V.trail_input(spark, d))


@query
def src7_recent_events(spark, d):
    events = EX.sealed_events(V.trail_input(spark, d).withColumns(
        {"prev_record_hash": F.lit(""), "record_hash": H.sha2_digest(F.concat_ws("-", "claim_id", _long("seq").cast("string")))}
    ))
    return EX.recent_events(events, 25).select("claim_key", _long("seq").alias("seq"), "status", "sealed_at_iso", "tx_hash")


@query
def src8_csv_export(spark, d):
    rows = SN.export_rows(V.claims(spark, d))
    return rows.select(F.col("claimId").alias("id"), SN.csv_line([F.col(c) for c in rows.columns]).alias("line"))


@query
def src9_dossier(spark, d):
    return SN.dossier_headers(_sealed(spark, d), F.lit("2024-02-01T00:00:00Z"))


@query
def src9_dossier_records(spark, d):
    unsealed = V.trail_input(spark, d).withColumns({"prev_record_hash": F.lit("p"), "record_hash": F.lit("r")})
    return SN.dossier_records(unsealed).select("claim_id", _long("seq").alias("seq"), "record")


@query
def src10_ocr_pages(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    pages = docs.select(
        F.col("doc_id").cast("string").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")
    ).withColumn("page", (F.col("p") + 1).cast("int"))
    out = D.join_pages(pages)
    return out.select("file_id", F.md5("text").alias("text_md5"), _long(F.length("text")).alias("n_chars"))


# --- filters ---------------------------------------------------------------------

@query
def flt1_intake_validation(spark, d):
    claims = V.claims(spark, d).withColumn("note", F.repeat(F.lit("n"), F.col("score") * 4))
    return VA.check_claims(claims).select("id", _join("issues").alias("issues"))


@query
def flt2_file_validation(spark, d):
    out = VA.check_files(V.evidence(spark, d))
    return out.select(
        "claim_id", "n_files", "n_too_large", "n_bad_type", _join("overfull_kinds").alias("overfull"), "accepted"
    )


@query
def flt3_photo_required(spark, d):
    return VA.with_photo(V.claims(spark, d), V.evidence(spark, d)).select("id", "loss_type")


@query
def flt4_history_filter(spark, d):
    out = HI.history(V.claims(spark, d), V.users(spark, d), status="flagged", search="mer#0_0", loss_type="flood")
    return out.select("id", "status", "claimant_name", "inspector_name", _ts("submitted_at").alias("submitted_at"))


@query
def flt5_status_groups(spark, d):
    claims = V.claims(spark, d)
    groups = [*C.STATUS_GROUPS, "AI_REJECTED"]
    return claims.agg(*[F.count_if(HI.status_filter(F.col("status"), g)).alias(g.lower()) for g in groups])


@query
def flt6_live_only(spark, d):
    claims = V.claims(spark, d)
    seeded = V.table(spark, d, "events").select(V.claim_id(F.col("user_id")).alias("id"))
    return HI.live_only(claims, seeded).select("id", "status")


@query
def flt7_decided(spark, d):
    return HI.decided(V.claims(spark, d)).select("id", "status")


@query
def flt8_roster(spark, d):
    return HI.roster(V.users(spark, d)).withColumn("created_at", _ts("created_at"))


@query
def flt9_payout_eligibility(spark, d):
    return GU.check_payouts(V.claims(spark, d)).select("id", "status", "payout_code")


@query
def flt10_transition_guard(spark, d):
    out = GU.check_requests(V.claims(spark, d), V.transitions(spark, d))
    return out.select("claim_id", _long("seq").alias("seq"), "current", "requested", "code")


@query
def flt11_run_status(spark, d):
    claims = V.claims(spark, d)
    runs = claims.where(F.col("verdict").isNotNull()).select(F.col("id").alias("claim_id"))
    return HI.run_status(claims, runs)


@query
def flt12_point_lookups(spark, d):
    claims, evidence, users = V.claims(spark, d), V.evidence(spark, d), V.users(spark, d)
    one = lambda df, what, key: df.select(F.lit(what).alias("what"), F.col(key).alias("key"))
    return (
        one(HI.claim_by_id(claims, "CLM-7"), "claim", "id")
        .unionByName(one(HI.evidence_of_claim(evidence, "CLM-7"), "evidence", "file_id"))
        .unionByName(one(HI.evidence_by_file(evidence, "ev-5979-6-1616-79-23"), "file", "claim_id"))
        .unionByName(one(HI.user_by(users, email="user3@example.org"), "email", "id"))
        .unionByName(one(HI.user_by(users, user_id="USR-5"), "user", "email"))
    )


@query
def flt13_reopen_eligibility(spark, d):
    return V.claims(spark, d).select("id", GU.may_reopen(F.col("status")).alias("may_reopen"))


# --- joins -----------------------------------------------------------------------

@query
def jn1_history_join(spark, d):
    out = HI.with_inspector(V.claims(spark, d), V.users(spark, d))
    return out.select("id", "assigned_to", "inspector_name", "inspector_district")


@query
def jn2_near_duplicates(spark, d):
    return ND.near_duplicates(V.hashes(spark, d)).withColumns({"tier": _long("tier"), "distance": _long("distance")})


@query
def jn2_near_duplicates_as_of(spark, d):
    runs = VP.with_run_time(V.claims(spark, d)).select(F.col("id").alias("claim_id"), "run_at")
    out = ND.near_duplicates(ND.photo_hashes(V.evidence(spark, d)), runs)
    return out.select(
        "claim_id", "file_id", _long("tier").alias("tier"), "match_claim_id", "match_file_id",
        _long("distance").alias("distance"),
    )


@query
def jn2_stored_index_as_of(spark, d):
    """The index is filled by three batches; then every picture is looked up."""
    runs = VP.with_run_time(V.claims(spark, d)).select(F.col("id").alias("claim_id"), "run_at")
    photos = ND.photo_hashes(V.evidence(spark, d))
    index = PI.PhotoIndex(spark, work_dir(spark, "photos"))
    for epoch in range(3):
        index.append(photos.where(F.pmod(F.xxhash64("claim_id"), F.lit(3)) == epoch), epoch)
    return index.duplicates(photos, runs).select(
        "claim_id", "file_id", _long("tier").alias("tier"), "match_claim_id", "match_file_id",
        _long("distance").alias("distance"),
    )


@query
def jn2_hash_neighbours(spark, d):
    out = ND.hash_pairs(V.hashes(spark, d))
    return out.withColumns({"n_neighbours": _long("n_neighbours"), "least_distance": _long("least_distance")})


@query
def jn3_within_claim(spark, d):
    photos = V.hashes(spark, d).withColumn("seq", F.regexp_extract("file_id", r"(\d+)$", 1).cast("long"))
    own = photos.withColumn("claim_id", V.claim_id(F.col("seq") % V.PLANTED))
    return ND.within_claim(own).withColumn("distance", _long("distance"))


@query
def jn4_policy_lookup(spark, d):
    out = PO.with_policy(V.claims(spark, d), V.policies(spark), "policy_number")
    return out.select(
        "id", "policy_number", "policy_holder", F.coalesce(_long("policy_limit"), F.lit(-1)).alias("policy_limit"),
        F.coalesce(F.array_contains("policy_losses", F.col("loss_type")), F.lit(False)).alias("covered"),
    )


@query
def jn5_nearest_district(spark, d):
    e = V.evidence(spark, d).where(F.col("exif.gps").isNotNull())
    out = G.with_district(e, F.col("exif.gps.lat"), F.col("exif.gps.lon"))
    return out.select("file_id", "nearest", "nearest_km", "resolved", "out_of_area")


@query
def jn6_knn_vote(spark, d):
    votes = VE.knn_votes(V.query_vectors(spark, d), V.memory(spark, d))
    best = F.get("matches", F.lit(0))
    return votes.select(
        "claim_id", _long("fraud_score").alias("fraud_score"), _long("knn").alias("knn"),
        F.coalesce(best["claim_id"], F.lit("")).alias("nearest"),
    )


@query
def jn7_prompt_margin(spark, d):
    scored = VE.prompt_scores(V.all_vectors(spark, d), V.prompt_vectors(spark, d))
    return scored.select("file_id", _long("staged").alias("staged"), _long("ai_gen").alias("ai_gen"), _long("rel_flood").alias("rel_flood"))


def _identity_pairs(spark, d) -> DataFrame:
    """The card read from every document, and the next document as its land record (none for the last)."""
    docs = V.documents(spark, d)
    cards = docs.select(F.col("doc_id").alias("pair"), E.identity_card(F.col("text")).alias("card"))
    deeds = docs.select((F.col("doc_id") - 1).alias("pair"), F.col("text").alias("deed_text"))
    return cards.join(deeds, "pair", "left").select("pair", "card.name", "card.name_devanagari", "deed_text")


@query
def jn8_str5_identity(spark, d):
    out = with_identity(_identity_pairs(spark, d), "name", "name_devanagari", "deed_text")
    return out.select("pair", "identity.matched", "identity.inconclusive", "identity.score", "identity.registry_name")


def _similar(spark, d) -> DataFrame:
    return VE.similar_rows(VE.knn_votes(V.query_vectors(spark, d), V.memory(spark, d)))


@query
def jn9_similar_cases(spark, d):
    out = HI.similar_cases(_similar(spark, d), V.claims(spark, d))
    return out.select(
        "claim_id", "matched_claim_id", "label", _long("rank").alias("rank"), "matched_loss_type",
        _long("matched_amount").alias("matched_amount"), "matched_status",
    )


@query
def jn10_reflectance_window(spark, d):
    plots = PL.claim_plots(V.claims(spark, d), G.plot_points(V.evidence(spark, d)))
    windows = PL.reflectance_windows(plots, V.reflectance(spark, d))
    return windows.select(
        "tile_id", F.col("event_date").cast("string").alias("event_date"),
        *[F.round(c, 6).alias(c) for c in ("red_pre", "nir_pre", "red_post", "nir_post")],
    )


@query
def jn11_event_search(spark, d):
    events = EX.sealed_events(_sealed(spark, d))
    by_claim = EX.search_events(events, "clm-5")
    one = "0x" + "0" * 64
    by_hash = EX.search_events(events, one)
    cols = ["interpreted_as", "claim_key", "state_hash", "status"]
    return by_claim.select(_long("seq").alias("seq"), *cols).unionByName(by_hash.select(_long("seq").alias("seq"), *cols))


@query
def jn11_indexed_search(spark, d):
    """The same searches through a stored index of hashes."""
    index = EventIndex(spark, work_dir(spark, "event-index"), 32)
    index.append(EX.sealed_events(_sealed(spark, d)), 0)
    cols = ["interpreted_as", "claim_key", "state_hash", "status"]
    found = [index.search(q).select(_long("seq").alias("seq"), *cols) for q in ("clm-5", "0x" + "0" * 64)]
    return found[0].unionByName(found[1])


@query
def jn12_claim_reference(spark, d):
    rows = V.trail_input(spark, d).withColumns({"prev_record_hash": F.lit(""), "record_hash": F.lit("")})
    out = EX.with_claim_ref(EX.sealed_events(rows), V.claims(spark, d))
    return out.groupBy("claim_key", "claim_ref").agg(F.count("*").alias("n"))


@query
def jn13_untrained_claims(spark, d):
    return ME.untrained_claims(V.claims(spark, d), V.evidence(spark, d), V.memory(spark, d)).select("id", "status", "label")


@query
def jn14_gap_fill(spark, d):
    claims = V.claims(spark, d).select("id", "status")
    spare = V.table(spark, d, "events").select(V.claim_id(F.col("user_id") + 14000).alias("id")).distinct()
    stored = claims.where(F.col("status") != "PAID")
    return MT.fill_gaps(stored, spare.withColumn("status", F.lit("SPARE")))


@query
def jn15_shared_files(spark, d):
    out = ND.shared_files(V.evidence(spark, d))
    return out.select("sha256", "n_claims", "n_files", "first_claim_id")


# --- aggregations ------------------------------------------------------------------

@query
def agg1_agg2_kpi_strip(spark, d):
    return K.kpi_strip(V.claims(spark, d), _now())


@query
def agg3_agg4_memory_statistics(spark, d):
    return K.memory_statistics(V.memory(spark, d))


@query
def agg5_agg6_score_verdict(spark, d):
    e = V.table(spark, d, "events")
    logs = e.select(
        F.col("user_id").alias("claim_id"),
        F.when(F.col("event_id") % 9 == 0, "DECISION").otherwise("EXIF_INTEGRITY").alias("stage"),
        F.when(F.col("event_id") % 31 == 0, "FAIL").when(F.col("event_id") % 29 == 0, "WARN").otherwise("PASS").alias("result"),
    )
    return S.score_logs(logs).withColumn("score", _long("score"))


@query
def agg7_decision_reasons(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    words = lambda *mods: F.transform(F.array(*[F.lit(m) for m in mods]), lambda m: (k % m).cast("string"))
    return o.select(k.alias("claim_id"), _join(S.decision_reasons(words(3, 5), words(2, 3), words(7), words(4, 9))).alias("reasons"))


@query
def agg8_similar_dedup(spark, d):
    # the same matches seen from two files of a claim
    twice = _similar(spark, d).unionByName(_similar(spark, d).withColumns({"file_id": F.lit("other"), "pos": F.col("pos") + 100}))
    return HI.best_similar(twice).select("claim_id", "matched_claim_id", "label", "file_id")


@query
def agg9_trail_counters(spark, d):
    heads = TR.chain_heads(_sealed(spark, d))
    return heads.select("claim_id", "trail_length", "last_seq", "head_hash")


@query
def agg10_exif_counters(spark, d):
    return D.exif_counters(V.evidence(spark, d))


def _features(spark, d) -> DataFrame:
    return D.claim_features(V.evidence(spark, d), V.ocr_text(spark, d))


@query
def agg11_entities_by_kind(spark, d):
    out = D.entities_by_kind(D.entity_rows(_features(spark, d)))
    return out.select("claim_id", "doc_kind", "n", F.to_json("entities").alias("entities"))


@query
def agg12_audit_dedup(spark, d):
    return MT.distinct_audit(V.audit_records(spark, d)).select("claim_id", "status", _ts("ts").alias("ts"), "event_id")


@query
def agg13_merkle_roots(spark, d):
    return MK.merkle_roots(_sealed(spark, d), counted=V.trail_input(spark, d))


@query
def agg13_merkle_frontier(spark, d):
    """The trail comes in three batches; the state of the trees is stored between them."""
    sealed = ND.stored(_sealed(spark, d).select("claim_id", "seq", "record_hash"), "sealed")
    state = ND.stored(MK.frontier_of(sealed.where("seq < 2")), "frontier")
    state = ND.stored(MK.append_leaves(state, sealed.where("seq BETWEEN 2 AND 6")), "frontier")
    return MK.frontier_roots(MK.append_leaves(state, sealed.where("seq > 6")))


@query
def agg14_agg15_merkle_proofs(spark, d):
    proofs = MK.merkle_proofs(_sealed(spark, d), counted=V.trail_input(spark, d))
    return proofs.select(
        "claim_id", "leaf_index", "leaf", F.size("siblings").alias("path_length"), "root",
        MK.proof_holds(F.col("leaf"), F.col("siblings"), F.col("root")).alias("verifies"),
    )


@query
def agg16_destruction_ladder(spark, d):
    scored = VE.prompt_scores(V.all_vectors(spark, d), V.prompt_vectors(spark, d))
    return scored.select("file_id", _long("destruction_pct").alias("destruction_pct"), "rung")


@query
def agg17_ndvi_drop(spark, d):
    out = PL.plot_damage(V.claims(spark, d), G.plot_points(V.evidence(spark, d)), V.reflectance(spark, d))
    return out.select("claim_id", "tile_id", "destruction_pct", "rung")


@query
def agg18_calibration_table(spark, d):
    out = VE.calibration_table(V.all_vectors(spark, d), V.prompt_vectors(spark, d))
    return out.select("file_id", *[_long(c).alias(c) for c in out.columns if c != "file_id"])


def _tampered(spark, d) -> DataFrame:
    """Sealed trail in which some records were changed afterwards."""
    sealed = _sealed(spark, d)
    hit = (F.col("seq") == 3) & F.col("claim_id").endswith("7")
    return sealed.withColumn("state_hash", F.when(hit, F.lit("0xbad")).otherwise(F.col("state_hash")))


@query
def agg19_integrity_report(spark, d):
    out = TR.integrity_report(_tampered(spark, d), _sealed(spark, d))
    fill = lambda c: F.coalesce(_long(c), F.lit(-1)).alias(c)
    return out.select(
        "claim_id", "off_chain_valid", fill("off_chain_break_at"), "on_chain_valid", fill("on_chain_break_at")
    )


# --- windows -------------------------------------------------------------------------

@query
def win1_trail_verification(spark, d):
    out = TR.verify_claims(V.claims(spark, d).select(F.col("id").alias("claim_id")), _tampered(spark, d))
    return out.select("claim_id", "records", F.coalesce(_long("break_at"), F.lit(-1)).alias("break_at"), "valid")


@query
def win1_check_since(spark, d):
    """The first three records of each claim were checked before; later ones and a part of these are now."""
    trail = ND.stored(_tampered(spark, d), "trail")
    old, new = trail.where("seq < 3"), trail.where("seq >= 3")
    marks = ND.stored(TR.checkpoints(old, TR.chain_breaks(old)), "marks")
    out = TR.check_since(new, marks, old)
    ids = V.claims(spark, d).select(F.col("id").alias("claim_id"))
    return ids.join(out, "claim_id", "left").select(
        "claim_id", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce(_long("break_at"), F.lit(-1)).alias("break_at"),
        F.coalesce("valid", F.lit(True)).alias("valid"),
    )


@query
def win2_trail_sealing(spark, d):
    return _sealed(spark, d).select("claim_id", _long("seq").alias("seq"), "prev_record_hash", "record_hash")


@query
def win3_chain_head(spark, d):
    rows = V.trail_input(spark, d).withColumn("record_hash", F.lit(""))
    return TR.chain_heads(rows).select("claim_id", "status", "state_hash")


@query
def win4_memory_cap(spark, d):
    return ME.cap_memory(V.memory(spark, d)).select("claim_id", "label")


@query
def win5_memory_upsert(spark, d):
    memory = V.memory(spark, d)
    new = V.query_vectors(spark, d).select(
        V.claim_id(N.half_up(F.regexp_extract("claim_id", r"(\d+)", 1).cast("long") / 4)).alias("claim_id"),
        "file_id", F.lit("fraud").alias("label"), F.lit("human").alias("source"), "vec",
        F.col("run_at").alias("at"), F.lit(1).cast("long").alias("seq"),
        F.regexp_extract("claim_id", r"(\d+)", 1).cast("long").alias("batch"),
    )
    return ME.upsert_memory(memory, new, 10_000).select("claim_id", "file_id", "label", "source")


@query
def win6_ma6_first_plot(spark, d):
    out = G.plot_points(V.evidence(spark, d))
    return out.select("claim_id", "tile_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query
def win7_first_photos(spark, d):
    return D.first_photos(V.image_vectors(spark, d).drop("vec"), 3).select("claim_id", "file_id", _long("rank").alias("rank"))


@query
def win8_last_papers(spark, d):
    return D.last_papers(V.evidence(spark, d), V.ocr_text(spark, d))


@query
def win9_transition_audit(spark, d):
    rows = V.transitions(spark, d).withColumnRenamed("requested", "status")
    return GU.audit_history(rows).select("claim_id", _long("seq").alias("seq"), "previous", "status", "code")


# --- sorts and limits -------------------------------------------------------------------

@query
def top1_history_newest_first(spark, d):
    return HI.history(V.claims(spark, d), V.users(spark, d)).select("id", _ts("submitted_at").alias("submitted_at"))


@query
def top2_top_similar(spark, d):
    out = HI.similar_cases(_similar(spark, d), V.claims(spark, d), 4)
    return out.select("claim_id", "matched_claim_id", _long("rank").alias("rank"))


@query
def top3_neighbours(spark, d):
    return _similar(spark, d).select(
        "claim_id", "matched_claim_id", "label", F.round("similarity", 3).alias("similarity"),
        (_long("pos") - C.KNN_K).alias("pos"),
    )


@query
def top5_str1_classify(spark, d):
    out = D.classify(V.documents(spark, d))
    return out.select("doc_id", *[_long(f"{r}_hits").alias(f"{r}_hits") for r in C.ROLE_SIGNS], "role")


@query
def top6_text_snippets(spark, d):
    out = D.text_snippets(V.evidence(spark, d), V.ocr_text(spark, d))
    whole = V.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("claim_id"), F.lit("doc").alias("file_id"), F.lit("bill").alias("kind"),
        F.substring("text", 1, 1500).alias("snippet"),
    )
    return out.unionByName(whole).withColumn("snippet", F.md5("snippet"))


# --- set operations -----------------------------------------------------------------------

@query
def set1_evidence_list(spark, d):
    return D.evidence_list(V.evidence(spark, d)).select("claim_id", _long("kind_rank").alias("kind_rank"), "file_id", "kind")


@query
def set2_st6_addendum(spark, d):
    _, records = MT.addenda(V.claims(spark, d), V.evidence(spark, d))
    return records.select("claim_id", "n", "status", "note", _ts("ts").alias("ts"))


@query
def set4_evidence_digests(spark, d):
    out = MT.claim_digests(V.evidence(spark, d))
    return out.select("claim_id", "n_files", "evidence_digest")


# --- maintenance ----------------------------------------------------------------------------

def _claim_update(spark, d) -> DataFrame:
    """Newer versions of some claims, and claims that are not stored yet."""
    k = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    return V.claims(spark, d).withColumn("k", k).where(F.col("k") % 3 == 0).select(
        F.when(F.col("k") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("NEW-"), F.col("k").cast("string"))).alias("id"),
        "claimant_name", "loss_type", (F.col("amount_requested") + 1).alias("amount_requested"),
        F.lit("HUMAN_REVIEW").alias("status"), "policy_number", "destruction_pct_claimed",
        _now().alias("submitted_at"), _now().alias("decided_at"), "duration_ms", "verdict", "score", "latest_state_hash",
        F.lit("USR-1").alias("assigned_to"),
    )


@query
def mnt1_claim_upsert(spark, d):
    out = MT.upsert_claims(V.claims(spark, d), _claim_update(spark, d))
    return out.select(
        "id", "status", _long("amount_requested").alias("amount_requested"), _ts("submitted_at").alias("submitted_at"),
        F.coalesce("assigned_to", F.lit("")).alias("assigned_to"),
    )


@query
def mnt2_evidence_insert(spark, d):
    evidence = V.evidence(spark, d)
    stored = evidence.where(F.col("kind") == "photo")
    # the same file may come under several kinds; one key per part
    rekey = F.concat(F.lit("p"), F.element_at(F.split("file_id", "-"), 4))
    new = evidence.withColumn("file_id", rekey)
    old = stored.withColumn("file_id", rekey).dropDuplicates(["file_id"])
    added = MT.insert_absent(old, new, "file_id", [F.col("created_at"), F.col("claim_id"), F.col("seq"), F.col("sha256")])
    return added.select("file_id", "claim_id", "kind")


@query
def mnt3_assignment_sync(spark, d):
    _, claims = MT.assign(V.claims(spark, d), V.assignments(spark, d), V.users(spark, d))
    return claims.select("id", F.coalesce("assigned_to", F.lit("")).alias("assigned_to"))


@query
def mnt4_payout_records(spark, d):
    requests = V.table(spark, d, "orders").select(
        V.claim_id(F.col("o_orderkey")).alias("claim_id"),
        F.concat(F.lit("UPI-"), F.col("o_custkey").cast("string")).alias("reference"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(500)).alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    # every claim asks twice, the second time a day later and in full
    again = requests.select(
        "claim_id", F.concat("reference", F.lit("-again")).alias("reference"), F.lit(None).cast("int").alias("amount"),
        F.date_add(F.col("ts").cast("date"), 1).cast("timestamp").alias("ts"),
    )
    out = MT.pay(V.claims(spark, d), requests.unionByName(again))
    return out.select("claim_id", "code", _long("paid_inr").alias("paid_inr"), "status", "note", _ts("ts").alias("ts"))


@query
def mnt5_rerun_records(spark, d):
    claims = V.claims(spark, d)
    later = F.date_add(F.col("submitted_at").cast("date"), 3).cast("timestamp").alias("run_at")
    runs = claims.where(F.col("verdict").isNotNull()).select(F.col("id").alias("claim_id"), "verdict", "score", later)
    records, _ = MT.rerun_records(claims, runs)
    return records.select("claim_id", "status", "note", _ts("ts").alias("ts"))


@query
def mnt6_human_decisions(spark, d):
    out = MT.human_decisions(V.claims(spark, d), V.transitions(spark, d))
    return out.select("claim_id", "requested", "current", "code", "status", "note", F.coalesce("label", F.lit("")).alias("label"), _ts("ts").alias("ts"))


@query
def mnt7_resync(spark, d):
    claims, evidence = V.claims(spark, d), V.evidence(spark, d)
    merged, files = MT.resync(
        claims.where(F.col("status") != "PAID"), claims, evidence.where(F.col("kind") == "photo"), evidence
    )
    n = merged.agg(F.count("*").alias("n"), F.sum(_long("amount_requested")).alias("total")).withColumn("what", F.lit("claims"))
    m = files.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("total")).withColumn("what", F.lit("evidence"))
    return n.unionByName(m)


# --- texts ----------------------------------------------------------------------------------

@query
def str2a_identity_card(spark, d):
    out = V.documents(spark, d).select("doc_id", E.identity_card(F.col("text")).alias("f"))
    return out.select("doc_id", "f.name", "f.dob", "f.aadhaar_masked", "f.gender")


@query
def str2b_land_record(spark, d):
    out = V.documents(spark, d).select("doc_id", E.land_record(F.col("text")).alias("f"))
    return out.select(
        "doc_id", "f.district", "f.village", "f.deed_type", "f.execution_date", "f.khasra_no", "f.area_hectares", "f.state",
    )


@query
def str2b_land_record_owner(spark, d):
    out = V.documents(spark, d).select("doc_id", E.land_record(F.col("text")).alias("f"))
    return out.select("doc_id", "f.owner_name", "f.owner_relation", "f.area_value", "f.confidence")


@query
def str2c_policy_paper(spark, d):
    out = V.documents(spark, d).select("doc_id", E.policy_paper(F.col("text")).alias("f"))
    return out.select("doc_id", "f.policy_number", "f.sum_insured", _join("f.coverage").alias("coverage"))


@query
def str2d_bill(spark, d):
    out = V.documents(spark, d).select("doc_id", E.bill(F.col("text")).alias("f"))
    return out.select("doc_id", "f.policy_number", F.coalesce("f.amount", F.lit(-1)).alias("amount"))


@query
def str2e_entity_rows(spark, d):
    return D.entity_rows(_features(spark, d))


def _wide(spark, d) -> DataFrame:
    claims = V.claims(spark, d).withColumnRenamed("id", "claim_id")
    return claims.join(D.with_cross_check(_features(spark, d)), "claim_id", "left")


@query
def str2f_document_summary(spark, d):
    nothing = {"satellite_pct": F.lit(None).cast("int"), "satellite_rung": F.lit(None).cast("string")}
    out = _wide(spark, d).withColumns(nothing).withColumn("summary", D.document_summary())
    return out.select("claim_id", F.to_json("summary").alias("summary"))


@query
def str3_transliterate(spark, d):
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        k.alias("claim_id"), V.person_deva(k).alias("name"), X.transliterate(V.person_deva(k)).alias("latin")
    )


@query
def str4_name_match(spark, d):
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        k.alias("claim_id"), _long(X.name_score(V.person(k), V.person(F.col("o_custkey")))).alias("score")
    )


@query
def str4_name_match_bilingual(spark, d):
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        k.alias("claim_id"), _long(X.name_score(V.person(k), V.person_deva(F.col("o_custkey")))).alias("score")
    )


@query
def str6_devanagari_digits(spark, d):
    o = V.table(spark, d, "orders")
    deva = F.translate(F.col("o_orderkey").cast("string"), "0123456789", X.DEVA_DIGITS)
    return o.select(F.col("o_orderkey").alias("k"), deva.alias("deva"), X.ascii_digits(deva).alias("ascii"))


@query
def str7_damage_words(spark, d):
    docs = V.documents(spark, d)
    lowered = F.lower("text")
    hits = {loss: X.word_hits(lowered, C.LOSS_META[loss]["terms"]) for loss in C.LOSS_TYPES}
    return docs.select(
        "doc_id", *[(h > 0).alias(loss) for loss, h in hits.items()],
        F.when(hits["flood"] > 0, 70 + F.least(F.lit(20), F.lit(10))).otherwise(35).cast("long").alias("severity_one_photo"),
    )


@query
def str9_indian_digits(spark, d):
    return V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), X.indian_digits(F.floor(F.col("o_totalprice") * F.col("o_orderkey"))).alias("grouped")
    )


@query
def str10_policy_holder(spark, d):
    joined = PO.with_policy(V.claims(spark, d), V.policies(spark), "policy_number").where(F.col("policy_holder").isNotNull())
    return joined.select("id", PO.holder_differs(F.col("policy_holder"), F.col("claimant_name")).alias("differs"))


@query
def str11_short_hash(spark, d):
    return V.claims(spark, d).select("id", X.short_hash(F.col("latest_state_hash")).alias("a"), X.short_hash(F.col("id")).alias("b"))


# --- dates, numbers, hashes --------------------------------------------------------------------

@query
def dt1_dt4_times(spark, d):
    c = V.claims(spark, d)
    first, day, last = DT.event_window(F.col("submitted_at"), C.WINDOW_BEFORE_DAYS, C.WINDOW_AFTER_DAYS)
    return c.select(
        "id", DT.within_last_hours(F.col("submitted_at"), _now()).alias("today"),
        first.cast("string").alias("window_start"), day.cast("string").alias("event_day"), last.cast("string").alias("window_end"),
        DT.epoch_to_iso(F.unix_seconds("submitted_at")).alias("iso"),
        F.coalesce(DT.duration_ms(F.col("submitted_at"), F.col("decided_at")), F.lit(-1)).alias("duration_ms"),
    )


@query
def ma1_ma2_geometry(spark, d):
    part = V.table(spark, d, "lineitem").select("l_partkey").distinct()
    lat, lon = V.part_lat(), V.part_lon()
    km = N.haversine_km(lat, lon, F.lit(19.8697), F.lit(77.3091))
    return part.select(
        "l_partkey", F.round(km, 3).alias("km"), N.half_up(km).alias("km_whole"),
        N.half_up(F.lit(2.5) - (F.col("l_partkey") % 7).cast("double")).alias("half_up"), N.tile_id(lat, lon).alias("tile_id"),
    )


@query
def ma3_ma5_vectors(spark, d):
    e = V.table(spark, d, "embeddings")
    other = e.where(F.col("vec_id") == 0).select("embedding").scalar()
    scaled = N.l2_normalise(F.transform("embedding", lambda x: x * 3))
    return e.withColumn("other", other).select(
        "vec_id", F.round(N.dot(F.col("embedding"), F.col("other")), 3).alias("dot"),
        F.round(N.dot(scaled, F.col("other")), 3).alias("normalised_dot"),
        F.round(F.aggregate(N.round_vector(F.col("embedding"), 3), F.lit(0.0), lambda a, x: a + x), 3).alias("rounded_sum"),
    )


@query
def ma4_hamming(spark, d):
    h = V.hashes(spark, d)
    k = F.regexp_extract("file_id", r"(\d+)$", 1).cast("long")
    a = h.where(k < V.PLANTED).select(k.alias("k"), F.col("p_hash").alias("a"))
    b = h.where(k >= V.PLANTED).select((k - V.PLANTED).alias("k"), F.col("p_hash").alias("b"))
    return a.join(b, "k").select(
        "k", _long(N.hamming(F.col("a"), F.col("b"))).alias("distance"),
        _long(N.hamming(F.col("a"), F.substring("b", 1, 63))).alias("unequal_length"),
    )


@query
def hs1_hs2_state_hashes(spark, d):
    c = V.claims(spark, d)
    return c.select(
        "id", H.claim_key(F.col("id")).alias("claim_key"),
        H.state_hash(
            F.col("id"), F.col("loss_type"), F.col("claimant_name"), F.col("amount_requested"),
            F.col("latest_state_hash"), F.date_format("submitted_at", DT.ISO_MILLIS),
        ).alias("state_hash"),
    )


@query
def hs3_run_digest(spark, d):
    c = V.claims(spark, d).where(F.col("verdict").isNotNull())
    stages = F.array(
        F.struct(F.lit("EXIF_INTEGRITY").alias("stage"), F.lit("PASS").alias("result"), F.col("loss_type").alias("details")),
        F.struct(F.lit("DECISION").alias("stage"), F.col("verdict").alias("result"), F.col("status").alias("details")),
    )
    return c.select("id", H.run_digest(F.col("id"), F.col("verdict"), F.col("score"), stages).alias("run_digest"))


@query
def js1_sorted_json(spark, d):
    c = V.claims(spark, d)
    return c.select("id", H.sorted_json(status=F.col("status"), amount=F.col("amount_requested"), loss=F.col("loss_type")).alias("json"))


# --- rule stages -----------------------------------------------------------------------------------

def _stage_result(df: DataFrame, stage: Column) -> DataFrame:
    out = df.withColumn("s", stage)
    return out.select("claim_id", "s.result", F.size("s.reasons").cast("long").alias("n_reasons"))


@query
def rul1_exif_integrity(spark, d):
    claims = V.claims(spark, d).select(F.col("id").alias("claim_id"))
    counted = D.exif_counters(V.evidence(spark, d)).withColumn("software", F.lit("x"))
    return _stage_result(claims.join(counted, "claim_id", "left"), S.exif_integrity())


@query
def rul2_duplicate_phash(spark, d):
    claims = V.claims(spark, d)
    runs = VP.with_run_time(claims).select(F.col("id").alias("claim_id"), "run_at")
    photos = ND.photo_hashes(V.evidence(spark, d))
    hits = ND.near_duplicates(photos, runs).groupBy("claim_id").agg(F.count("*").alias("n_dup"))
    wide = runs.join(hits, "claim_id", "left").join(ND.foreign_counts(photos, photos, runs), "claim_id", "left")
    wide = wide.withColumns({name: F.lit(None).cast("array<string>") for name in ("dup_shown", "inner_shown")})
    inner = ND.within_claim(photos).groupBy("claim_id").agg(F.count("*").alias("n_inner"))
    stage = S.duplicate_phash()
    return wide.join(inner, "claim_id", "left").select(
        "claim_id", stage["result"].alias("result"), F.coalesce("n_dup", F.lit(0)).alias("n_dup"), F.coalesce("n_inner", F.lit(0)).alias("n_inner"),
        F.when(F.coalesce("n_dup", "n_inner").isNull(), stage["details"]).alias("unique"),
    )


@query
def rul3_ocr_extract(spark, d):
    return _stage_result(_wide(spark, d), S.ocr_extract()).select("claim_id", "result")


@query
def rul4_policy_match(spark, d):
    wide = _wide(spark, d).withColumn("paper_number", S.paper_number())
    return _stage_result(PO.with_policy(wide, V.policies(spark), "paper_number"), S.policy_match())


@query
def rul5_doc_cross(spark, d):
    return _stage_result(_wide(spark, d), S.doc_cross())


@query
def rul6_damage_assess(spark, d):
    tables = _tables(spark, d)
    wide = _wide(spark, d).join(VP.image_signals(tables)[0], "claim_id", "left")
    return _stage_result(wide, S.damage_assess())


@query
def rul7_geography(spark, d):
    out = G.geo_reasons(V.evidence(spark, d), V.claims(spark, d))
    return out.select("claim_id", "file_id", "reason")


@query
def rul7_exaggeration(spark, d):
    measured = V.claims(spark, d).withColumn("satellite_pct", (F.col("amount_requested") % 100).cast("int"))
    return measured.withColumn("reason", S.exaggeration()).where(F.col("reason").isNotNull()).select("id", "reason")


@query
def rul7_file_reasons(spark, d):
    claims, evidence = V.claims(spark, d), V.evidence(spark, d)
    runs = VP.with_run_time(claims).select(F.col("id").alias("claim_id"), "run_at")
    rows = VP.file_reasons(G.geo_reasons(evidence, claims), ND.near_duplicates(ND.photo_hashes(evidence), runs))
    return rows.groupBy("claim_id").agg(
        F.count_if(F.col("rule") == 1).alias("n_geo"), F.count_if(F.col("rule") == 2).alias("n_duplicate")
    )


def _tables(spark, d) -> VP.ClaimTables:
    return VP.ClaimTables(
        V.claims(spark, d), V.evidence(spark, d), V.ocr_text(spark, d), V.image_vectors(spark, d),
        V.prompt_vectors(spark, d), V.memory(spark, d), V.policies(spark),
    )


@query
def rul9_verify_claims(spark, d):
    return VP.verify_claims(_tables(spark, d)).select(
        "claim_id", "verdict", "score", _join("reasons").alias("reasons"), "run_digest"
    )


@query
def str8_explanation(spark, d):
    runs = VP.verify_claims(_tables(spark, d))
    return EP.explain_runs(runs, "en")


@query
def rul10_training_labels(spark, d):
    s = F.col("status")
    return V.claims(spark, d).select(
        "id", ME.bulk_label(s).alias("bulk"), ME.human_label(s).alias("human"),
        F.when(F.col("verdict").isNotNull(), ME.verdict_label(F.col("verdict"))).alias("live"),
    )


# --- streams: the same rows arrive as a stream, the result is read from its table ---------------------

def _event_stream(spark, d) -> DataFrame:
    events = ST.read_files(spark, f"{d}/events.parquet*", EVENTS_RAW)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("pos", F.unix_micros("ts"))


def _claim_stream(spark, d) -> DataFrame:
    return V.claims(spark, d, ST.read_files(spark, f"{d}/orders.parquet*", ORDERS_RAW))


@query
def st1_verify_on_intake(spark, d):
    runs, _ = ST.verify_on_intake(_claim_stream(spark, d), _tables(spark, d))
    return runs.select("claim_id", "verdict", "score")


@query
def st2_sealing(spark, d):
    records = _event_stream(spark, d).select(
        V.claim_id(F.col("user_id")).alias("claim_id"), "pos",
        H.sha2_digest(F.concat(F.lit("state-"), F.col("event_id").cast("string"))).alias("state_hash"),
        V.event_status().alias("status"), F.unix_seconds("ts").alias("ts"), F.lit("svc").alias("recorded_by"),
        F.col("props").alias("note"),
    )
    out = ST.drain(ST.seal_stream(records), "sealing")
    return out.select("claim_id", "seq", "prev_record_hash", "record_hash")


@query
def st3_transition_guard(spark, d):
    t = F.col("event_type")
    requests = _event_stream(spark, d).select(
        V.claim_id(F.col("user_id")).alias("claim_id"), "pos",
        F.when(t == "purchase", "pay").when(t.isin("view", "signup"), "verdict").otherwise("human").alias("kind"),
        F.when(t == "view", "AI_FLAGGED").when(t == "signup", "AI_APPROVED").when(t == "click", "HUMAN_APPROVED")
        .when(t == "error", "HUMAN_REJECTED").otherwise("PAID").alias("requested"),
        F.repeat(F.col("props"), (1 + F.col("event_id") % 3).cast("int")).alias("note"),
    )
    return ST.drain(ST.guard_stream(requests), "guard").select("claim_id", "pos", "requested", "previous", "code", "status")


@query
def st4_intake_velocity(spark, d):
    """More than three requests of one source in a day."""
    out = ST.too_fast(_event_stream(spark, d), "user_id", "ts", limit=3, seconds=86400)
    return out.select("user_id", _ts("window_start").alias("window_start"), "n")


def _audit_stream(spark, d) -> DataFrame:
    return V.audit_rows(ST.read_files(spark, f"{d}/events.parquet*", EVENTS_RAW))


@query
def st5_audit_append(spark, d):
    out = ST.drain(ST.audit_stream(_audit_stream(spark, d)), "audit")
    return out.select("claim_id", "status", _ts("ts").alias("ts"))


@query
def st5_audit_forever(spark, d):
    out = ST.audit_forever(_audit_stream(spark, d), work_dir(spark, "audit"))
    return out.select("claim_id", "status", _ts("ts").alias("ts"), "event_id")


@query
def st6_late_evidence(spark, d):
    files = V.evidence(spark, d, ST.read_files(spark, f"{d}/lineitem.parquet*", LINEITEM_RAW))
    _, records = ST.late_evidence(files, V.claims(spark, d))
    return records.select("claim_id", "n", "status", "note", _ts("ts").alias("ts"))


@query
def st7_memory_upkeep(spark, d):
    decided = _claim_stream(spark, d).where(F.col("verdict").isNotNull()).select(
        F.col("id").alias("claim_id"), ME.verdict_label(F.col("verdict")).alias("label"), F.col("decided_at").alias("at")
    )
    out = ST.memory_upkeep(decided, V.image_vectors(spark, d), V.memory(spark, d), "pipeline")
    return out.select("claim_id", "file_id", "label")


@query
def st8_live_kpi(spark, d):
    return ST.live_kpi(_claim_stream(spark, d), _now())
