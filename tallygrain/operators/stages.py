"""The eight stages as expressions over one wide row per claim.

Each function returns a struct(stage, result, details, reasons).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallygrain import constants as C
from tallygrain.functions.numeric import clamp
from tallygrain.operators.policy import money, policy_reasons


def _none() -> Column:
    return F.array().cast("array<string>")


def _stage(name: str, result: Column, details: Column, reasons: Column) -> Column:
    return F.struct(
        F.lit(name).alias("stage"), result.alias("result"), details.alias("details"), reasons.alias("reasons")
    )


def _str(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: Column | str) -> Column:
    """Concatenate; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def exif_integrity(strict: bool = False) -> Column:
    photos, missing, edited = _n("n_photos"), _n("n_no_exif"), _n("n_edited")
    reasons = _list(
        F.when(missing > 0, _cat(missing, " photo(s) missing EXIF")),
        F.when(
            edited > 0,
            _cat("edit signature: ", F.col("software")),
        ),
    )
    bad = (edited > 0) | ((missing > 0) & F.lit(strict))
    result = F.when(photos == 0, "FAIL").when(bad, "FAIL").when(missing > 0, "WARN").otherwise("PASS")
    details = (
        F.when(photos == 0, "no photo evidence at all")
        .when(
            F.size(reasons) == 0, _cat(photos, " photo(s), ", _n("n_geotagged"), " geotagged, timestamps consistent")
        )
        .otherwise(F.array_join(reasons, " · "))
    )
    return _stage(
        "EXIF_INTEGRITY", result, details, F.when(photos == 0, F.array(F.lit("no photos"))).otherwise(reasons)
    )


def duplicate_phash() -> Column:
    """Expects n_dup, dup_shown (first collisions as text), n_inner, inner_shown (the same
    within the claim, for information only), n_hashes and n_foreign; the last may be null."""
    def listed(label: str, n: Column, shown: Column) -> Column:
        more = F.when(n > F.size(shown), _cat(" (+", n - F.size(shown), " more)")).otherwise("")
        return F.concat(F.lit(label), F.array_join(shown, "; "), more)

    hits, shown = _n("n_dup"), F.coalesce("dup_shown", _none())
    inner, inner_shown = _n("n_inner"), F.coalesce("inner_shown", _none())
    foreign = F.coalesce(F.concat(F.col("n_foreign").cast("string"), F.lit(" ")), F.lit(""))
    details = (
        F.when(hits > 0, listed("cross-claim collision: ", hits, shown))
        .when(inner > 0, listed("intra-claim duplicates: ", inner, inner_shown))
        .otherwise(_cat(_n("n_hashes"), " photo pHash(es) unique across ", foreign, "stored foreign photos"))
    )
    return _stage("DUPLICATE_PHASH", F.when(hits > 0, "FAIL").otherwise("PASS"), details, shown)


def ocr_extract() -> Column:
    docs, read = _n("n_docs"), _n("n_docs_read")
    bill = F.col("bill")
    found = F.array_join(
        F.array_compact(F.array(bill["policy_number"], bill["name"], bill["amount"].cast("string"))), " · "
    )
    result = F.when(docs == 0, "INFO").when(read == 0, "WARN").otherwise("PASS")
    details = (
        F.when(docs == 0, "no documents submitted — policy check skipped")
        .when(read == 0, _cat("OCR produced no text for ", docs, " document(s)"))
        .otherwise(
            _cat(
                read, "/", docs, " doc(s) read · fields: ", F.coalesce(found, F.lit("")), " · confidence ",
                F.format_number(F.coalesce(bill["confidence"], F.lit(0.0)), 2),
            )
        )
    )
    return _stage("OCR_EXTRACT", result, details, _none())


def paper_number() -> Column:
    return F.coalesce(F.col("paper.policy_number"), F.col("bill.policy_number"))


def policy_match() -> Column:
    """Expects the policy columns of ``with_policy`` joined on the paper number."""
    number = F.col("paper_number")
    name = F.coalesce(F.col("paper.insured_name"), F.col("bill.name"))
    insured = F.coalesce(F.col("paper.sum_insured"), F.col("bill.amount").cast("double"))
    nothing = number.isNull() & name.isNull() & insured.isNull()
    reasons = F.when(nothing, _none()).otherwise(
        policy_reasons(
            number, insured, F.col("bill.amount"), F.col("claimant_name"), F.col("amount_requested"), F.col("loss_type")
        )
    )
    result = F.when(nothing, "INFO").when(F.size(reasons) > 0, "FAIL").otherwise("PASS")
    details = (
        F.when(nothing, "no policy fields extracted — cannot cross-check")
        .when(F.size(reasons) > 0, F.array_join(reasons, " · "))
        .when(
            number.isNotNull(),
            _cat("verified: ", number, " covers ", F.col("loss_type"), " up to ", F.coalesce(money(insured), F.lit("₹10,000"))),
        )
        .otherwise("name/limit/loss-type within cover")
    )
    return _stage("POLICY_MATCH", result, details, reasons)


def doc_cross() -> Column:
    identity, paper = F.col("identity"), F.col("paper")
    total = _n("n_registry") + _n("n_aadhaar") + _n("n_policy")
    amount = F.col("amount_requested")
    has_card, has_deed = _n("n_aadhaar") > 0, _n("n_registry") > 0
    # unreadable papers by kind, in the order of each kind's first one; one reason per paper
    unread = F.array_sort(
        _list(
            *[
                F.when(
                    F.col(f"first_unread_{k}").isNotNull(),
                    F.struct(F.col(f"first_unread_{k}").alias("at"), F.lit(k).alias("kind"), _n(f"unread_{k}").cast("int").alias("n")),
                )
                for k in C.FARMER_DOCS
            ]
        )
    )
    unread_reasons = F.flatten(
        F.transform(
            unread,
            lambda u: F.array_repeat(_cat("R-DOC ", u["kind"], " could not be read (photo unclear or unsupported scan)"), u["n"]),
        )
    )
    no_deed = identity.isNull() & has_card & ~has_deed
    others = _list(
        F.when(
            identity.isNotNull() & has_card & has_deed & ~identity["inconclusive"] & ~identity["matched"],
            _cat("R-IDENTITY ", identity["detail"]),
        ),
        F.when(no_deed, F.lit("R-DOC registry missing: Aadhaar cannot be cross-verified against a land record")),
        F.when(
            amount > paper["sum_insured"] * 1.5,
            _cat(
                "R5 amount: claimed ", money(amount), " exceeds policy sum insured ", money(paper["sum_insured"]), " by >50%"
            ),
        ),
    )
    reasons = F.concat(unread_reasons, others)
    doubtful = F.coalesce(identity["inconclusive"], F.lit(False))
    result = (
        F.when(total == 0, "INFO").when(F.size(reasons) > 0, "FAIL").when(doubtful, "WARN").otherwise("PASS")
    )
    parts = []
    for k in C.FARMER_DOCS:
        doc = F.col(f"doc_{k}")
        looks = F.when(doc["role"] != k, _cat(", looks like ", doc["role"])).otherwise("")
        lang = F.when(doc["hindi"], "hindi").otherwise("english")
        parts.append(
            F.when(
                doc.isNotNull(),
                F.when(~doc["read"], _cat(k, ": UNREADABLE")).otherwise(
                    _cat(k, "(", lang, looks, ": ", doc["chars"], " chars)")
                ),
            )
        )
    parts.append(identity["detail"])
    parts.append(F.when(no_deed, F.lit("registry missing — identity cross-check impossible")))
    details = F.when(
        total == 0, "no farmer documents (registry/aadhaar/policy) submitted — identity cross-check skipped"
    ).otherwise(F.array_join(F.array_compact(F.array(*parts)), " · "))
    return _stage("DOC_CROSS", result, details, F.when(total == 0, _none()).otherwise(reasons))


def _by_loss(values: dict[str, Column]) -> Column:
    return reduce(
        lambda acc, loss: acc.when(F.col("loss_type") == loss, values[loss]),
        C.LOSS_TYPES[1:],
        F.when(F.col("loss_type") == C.LOSS_TYPES[0], values[C.LOSS_TYPES[0]]),
    )


def damage_assess() -> Column:
    """Keywords, relevance, remembered cases, staged and synthetic imagery, in that order.

    Expects shows_*, rel_* (best photo), staged, ai_gen, knn, knn_fraud and
    knn_matched; signals are null where no vector was given.
    """
    photos = _n("n_photos")
    hits = F.coalesce(_by_loss({loss: F.col(f"shows_{loss}") for loss in C.LOSS_TYPES}), F.lit(0))
    label = _by_loss({loss: F.lit(C.LOSS_META[loss]["label"]) for loss in C.LOSS_TYPES})
    rel = F.coalesce(_by_loss({loss: F.col(f"rel_{loss}") for loss in C.LOSS_TYPES}), F.lit(0))
    knn, fraud = F.col("knn"), _n("knn_fraud")
    staged, synthetic = F.col("staged"), F.col("ai_gen")
    severity = F.when(hits > 0, 70 + F.least(F.lit(20), hits * 10)).otherwise(35)

    off_topic = (hits == 0) & (rel > 0) & (rel < C.RELEVANCE_FLAG)
    on_topic = (hits == 0) & (rel >= C.RELEVANCE_PASS)
    known_fraud = (_n("knn") > 0) & (fraud >= C.KNN_FAIL)
    # result after each signal, in order
    r1 = F.when(hits > 0, "PASS").when(off_topic, "FAIL").when(on_topic, "PASS").otherwise("WARN")
    r2 = F.when(known_fraud, "FAIL").otherwise(r1)
    staged_fail = (staged >= C.STAGED_FAIL) & (r2 != "FAIL")
    r3 = F.when(staged_fail, "FAIL").when((staged >= C.STAGED_WARN) & (r2 == "PASS"), "WARN").otherwise(r2)
    r4 = (
        F.when(synthetic >= C.AIGEN_FAIL, "FAIL")
        .when((synthetic >= C.AIGEN_WARN) & (r3 == "PASS"), "WARN")
        .otherwise(r3)
    )
    result = F.when(photos == 0, "FAIL").otherwise(r4)

    reasons = _list(
        F.when((hits == 0) & ~on_topic, _cat("no ", label, " damage signal in any photo")),
        F.when(
            off_topic,
            _cat(
                "imagery does not depict ", label, " loss (loss-type relevance ", rel, f"% < {C.RELEVANCE_FLAG}%)"
            ),
        ),
        F.when(
            known_fraud,
            _cat(
                "trained fraud memory: ", fraud, "% of nearest decided claims were fraudulent (",
                F.array_join(F.coalesce("knn_matched", _none()), ", "), ")",
            ),
        ),
        F.when(
            staged_fail,
            _cat("zero-shot visual check: imagery resembles staged/re-photographed evidence (", staged, "%)"),
        ),
        F.when(synthetic >= C.AIGEN_FAIL, _cat("imagery appears AI-generated / synthetic (", synthetic, "%)")),
    )
    opening = (
        F.when(
            hits > 0,
            _cat("damage signal in ", hits, "/", photos, " photo(s) · severity ", severity, "/100 (", F.col("loss_type"), ")"),
        )
        .when(
            on_topic,
            _cat("visual ", label, " damage signal (relevance ", rel, "%) · severity ", severity, "/100 (", F.col("loss_type"), ")"),
        )
        .otherwise(_cat("no ", label, " damage vocabulary in photos · severity ", severity, "/100"))
    )
    signals = F.when(
        staged.isNull(), _cat(" · trained memory unavailable")
    ).otherwise(
        F.concat(
            F.when(_n("knn") > 0, _cat(" · trained memory: kNN fraud ", fraud, "% (k=", knn, ")")).otherwise(
                " · trained memory: empty"
            ),
            _cat(" · zero-shot staged-imagery ", staged, "%"),
            _cat(" · ai-generation ", synthetic, "%"),
        )
    )
    details = F.when(photos == 0, "no photos to assess").otherwise(
        F.concat(
            opening, F.when((rel > 0) & ~on_topic, _cat(" · loss-type relevance ", rel, "%")).otherwise(""), signals
        )
    )
    return _stage(
        "DAMAGE_ASSESS", result, details, F.when(photos == 0, F.array(F.lit("no photos"))).otherwise(reasons)
    )


def exaggeration() -> Column:
    """Reason when a stated flood loss is far from the measured one."""
    claimed, measured = F.col("destruction_pct_claimed"), F.col("satellite_pct")
    delta = F.abs(claimed - measured)
    return F.when(
        (F.col("loss_type") == "flood") & (delta > C.DELTA_FLAG),
        _cat(
            "R5 destruction-exaggeration: claimed ", claimed, "% but satellite imagery measures ", measured,
            "% (delta ", delta, f" pts > {C.DELTA_FLAG})",
        ),
    )


def fraud_rules(policy: Column) -> Column:
    """Policy reasons, exaggeration, then file reasons.

    Expects n_file_reasons and file_reasons (the first ones, in rule order).
    """
    shown = F.coalesce("file_reasons", _none())
    reasons = F.concat(policy["reasons"], _list(exaggeration()), shown)
    hidden = _n("n_file_reasons") - F.size(shown)
    details = F.when(F.size(reasons) == 0, "no fraud rule triggered").otherwise(
        F.concat(F.array_join(reasons, " · "), F.when(hidden > 0, _cat(" (+", hidden, " more)")).otherwise(""))
    )
    return _stage("FRAUD_RULES", F.when(F.size(reasons) > 0, "FAIL").otherwise("PASS"), details, reasons)


def stage_score(fails: Column, warns: Column) -> Column:
    return clamp(F.lit(100) - fails * C.FAIL_COST - warns * C.WARN_COST, 0, 100).cast("int")


def verdict(fails: Column, score: Column) -> Column:
    return (
        F.when((fails == 0) & (score >= C.APPROVE_AT), "AI_APPROVED")
        .when(score < C.REJECT_BELOW, "AI_REJECTED")
        .otherwise("AI_FLAGGED")
    )


def decision_reasons(fraud: Column, policy: Column, damage: Column, docs: Column) -> Column:
    return F.slice(F.array_distinct(F.concat(fraud, policy, damage, docs)), 1, C.REASONS_SHOWN)


def decision(score: Column, outcome: Column, reasons: Column) -> Column:
    tail = F.when(F.size(reasons) > 0, F.concat(F.lit(" · reasons: "), F.array_join(reasons, ", "))).otherwise("")
    return _stage("DECISION", outcome, F.concat(_cat("score ", score, " · ", outcome), tail), reasons)


def score_logs(stage_logs):
    """Score and verdict of every claim from long-format stage logs."""
    counted = F.col("stage") != "DECISION"
    fails = F.count_if(counted & (F.col("result") == "FAIL"))
    warns = F.count_if(counted & (F.col("result") == "WARN"))
    out = stage_logs.groupBy("claim_id").agg(fails.alias("fails"), warns.alias("warns"))
    return out.withColumn("score", stage_score(F.col("fails"), F.col("warns"))).withColumn(
        "verdict", verdict(F.col("fails"), F.col("score"))
    )
