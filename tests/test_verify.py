"""Whole runs over small planted stories."""

from pyspark.sql import functions as F

from tallygrain import constants as C
from tallygrain.plans import explain as EP, verify as VP
from tallygrain.schemas import CLAIMS, EVIDENCE, IMAGE_VECTORS, MEMORY, OCR_TEXT, POLICIES, PROMPT_VECTORS
import datetime as dt

T0 = dt.datetime(2024, 6, 1, 12, 0)


def claim(i, name, loss, amount, minutes, pct=None):
    return (i, name, loss, amount, "SUBMITTED", None, pct, T0 + dt.timedelta(minutes=minutes), None, None, None, None, None, None)


def file(fid, cid, seq, kind, minutes, p_hash=None, exif=(False, None, None, None, None)):
    return (fid, cid, seq, kind, f"{fid}.jpg", "image/jpeg", 1, "0x" + fid, p_hash, exif, T0 + dt.timedelta(minutes=minutes))


def tables(spark, claims, evidence, texts, vectors=(), memory=()):
    return VP.ClaimTables(
        spark.createDataFrame(claims, CLAIMS),
        spark.createDataFrame(evidence, EVIDENCE),
        spark.createDataFrame([(f, t, any("ऀ" <= c <= "ॿ" for c in t)) for f, t in texts], OCR_TEXT),
        spark.createDataFrame(list(vectors), IMAGE_VECTORS),
        spark.createDataFrame([], PROMPT_VECTORS),
        spark.createDataFrame(list(memory), MEMORY),
        spark.createDataFrame(C.POLICIES, POLICIES),
    )


def logs(runs):
    return {(r.claim_id, r.stage): r for r in VP.stage_logs(runs).collect()}


PADDY, PADDY2 = "01" * 32, "0011" * 16


def story(spark):
    paddy, soy, maize = (PADDY, PADDY2), ("0" * 32 + "1" * 32, "1" * 32 + "0" * 32), ("000111" * 10 + "0000",)
    claims, evidence, texts = [], [], []
    for cid, name, loss, amount, minutes, pics, number, word in [
        ("CLM-4102", "Vitthal Rao", "flood", 7800, 0, paddy, "MH-31-2255", "flooded paddy field"),
        ("CLM-8920", "Ramesh Kumar", "flood", 6500, 500, soy, "MH-12-9931", "waterlogged soybean"),
        ("CLM-8919", "Devendra Singh", "flood", 9200, 900, paddy, "MH-27-4102", "flooded paddy field"),
        ("CLM-8930", "Sunita Pawar", "drought", 4300, 990, maize, None, "drought cracked maize"),
    ]:
        claims.append(claim(cid, name, loss, amount, minutes))
        for i, h in enumerate(pics):
            evidence.append(file(f"{cid}-p{i}", cid, i, "photo", minutes, h))
            texts.append((f"{cid}-p{i}", word))
        if number:
            evidence.append(file(f"{cid}-b", cid, 9, "bill", minutes))
            texts.append((f"{cid}-b", f"policy {number} insured {name} claim amount {amount}"))
    return tables(spark, claims, evidence, texts)


def test_seed_story(spark):
    runs = VP.verify_claims(story(spark)).cache()
    got, by_stage = {r.claim_id: r for r in runs.collect()}, logs(runs)
    assert got["CLM-8919"].verdict == "AI_FLAGGED"
    assert by_stage["CLM-8919", "DUPLICATE_PHASH"].result == "FAIL" == by_stage["CLM-8919", "FRAUD_RULES"].result
    assert by_stage["CLM-4102", "DUPLICATE_PHASH"].result == "PASS" == by_stage["CLM-4102", "FRAUD_RULES"].result
    assert {got[c].verdict for c in ("CLM-4102", "CLM-8920", "CLM-8930")} == {"AI_APPROVED"}
    # photos without EXIF warn: 100 - 12; the duplicate costs two stages
    assert (got["CLM-4102"].score, got["CLM-8919"].score) == (88, 38)
    assert by_stage["CLM-8930", "OCR_EXTRACT"].result == "INFO"
    assert "R2 duplicate-evidence: CLM-8919-p0 matches archived CLM-4102/CLM-4102-p0" in got["CLM-8919"].reasons
    assert [s.stage for s in got["CLM-4102"].stages] == C.STAGES


def test_strict_exif_fails_and_text_is_built_in_both_languages(spark):
    runs = VP.verify_claims(story(spark), strict_exif=True).cache()
    assert logs(runs)["CLM-4102", "EXIF_INTEGRITY"].result == "FAIL"
    english = {r.claim_id: r.explanation for r in EP.explain_runs(runs).collect()}
    hindi = {r.claim_id: r.explanation for r in EP.explain_runs(runs, "hi").collect()}
    assert english["CLM-4102"].startswith("Held for human review: 1 warning sign was found on Vitthal Rao's flood claim of ₹7,800.")
    assert "• Photo metadata: 2 photo(s) missing EXIF" in english["CLM-4102"]
    assert "• Document evidence:\n  → Identity check inconclusive" in english["CLM-4102"]
    assert "3 warning signs were found" in english["CLM-8919"] and "मानव समीक्षा" in hindi["CLM-4102"]


CARD = "GOVERNMENT OF INDIA\nName: Roshan Pandey\nDoB: 03/01/1995\nMALE\n5522 6616 4533"


DEEDS = {
    "same": ("sale deed khasra\nowner: Roshan Pandey 7", "PASS", None),
    "other": ("sale deed khasra\nowner: Meera Joshi 7", "FAIL", "R-IDENTITY"),
    "torn": ("## ## blurred", "WARN", None),
    "blank": ("", "FAIL", "R-DOC registry could not be read"),
    "none": (None, "FAIL", "R-DOC registry missing"),
}


def test_papers(spark):
    evidence, texts, claims = [], [], []
    for k, (deed, _, _) in DEEDS.items():
        claims.append(claim(k, "Roshan Pandey", "flood", 100, 0))
        evidence += [file(f"{k}-p", k, 0, "photo", 0), file(f"{k}-a", k, 1, "aadhaar", 0)]
        texts += [(f"{k}-a", CARD), (f"{k}-p", "flood")]
        if deed is not None:
            evidence.append(file(f"{k}-r", k, 2, "registry", 0))
            texts.append((f"{k}-r", deed))
    runs = VP.verify_claims(tables(spark, claims, evidence, texts)).cache()
    rows, found = logs(runs), {r.claim_id: r.summary for r in runs.collect()}
    for k, (deed, result, reason) in DEEDS.items():
        row = rows[k, "DOC_CROSS"]
        assert row.result == result, k
        assert (not row.reasons) if reason is None else any(r.startswith(reason) for r in row.reasons)
        assert found[k].aadhaar.aadhaar_masked == "XXXX XXXX 4533" and found[k].registry.found == (deed is not None)
        # farmer papers alone leave the plain document reading without text
        assert rows[k, "OCR_EXTRACT"].result == "WARN"


def test_policy_reasons_cost_two_stages_and_come_first(spark):
    evidence = [file("p", "A", 0, "photo", 0, exif=(True, None, None, None, None)), file("b", "A", 1, "bill", 0), file("b2", "A", 2, "bill", 0)]
    texts = [("p", "cattle"), ("b", "policy MH-22-7789 insured: X Y"), ("b2", "policy MH-12-9931 insured: Ramesh Kumar bill total 99000")]
    runs = VP.verify_claims(tables(spark, [claim("A", "Someone Else", "livestock", 20000, 0)], evidence, texts))
    run = runs.first()
    # the last bill counts
    assert run.reasons == [
        "name mismatch: policy=Ramesh Kumar vs claim=Someone Else", "amount ₹20000 exceeds policy limit ₹10000",
        "loss type livestock not covered by MH-12-9931", "bill amount ₹99000 far exceeds requested ₹20000",
    ]
    assert (run.score, run.verdict) == (50, "AI_FLAGGED")


def test_claim_without_files(spark):
    run = VP.verify_claims(tables(spark, [claim("A", "N", "flood", 1, 0)], [], [])).first()
    results = {s.stage: s.result for s in run.stages}
    assert results["EXIF_INTEGRITY"] == results["DAMAGE_ASSESS"] == "FAIL" and run.verdict == "AI_FLAGGED"


def test_no_fail_means_approved_and_runs_repeat(spark):
    tables = story(spark)
    first = VP.verify_claims(tables).collect()
    for r in first:
        fails = sum(s.result == "FAIL" for s in r.stages)
        assert (fails == 0) == (r.verdict == "AI_APPROVED")
    assert {r.claim_id: r.run_digest for r in first} == {
        r.claim_id: r.run_digest for r in VP.verify_claims(tables).collect()
    }


def test_all_outputs_of_a_batch(spark):
    out = VP.verification(story(spark))
    assert out.runs.count() == 4 and out.logs.count() == 4 * len(C.STAGES)
    assert {(r.claim_id, r.file_id, r.rule) for r in out.reasons.collect()} == {("CLM-8919", f"CLM-8919-p{i}", 2) for i in range(2)}
    assert out.similar.collect() == []


def test_duplicate_stage_names_copies_within_a_claim_and_counts(spark):
    near = "10" + PADDY[2:]
    claims = [claim("CLM-1", "Ram Rao", "flood", 100, 0), claim("CLM-2", "Sita Rao", "flood", 100, 10)]
    evidence = [file("a", "CLM-1", 0, "photo", 0, PADDY), file("b", "CLM-1", 1, "photo", 0, PADDY), file("c", "CLM-1", 2, "photo", 0, near),
                file("d", "CLM-2", 0, "photo", 10, "0" * 64)]
    found = logs(VP.verify_claims(tables(spark, claims, evidence, [])))
    assert found["CLM-1", "DUPLICATE_PHASH"].details == "intra-claim duplicates: a≈b (d=0); a≈c (d=2)"
    assert found["CLM-1", "DUPLICATE_PHASH"].result == "PASS"
    assert found["CLM-2", "DUPLICATE_PHASH"].details == "1 photo pHash(es) unique across 3 stored foreign photos"


def test_images_and_pictures_are_settled_before_the_texts(spark):
    """The last job joins small tables; vectors are not scored and shuffled beside the texts."""
    plan = VP.verify_claims(story(spark))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
