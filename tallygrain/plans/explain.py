"""Plain-language explanation of a run, in English or Hindi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.text import indian_digits, let

# fixed values: wording.  {name}, {loss}, {amount} and {n} are filled per run.
STAGE_LABELS = {
    "en": {
        "EXIF_INTEGRITY": "Photo metadata",
        "DUPLICATE_PHASH": "Duplicate-image check",
        "OCR_EXTRACT": "Document reading",
        "POLICY_MATCH": "Policy cross-check",
        "DOC_CROSS": "Aadhaar–registry–policy cross-verification",
        "DAMAGE_ASSESS": "Damage assessment",
        "FRAUD_RULES": "Fraud rules",
    },
    "hi": {
        "EXIF_INTEGRITY": "फ़ोटो मेटाडेटा",
        "DUPLICATE_PHASH": "डुप्लिकेट-तस्वीर जाँच",
        "OCR_EXTRACT": "दस्तावेज़ पढ़ाई",
        "POLICY_MATCH": "पॉलिसी क्रॉस-जाँच",
        "DOC_CROSS": "आधार–रजिस्ट्री–पॉलिसी क्रॉस-जाँच",
        "DAMAGE_ASSESS": "क्षति आकलन",
        "FRAUD_RULES": "फ़्रॉड नियम",
    },
}
LOSS_LABELS = {
    "en": {"flood": "flood", "drought": "drought", "livestock": "livestock"},
    "hi": {"flood": "बाढ़", "drought": "सूखा", "livestock": "पशुधन"},
}
OPENERS = {
    "en": {
        "AI_APPROVED": "Verified automatically: all checks passed on {name}'s {loss} claim of {amount}. "
        "The evidence is consistent and no fraud signal was found.",
        "AI_FLAGGED": "Held for human review: {n} on {name}'s {loss} claim of {amount}.",
        "AI_REJECTED": "Not approved automatically: the evidence submitted for {name}'s {loss} claim does not "
        "demonstrate the claimed loss.",
    },
    "hi": {
        "AI_APPROVED": "स्वचालित रूप से सत्यापित: {name} के {loss} के दावे ({amount}) की सभी जाँचें सफल रहीं। "
        "सबूत संगत हैं और कोई फ़्रॉड संकेत नहीं मिला।",
        "AI_FLAGGED": "मानव समीक्षा के लिए रोका गया: {name} के {loss} के दावे ({amount}) में {n}।",
        "AI_REJECTED": "स्वचालित रूप से स्वीकृत नहीं: {name} के {loss} के दावे के सबूत बताई गई हानि को पुष्ट नहीं करते।",
    },
}
PROBLEMS = {
    "en": ("{k} warning sign was found", "{k} warning signs were found", "the verification score fell in the grey zone"),
    "hi": ("{k} चेतावनी संकेत मिले", "{k} चेतावनी संकेत मिले", "सत्यापन स्कोर संदिग्ध क्षेत्र में रहा"),
}
NEXT_STEPS = {
    "en": {
        "AI_APPROVED": "Next step: this claim is payout-unlocked. Paying {amount} via UPI will be sealed on-chain as "
        "the final record.",
        "AI_FLAGGED": "Next step: this claim is locked — flagged claims cannot be paid until a claims officer reviews "
        "the evidence and approves or rejects it. That decision will be sealed on-chain.",
        "AI_REJECTED": "Next step: the claimant may request a human appeal. A rejected claim can only be overturned by "
        "a reviewed human decision, sealed on-chain.",
    },
    "hi": {
        "AI_APPROVED": "अगला कदम: यह दावा भुगतान के लिए खुला है। {amount} का UPI भुगतान अंतिम रिकॉर्ड के रूप में चेन पर "
        "सील किया जाएगा।",
        "AI_FLAGGED": "अगला कदम: यह दावा लॉक है — जब तक कोई अधिकारी सबूत देखकर स्वीकृत या अस्वीकृत नहीं करता, तब तक "
        "चिह्नित दावे का भुगतान नहीं हो सकता। वह निर्णय चेन पर सील किया जाएगा।",
        "AI_REJECTED": "अगला कदम: दावेदार मानव अपील मांग सकता है। अस्वीकृत दावा केवल समीक्षित मानव निर्णय से बदला जा "
        "सकता है, जो चेन पर सील होगा।",
    },
}
FOUND = {"en": "What the AI found:", "hi": "AI को क्या मिला:"}
EVIDENCE = {"en": "• Document evidence:", "hi": "• दस्तावेज़ प्रमाण:"}


def _fill(template: str, **values: Column) -> Column:
    """A template with columns for its {fields}."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        field, rest = rest.split("}", 1)
        parts += [F.lit(head), values[field].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _choose(key: Column, options: dict[str, Column]) -> Column:
    out = None
    for name, value in options.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def _say(lang: str, en: str, hi: str, **values: Column) -> Column:
    return _fill(hi if lang == "hi" else en, **values)


def document_facts(lang: str) -> Column:
    """Lines of document evidence from the run's ``summary``."""
    d = F.col("summary")
    reg, card, cross, paper, sat = (
        d["registry"], d["aadhaar"], d["identity_cross"], d["policy"], d["satellite"],
    )
    parts = F.array_compact(
        F.array(
            reg["deed_type"],
            _say(lang, "district {v}", "जिला {v}", v=reg["district"]),
            _say(lang, "village {v}", "गाँव {v}", v=reg["village"]),
            _say(lang, "Khasra/Plot #{v}", "खसरा नं० {v}", v=reg["khasra_no"]),
            _say(lang, "area {v}", "रकबा {v}", v=reg["area_hectares"]),
            reg["state"],
        )
    )
    registry = F.when(
        reg["found"],
        let(
            parts,
            lambda p: F.when(
                F.size(p) > 0, F.concat(F.lit("रजिस्ट्री: " if lang == "hi" else "Registry: "), F.array_join(p, ", "))
            ).otherwise(_say(lang, "Registry read ({v})", "रजिस्ट्री पठित ({v})", v=F.coalesce(reg["language"], F.lit("mixed")))),
        ),
    )
    holder = F.coalesce(card["name"], card["name_devanagari"])
    masked = F.when(card["aadhaar_masked"].isNotNull(), F.concat(F.lit(" ("), card["aadhaar_masked"], F.lit(")"))).otherwise("")
    aadhaar = F.when(card["found"], _say(lang, "Aadhaar: {v}{m}", "आधार: {v}{m}", v=holder, m=masked))
    matched = F.array_join(
        F.array_compact(
            F.array(
                _say(lang, "Identity verified at {s}%", "पहचान सत्यापित {s}%", s=cross["score"]),
                _say(
                    lang,
                    'Aadhaar "{a}" matched registry "{r}"',
                    '"{a}" ↔ "{r}"',
                    a=F.trim(cross["aadhaar_name"]),
                    r=cross["registry_name"],
                ),
                _say(lang, "(transliterated: {t})", "(लिप्यंतरण: {t})", t=cross["transliterated"]),
            )
        ),
        " · ",
    )
    identity = (
        F.when(cross["matched"], matched)
        .when(
            cross["inconclusive"],
            F.lit(
                "पहचान अनिर्णीत — दस्तावेज़ अपठनीय" if lang == "hi" else "Identity check inconclusive — document unreadable"
            ),
        )
        .when(
            cross["score"] > 0,
            _say(lang, "Identity mismatch (best score {s}%)", "पहचान मेल नहीं खाता ({s}%)", s=cross["score"]),
        )
    )
    policy = F.when(
        paper["policy_number"].isNotNull(),
        F.array_join(
            F.array_compact(
                F.array(
                    F.concat(F.lit("Policy "), paper["policy_number"]),
                    F.when(
                        paper["sum_insured"] > 0,
                        _say(lang, "sum insured ₹{v}", "बीमा राशि ₹{v}", v=indian_digits(paper["sum_insured"])),
                    ),
                    _say(lang, "insured: {v}", "बीमाधारक {v}", v=paper["insured_name"]),
                    F.when(
                        F.size(paper["coverage"]) > 0, F.concat(F.lit("covers: "), F.array_join(paper["coverage"], ", "))
                    ),
                )
            ),
            " · ",
        ),
    )
    satellite = F.when(
        sat["found"],
        _say(
            lang,
            "Satellite (uploaded imagery): {p}% destruction (rung: {r})",
            "उपग्रह (अपलोड की गई इमेजरी): {p}% विनाश (स्तर: {r})",
            p=sat["destruction_pct"],
            r=F.coalesce(sat["rung"], F.lit("?")),
        ),
    )
    compared = _say(
        lang,
        "Claimed {c}% vs measured {m}% (Δ {d} pts)",
        "दावा किया {c}% बनाम मापा {m}% (Δ {d} pts)",
        c=d["claimed_pct"],
        m=sat["destruction_pct"],
        d=d["pct_delta"],
    )
    return F.array_compact(F.array(registry, aadhaar, identity, policy, satellite, compared))


def explanation(lang: str = "en") -> Column:
    """Text for a run row: verdict, claimant, loss_type, amount_requested, stages, summary."""
    verdict, name = F.col("verdict"), F.col("claimant_name")
    amount = F.concat(F.lit("₹"), indian_digits(F.col("amount_requested")))
    loss = _choose(F.col("loss_type"), {k: F.lit(v) for k, v in LOSS_LABELS[lang].items()})
    problems = F.filter("stages", lambda s: (s["stage"] != "DECISION") & s["result"].isin("FAIL", "WARN"))
    one, many, none = PROBLEMS[lang]

    def counted(k: Column) -> Column:
        return F.when(k == 1, _fill(one, k=k)).when(k > 1, _fill(many, k=k)).otherwise(none)

    opener = _choose(
        verdict,
        {v: _fill(t, name=name, loss=loss, amount=amount, n=counted(F.size(problems))) for v, t in OPENERS[lang].items()},
    )
    label = lambda s: F.coalesce(
        _choose(s["stage"], {k: F.lit(v) for k, v in STAGE_LABELS[lang].items()}), s["stage"]
    )
    found = let(
        problems,
        lambda p: F.when(
            F.size(p) > 0,
            F.concat(
                F.array(F.lit(FOUND[lang])),
                F.transform(
                    F.slice(p, 1, C.REASONS_SHOWN), lambda s: F.concat(F.lit("• "), label(s), F.lit(": "), s["details"])
                ),
            ),
        ),
    )
    facts = let(
        document_facts(lang),
        lambda f: F.when(
            F.size(f) > 0,
            F.concat(F.array(F.lit(EVIDENCE[lang])), F.transform(f, lambda x: F.concat(F.lit("  → "), x))),
        ),
    )
    nothing = F.array().cast("array<string>")
    closing = _choose(verdict, {v: _fill(t, amount=amount) for v, t in NEXT_STEPS[lang].items()})
    return F.array_join(
        F.concat(F.array(opener), F.coalesce(facts, nothing), F.coalesce(found, nothing), F.array(closing)), "\n"
    )


def explain_runs(runs: DataFrame, lang: str = "en") -> DataFrame:
    return runs.select("claim_id", "verdict", explanation(lang).alias("explanation"))
