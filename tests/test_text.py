import random

import pytest
from pyspark.sql import functions as F

from tallygrain.functions import extract as E, numeric as N, text as X
from tallygrain.functions.identity import with_identity


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("Roshan Pandey", "Pandey Roshan", 100),
        ("Roshan Pandey", "Roshan Srivastava", 50),
        ("Shri Ramesh Kumar", "Ramesh Kumar", 100),
        ("Li", "Li", 0),
        ("रोशन पांडेय", "Roshan Pandey", 100),
        ("Roshn Pandy", "Roshan Pandey", 100),
        ("Ram", "Raj", 100),
        ("Ramesh", "Mahesh", 100),
        ("Ramesh", "Suresh", 0),
        ("Anita", "Meera", 0),
    ],
)
def test_name_score(spark, a, b, score):
    assert one(spark, X.name_score(F.lit(a), F.lit(b))) == score


@pytest.mark.parametrize(
    "text, latin",
    [
        ("रोशन पांडेय", "roshana pandeya"),
        ("विक्रम", "vikrama"),
        ("औरंगाबाद", "aurangabada"),
        ("Ab-c_D.e/F1", "ab c d e f1"),
        ("Roshan\nPandey", "roshanpandey"),
        ("क़लम", "kalama"),
        ("ऩाम", "ama"),
        ("राम।श्याम", "rama shyama"),
        ("é ñ x", "x"),
    ],
)
def test_transliterate(spark, text, latin):
    assert one(spark, X.transliterate(F.lit(text))) == latin


@pytest.mark.parametrize("n, text", [(0, "0"), (999, "999"), (1000, "1,000"), (123456, "1,23,456"), (1234567, "12,34,567"), (-1234567, "-12,34,567")])
def test_indian_digits(spark, n, text):
    assert one(spark, X.indian_digits(F.lit(n))) == text


def test_half_up_goes_to_plus_infinity(spark):
    assert [one(spark, N.half_up(F.lit(x))) for x in (-2.5, -0.5, 0.5, 2.5)] == [-2, 0, 1, 3]


def test_hamming(spark):
    a = "01" * 32
    flipped = "1" + a[1:63] + "0"
    assert one(spark, N.hamming(F.lit(a), F.lit(flipped))) == 2
    assert one(spark, N.hamming(F.lit(a), F.lit(a[:63]))) == 64


def test_bill(spark):
    b = one(spark, E.bill(F.lit("policy MH-12-9931 insured: Ramesh Kumar claim amount 5,000.60")))
    assert (b.policy_number, b.name, b.amount, b.confidence) == ("MH-12-9931", "Ramesh Kumar claim", 5001, 1.0)
    empty = one(spark, E.bill(F.lit("nothing here")))
    assert (empty.policy_number, empty.name, empty.amount, empty.confidence) == (None, None, None, 0.0)
    # an amount out of range gives way to the second pattern
    assert one(spark, E.bill(F.lit("rs 99,99,99,999 total 450"))).amount == 450


def test_card_number_is_masked(spark):
    text = "GOVERNMENT OF INDIA\nName: Roshan Pandey\nDoB: 03/01/1995\nMALE\n५५२२ 6616 4533"
    c = one(spark, E.identity_card(F.lit(text)))
    assert (c.name, c.dob, c.aadhaar_masked, c.gender, c.confidence) == (
        "Roshan Pandey", "03/01/1995", "XXXX XXXX 4533", "male", 1.0,
    )
    assert one(spark, E.identity_card(F.lit("महिला"))).gender == "female"


def test_land_record(spark):
    text = "विक्रय विलेख\nक्रेता: रोशन पांडेय पुत्र राम\nजिला: नांदेड ग्राम: रामपुर\nखसरा संख्या 45/2 रकबा 2.5 हेक्टेयर\n12/03/2019 रू0 ५०,०००"
    d = one(spark, E.land_record(F.lit(text)))
    assert d.owner_name == "रोशन पांडेय" and d.deed_type == "विक्रय विलेख"
    assert d.khasra_no == "45/2" and d.area_hectares == "2.5 हेक्टेयर" and d.area_value == 50000.0
    assert d.execution_date == "12/03/2019" and d.confidence == 1.0
    assert one(spark, E.land_record(F.lit("s/o wo"))).owner_name is None


def test_policy_paper_reads_lines_first(spark):
    text = "Policy No: MH-12-9931\nInsured Name: Ramesh Kumar\nSum Insured: Rs 10,000\ncover flood and cattle"
    p = one(spark, E.policy_paper(F.lit(text)))
    assert (p.policy_number, p.insured_name, p.sum_insured) == ("MH-12-9931", "Ramesh Kumar", 10000.0)
    assert p.coverage == ["flood", "livestock"]


@pytest.mark.parametrize(
    "text, role",
    [
        ("GOVERNMENT OF INDIA dob", "aadhaar"),
        ("sale deed khasra", "registry"),
        ("policy premium sum insured", "policy"),
        ("nothing to see", None),
        ("female policy", "aadhaar"),  # female counts for male as well
    ],
)
def test_document_role(spark, text, role):
    assert one(spark, X.document_role(F.lit(text), F.lit("")))["role"] == role


def test_identity(spark):
    deed = "sale deed\nowner: Roshan Pandey 77"
    rows = spark.createDataFrame(
        [
            (1, "Roshan Pandey", None, deed),
            (2, "Roshan Srivastava", None, deed),
            (3, "Meera Joshi", None, deed),
            (4, None, None, deed),
            (5, "Roshan Pandey", None, "## torn page ##"),
            (6, None, "रोशन पांडेय", deed),
            (7, "Roshan Pandey", None, "## roshan"),
        ],
        "k int, n string, nd string, t string",
    )
    got = {r.k: r.identity for r in with_identity(rows, "n", "nd", "t").select("k", "identity").collect()}
    assert [got[k].matched for k in range(1, 8)] == [True, True, False, False, False, True, False]
    assert [got[k].inconclusive for k in range(1, 8)] == [False, False, False, True, True, False, True]
    assert [got[k].score for k in range(1, 8)] == [100, 50, 0, 0, 0, 100, 45]


def test_identity_finds_the_best_window_of_a_long_text(spark):
    filler = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(400))
    rows = spark.createDataFrame([("Devendra Singh", None, f"{filler} devendr sing {filler}")], "n string, nd string, t string")
    got = with_identity(rows, "n", "nd", "t").first()["identity"]
    assert got.matched and got.score == 100 and "devendr sing" in got.registry_name


def test_person_lines_are_looked_for_only_beside_a_marker(spark, monkeypatch):
    from tallygrain.functions import identity as I

    monkeypatch.setattr(I.P, "DEED_PERSON_LINES", "(Meera Joshi)")
    rows = spark.createDataFrame(
        [(1, "Meera Joshi", None, "Meera Joshi torn"), (2, "Meera Joshi", None, "Meera Joshi torn W/O page"), (3, "Meera Joshi", None, None)],
        "k int, n string, nd string, t string",
    )
    got = {r.k: r.identity for r in I.with_identity(rows, "n", "nd", "t").select("k", "identity").collect()}
    assert [got[k].registry_name for k in (1, 2, 3)] == ["meera joshi", "Meera Joshi", None]
    assert [got[k].score for k in (1, 2, 3)] == [100, 100, 0]


def test_letters_outside_devanagari(spark):
    rng = random.Random(5)
    signs = list("aZ09 -_./\t\n,'") + ["é", "İ", "\u212a", "\u200d", "\u00a0", "中", "₹"]
    texts = [rng.choice(["", " "]).join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    both = df.select(X.transliterate(F.col("t")).alias("a"), X._from_devanagari(F.col("t")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]


def test_anchors_change_no_field(spark, monkeypatch):
    from tallygrain.functions import extract as E, patterns as P

    words = sorted({w for ws in P.ANCHORS.values() for w in ws}) + [
        "Name: Ram Kumar", "DOB 01/02/1990", "1999-03-04", "9999 8888 7777", "oooo XXXX 1234", "राम कुमार\nRam", "FEMALE", "Male", "Owner: Sita Devi",
        "12 March 2020", "District: Pune", "Dist. Nanded", "Village Rampur", "Khasra no. 12/3", "area 2.5 hectare", "Rs. 45,000", "₹ 1,20,000", "1234567/-",
        "Policy No: AB/12/CD/3456", "MH-12-3456", "PMFBY/MH/2020-1", "Insured: Ram Kumar Sum Insured: 50,000", "Sum insured 1,000", "flood", "पशु", "Mr. Ram Kumar",
        "Total: 4,500", "certificate # AB-1234", "प्रथम पक्ष: सीता देवी निवासी", "पुत्र राम लाल", "UTTAR PRADESH", "\n", " ", "K", "ſ",
    ]
    rng = random.Random(4)
    texts = ["", None] + words + [rng.choice([" ", "\n", ""]).join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(400)]
    texts += [t.upper() for t in texts[2:200]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).cache()
    parsers = [E.identity_card, E.land_record, E.land_record_owner, E.policy_paper, E.bill]

    def fields():
        return sorted(map(str, df.select("t", *[p(F.col("t")).alias(p.__name__) for p in parsers]).collect()))

    gated = fields()
    monkeypatch.setattr(E, "_worth", lambda s, pattern: F.lit(True))
    assert gated == fields()
