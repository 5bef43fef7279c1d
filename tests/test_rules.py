import pytest
from pyspark.sql import functions as F

from tallygrain.operators import geo, guard, kpi, policy, stages as S
from tallygrain.operators.guard import judge

SCORES = [
    (0, 0, 100, "AI_APPROVED"), (0, 4, 52, "AI_APPROVED"), (1, 0, 75, "AI_FLAGGED"), (2, 2, 26, "AI_FLAGGED"),
    (2, 3, 14, "AI_REJECTED"), (3, 0, 25, "AI_FLAGGED"), (3, 1, 13, "AI_REJECTED"), (4, 0, 0, "AI_REJECTED"),
]
GUARD = [
    ("AI_FLAGGED", "AI_APPROVED", 30, "AI_VERDICTS_ARE_COMPUTED"), ("AI_FLAGGED", "PAID", 30, "USE_PAY_ENDPOINT"),
    ("PAID", "HUMAN_APPROVED", 30, "TERMINAL_STATE"), ("AI_FLAGGED", "HUMAN_APPROVED", 14, "REASON_TOO_SHORT"),
    ("AI_FLAGGED", "HUMAN_APPROVED", 20, "OK"), ("AI_FLAGGED", "HUMAN_REVIEW", 30, "INVALID_TRANSITION"),
    ("AI_REJECTED", "HUMAN_REVIEW", 1, "OK"), ("AI_REJECTED", "NONSENSE", 30, "INVALID_TRANSITION"),
]


def test_score_and_verdict(spark):
    rows = spark.createDataFrame([(f, w) for f, w, _, _ in SCORES], "f int, w int").withColumn("s", S.stage_score(F.col("f"), F.col("w")))
    got = {(r.f, r.w): (r.s, r.v) for r in rows.withColumn("v", S.verdict(F.col("f"), F.col("s"))).collect()}
    assert got == {(f, w): (s, v) for f, w, s, v in SCORES}


def test_transition_guard(spark):
    rows = spark.createDataFrame([(c, n, "x" * k) for c, n, k, _ in GUARD], "c string, n string, note string")
    got = [r.v for r in rows.select(guard.transition_code(F.col("c"), F.col("n"), F.col("note")).alias("v")).collect()]
    assert got == [g[3] for g in GUARD]
    assert [judge(c, "human", n, "x" * k) for c, n, k, _ in GUARD] == got


@pytest.mark.parametrize("status, code", [("AI_FLAGGED", "FLAGGED_LOCKED"), ("SUBMITTED", "INVALID_STATE"), ("HUMAN_APPROVED", "OK")])
def test_payout(spark, status, code):
    assert spark.range(1).select(guard.payout_code(F.lit(status)).alias("v")).first().v == code
    assert judge(status, "pay", "PAID", None) == code


def test_geography(spark):
    # north of Yavatmal by a number of degrees; 1 degree is about 111.2 km
    points = [(1, 19.8697, 77.3091), (2, 20.7002, 77.0082), (3, 15.0, 77.3), (4, 17.6599, 74.95)]
    rows = spark.createDataFrame(points, "k int, lat double, lon double")
    got = {r.k: r for r in geo.with_district(rows, F.col("lat"), F.col("lon")).collect()}
    assert (got[1].resolved, got[1].nearest_km) == ("yavatmal", 0)
    assert got[2].resolved == "akola" and got[3].out_of_area
    assert got[4].resolved is None and not got[4].out_of_area and got[4].nearest_km > 80
    evidence = rows.select(
        F.lit("C").alias("claim_id"), F.col("k").cast("string").alias("file_id"), F.col("k").alias("seq"), F.lit("photo").alias("kind"),
        F.struct(F.struct("lat", "lon").alias("gps")).alias("exif"),
    )
    claims = spark.createDataFrame([("C", "flood")], "id string, loss_type string")
    reasons = {r.file_id: r.reason.split(":")[0] for r in geo.geo_reasons(evidence, claims).collect()}
    assert reasons == {"2": "R4 district-mismatch", "3": "R4 gps-out-of-area", "4": "R4 gps-unresolved"}


def test_upper_median(spark):
    def median(values):
        return spark.createDataFrame([(v,) for v in values], "d int").agg(kpi.upper_median("d").alias("m")).first().m

    assert median([1, 2, 3, 4]) == 3 and median([7]) == 7 and median([]) is None


def test_policy_holder_compare(spark):
    f = lambda h, c: spark.range(1).select(policy.holder_differs(F.lit(h), F.lit(c)).alias("v")).first().v
    assert not f("Ramesh Kumar", "RAMESH KUMAR") and f("Ramesh Kumar", "Ramesh") and not f("Generic Farmer Policy", "Anyone")


DAMAGE = [
    # shows, relevance, knn, fraud, staged, synthetic -> result
    (1, 10, 5, 0, 10, 10, "PASS"), (0, 0, 5, 0, 10, 10, "WARN"), (0, 49, 5, 0, 10, 10, "FAIL"), (0, 64, 5, 0, 10, 10, "WARN"),
    (0, 65, 5, 0, 10, 10, "PASS"), (1, 0, 5, 60, 10, 10, "FAIL"), (1, 0, 5, 40, 55, 10, "WARN"), (1, 0, 5, 40, 75, 10, "FAIL"),
    (1, 0, 5, 0, 10, 78, "WARN"), (1, 0, 5, 0, 10, 88, "FAIL"), (0, 60, 5, 0, 60, 80, "WARN"), (1, 0, None, None, None, None, "PASS"),
]


def test_damage_signals_in_order(spark):
    rows = spark.createDataFrame(
        [(i, "flood", 2, *d[:6]) for i, d in enumerate(DAMAGE)],
        "i int, loss_type string, n_photos int, shows_flood int, rel_flood int, knn int, knn_fraud int, staged int, ai_gen int",
    )
    for other in ("drought", "livestock"):
        rows = rows.withColumns({f"shows_{other}": F.lit(0), f"rel_{other}": F.lit(0)})
    rows = rows.withColumn("knn_matched", F.array(F.lit("a")))
    got = [r.v for r in rows.orderBy("i").select("i", S.damage_assess()["result"].alias("v")).orderBy("i").collect()]
    assert got == [d[6] for d in DAMAGE]
