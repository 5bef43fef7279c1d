import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrain.operators import memory as ME, vectors as VE

MEM = "claim_id string, file_id string, label string, source string, vec array<float>, t long, seq long"


def memory(spark, rows):
    df = spark.createDataFrame([(c, f"m{i}", lab, "pipeline", v, t, i) for i, (c, lab, v, t) in enumerate(rows)], MEM)
    return df.withColumn("at", F.timestamp_seconds("t")).drop("t")


def queries(spark, rows):
    df = spark.createDataFrame([(c, f"q{i}", 1, v, t) for i, (c, v, t) in enumerate(rows)], "claim_id string, file_id string, seq int, vec array<float>, t long")
    return df.withColumn("run_at", F.timestamp_seconds("t")).drop("t")


def unit(rng, n=8):
    v = rng.normal(size=n)
    return [float(x) for x in v / np.linalg.norm(v)]


@pytest.mark.parametrize("exclude_self", [True, False])
def test_votes_equal_brute_force(spark, exclude_self):
    rng = np.random.default_rng(5)
    mem = [(f"C{i % 7}", "fraud" if i % 3 == 0 else "genuine", unit(rng), int(rng.integers(100))) for i in range(40)]
    ask = [(f"C{i % 9}", unit(rng), int(rng.integers(100))) for i in range(25)]
    got = {r.file_id: r for r in VE.knn_votes(queries(spark, ask), memory(spark, mem), exclude_self=exclude_self).collect()}
    for i, (claim, vec, t) in enumerate(ask):
        pool = [
            (-float(np.dot(np.float32(vec).astype(float), np.float32(v).astype(float))), j, c, lab)
            for j, (c, lab, v, at) in enumerate(mem)
            if at < t and not (exclude_self and c == claim)
        ]
        best = sorted(pool)[:5]
        row = got[f"q{i}"]
        assert row.knn == len(best)
        assert [m.claim_id for m in row.matches] == [b[2] for b in best]
        assert row.fraud_score == math.floor(100 * sum(b[3] == "fraud" for b in best) / max(1, len(best)) + 0.5)


def test_ties_go_to_the_earlier_enrolment_and_empty_memory_scores_zero(spark):
    v = [1.0, 0.0]
    mem = [(f"C{i}", "fraud" if i < 3 else "genuine", v, 1) for i in range(8)]
    row = VE.knn_votes(queries(spark, [("Q", v, 5)]), memory(spark, mem)).first()
    assert [m.claim_id for m in row.matches] == ["C0", "C1", "C2", "C3", "C4"] and row.fraud_score == 60
    none = VE.knn_votes(queries(spark, [("Q", v, 5)]), memory(spark, mem).limit(0)).first()
    assert (none.fraud_score, none.knn, none.matches) == (0, 0, [])


def test_cap_applies_as_of_each_run(spark):
    """1 200 remembered vectors: a run after the 100th sees those before it, a late one the newest 500 of a label."""
    rng = np.random.default_rng(3)
    mem = [(f"C{i}", "fraud" if i % 4 else "genuine", unit(rng, 4), i // 3) for i in range(1200)]
    ask = [(f"Q{i}", unit(rng, 4), t) for i, t in enumerate([0, 1, 33, 34, 150, 222, 223, 399, 400, 10_000, None])]
    for cap in (7, 500):
        got = {r.file_id: r for r in VE.knn_votes(queries(spark, ask), memory(spark, mem), per_label=cap).collect()}
        for i, (_, vec, t) in enumerate(ask):
            pool = []
            for label in ("fraud", "genuine"):
                own = [j for j, m in enumerate(mem) if m[1] == label and (t is None or m[3] < t)]
                pool += own[-cap:]
            best = sorted(pool, key=lambda j: (-float(np.dot(np.float32(vec).astype(float), np.float32(mem[j][2]).astype(float))), j))[:5]
            assert [m.claim_id for m in got[f"q{i}"].matches] == [f"C{j}" for j in best], (cap, t)


def test_busy_epochs_are_split(spark, monkeypatch):
    monkeypatch.setattr(VE, "EPOCH_QUERIES", 3)
    test_cap_applies_as_of_each_run(spark)


def test_cap_and_upsert(spark):
    old = memory(spark, [(f"C{i}", "fraud", [1.0], i) for i in range(6)])
    assert {r.claim_id for r in ME.cap_memory(old, 2).collect()} == {"C4", "C5"}
    new = memory(spark, [("C5", "genuine", [2.0], 50), ("C9", "genuine", [2.0], 51), ("C9", "genuine", [3.0], 52)])
    new = new.withColumn("batch", F.when(F.col("seq") == 1, 0).otherwise(1))
    got = {(r.claim_id, r.label, r.vec[0]) for r in ME.upsert_memory(old, new, 3).collect()}
    assert got == {("C5", "genuine", 2.0), ("C9", "genuine", 3.0), ("C2", "fraud", 1.0), ("C3", "fraud", 1.0), ("C4", "fraud", 1.0)}


def prompts(spark):
    rows, pos = [], 0
    for signal, loss in [("staged", None), ("ai_gen", None)] + [("relevance", x) for x in ("flood", "drought", "livestock")]:
        for side, v in (("pos", [1.0, 0.0, 0.0]), ("neg", [0.0, 1.0, 0.0])):
            rows.append((pos, signal, loss, side, None, None, v))
            pos += 1
    for i, rung in enumerate(["intact", "wet", "waterlogged", "submerged", "heavy", "severe"]):
        rows.append((pos + i, "ladder", None, "pos", rung, 0, [0.0, 0.0, 1.0 if rung == "heavy" else 0.0]))
    rows.append((pos + 6, "flooded", None, "pos", None, 0, [0.0, 1.0, 0.0]))
    return spark.createDataFrame(rows, "pos int, signal string, loss_type string, side string, rung string, weight int, vec array<float>")


def test_prompt_margins_and_ladder(spark):
    images = spark.createDataFrame(
        [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0])], "file_id string, vec array<float>"
    )
    got = {r.file_id: r for r in VE.prompt_scores(images, prompts(spark)).collect()}
    assert [got[k].staged for k in "abc"] == [100, 0, 50] and got["a"].rel_drought == 100
    assert got["c"].rung == "heavy" and got["c"].destruction_pct == 82
    # equal similarity to all rungs: the plain mean of the weights, first rung named
    assert got["a"].destruction_pct == 49 and got["a"].rung == "intact"
    ref = images.withColumn("ref_vec", F.when(F.col("file_id") == "c", F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0)).cast("array<float>")))
    shifted = {r.file_id: r.destruction_pct for r in VE.prompt_scores(ref, prompts(spark)).collect()}
    assert shifted["c"] == 74 and shifted["a"] == 49
    without = VE.prompt_scores(images, prompts(spark).where("signal <> 'ai_gen'")).first()
    assert without.ai_gen is None and without.staged is not None
