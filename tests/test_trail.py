import hashlib

import pytest
from pyspark.sql import functions as F

from tallygrain import constants as C
from tallygrain.operators import merkle as MK, trail as TR

H = lambda s: "0x" + hashlib.sha256(s.encode()).hexdigest()


def records(spark, lengths):
    rows = [(c, i, f"0xs{c}{i}", "SUBMITTED", 100 + i, "svc", f"note {i}") for c, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "claim_id string, seq long, state_hash string, status string, ts long, recorded_by string, note string")


def breaks(spark, trail, ids):
    out = TR.verify_claims(spark.createDataFrame([(i,) for i in ids], "claim_id string"), trail)
    return {r.claim_id: (r.records, r.break_at, r.valid) for r in out.collect()}


def test_seal_then_verify(spark):
    sealed = TR.seal(records(spark, {"A": 3, "B": 1}))
    rows = {(r.claim_id, r.seq): r for r in sealed.collect()}
    assert rows["A", 0].prev_record_hash == C.ZERO_HASH == rows["B", 0].prev_record_hash
    assert rows["A", 1].prev_record_hash == rows["A", 0].record_hash
    assert breaks(spark, sealed, ["A", "B", "unknown"]) == {"A": (3, None, True), "B": (1, None, True), "unknown": (0, None, True)}


@pytest.mark.parametrize("field", ["state_hash", "status", "note", "recorded_by", "record_hash", "prev_record_hash"])
def test_any_change_is_found(spark, field):
    sealed = TR.seal(records(spark, {"A": 3, "B": 2}))
    hit = (F.col("claim_id") == "A") & (F.col("seq") == 1)
    changed = sealed.withColumn(field, F.when(hit, F.lit("0xbad")).otherwise(F.col(field)))
    got = breaks(spark, changed, ["A", "B"])
    assert got["A"] == (3, 1, False) and got["B"][2]


def test_dropped_record_breaks_at_the_next(spark):
    sealed = TR.seal(records(spark, {"A": 3}))
    assert breaks(spark, sealed.where("seq <> 1"), ["A"])["A"] == (2, 2, False)
    assert breaks(spark, sealed.where("seq <> 0"), ["A"])["A"][1] == 1


def test_sealing_goes_on_from_heads(spark):
    rows = records(spark, {"A": 6})
    whole = {r.seq: r.record_hash for r in TR.seal(rows).collect()}
    first = TR.seal(rows.where("seq < 4"))
    rest = TR.seal(rows.where("seq >= 4"), TR.chain_heads(first))
    assert {r.seq: r.record_hash for r in first.unionByName(rest).collect()} == whole


def test_empty_ids_are_refused(spark):
    bad = records(spark, {"": 1, "A": 1}).unionByName(records(spark, {"B": 1}).withColumn("state_hash", F.lit(C.ZERO_HASH)))
    assert [r.claim_id for r in TR.seal(bad).collect()] == ["A"]


def test_another_digest(spark):
    short = lambda c: F.concat(F.lit("#"), F.md5(c))
    sealed = TR.seal(records(spark, {"A": 3}), digest=short, python_digest=lambda t: "#" + hashlib.md5(t.encode()).hexdigest())
    assert TR.chain_breaks(sealed, short).first().valid and not TR.chain_breaks(sealed).first().valid


def brute_root(leaves):
    level = [H(H(x)) for x in leaves]
    while len(level) > 1:
        level = [H(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    return level[0]


def test_merkle_roots_and_proofs(spark):
    sizes = {"n1": 1, "n2": 2, "n3": 3, "n4": 4, "n5": 5, "n33": 33, "full": MK.FAN, "more": MK.FAN + 1, "long": 2 * MK.FAN + 77}
    rows = [(c, i, H(f"{c}{i}")) for c, n in sizes.items() for i in range(n)]
    trail = spark.createDataFrame(rows, "claim_id string, seq long, record_hash string").repartition(4)
    expected = {c: brute_root([H(f"{c}{i}") for i in range(n)]) for c, n in sizes.items()}
    ids = spark.createDataFrame([(c,) for c in [*sizes, "none"]], "claim_id string")
    assert {r.claim_id: r.root for r in MK.roots_of(ids, trail).collect()} == {**expected, "none": C.ZERO_HASH}
    holds = MK.proof_holds(F.col("leaf"), F.col("siblings"), F.col("root"))
    proofs = MK.merkle_proofs(trail).withColumn("ok", holds).withColumn(
        "bad", MK.proof_holds(F.lit("0xother"), F.col("siblings"), F.col("root"))
    )
    got = proofs.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.count_if("bad").alias("bad"), F.max("root").alias("root"))
    for r in got.collect():
        assert (r.n, r.ok, r.bad, r.root) == (sizes[r.claim_id], sizes[r.claim_id], 0, expected[r.claim_id])


@pytest.mark.parametrize("cuts", [[1], [2, 3], [1023, 1024, 1025], [5, 2100]])
def test_frontier_equals_the_tree_after_any_split(spark, cuts):
    sizes = {"n1": 1, "n2": 2, "n3": 3, "n7": 7, "n33": 33, "full": MK.FAN, "more": MK.FAN + 1, "long": 2 * MK.FAN + 77}
    rows = [(c, i, H(f"{c}{i}")) for c, n in sizes.items() for i in range(n)]
    trail = spark.createDataFrame(rows, "claim_id string, seq long, record_hash string").repartition(3)
    state, start = None, 0
    for end in [*cuts, 10**6]:
        batch = trail.where((F.col("seq") >= start) & (F.col("seq") < end))
        state = MK.frontier_of(batch) if state is None else MK.append_leaves(state, batch)
        state = spark.createDataFrame(state.collect(), MK.FRONTIER)
        start = end
    assert {r.claim_id: (r.n, sum(h is not None for h in r.frontier)) for r in state.collect()} == {c: (n, n.bit_count()) for c, n in sizes.items()}
    assert {r.claim_id: r.root for r in MK.frontier_roots(state).collect()} == {c: brute_root([H(f"{c}{i}") for i in range(n)]) for c, n in sizes.items()}


def test_check_goes_on_from_checkpoints(spark):
    sealed = TR.seal(records(spark, {"A": 9, "B": 5, "C": 3, "D": 6})).cache()
    old, new = sealed.where("seq < 4"), sealed.where("seq >= 4")
    marks = TR.checkpoints(old, TR.chain_breaks(old)).cache()
    found = lambda *a, **k: {r.claim_id: (r.records, r.break_at, r.checked) for r in TR.check_since(*a, **k).collect()}
    # only newer records are checked
    assert found(new, marks) == {"A": (9, None, 5), "B": (5, None, 1), "C": (3, None, 0), "D": (6, None, 2)}
    hit = lambda df, c, s, col: df.withColumn(col, F.when((F.col("claim_id") == c) & (F.col("seq") == s), F.lit("0xbad")).otherwise(F.col(col)))
    # after the checkpoint: content, link to the stored head, a gap, a record that belongs before
    assert found(hit(new, "A", 6, "note"), marks)["A"][1] == 6
    assert found(hit(new, "B", 4, "prev_record_hash"), marks)["B"][1] == 4
    assert found(new.where("NOT (claim_id = 'A' AND seq = 5)"), marks)["A"][1] == 6
    assert found(new.unionByName(old.where("claim_id = 'C' AND seq = 1")), marks)["C"][1] == 1
    # before it: the turns together check every old record once
    turns = [found(new, marks, old, turn=t, parts=3) for t in range(3)]
    assert all(t[c][1] is None for t in turns for c in t)
    assert [sum(t[c][2] for t in turns) for c in "ABCD"] == [4 + 3 * 5, 4 + 3 * 1, 3, 4 + 3 * 2]
    bad = hit(old, "D", 2, "note")
    assert {found(new, marks, bad, turn=t, parts=3)["D"][1] for t in range(3)} == {None, 2}
    # the number of old records and the one at the mark are compared at every turn
    assert found(new, marks, old.where("NOT (claim_id = 'A' AND seq = 0)"), parts=10**6)["A"][1] == 3
    assert found(new, marks, hit(old, "A", 3, "record_hash"), parts=10**6)["A"][1] == 3
    assert found(new, marks, old.where("claim_id <> 'B'"), parts=10**6)["B"][1] == 0


def test_claims_without_checkpoint_are_checked_from_the_start(spark):
    sealed = TR.seal(records(spark, {"A": 2, "B": 3}))
    none = spark.createDataFrame([], "claim_id string, mark long, head string")
    assert {r.claim_id: (r.records, r.valid, r.checked) for r in TR.check_since(sealed, none).collect()} == {"A": (2, True, 2), "B": (3, True, 3)}
