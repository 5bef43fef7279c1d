"""A stream over several files gives what one batch gives; replays change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import kpi as KPI, memory as ME, trail as TR
from tallygrain.operators.vectors import knn_votes
from tallygrain.schemas import IMAGE_VECTORS, MEMORY
from tallygrain.streaming import jobs as ST


def write_parts(df, path, parts):
    """One file per part, in this order of arrival."""
    for i, where in enumerate(parts):
        df.where(where).coalesce(1).write.mode("append").parquet(f"{path}/in")


RECORDS = "claim_id string, pos long, state_hash string, status string, ts long, recorded_by string, note string"


def test_sealing_in_parts_with_a_replay(spark, tmp_path):
    rows = [(f"C{i % 3}", i, f"0xs{i}", "SUBMITTED", i, "svc", f"n{i}") for i in range(30)]
    df = spark.createDataFrame(rows, RECORDS)
    expected = {(r.claim_id, r.seq): r.record_hash for r in TR.seal(df.withColumn(
        "seq", F.floor(F.col("pos") / 3).cast("long"))).collect()}
    write_parts(df, str(tmp_path), ["pos < 10"])
    folder = str(tmp_path / "out")
    stream = lambda: ST.seal_stream(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1))
    ST.drain(stream(), "t", folder)
    # the second round brings old rows again, and then new ones
    write_parts(df, str(tmp_path), ["pos >= 5 AND pos < 20", "pos >= 20"])
    got = ST.drain(stream(), "t", folder).collect()
    assert {(r.claim_id, r.seq): r.record_hash for r in got} == expected and len(got) == 30


def test_second_payment_is_refused(spark, tmp_path):
    rows = [
        ("A", 1, "pay", "PAID", ""), ("A", 2, "verdict", "AI_FLAGGED", ""), ("A", 3, "pay", "PAID", ""),
        ("A", 4, "human", "HUMAN_APPROVED", "short"), ("A", 5, "human", "HUMAN_APPROVED", "x" * 20), ("A", 6, "pay", "PAID", ""),
        ("A", 7, "pay", "PAID", ""), ("A", 8, "human", "HUMAN_REJECTED", "x" * 20), ("B", 1, "verdict", "AI_APPROVED", ""),
    ]
    df = spark.createDataFrame(rows, "claim_id string, pos long, kind string, requested string, note string")
    write_parts(df, str(tmp_path), ["pos < 4", "pos >= 4"])
    out = ST.drain(ST.guard_stream(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1)), "t", str(tmp_path / "out"))
    codes = [r.code for r in out.where("claim_id = 'A'").orderBy("pos").collect()]
    assert codes == ["INVALID_STATE", "OK", "FLAGGED_LOCKED", "REASON_TOO_SHORT", "OK", "OK", "INVALID_STATE", "TERMINAL_STATE"]


def test_velocity_counts_across_batches(spark, tmp_path):
    rows = [("s1", 10 + i) for i in range(8)] + [("s1", 30 + i) for i in range(6)] + [("s2", i * 61) for i in range(20)]
    df = spark.createDataFrame(rows, "source string, t long").select("source", F.timestamp_seconds("t").alias("ts"))
    write_parts(df, str(tmp_path), ["unix_seconds(ts) < 20", "unix_seconds(ts) >= 20"])
    out = ST.too_fast(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1), "source", "ts")
    assert [(r.source, r.n) for r in out.collect()] == [("s1", 14)]


def test_audit_rows_once_for_ever(spark, tmp_path):
    rows = [("A", "h", "PAID", "x", "y", dt.datetime(2024, 1, d)) for d in (1, 1, 2, 1)]
    schema = "claim_id string, state_hash string, status string, recorded_by string, note string, ts timestamp"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
    assert ST.audit_forever(stream, str(tmp_path / "forever")).count() == 2
    assert ST.drain(ST.audit_stream(stream), "t", str(tmp_path / "once")).count() == 2


def test_memory_versions(spark, tmp_path):
    start = spark.createDataFrame([("A", "a0", "genuine", "seed", [1.0], dt.datetime(2024, 1, 1), 0)], MEMORY)
    vectors = spark.createDataFrame([("a1", "A", 1, "photo", [0.123456789]), ("b1", "B", 1, "photo", [2.0]), ("b2", "B", 2, "bill", [3.0])], IMAGE_VECTORS)
    schema = "claim_id string, label string, at timestamp"
    for row in [("A", "fraud", dt.datetime(2024, 2, 1)), ("B", "fraud", dt.datetime(2024, 2, 2)), ("A", "genuine", dt.datetime(2024, 2, 3))]:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
    out = ST.memory_upkeep(stream, vectors, start, "human", str(tmp_path / "memory"))
    got = {(r.claim_id, r.file_id): (r.label, round(r.vec[0], 6)) for r in out.collect()}
    assert got == {("A", "a1"): ("genuine", 0.12346), ("B", "b1"): ("fraud", 2.0)}


def test_memory_history_shows_each_run_the_memory_of_its_time(spark, tmp_path):
    """One decision a batch; a cap of two; B is decided twice, with another label."""
    start = spark.createDataFrame([("S", "s0", "fraud", "seed", [9.0, 1.0], dt.datetime(2024, 1, 1), 0)], MEMORY)
    decisions = [("A", "fraud"), ("B", "fraud"), ("B", "genuine"), ("D", "fraud")]
    vectors = spark.createDataFrame([(f"{c.lower()}1", c, i, "photo", [float(i + 1), 1.0]) for i, c in enumerate("ABD")], IMAGE_VECTORS)
    schema = "claim_id string, label string, at timestamp"
    for day, (claim, label) in enumerate(decisions, 2):
        spark.createDataFrame([(claim, label, dt.datetime(2024, 1, day))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
    kept = ST.memory_history(stream, vectors, start, "human", str(tmp_path / "history"), 2)
    memory, shown = {"S": ("fraud", 1)}, {1: set()}
    for day, (claim, label) in enumerate(decisions, 2):
        shown[day] = {(c, lab) for c, (lab, _) in memory.items()}
        memory[claim] = (label, day)
        for lab in ("fraud", "genuine"):
            for c in sorted((c for c in memory if memory[c][0] == lab), key=lambda c: memory[c][1])[:-2]:
                del memory[c]
    shown[6] = {(c, lab) for c, (lab, _) in memory.items()}
    asked = spark.createDataFrame([("Q", f"q{d}", 1, [1.0, 1.0], dt.datetime(2024, 1, d)) for d in shown], "claim_id string, file_id string, seq int, vec array<float>, run_at timestamp")
    got = {r.file_id: {(m.claim_id, m.label) for m in r.matches} for r in knn_votes(asked, kept, per_label=2).collect()}
    assert got == {f"q{d}": s for d, s in shown.items()}
    assert {(r.claim_id, r.label) for r in kept.where("until IS NULL").collect()} == shown[6]
    assert kept.groupBy("label", "n").count().where("count > 1").isEmpty()


def test_intake_goes_on_after_a_failure(spark, tmp_path):
    from test_verify import story
    from tallygrain.plans.verify import verify_claims

    tables = story(spark)
    for i in (0, 1):
        tables.claims.where(F.abs(F.hash("id")) % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.read_files(spark, f"{tmp_path}/in", tables.claims.schema, 1)
    runs, failed = ST.verify_on_intake(stream, tables, str(tmp_path / "good"))
    expected = {r.claim_id: (r.verdict, r.score) for r in verify_claims(tables).collect()}
    assert {r.claim_id: (r.verdict, r.score) for r in runs.collect()} == expected and failed.count() == 0
    broken = tables.only(tables.claims)
    broken.policies = broken.policies.withColumn("limit_inr", F.raise_error(F.lit("no table")).cast("int"))
    runs, failed = ST.verify_on_intake(stream, broken, str(tmp_path / "bad"))
    assert failed.select("claim_id").distinct().count() + runs.count() == 4 and failed.count() > 0


def test_ties_and_late_records_are_sealed(spark, tmp_path):
    rows = [("A", 5, "s5", "SUBMITTED", 5, "svc", "a"), ("A", 5, "s5b", "PAID", 5, "svc", "b"), ("A", 9, "s9", "PAID", 9, "svc", "c"), ("A", 2, "s2", "PAID", 2, "svc", "late")]
    df = spark.createDataFrame(rows, RECORDS)
    folder = str(tmp_path / "out")
    stream = lambda: ST.seal_stream(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1))
    write_parts(df, str(tmp_path), ["pos >= 5"])
    ST.drain(stream(), "t", folder)
    write_parts(df, str(tmp_path), ["pos = 2 OR pos = 5"])
    got = ST.drain(stream(), "t", folder).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 1, 2, 3] and got[3].note == "late" and {got[0].note, got[1].note} == {"a", "b"}
    assert all(b.prev_record_hash == a.record_hash for a, b in zip(got, got[1:]))


def test_late_requests_are_judged(spark, tmp_path):
    rows = [("A", 3, "verdict", "AI_APPROVED", ""), ("A", 3, "pay", "PAID", ""), ("A", 1, "pay", "PAID", "late")]
    df = spark.createDataFrame(rows, "claim_id string, pos long, kind string, requested string, note string")
    write_parts(df, str(tmp_path), ["pos = 3", "pos = 1"])
    out = ST.drain(ST.guard_stream(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1)), "t", str(tmp_path / "out")).collect()
    assert len(out) == 3 and sum(r.kind == "pay" and r.code == "OK" for r in out) == 1


def test_one_bad_claim_does_not_take_its_batch_along(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"C{i}",) for i in range(9)], "id string")
    write_parts(df, str(tmp_path), ["id <> ''"])

    class Tables:
        def only(self, batch):
            return batch

    def verify(batch):
        if batch.where("id = 'C4'").count():
            raise ValueError("bad claim")
        return batch.select(*[(F.col("id") if f.name == "claim_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in ST.RUNS.fields])

    monkeypatch.setattr(ST, "verify_claims", verify)
    called = []
    runs, failed = ST.verify_on_intake(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1), lambda: called.append(1) or Tables(), str(tmp_path / "out"))
    assert {r.claim_id for r in runs.collect()} == {f"C{i}" for i in range(9) if i != 4}
    assert [(r.claim_id, "bad claim" in r.error) for r in failed.collect()] == [("C4", True)] and called


def test_a_full_disk_is_no_bad_claim(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"C{i}",) for i in range(5)], "id string")
    write_parts(df, str(tmp_path), ["id <> ''"])
    calls = []

    class Tables:
        def only(self, batch):
            return batch

    def verify(batch):
        calls.append(1)
        if len(calls) <= broken:
            raise OSError("No space left on device")
        return batch.select(*[(F.col("id") if f.name == "claim_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in ST.RUNS.fields])

    monkeypatch.setattr(ST, "verify_claims", verify)
    intake = lambda: ST.read_files(spark, f"{tmp_path}/in", df.schema, 1)
    broken = 99
    with pytest.raises(Exception, match="No space left"):
        ST.verify_on_intake(intake(), Tables(), str(tmp_path / "out"))
    assert len(calls) == 1 + ST.RETRIES  # the batch is neither halved nor noted
    # the same job goes on at the batch where it stopped, and a second try is enough
    calls.clear()
    broken = 1
    runs, failed = ST.verify_on_intake(intake(), Tables(), str(tmp_path / "out"))
    assert {r.claim_id for r in runs.collect()} == {f"C{i}" for i in range(5)} and failed.count() == 0 and len(calls) == 2


def test_velocity_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame([("s1", i) for i in range(9)], "source string, t long").select("source", F.timestamp_seconds("t").alias("ts"))
    run = lambda: ST.too_fast(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1), "source", "ts", limit=3, folder=str(tmp_path / "out"))
    write_parts(df, str(tmp_path), ["unix_seconds(ts) < 4"])
    assert [(r.source, r.n) for r in run().collect()] == [("s1", 4)]
    write_parts(df, str(tmp_path), ["unix_seconds(ts) >= 4"])
    assert [(r.source, r.n) for r in run().collect()] == [("s1", 9)]


def test_velocity_counts_files_in_any_order_of_time(spark, tmp_path):
    rows = [("s1", i) for i in range(6)] + [("s2", 90_000 + i) for i in range(12)] + [("s1", 20 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "source string, t long").select("source", F.timestamp_seconds("t").alias("ts"))
    # the newest rows come first and again in between
    write_parts(df, str(tmp_path), ["unix_seconds(ts) >= 90006", "unix_seconds(ts) < 20", "unix_seconds(ts) BETWEEN 90000 AND 90005", "unix_seconds(ts) BETWEEN 20 AND 80000"])
    stream = lambda: ST.read_files(spark, f"{tmp_path}/in", df.schema, 1)
    assert {(r.source, r.n) for r in ST.too_fast(stream(), "source", "ts", limit=6).collect()} == {("s1", 12), ("s2", 12)}
    assert ("s1", 12) not in {(r.source, r.n) for r in ST.too_fast(stream(), "source", "ts", limit=6, late="10 minutes").collect()}


def test_halving_goes_on_until_one_claim_is_left(spark, tmp_path, monkeypatch):
    bits = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)).cast("string") for k in range(1, 14)]
    ids = spark.range(40_000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("id")).withColumn("path", F.concat(*bits))
    # two claims that thirteen halvings leave together
    pair = ids.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).orderBy("path").first()["ids"][:2]
    df = spark.createDataFrame([(i,) for i in pair], "id string")
    write_parts(df, str(tmp_path), ["id <> ''"])

    class Tables:
        def only(self, batch):
            return batch

    def verify(batch):
        if batch.where(F.col("id") == pair[0]).count():
            raise ValueError("bad claim")
        return batch.select(*[(F.col("id") if f.name == "claim_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in ST.RUNS.fields])

    monkeypatch.setattr(ST, "verify_claims", verify)
    runs, failed = ST.verify_on_intake(ST.read_files(spark, f"{tmp_path}/in", df.schema, 1), Tables(), str(tmp_path / "out"))
    assert [r.claim_id for r in runs.collect()] == [pair[1]] and [r.claim_id for r in failed.collect()] == [pair[0]]


def test_intake_with_a_stored_index_finds_what_came_two_batches_ago(spark, tmp_path):
    from test_verify import story
    from tallygrain.operators.photoindex import PhotoIndex

    tables = story(spark)
    # the pictures of CLM-4102 come again with CLM-8919, two batches later
    for ids in (("CLM-4102",), ("CLM-8920",), ("CLM-8919", "CLM-8930")):
        tables.claims.where(F.col("id").isin(*ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.read_files(spark, f"{tmp_path}/in", tables.claims.schema, 1)
    index = PhotoIndex(spark, str(tmp_path / "photos"), blocks=7, buckets=2)
    runs, failed = ST.verify_on_intake(stream, tables, str(tmp_path / "out"), index)
    stage = {r.claim_id: {s.stage: s for s in r.stages}["DUPLICATE_PHASH"] for r in runs.collect()}
    assert failed.count() == 0 and {c: s.result for c, s in stage.items()} == {"CLM-4102": "PASS", "CLM-8920": "PASS", "CLM-8919": "FAIL", "CLM-8930": "PASS"}
    assert "CLM-4102" in stage["CLM-8919"].details


def test_live_figures_hold_the_median_over_all_batches(spark, tmp_path):
    schema = "id string, status string, amount_requested long, submitted_at timestamp, duration_ms int"
    at = dt.datetime(2024, 1, 1)
    parts = [[5, 90_000, None, 7], [7, 30_000], [12, 12, 12]]
    for i, part in enumerate(parts):
        rows = [(f"C{i}{j}", "PAID" if j else "AI_FLAGGED", 10, at, d) for j, d in enumerate(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    shape = spark.createDataFrame([], schema).schema
    stream = ST.read_files(spark, f"{tmp_path}/in", shape, 1)
    got = ST.live_kpi(stream, F.lit(at), str(tmp_path / "kpi")).first()
    want = KPI.kpi_strip(spark.read.schema(shape).parquet(f"{tmp_path}/in"), F.lit(at)).first()
    assert got.asDict() == want.asDict() and got.verification_p50_ms == 12 and got.total == 9


@pytest.mark.parametrize("values", [[], [3], [3, 3], [1, 2], [10_000, 9_999, 20_000, 20_001], [-5, 5, 5, 40_000], [None, 1]])
def test_counted_median_equals_the_plain_one(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    got = spark.range(1).select(KPI.counted_median(counts, "v", "n").alias("m")).first().m
    known = sorted(v for v in values if v is not None)
    assert got == rows.agg(KPI.upper_median("v").alias("m")).first().m == (known[len(known) // 2] if known else None)
