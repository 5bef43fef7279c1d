import json

from pyspark.sql import functions as F

from tallygrain.operators import explorer as EX, history as HI, maintain as MT, validate as VA
from tallygrain.operators import documents as D
from tallygrain.operators.eventindex import EventIndex
from tallygrain.schemas import CLAIMS
from tallygrain.sources import files as SF, snapshots as SN


def claims(spark, rows):
    base = {f.name: None for f in CLAIMS.fields}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], CLAIMS)


def test_upsert_keeps_submission_and_inspector(spark):
    old = claims(spark, [dict(id="A", status="SUBMITTED", assigned_to="U1", amount_requested=1), dict(id="B", status="PAID")])
    new = claims(spark, [dict(id="A", status="AI_FLAGGED", assigned_to="U9", amount_requested=2, policy_number=None), dict(id="C", status="SUBMITTED", assigned_to="U2")])
    got = {r.id: r for r in MT.upsert_claims(old, new).collect()}
    assert (got["A"].status, got["A"].assigned_to, got["A"].amount_requested) == ("AI_FLAGGED", "U1", 2)
    assert got["B"].status == "PAID" and got["C"].assigned_to == "U2" and len(got) == 3


def test_assignments_last_wins_and_unknown_staff_is_refused(spark):
    rows = spark.createDataFrame([("A", "U1", 1), ("A", "U2", 2), ("A", "ghost", 3), ("B", "ghost", 1)], "claim_id string, assigned_to string, assigned_at int")
    users = spark.createDataFrame([("U1",), ("U2",)], "id string")
    table, synced = MT.assign(claims(spark, [dict(id="A"), dict(id="B", assigned_to="U1")]), rows, users)
    assert {(r.claim_id, r.assigned_to) for r in table.collect()} == {("A", "U2")}
    assert {r.id: r.assigned_to for r in synced.collect()} == {"A": "U2", "B": "U1"}


def test_resync_twice_changes_nothing(spark):
    c = claims(spark, [dict(id="A", status="PAID", amount_requested=5)])
    e = spark.createDataFrame([("f1", "A", 1), ("f2", "A", 2)], "file_id string, claim_id string, seq int")
    c1, e1 = MT.resync(c.limit(0), c, e.limit(0), e)
    c2, e2 = MT.resync(c1, c, e1, e)
    assert c1.collect() == c2.collect() and sorted(e1.collect()) == sorted(e2.collect()) and e2.count() == 2


def test_intake_issues(spark):
    rows = claims(spark, [dict(id="A", claimant_name="x", loss_type="flood", amount_requested=1),
                          dict(id="B", claimant_name="", loss_type="fire", amount_requested=0, policy_number="p" * 41, destruction_pct_claimed=101)])
    good, bad = VA.split_claims(rows)
    assert [r.id for r in good.collect()] == ["A"]
    assert bad.first().issues == ["claimant_name", "loss_type", "amount_requested", "policy_number", "destruction_pct_claimed"]


def test_history_search_wildcards_and_case(spark):
    rows = claims(spark, [dict(id="CLM-1", claimant_name="Ünal KUMAR", policy_number="a\\b"), dict(id="CLM-2", claimant_name="ünal")])
    users = spark.createDataFrame([], "id string, name string, district string")
    ids = lambda q: {r.id for r in HI.history(rows, users, search=q).collect()}
    assert ids("kumar") == {"CLM-1"} and ids("clm-_") == {"CLM-1", "CLM-2"} and ids("a\\b") == {"CLM-1"} and ids("ÜNAL") == {"CLM-1"}


def test_indexed_search_equals_the_plain_one_and_reads_one_bucket(spark, tmp_path):
    zero = "0x" + "0" * 64
    h = lambda i: "0x" + f"{i:064X}"
    rows = [(f"CLM-{i % 5}", i // 5, h(i), zero if i < 5 else h(100 + i - 5), h(100 + i), "PAID", 60 * i) for i in range(40)]
    rows.append(("CLM-9", 0, h(3), None, h(3), "PAID", 9_999))  # one hash in two columns, and a missing one
    trail = spark.createDataFrame(rows, "claim_id string, seq long, state_hash string, prev_record_hash string, record_hash string, status string, ts long")
    events = EX.sealed_events(trail)
    index = EventIndex(spark, str(tmp_path), 16)
    for epoch, part in enumerate(["ts < 1000", "ts >= 1000", "ts >= 1000"]):
        index.append(events.where(part), min(epoch, 1))  # the last batch comes twice
    key = events.where("ts = 60").first()
    for query in ("clm-3", " CLM-77 ", zero, h(3), h(117), h(999), key.claim_key, key.tx_hash, "what"):
        got, want = index.search(query), EX.search_events(events, query)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), query
    plan = index.search(h(117))._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(bucket" in plan and "dynamicpruning" in plan.lower()
    # a trail's own block and transaction count
    own = EX.sealed_events(trail.withColumns({"block_number": F.lit(7).cast("long"), "tx_hash": F.lit(h(5))})).first()
    assert (own.block_number, own.tx_hash) == (7, h(5))


def test_log_and_hashes_are_of_the_same_events(spark, tmp_path):
    """Events that come out otherwise each time they are worked out: once must do."""
    seen = spark.range(20).select(
        F.lit("CLM-1").alias("claim_id"), F.col("id").alias("seq"), F.lit("").alias("state_hash"),
        F.lit("0x1").alias("prev_record_hash"), F.lit("0x2").alias("record_hash"), F.lit("PAID").alias("status"), F.col("id").alias("ts"),
    )

    def stamped(batches):
        import uuid

        for batch in batches:
            yield batch.assign(state_hash=["0x" + uuid.uuid4().hex * 2 for _ in range(len(batch))])

    index = EventIndex(spark, str(tmp_path), 4)
    index.append(EX.sealed_events(seen.mapInPandas(stamped, seen.schema)), 0)
    logged = index.log().where("seq = 7").first().state_hash
    assert [r.seq for r in index.search(logged).collect()] == [7]


def test_absent_rows_carry_only_the_columns_that_are_read(spark):
    new = spark.createDataFrame([("f1", 2, "wide"), ("f1", 1, "x"), ("f2", 1, "y"), (None, 1, "z"), (None, 2, "w")], "file_id string, seq int, sha256 string")
    old = new.where("file_id = 'f2'")
    added = MT.insert_absent(old, new, "file_id", [F.col("seq")])
    assert sorted(map(tuple, added.collect()), key=str) == [("f1", 1, "x"), (None, 1, "z")]
    # no packed row is made, which would keep every column alive
    assert "struct" not in added.select("file_id")._jdf.queryExecution().optimizedPlan().toString()


def test_search_by_any_hash(spark):
    h = "0x" + "ab" * 32
    trail = spark.createDataFrame([("A", 0, h, "0x1", "0x2", "PAID", 60), ("B", 0, "0x3", h, "0x4", "PAID", 120)],
                                  "claim_id string, seq long, state_hash string, prev_record_hash string, record_hash string, status string, ts long")
    events = EX.sealed_events(trail)
    assert EX.search_events(events, h.upper().replace("0X", "0x")).count() == 2
    assert EX.search_events(events, " a ").count() == 0 and EX.interpret("clm-1") == "claimId"
    assert EX.search_events(EX.sealed_events(trail.withColumn("claim_id", F.concat(F.lit("CLM-"), "claim_id"))), "clm-a").first().claim_ref == "CLM-A"
    assert EX.recent_events(events, 1).first().block_number == 2 and EX.recent_events(events, 0).count() == 1


def test_files(spark, tmp_path):
    for claim, kind, name, body in [("A", "photo", "x.jpg", b"one"), ("A", "bill", "y.pdf", b"two"), ("B", "photo", "z.png", b"one")]:
        (tmp_path / claim / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / claim / kind / name).write_bytes(body)
    manifest = SF.evidence_manifest(spark, str(tmp_path))
    rows = {r.file_id: r for r in manifest.collect()}
    assert set(rows) == {"A/photo/x.jpg", "A/bill/y.pdf", "B/photo/z.png"}
    assert rows["A/bill/y.pdf"].mime_type == "application/pdf" and rows["A/photo/x.jpg"].sha256 == rows["B/photo/z.png"].sha256
    recorded = spark.createDataFrame(list(rows.values()), manifest.schema)
    (tmp_path / "A" / "bill" / "y.pdf").write_bytes(b"changed")
    (tmp_path / "B" / "photo" / "z.png").unlink()
    audit = SF.integrity_audit(recorded, SF.evidence_manifest(spark, str(tmp_path)))
    assert {r.file_id: r.intact for r in audit.collect()} == {"A/photo/x.jpg": True, "A/bill/y.pdf": False, "B/photo/z.png": False}
    vectors = SF.embed_files(SF.scan_files(spark, str(tmp_path)), lambda images: [[float(len(b))] for b in images])
    assert sorted(r.vec[0] for r in vectors.collect()) == [3.0, 7.0]
    texts = SF.read_texts(SF.scan_files(spark, str(tmp_path)), lambda images: [b.decode() for b in images])
    assert {r.text for r in texts.collect()} == {"one", "changed"}


def test_labelled_folder(spark, tmp_path):
    for path in ["genuine/c1/a.jpg", "genuine/loose.png", "fraud/c2/b.JPEG", "fraud/c2/notes.txt", "other/c3/c.jpg"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    (tmp_path / "fraud/c2/manifest.json").write_text(json.dumps({"lossType": "flood", "note": "again"}))
    got = {r.claim_id: (r.label, r.file_id, r.note) for r in SF.labelled_folder(spark, str(tmp_path)).collect()}
    assert got == {
        "TRAINING/genuine/c1": ("genuine", "a.jpg", None), "TRAINING/genuine/_flat": ("genuine", "loose.png", None),
        "TRAINING/fraud/c2": ("fraud", "b.JPEG", "flood · again"),
    }


def test_snapshot_reading_rules(spark, tmp_path):
    old = {"savedAt": "2024-01-01", "contract": "X", "claims": [{"id": "A", "status": "PAID"}, {"status": "PAID"}, {"id": "A", "status": "SUBMITTED"}]}
    other = {"savedAt": "2024-01-02", "contract": "Y", "claims": [{"id": "B", "status": "PAID"}]}
    (tmp_path / "a.json").write_text(json.dumps(old) + "\n" + json.dumps(other))
    assert [(r.id, r.status) for r in SN.read_snapshot(spark, str(tmp_path), "X").collect()] == [("A", "PAID")]


def test_csv_and_dossier(spark, tmp_path):
    SN.write_csv(claims(spark, [dict(id="A", claimant_name='O"Neil, Pat', status="PAID")]), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    # the row may stand in any of the part files
    assert any(line.startswith('A,"O""Neil, Pat",,,PAID,,,') for line in text.splitlines())
    from tallygrain.operators.trail import seal

    rows = spark.createDataFrame([("A", 0, "0x1", "PAID", 0, "svc", 'a "note"')], "claim_id string, seq long, state_hash string, status string, ts long, recorded_by string, note string")
    record = json.loads(SN.dossier_records(seal(rows)).first().record)
    assert list(record) == sorted(record) and record["note"] == 'a "note"' and record["sealedAtIso"] == "1970-01-01T00:00:00.000Z"
    header = SN.dossier_headers(seal(rows), F.lit("now")).first()
    document = json.loads(header.document)
    assert list(document) == sorted(document) and document["recordCount"] == 1 and document["integrity"]["valid"]


def test_a_dossier_seals_its_trail_once(spark):
    from tallygrain.operators.trail import seal, sha2_text

    calls = spark.sparkContext.accumulator(0)

    def counted(text):
        calls.add(1)
        return sha2_text(text)

    rows = spark.createDataFrame(
        [(c, i, f"0x{c}{i}", "PAID", i, "svc", "") for c in "AB" for i in range(3)],
        "claim_id string, seq long, state_hash string, status string, ts long, recorded_by string, note string",
    )
    headers = SN.dossier_headers(seal(rows, python_digest=counted), F.lit("now")).collect()
    assert calls.value == 6
    assert sorted((h.claim_id, h.record_count, h.valid) for h in headers) == [("A", 3, True), ("B", 3, True)]


def test_second_payment_and_contrary_decision_are_refused(spark):
    import datetime as dt

    from tallygrain.operators import maintain as MT

    claims = spark.createDataFrame([("A", "HUMAN_APPROVED", 10), ("B", "AI_FLAGGED", 20), ("C", "AI_FLAGGED", 30)], "id string, status string, amount_requested int")
    day = lambda n: dt.datetime(2024, 1, n)
    asked = [("A", "r1", None, day(2)), ("A", "r1", None, day(2)), ("A", "r0", 5, day(3)), ("B", "r2", None, day(1))]
    out = MT.pay(claims, spark.createDataFrame(asked, "claim_id string, reference string, amount int, ts timestamp")).collect()
    assert sorted((r.claim_id, r.code) for r in out) == [("A", "INVALID_STATE"), ("A", "INVALID_STATE"), ("A", "OK"), ("B", "FLAGGED_LOCKED")]
    long = "x" * 40
    steps = [("C", "HUMAN_APPROVED", long, "u", day(1)), ("C", "HUMAN_REJECTED", long, "u", day(2)), ("C", "HUMAN_APPROVED", "\n\t" + "x" * 3 + "　", "u", day(3))]
    got = MT.human_decisions(claims, spark.createDataFrame(steps, "claim_id string, requested string, note string, reviewer string, ts timestamp")).orderBy("ts").collect()
    assert [r.current for r in got][:2] == ["AI_FLAGGED", "HUMAN_APPROVED"] and got[0].code == "OK"
    assert sum(r.label is not None for r in got) == sum(r.code == "OK" for r in got)


def test_evidence_digest_tells_missing_fields_and_separators_apart(spark):
    schema = "claim_id string, seq long, file_id string, sha256 string, p_hash string"
    from tallygrain.functions.digest import sha2_digest

    bits = "01" * 32
    hashed = spark.range(1).select(sha2_digest(F.lit(bits)).alias("h")).first()["h"]
    rows = [("A", 1, "f", "x", None), ("B", 1, "f", None, bits), ("C", 1, "f", hashed, None), ("D", 1, "f|x", "y", None), ("E", 1, "f", "x|y", None)]
    # the same files in another order of rows, and places beyond one stretch
    rows += [("F", i, f"f{i}", "x", None) for i in range(600)] + [("G", i, f"f{i}", "x", None) for i in reversed(range(600))] + [("H", None, "f", "x", None)]
    found = {r["claim_id"]: r for r in MT.claim_digests(spark.createDataFrame(rows, schema)).collect()}
    assert len({found[c]["evidence_digest"] for c in "ABCDEFH"}) == 7
    assert found["F"]["evidence_digest"] == found["G"]["evidence_digest"] and found["F"]["n_files"] == 600


def test_texts_of_files_do_not_go_through_the_driver(spark):
    exif = "struct<present: boolean, software: string, gps: struct<lat: double, lon: double>>"
    evidence = spark.createDataFrame([("A", "f1", "bill", 1, "bill.pdf", None)], f"claim_id string, file_id string, kind string, seq int, filename string, exif {exif}")
    ocr = spark.createDataFrame([("f1", "policy MH-99-0001 claim amount 500", False)], "file_id string, text string, hindi boolean")
    for out in (D.claim_features(evidence, ocr), D.last_papers(evidence, ocr), D.text_snippets(evidence, ocr)):
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
