"""Files that no task should read whole."""

import gzip
import hashlib
import random

from tallygrain.functions import sha256state as SHA
from tallygrain.sources import files as SF


def test_state_of_a_digest_goes_on_elsewhere():
    data = random.Random(1).randbytes(5000)
    state = SHA.start()
    for a, b in [(0, 0), (0, 1), (1, 64), (64, 130), (130, 4097), (4097, 5000)]:
        state = SHA.extend(bytes(bytearray(state)), data[a:b])
    assert SHA.available() and SHA.finish(state) == hashlib.sha256(data).hexdigest()
    assert SHA.finish(SHA.start()) == hashlib.sha256(b"").hexdigest()


def test_large_files_are_hashed_in_turns(spark, tmp_path, monkeypatch):
    noise = random.Random(2).randbytes
    bodies = {
        "bytes.jpg": noise(900_001),
        "ends with line feed.pdf": noise(700_000) + b"\n",
        "two line feeds.png": noise(500_000) + b"\n\n",
        "mark.bin": b"\xef\xbb\xbf" + noise(450_000) + b"x",
        "mark-and-feed.bin": b"\xef\xbb\xbf\xef\xbb\xbf\n" + noise(450_000) + b"\n",
        "returns.webp": b"\r\n\r\r\n" * 130_000,
        "feeds.bin": b"\n" * 410_000,
        "one line é%20.bin": b"\x00" * 2_500_000 + b"\nend",
        "small.bin": b"one",
        "small-packed.gz": gzip.compress(b"one"),
    }
    for name, body in bodies.items():
        for kind in ("photo", "bill"):
            (tmp_path / "A" / kind).mkdir(parents=True, exist_ok=True)
            (tmp_path / "A" / kind / name).write_bytes(body)
    monkeypatch.setattr(SF, "TURN_BYTES", 300_000, raising=False)
    # no task may hold a file of more than this, which stands for Spark's 2 GB
    settings = {"spark.sql.sources.binaryFile.maxLength": "400000", "spark.sql.files.maxPartitionBytes": "100000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        manifest = SF.evidence_manifest(spark, str(tmp_path))
        rows = {r.file_id: r for r in manifest.collect()}
        recorded = spark.createDataFrame(list(rows.values()), manifest.schema)
        (tmp_path / "A" / "bill" / "bytes.jpg").write_bytes(bodies["bytes.jpg"][:-1] + b"?")
        (tmp_path / "A" / "bill" / "feeds.bin").unlink()
        audit = SF.integrity_audit(recorded, SF.evidence_manifest(spark, str(tmp_path)))
        broken = {r.file_id for r in audit.collect() if not r.intact}
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert {f: (r.size_bytes, r.sha256) for f, r in rows.items()} == {
        f"A/{kind}/{name}": (len(body), "0x" + hashlib.sha256(body).hexdigest())
        for name, body in bodies.items()
        for kind in ("photo", "bill")
    }
    assert broken == {"A/bill/bytes.jpg", "A/bill/feeds.bin"}


def test_large_packed_files_are_hashed_as_they_are(spark, tmp_path, monkeypatch):
    (tmp_path / "A" / "bill").mkdir(parents=True)
    packed = gzip.compress(random.Random(3).randbytes(50_000))
    (tmp_path / "A" / "bill" / "x.GZ").write_bytes(packed)
    (tmp_path / "A" / "bill" / "x.gz").write_bytes(packed)
    monkeypatch.setattr(SF, "TURN_BYTES", 10_000, raising=False)
    digests = {r.sha256 for r in SF.evidence_manifest(spark, str(tmp_path)).collect()}
    assert digests == {"0x" + hashlib.sha256(packed).hexdigest()}
