import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import neardup as ND, photoindex as PI
from tallygrain.operators.photoindex import PhotoIndex
from tallygrain.session import SHUFFLE_CLEANUP


def flip(bits, places):
    return "".join("10"[int(b)] if i in places else b for i, b in enumerate(bits))


def crowd(seed, n_base=12, n_copies=40):
    """Random pictures; one of them has a crowd of near-copies, most with distinct hashes."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice("01") for _ in range(64)) for _ in range(n_base)]
    rows = []
    for i in range(n_copies):
        base = bases[0] if i % 2 else rng.choice(bases)
        places = set(rng.sample(range(64), rng.choice([0, 0, 1, 2, 3, 5, 6, 7])))
        rows.append((f"C{rng.randrange(n_copies // 2)}", f"F{i}", flip(base, places), rng.randrange(50)))
    return rows


def distance(a, b):
    return sum(x != y for x, y in zip(a, b))


def frame(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, file_id string, p_hash string, t int").select(
        "claim_id", "file_id", "p_hash", F.timestamp_seconds("t").alias("created_at")
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("as_of", [False, True])
def test_flags_equal_brute_force(spark, seed, as_of):
    rows = crowd(seed)
    run_at = {c: random.Random(c + str(seed)).randrange(50) for c in {r[0] for r in rows}}
    runs = None
    if as_of:
        runs = spark.createDataFrame(list(run_at.items()), "claim_id string, r int").select("claim_id", F.timestamp_seconds("r").alias("run_at"))
    expected = {
        f for c, f, h, _ in rows
        if any(c2 != c and distance(h, h2) <= 6 and (not as_of or t2 <= run_at[c]) for c2, _, h2, t2 in rows)
    }
    got = ND.near_duplicates(frame(spark, rows), runs).collect()
    by_file = {r[1]: r for r in rows}
    assert {r.file_id for r in got} == expected and len(got) == len(expected)
    for r in got:
        mine, other = by_file[r.file_id], by_file[r.match_file_id]
        assert other[0] == r.match_claim_id != mine[0]
        assert r.distance == distance(mine[2], other[2]) <= 6
        assert not as_of or other[3] <= run_at[mine[0]]


@pytest.mark.parametrize("threshold, bands", [(2, 3), (4, 4), (6, 4), (7, 4), (6, 3)])
def test_band_join_loses_nothing(spark, threshold, bands):
    rows = crowd(threshold * 10 + bands, n_copies=60)
    hashes = sorted({r[2] for r in rows})
    df = spark.createDataFrame([(h,) for h in hashes], "p_hash string")
    # tiny buckets force the salted path
    found = ND.band_matches(df, df, threshold, bands, bucket_rows=3).select("p_hash", "other_hash").distinct().collect()
    expected = {(a, b) for a in hashes for b in hashes if distance(a, b) <= threshold}
    assert {tuple(r) for r in found} == expected


@pytest.mark.parametrize("threshold, blocks", [(2, 3), (4, 6), (6, 7), (6, 8), (6, 9), (6, 10)])
def test_block_combinations_lose_nothing(spark, threshold, blocks):
    rows = crowd(threshold * 10 + blocks, n_copies=60)
    hashes = sorted({r[2] for r in rows} | {"0" * 64, "1" * 64, "1" + "0" * 63})
    df = spark.createDataFrame([(h,) for h in hashes], "p_hash string").select(ND.code(F.col("p_hash")).alias("code"))
    found = {tuple(r) for r in ND.block_matches(df, df, threshold, blocks).collect()}
    number = {h: int(h, 2) - (1 << 64 if h[0] == "1" else 0) for h in hashes}
    assert found == {(number[a], number[b], distance(a, b)) for a in hashes for b in hashes if distance(a, b) <= threshold}


def test_more_hashes_take_more_blocks():
    picked = [ND.blocks_for(10**e) for e in range(2, 11)]
    assert picked == sorted(picked) and picked[0] == 7 and picked[-1] == 10
    # candidates a hash meets: 68 probes of bands of 16 bits met n / 964
    for n, at_most in ((10**6, 430), (10**7, 410), (10**8, 500)):
        assert sum(n / 2 ** m.bit_count() for m in ND.block_masks(ND.blocks_for(n), 6)) < at_most < n / 964


@pytest.mark.parametrize("blocks", [7, 9])
def test_neighbour_counts_equal_brute_force(spark, blocks):
    hashes = sorted({r[2] for r in crowd(5, n_copies=60)})
    found = ND.hash_pairs(spark.createDataFrame([(h,) for h in hashes], "p_hash string"), blocks=blocks).collect()
    want = []
    for a in hashes:
        near = sorted((distance(a, b), b) for b in hashes if b != a and distance(a, b) <= 6)
        if near:
            want.append((a, len(near), near[0][0], near[0][1]))
    assert sorted(map(tuple, found)) == want


def test_null_and_short_hashes_never_match(spark):
    evidence = spark.createDataFrame(
        [("A", "1", 1, "photo", None), ("B", "2", 1, "photo", "01"), ("C", "3", 1, "photo", "01"), ("D", "4", 1, "bill", "0" * 64)],
        "claim_id string, file_id string, seq int, kind string, p_hash string",
    ).withColumn("created_at", F.timestamp_seconds(F.lit(1)))
    assert ND.photo_hashes(evidence).count() == 0


def test_within_claim(spark):
    a = "01" * 32
    rows = [("A", "1", 1, a), ("A", "2", 2, flip(a, {3})), ("A", "3", 3, flip(a, {3, 9, 40})), ("B", "4", 1, a)]
    df = spark.createDataFrame(rows, "claim_id string, file_id string, seq int, p_hash string")
    got = {r.file_id: (r.earlier_file_id, r.distance) for r in ND.within_claim(df).collect()}
    assert got == {"2": ("1", 1), "3": ("2", 2)}


def test_probe_masks():
    assert len(ND.probe_masks(16, 1)) == 17 and len(ND.probe_masks(16, 2)) == 137
    assert sum(length for _, length in ND.chunks(6)) == 64 and max(length for _, length in ND.chunks(6)) == 6


def index_rows(out):
    return sorted(map(tuple, out.select("claim_id", "file_id", "tier", "match_claim_id", "match_file_id", "distance").collect()))


@pytest.mark.parametrize("seed, as_of", [(1, True), (2, False)])
def test_stored_index_equals_a_search_over_all(spark, tmp_path, seed, as_of):
    rows = crowd(seed, n_copies=60)
    photos = frame(spark, rows).cache()
    part = F.pmod(F.xxhash64("claim_id"), F.lit(2))
    run_at = {c: random.Random(c + str(seed)).randrange(50) for c in {r[0] for r in rows}}
    runs = spark.createDataFrame(list(run_at.items()), "claim_id string, r int").select("claim_id", F.timestamp_seconds("r").alias("run_at"))
    if not as_of:
        runs = runs.withColumn("run_at", F.lit(None).cast("timestamp"))
    index = PhotoIndex(spark, str(tmp_path / "index"), blocks=8, buckets=4)
    for epoch in range(2):
        batch = photos.where(part == epoch)
        index.append(batch, epoch)
        got = index_rows(index.duplicates(batch, runs))
        assert got == index_rows(ND.near_duplicates(photos.where(part <= epoch), runs.join(batch.select("claim_id").distinct(), "claim_id"), blocks=8))
    # a batch that is repeated changes nothing, and an earlier state can be asked again
    first = photos.where(part == 0)
    before = index_rows(index.until(0).duplicates(first, runs))
    index.append(first, 0)
    assert index_rows(index.until(0).duplicates(first, runs)) == before
    assert index_rows(index.compacted(str(tmp_path / "new")).duplicates(photos, runs)) == index_rows(index.duplicates(photos, runs))


def test_a_search_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    index = PhotoIndex(spark, str(tmp_path / "index"), blocks=7, buckets=512)
    photos = frame(spark, [("A", "1", "01" * 32, 1), ("B", "2", "01" * 31 + "10", 2)])
    index.append(photos, 0)
    codes = photos.limit(1).select(ND.code(F.col("p_hash")).alias("code"))
    asked = codes.select(F.explode(ND.block_keys(F.col("code"), 7)).alias("key")).withColumn("bucket", index._bucket("key"))
    read = index._read("blocks", PI.BLOCKS, asked)
    files = {Path(r[0]).parent.name for r in read.select(F.input_file_name()).distinct().collect()}
    assert files and files <= {f"bucket={r.bucket}" for r in asked.collect()}
    assert {r.claim_id for r in index._blocks_met(codes).collect()} <= {"A", "B"}


def test_pictures_without_an_earlier_batch_and_empty_batches(spark, tmp_path):
    index = PhotoIndex(spark, str(tmp_path / "index"), buckets=2)
    none = frame(spark, [])
    index.append(none, 0)
    assert index_rows(index.duplicates(none)) == []
    index.append(frame(spark, [("A", "1", "01" * 32, 1)]), 1)
    assert index_rows(index.duplicates(frame(spark, [("B", "2", "01" * 32, 2)]))) == [("B", "2", 0, "A", "1", 0)]


def test_copies_within_a_claim_name_the_first(spark):
    a = "01" * 32
    rows = [("A", f"f{i}", i, a) for i in range(30)] + [("A", "g", 40, flip(a, {0, 1})), ("A", "h", 41, flip(a, {0, 1, 2})), ("A", "i", 42, flip(a, {0, 1, 2, 3, 4}))]
    df = spark.createDataFrame(rows, "claim_id string, file_id string, seq int, p_hash string")
    got = {r.file_id: (r.earlier_file_id, r.distance) for r in ND.within_claim(df).collect()}
    assert got == {**{f"f{i}": ("f0", 0) for i in range(1, 30)}, "g": ("f0", 2), "h": ("g", 1), "i": ("h", 2)}


def test_foreign_counts_equal_brute_force(spark):
    rows = [(c, f, h, t * 20_000) for c, f, h, t in crowd(9)]
    run_at = {c: (random.Random(c).randrange(50) * 20_000 if c != "C1" else None) for c in {r[0] for r in rows} | {"none"}}
    runs = spark.createDataFrame(list(run_at.items()), "claim_id string, r long").select("claim_id", F.timestamp_seconds("r").alias("run_at"))
    photos = frame(spark, [(c, f, h, t) for c, f, h, t in rows])
    got = {r.claim_id: (r.n_hashes, r.n_foreign) for r in ND.foreign_counts(photos, photos, runs).collect()}
    assert got == {
        c: (sum(r[0] == c for r in rows), sum(r[0] != c and (at is None or r[3] <= at) for r in rows)) for c, at in run_at.items()
    }


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_keys_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    """Spark takes the keys of a hash for one row, so by its own count it would broadcast them all."""
    photos = frame(spark, crowd(6)).withColumn("seq", F.lit(1))
    codes = ND.stored(photos.select(ND.code(F.col("p_hash")).alias("code")).distinct(), "codes")
    for out in (ND.block_matches(codes, codes), ND.near_duplicates(photos), ND.within_claim(photos)):
        assert "BroadcastExchange" not in plan(out)
    index = PhotoIndex(spark, str(tmp_path / "index"), blocks=7, buckets=2)
    index.append(photos, 0)
    few = index_rows(index.duplicates(photos))
    monkeypatch.setattr(PI, "FEW_KEYS", 0)
    assert "BroadcastExchange" not in plan(index._blocks_met(codes)) + plan(index._groups_met(codes, PI._chunk_masks()))
    assert index_rows(index.duplicates(photos)) == few


def test_keys_of_a_small_batch_spare_the_archive_a_shuffle(spark, tmp_path):
    index = PhotoIndex(spark, str(tmp_path / "index"), blocks=7, buckets=2)
    photos = frame(spark, crowd(6))
    index.append(photos, 0)
    assert "BroadcastExchange" in plan(index._groups_met(photos.select(ND.code(F.col("p_hash")).alias("code")), [PI.WHOLE]))


@pytest.mark.parametrize("blocks, group", [(7, 5), (9, 7), (10, 1000)])
def test_hashes_of_a_busy_value_meet_in_parts(spark, monkeypatch, blocks, group):
    """Pairs equal brute force and come once, whatever is cut; a hash is not laid out by all its keys."""
    monkeypatch.setattr(ND, "GROUP_CODES", group)
    hashes = sorted({r[2] for r in crowd(31, n_copies=80)})
    number = {h: int(h, 2) - (1 << 64 if h[0] == "1" else 0) for h in hashes}
    asked, stored = hashes[::2], hashes[: len(hashes) * 2 // 3]
    table = lambda some: spark.createDataFrame([(number[h],) for h in some] + [(None,)], "code long")
    out = ND.block_matches(table(asked), table(stored), 6, blocks)
    assert "Generate" not in plan(out)
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(number[a], number[b], distance(a, b)) for a in asked for b in stored if distance(a, b) <= 6}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"))
    before = disk.getAllFiles().size()
    kept = ND.stored(rows.groupBy("k").count(), "left")
    until = time.time() + 20
    while disk.getAllFiles().size() > before and time.time() < until:
        time.sleep(0.2)
    assert disk.getAllFiles().size() <= before and kept.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"


def test_only_pictures_that_may_repeat_are_laid_out_by_bands(spark, monkeypatch):
    """Texts that are no hash can only equal each other; a claim of one picture, or of far ones, goes no further."""
    a = "01" * 32
    rows = [("A", "1", 1, "x"), ("A", "2", 2, "x"), ("A", "3", 3, "y"), ("A", "4", 4, None), ("A", "5", 5, None), ("A", "6", 6, "0" * 64), ("A", "7", 7, "0" * 64)]
    rows += [("B", "1", 1, a), ("C", "1", 1, a), ("C", "2", 2, flip(a, set(range(0, 64, 2)))), ("D", "1", None, a), ("D", "2", 1, flip(a, {9}))]
    kept = {}
    write = ND.stored
    monkeypatch.setattr(ND, "stored", lambda df, purpose: kept.setdefault(purpose, write(df, purpose)))
    out = ND.within_claim(spark.createDataFrame(rows, "claim_id string, file_id string, seq int, p_hash string"))
    assert sorted(map(tuple, out.collect())) == [("A", "2", "1", 0), ("A", "7", "6", 0), ("D", "2", "1", 1)]
    assert {r.claim_id for r in kept["claim-photos"].collect()} == {"A", "C", "D"}
    # a hash is a number where bands meet
    assert dict(kept["claim-hashes"].dtypes)["code"] == "bigint"


def test_the_stored_index_keeps_few_rows_of_a_hash(spark, tmp_path):
    """Two rows by halves, one for each block a choice can start with, and names once; a search of many and one of few agree."""
    index = PhotoIndex(spark, str(tmp_path / "index"), blocks=9, buckets=2)
    photos = frame(spark, crowd(8))
    index.append(photos, 0)
    n = photos.select("p_hash").distinct().count()
    count = lambda name, schema: index._read(name, schema).count()
    assert (count("groups", PI.GROUPS), count("blocks", PI.BLOCKS)) == (2 * n, 7 * n)
    assert count("entries", PI.ENTRIES) <= 2 * n
    assert {f.name for f in (tmp_path / "index").iterdir()} == {"entries", "groups", "blocks"}


def test_halves_that_many_share_do_not_meet_in_pairs(spark, tmp_path, monkeypatch):
    """Hashes that share a half, stored by two batches and asked for with new ones."""
    rng = random.Random(4)
    base = "".join(rng.choice("01") for _ in range(64))
    rows = [(f"C{i % 9}", f"F{i}", flip(base, {rng.randrange(30, 64) for _ in range(8)}), i) for i in range(40)]
    rows += [("D", f"G{i}", flip(r[2], {rng.randrange(64)}), 50 + i) for i, r in enumerate(rows[:15])]
    photos = frame(spark, rows)
    index = PhotoIndex(spark, str(tmp_path / "index"), buckets=3)
    index.append(photos.where("claim_id < 'C5'"), 0)
    index.append(photos.where("claim_id >= 'C3'"), 1)
    want = index_rows(ND.near_duplicates(photos))
    assert index_rows(index.duplicates(photos)) == want and any(r[2] == 1 for r in want)
    monkeypatch.setattr(PI, "FEW_KEYS", 0)
    assert index_rows(index.duplicates(photos)) == want


def test_pictures_without_a_time_count_among_the_two_earliest(spark, tmp_path):
    """They come first, and no run knows them: with one's own they are the two claims of a hash that are kept."""
    a = "01" * 32
    rows = [("A", "1", a, None), ("C", "2", a, 1), ("D", "3", a, 2)]
    run = spark.createDataFrame([("C", 9)], "claim_id string, r int").select("claim_id", F.timestamp_seconds("r").alias("run_at"))
    index = PhotoIndex(spark, str(tmp_path / "index"), buckets=2)
    index.append(frame(spark, rows), 0)
    assert index_rows(index.duplicates(frame(spark, rows), run)) == []
