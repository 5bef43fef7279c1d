"""Pictures that were used before: near-equal 64-bit perceptual hashes.

The question asked of every picture is whether *some* picture of another claim,
known by the time this claim was run, lies within six bits.  It is answered in
three tiers, each exact, each on fewer rows than the one before:

0. equal hashes: one aggregation per hash;
1. equal but for one chunk of at most six bits: one aggregation per masked
   hash.  Members of such a group are within six bits of each other by
   construction, so a crowd of near-copies is settled in linear time;
2. everything else: an index of block combinations.  Cut into ``b`` blocks, two
   hashes within ``t`` bits agree in some ``b - t`` of them, so looking at the
   bits of every such choice finds every pair.  More blocks make more and
   longer keys: fewer candidates for more work on each hash, so ``b`` follows the
   number of hashes (:func:`blocks_for`); it changes the work and not the result.
   The first block of a choice is one of the first ``t + 1``, so a hash is sent
   ``t + 1`` times, packed with others, and the rest of the choices is looked at
   where the hashes of one block value meet.

Hashes travel as 64-bit numbers.  The result has one row per flagged picture
with one witness, never the list of all pairs of a crowd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallygrain import constants as C
from tallygrain.functions import numeric as N
from tallygrain.operators.spread import first_per_key
from tallygrain.session import shuffles_removed, work_dir

# index rows of one (band, value) beyond which the bucket is split
BUCKET_ROWS = 50_000
# what meeting a candidate costs, measured in keys looked at
CANDIDATE_COST = 0.05
# hashes of one block value that one task holds at a time; busier values are dealt to several
GROUP_CODES = 1_000_000
# hashes that a task packs at a time, and pairs that it hands on at a time
PACK_CODES = 500_000
PAIRS_OUT = 100_000
ASKS, STORED = 1, 2  # what a hash is in a search; 3 is both


def band_widths(bands: int, bits: int = C.PHASH_BITS) -> list[int]:
    base, extra = divmod(bits, bands)
    return [base + (1 if i < extra else 0) for i in range(bands)]


def chunks(width: int, bits: int = C.PHASH_BITS) -> list[tuple[int, int]]:
    """(start, length) of consecutive chunks of at most ``width`` bits."""
    n = -(-bits // width)
    out, start = [], 0
    for length in band_widths(n, bits):
        out.append((start, length))
        start += length
    return out


def probe_masks(width: int, radius: int) -> list[int]:
    """All bit patterns of a band with at most ``radius`` bits set."""
    return [
        sum(1 << bit for bit in picked) for r in range(radius + 1) for picked in combinations(range(width), r)
    ]


def _band_values(bands: int) -> Column:
    """Array of (band, value) cut from the bit string ``p_hash``."""
    parts, start = [], 1
    for i, width in enumerate(band_widths(bands)):
        value = F.conv(F.substring("p_hash", start, width), 2, 10).cast("long")
        parts.append(F.struct(F.lit(i).alias("band"), value.alias("value")))
        start += width
    return F.array(*parts)


def photo_hashes(evidence: DataFrame) -> DataFrame:
    """Photos and satellite files with a usable hash."""
    return evidence.where(F.col("kind").isin(*C.IMAGE_KINDS) & N.is_bit_hash(F.col("p_hash"))).select(
        "claim_id", "file_id", "seq", "p_hash", "created_at"
    )


def _earliest_claims(members: DataFrame, key: str) -> DataFrame:
    """Earliest file of each of the one or two earliest claims of every key.

    ``members`` has the key, claim_id, file_id, created_at and hash.  Columns
    e1 and e2 are structs (created_at, claim_id, file_id, hash); e2 is null
    when only one claim uses the key.
    """
    first = (
        members.groupBy(key, "claim_id")
        .agg(F.min(F.struct("created_at", "file_id", "hash")).alias("e"))
        .select(key, "claim_id", "e.*")
    )
    ranked = first_per_key(first, [key], [F.col("created_at"), F.col("claim_id"), F.col("file_id")], 2)
    entry = F.struct("created_at", "claim_id", "file_id", "hash")
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, entry)).alias("e1"), F.max(F.when(F.col("rn") == 2, entry)).alias("e2")
    )


def _other(claim: Column, e1: Column, e2: Column) -> Column:
    """Earliest entry that belongs to another claim."""
    return F.when(e1["claim_id"] != claim, e1).otherwise(e2)


def _known(entry: Column, run_at: Column) -> Column:
    """The entry, if it was there when the claim was run."""
    return F.when(run_at.isNull() | (entry["created_at"] <= run_at), entry)


def _salted_index(index: DataFrame, bands: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Index rows by (band, value, salt) and the number of salts of busy buckets."""
    halves = {"other_hi": N.bits_high(F.col("p_hash")), "other_lo": N.bits_low(F.col("p_hash"))}
    rows = (
        index.withColumns(halves)
        .select("*", F.explode(_band_values(bands)).alias("bv"))
        .select("*", "bv.band", "bv.value")
        .drop("bv")
    )
    busy = (
        rows.groupBy("band", "value")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > bucket_rows)
        .select("band", "value", F.ceil(F.col("n") / bucket_rows).cast("int").alias("salts"))
    )
    return rows, busy


def band_matches(
    probes: DataFrame,
    index: DataFrame,
    threshold: int = C.PHASH_CROSS,
    bands: int = 4,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Join of distinct probe hashes to index hashes within ``threshold`` bits.

    ``probes`` has p_hash; ``index`` has p_hash and any other columns.  A pair
    may appear once per band it agrees in, so the result must be folded with an
    idempotent aggregate such as ``min``.
    """
    radius = threshold // bands
    rows, busy = _salted_index(index, bands, bucket_rows)
    # at most (index rows x bands / bucket_rows) buckets can be busy; Spark
    # broadcasts this table only while it is below its size limit
    rows = (
        rows.join(busy, ["band", "value"], "left")
        .withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("p_hash"), "salts")).cast("int"))
        .drop("salts")
    )
    widths = band_widths(bands)
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in probe_masks(w, radius)]) for w in widths])
    # probes are laid out 68-fold, so they travel as two numbers, not as text
    asked = (
        # a step of its own: next to explode they would be worked out per exploded row
        probes.select("p_hash").withColumns({"hi": N.bits_high(F.col("p_hash")), "lo": N.bits_low(F.col("p_hash"))})
        .select("hi", "lo", F.explode(_band_values(bands)).alias("bv"))
        .select("hi", "lo", "bv.band", "bv.value")
        .withColumn("mask", F.explode(F.element_at(masks, F.col("band") + 1)))
        .select("hi", "lo", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        .join(busy, ["band", "value"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        .drop("salts")
    )
    rows = rows.withColumnRenamed("p_hash", "other_hash")
    distance = N.hamming_halves(F.col("hi"), F.col("lo"), F.col("other_hi"), F.col("other_lo"))
    return (
        asked.join(rows, ["band", "value", "salt"])
        .withColumn("distance", distance)
        .where(F.col("distance") <= threshold)
        .withColumn("p_hash", N.bit_text(F.col("hi"), F.col("lo")))
        .drop("hi", "lo", "other_hi", "other_lo", "band", "value", "salt")
    )


def code(p_hash: Column) -> Column:
    """A bit string as a 64-bit number."""
    return F.shiftleft(N.bits_high(p_hash), 32).bitwiseOR(N.bits_low(p_hash))


def _blocks(blocks: int, bits: int = C.PHASH_BITS) -> list[tuple[int, int]]:
    """(start, width) of every block, from the lowest bit."""
    cuts = [0]
    for width in band_widths(blocks, bits):
        cuts.append(cuts[-1] + width)
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_masks(blocks: int, threshold: int, bits: int = C.PHASH_BITS) -> list[int]:
    """For every choice of ``blocks - threshold`` blocks the bits it looks at."""
    if not threshold < blocks <= bits:
        raise ValueError("there must be more blocks than bits that may differ")
    one = [((1 << width) - 1) << start for start, width in _blocks(blocks, bits)]
    return [sum(pick) for pick in combinations(one, blocks - threshold)]


def blocks_for(n: int, threshold: int = C.PHASH_CROSS, bits: int = C.PHASH_BITS) -> int:
    """The number of blocks at which ``n`` evenly spread hashes cost least: keys a hash, and candidates it meets."""

    def cost(blocks: int) -> float:
        keys, told = comb(blocks, threshold), min(m.bit_count() for m in block_masks(blocks, threshold, bits))
        return keys + CANDIDATE_COST * keys * n / 2**told

    return min(range(threshold + 1, threshold + 5), key=cost)


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keys(c: Column, masks: list[int]) -> Column:
    """Array with one key for each mask; different masks make different keys."""
    return F.transform(F.array(*[F.lit(m).cast("long") for m in _signed(masks)]), lambda m: F.xxhash64(c.bitwiseAND(m), m))


def block_keys(c: Column, blocks: int, threshold: int = C.PHASH_CROSS) -> Column:
    """One key for each choice of blocks."""
    return _keys(c, block_masks(blocks, threshold))


def first_block_keys(c: Column, blocks: int, threshold: int = C.PHASH_CROSS) -> Column:
    """One key for each block that a choice can start with."""
    if not threshold < blocks <= C.PHASH_BITS:
        raise ValueError("there must be more blocks than bits that may differ")
    return _keys(c, [((1 << width) - 1) << start for start, width in _blocks(blocks)[: threshold + 1]])


def _packed(blocks: int, threshold: int, tiles: dict[tuple[int, int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (code, kind) as rows (block, value, tile, codes, kinds): hashes that share the bits of one of the first blocks.

    ``tiles`` says into how many parts a busy value is cut; every part that asks meets every part that is stored.
    """
    first = _blocks(blocks)[: threshold + 1]

    def rows(block: int, value: np.ndarray, tile: np.ndarray, sizes: np.ndarray, codes: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        many = lambda data, width: pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends * np.int32(width)), pa.py_buffer(data)])
        columns = [pa.array(x.astype(np.int32)) for x in (np.full(len(sizes), block), value, tile)]
        return pa.RecordBatch.from_arrays([*columns, many(codes, 8), many(kinds, 1)], names=["block", "value", "tile", "codes", "kinds"])

    def flush(codes: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block, (start, width) in enumerate(first):
            value = (codes >> np.uint64(start)) & np.uint64((1 << width) - 1)
            busy = [v for b, v in tiles if b == block]
            quiet = ~np.isin(value, np.array(busy, np.uint64)) if busy else slice(None)
            found, part, part_kinds = value[quiet], codes[quiet], kinds[quiet]
            order = np.argsort(found, kind="stable")
            values, sizes = np.unique(found, return_counts=True)
            yield rows(block, values, np.zeros(len(values)), sizes, part[order], part_kinds[order])
            for v in busy:
                n, here = tiles[block, v], value == np.uint64(v)
                part, part_kinds = codes[here], kinds[here]
                of = (part * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(n)
                for a in range(n):
                    for b in range(n):
                        kind = (part_kinds & ASKS) * (of == a) | (part_kinds & STORED) * (of == b)
                        mine = kind > 0
                        yield rows(block, np.array([v]), np.array([a * n + b]), np.array([mine.sum()]), part[mine], kind[mine])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch["code"].to_numpy(zero_copy_only=False).view(np.uint64), batch["kind"].to_numpy(zero_copy_only=False).astype(np.uint8)))
            if sum(len(c) for c, _ in held) >= PACK_CODES:
                yield from flush(*(np.concatenate(x) for x in zip(*held)))
                held = []
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return pack


def near_pairs(codes: np.ndarray, kinds: np.ndarray, block: int, blocks: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, other, distance) of different hashes within ``threshold`` bits, where ``block`` is the first in which they agree.

    All ``codes`` agree in that block and differ from each other.  Each pair comes once, with the choice of the first
    blocks in which it agrees.  Of a run of hashes that agree in a choice every one meets the next, the one after it and
    so on, so memory follows the number of hashes and not that of pairs.
    """
    if not (kinds & ASKS).any() or not (kinds & STORED).any():
        return
    cut = _blocks(blocks)
    bits = [np.uint64(((1 << width) - 1) << start) for start, width in cut]
    for rest in combinations(range(block + 1, blocks), blocks - threshold - 1):
        differ = [bits[k] for k in range(max((block, *rest))) if k != block and k not in rest]
        if sum(cut[k][1] for k in rest) <= 16:
            key, at = np.zeros(len(codes), np.uint64), 0
            for start, width in (cut[k] for k in rest):
                key |= ((codes >> np.uint64(start)) & np.uint64((1 << width) - 1)) << np.uint64(at)
                at += width
            key = key.astype(np.uint16)  # sorted by digits
        else:
            key = codes & np.bitwise_or.reduce([bits[k] for k in rest])
        order = np.argsort(key, kind="stable")
        key, sorted_, kind = key[order], codes[order], kinds[order]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        left, step = np.arange(len(key)), 0
        while True:
            step += 1
            left = left[end[left] > left + step]
            if not len(left):
                break
            apart = sorted_[left] ^ sorted_[left + step]
            distance = np.bitwise_count(apart)
            hit = np.flatnonzero(distance <= threshold)
            for mask in differ:
                hit = hit[(apart[hit] & mask) != 0]
            one, two = left[hit], left[hit] + step
            for a, b in ((one, two), (two, one)):
                wanted = ((kind[a] & ASKS) > 0) & ((kind[b] & STORED) > 0)
                if wanted.any():
                    yield sorted_[a[wanted]], sorted_[b[wanted]], distance[hit[wanted]]


def _met(blocks: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows, sorted by block, value and tile, as pairs."""

    def out(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code_, other, distance = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(code_.view(np.int64)), pa.array(other.view(np.int64)), pa.array(distance.astype(np.int32))], names=["code", "other", "distance"]
        )

    def pairs(key: tuple[int, int, int], parts: list[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        codes, kinds = (np.frombuffer(b"".join(x), dtype) for x, dtype in zip(zip(*parts), (np.uint64, np.uint8)))
        yield from near_pairs(codes, kinds, key[0], blocks, threshold)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[tuple[bytes, bytes]]]]:
        last, parts = None, []
        for batch in batches:
            for *key, codes, kinds in zip(*(batch[c] for c in ("block", "value", "tile", "codes", "kinds"))):
                key = tuple(k.as_py() for k in key)
                if key != last and parts:
                    yield last, parts
                    parts = []
                last = key
                parts.append((codes.as_buffer().to_pybytes(), kinds.as_buffer().to_pybytes()))
        if parts:
            yield last, parts

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for key, parts in groups(batches):
            for found in pairs(key, parts):
                held.append(found)
                n += len(found[0])
                if n >= PAIRS_OUT:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return meet


def _counted(blocks: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (code) as rows (block, value, n), one for each value of the first blocks."""
    first = _blocks(blocks)[: threshold + 1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << width, np.int64) for _, width in first]
        for batch in batches:
            codes = batch["code"].to_numpy(zero_copy_only=False).view(np.uint64)
            for total, (start, width) in zip(totals, first):
                total += np.bincount(((codes >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
        for block, total in enumerate(totals):
            values = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), block, np.int32)), pa.array(values.astype(np.int32)), pa.array(total[values])], names=["block", "value", "n"]
            )

    return count


def block_matches(probes: DataFrame, index: DataFrame, threshold: int = C.PHASH_CROSS, blocks: int | None = None) -> DataFrame:
    """(code, other, distance): numbers of ``probes`` and of ``index`` within ``threshold`` bits, each pair once.

    A hash is sent once for each of the first ``threshold + 1`` blocks, packed with
    those of the same value into 9 bytes a hash, and meets them in one task
    (``near_pairs``).  A value of more than GROUP_CODES hashes is cut into parts that
    meet two by two, so no task holds more than two parts.  The driver gathers the
    counts of busy values: at most one for each value of a block.
    """
    kind = lambda df, what: df.where(F.col("code").isNotNull()).select("code", F.lit(what).cast("tinyint").alias("kind"))
    every = kind(probes, ASKS).unionByName(kind(index, STORED)).groupBy("code").agg(F.bit_or("kind").alias("kind"))
    every = stored(every, "codes-met")
    n = every.count()
    blocks = blocks or blocks_for(n, threshold)
    if not threshold < blocks <= C.PHASH_BITS:
        raise ValueError("there must be more blocks than bits that may differ")
    counts = every.select("code").mapInArrow(_counted(blocks, threshold), "block int, value int, n long")
    busy = counts.groupBy("block", "value").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP_CODES).collect()
    tiles = {(r["block"], r["value"]): -(-r["n"] // GROUP_CODES) for r in busy}
    packed = every.mapInArrow(_packed(blocks, threshold, tiles), "block int, value int, tile int, codes binary, kinds binary")
    key = ["block", "value", "tile"]
    # one number for all groups: they are few bytes and much work, which merging by size does not see
    tasks = max(2 * every.sparkSession.sparkContext.defaultParallelism, -(-n * (threshold + 1) // GROUP_CODES))
    met = packed.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(_met(blocks, threshold), "code long, other long, distance int")
    same = every.where(F.col("kind") == (ASKS | STORED)).select("code", F.col("code").alias("other"), F.lit(0).alias("distance"))
    return met.unionByName(same)


def hash_pairs(hashes: DataFrame, threshold: int = C.PHASH_CROSS, blocks: int | None = None) -> DataFrame:
    """How many other distinct hashes lie within the threshold, and the nearest.

    One row per distinct hash that has a neighbour.
    """
    distinct = hashes.select("p_hash").distinct().select(code(F.col("p_hash")).alias("code"))
    found = block_matches(distinct, distinct, threshold, blocks).where(F.col("code") != F.col("other"))
    # bit strings sort as unsigned numbers
    order = F.struct("distance", F.col("other") < 0, "other")
    near = found.groupBy("code").agg(
        F.count("*").alias("n_neighbours"), F.min("distance").alias("least_distance"), F.min_by("other", order).alias("nearest")
    )
    text = lambda c: N.bit_text(F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(0xFFFFFFFF))
    return near.select(text("code").alias("p_hash"), "n_neighbours", "least_distance", text("nearest").alias("nearest_hash"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A table in the shared folder, written once for the several branches that read it."""
    path = work_dir(df.sparkSession, purpose)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunk_masks() -> list[tuple[int, int]]:
    """(half, mask) for every chunk: the bits outside the chunk, and those of the half without it; as signed numbers."""
    whole = (1 << C.PHASH_BITS) - 1
    cut = min((start for start, _ in chunks(C.PHASH_CROSS)), key=lambda start: abs(start - C.PHASH_BITS // 2))
    low = (1 << (C.PHASH_BITS - cut)) - 1
    rest = [(low if start < cut else whole - low, whole - (((1 << n) - 1) << (C.PHASH_BITS - start - n))) for start, n in chunks(C.PHASH_CROSS)]
    return [*zip(_signed([h for h, _ in rest]), _signed([m for _, m in rest]))]


def masked(masks: list[int]) -> Column:
    """One row (mask, bits) for every mask of a hash ``code``."""
    each = F.array(*[F.lit(m).cast("long") for m in masks])
    return F.explode(F.transform(each, lambda m: F.struct(m.alias("mask"), F.col("code").bitwiseAND(m).alias("bits"))))


def halves(codes: DataFrame) -> DataFrame:
    """(code, mask, bits): each hash by either half."""
    return codes.select("code", masked(sorted({h for h, _ in chunk_masks()})).alias("m")).select("code", "m.mask", "m.bits")


def by_chunk(halved: DataFrame) -> DataFrame:
    """(code, mask, bits): hashes by the bits outside each chunk that is not in the half of their row."""
    masks: dict[int, list[int]] = {}
    for half, mask in chunk_masks():
        masks.setdefault(half, []).append(mask)
    each = [halved.where(F.col("mask") == half).select("code", masked(rest).alias("m")) for half, rest in masks.items()]
    return each[0].unionByName(each[1]).select("code", "m.mask", "m.bits")


def near_duplicates(photos: DataFrame, runs: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Flagged pictures: claim_id, file_id, tier, match_claim_id, match_file_id, distance.

    ``photos`` has claim_id, file_id, p_hash, created_at.  ``runs`` has claim_id
    and run_at: only pictures stored by then count.  Without ``runs`` the
    comparison is symmetric.  The witness is the earliest picture of another
    claim in the lowest tier that has one.
    """
    extra = ["seq"] if "seq" in photos.columns else []
    # read by every tier, so written once
    photos = stored(photos.select("claim_id", "file_id", *extra, code(F.col("p_hash")).alias("code"), "created_at"), "photo-codes")
    index = stored(_earliest_claims(photos.withColumn("hash", F.col("code")), "code"), "photo-index")

    # the question is the same for all files of a claim that share a hash
    asked = photos.select("code", "claim_id").distinct()
    if runs is None:
        asked = asked.withColumn("run_at", F.lit(None).cast("timestamp"))
    else:
        asked = asked.hint("merge").join(runs.select("claim_id", "run_at"), "claim_id")

    def entry() -> Column:
        return _known(_other(F.col("claim_id"), F.col("e1"), F.col("e2")), F.col("run_at"))

    # tier 0: equal hashes
    # (merge: by the packed size of its files Spark takes a stored table for small enough to send to the driver)
    first = asked.hint("merge").join(index.where(F.col("e2").isNotNull()), "code", "left").withColumn("hit", entry()).drop("e1", "e2")
    first = stored(first, "photo-equal")
    settled0 = first.where(F.col("hit").isNotNull()).select("claim_id", "code", F.lit(0).alias("tier"), "hit")
    open0 = first.where(F.col("hit").isNull()).drop("hit")

    # tier 1: equal but for one chunk of at most six bits
    # such hashes share the half without the chunk, so only those that share a half are laid out by chunks
    halved = halves(index)
    crowded = halved.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    keys = by_chunk(stored(halved.hint("merge").join(crowded, ["mask", "bits"], "left_semi"), "photo-halves"))
    # few groups have more than one hash, and only their members' claims are looked at
    shared = keys.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    # as in block_matches: the exploded rows are many more than Spark thinks
    members = stored(keys.hint("merge").join(shared, ["mask", "bits"]).withColumn("masked", F.struct("mask", "bits")).select("code", "masked"), "photo-groups")
    # the two earliest claims of a hash are enough, so a crowd sends two rows per hash
    claims = (
        members.hint("merge").join(index, "code")
        .select("masked", F.explode(F.array_compact(F.array("e1", "e2"))).alias("e"))
        .select("masked", "e.*")
    )
    groups = _earliest_claims(claims, "masked").where(F.col("e2").isNotNull())
    # a hash has one group for each chunk at most
    near = members.hint("merge").join(groups, "masked").groupBy("code").agg(F.collect_list(F.struct("e1", "e2")).alias("groups"))
    hits = F.transform("groups", lambda g: _known(_other(F.col("claim_id"), g["e1"], g["e2"]), F.col("run_at")))
    second = open0.hint("merge").join(near, "code", "left").select("claim_id", "code", "run_at", F.array_min(hits).alias("hit1"))
    second = stored(second, "photo-chunks")

    # tier 2: block combinations, for hashes that are still open
    probes = second.where(F.col("hit1").isNull()).select("code").distinct()
    found = block_matches(probes, index, C.PHASH_CROSS, blocks).where(F.col("code") != F.col("other"))
    # two claims per probe are enough to leave out one's own
    entries = (
        found.join(index.select(F.col("code").alias("other"), "e1", "e2").hint("merge"), "other")
        .select("code", F.explode(F.array_compact(F.array("e1", "e2"))).alias("e"))
        .groupBy("code", F.col("e.claim_id").alias("claim_id"))
        .agg(F.min("e").alias("e"))
    )
    pair = (
        first_per_key(entries, ["code"], [F.col("e")], 2)
        .groupBy("code")
        .agg(
            F.max(F.when(F.col("rn") == 1, F.col("e"))).alias("e1"),
            F.max(F.when(F.col("rn") == 2, F.col("e"))).alias("e2"),
        )
    )
    third = second.hint("merge").join(pair, "code", "left").withColumn("hit2", F.when(F.col("hit1").isNull(), entry()))
    settled = third.select(
        "claim_id",
        "code",
        F.when(F.col("hit1").isNotNull(), 1).otherwise(2).alias("tier"),
        F.coalesce("hit1", "hit2").alias("hit"),
    ).where(F.col("hit").isNotNull())

    flagged = photos.hint("merge").join(settled0.unionByName(settled), ["claim_id", "code"])
    return flagged.select(
        "claim_id",
        "file_id",
        *extra,
        "tier",
        F.col("hit.claim_id").alias("match_claim_id"),
        F.col("hit.file_id").alias("match_file_id"),
        F.bit_count(F.col("code").bitwiseXOR(F.col("hit.hash"))).alias("distance"),
    )


def within_claim(photos: DataFrame, seq: str = "seq", threshold: int = C.PHASH_WITHIN) -> DataFrame:
    """Pictures of one claim that nearly equal an earlier picture of it.

    For information only.  One row per later picture, with the nearest earlier
    one (ties: the first).  An equal picture's nearest is the first of its hash,
    so copies never meet; bands of the hash join the key, so the different
    pictures of a large claim do not all meet either.  Claims with one picture
    are left out first, then those of which no two hashes share a band.
    """
    # a hash travels as a number; texts that are none can only equal each other
    usable = N.is_bit_hash(F.col("p_hash"))
    rows = photos.select(
        "claim_id", "file_id", F.col(seq).alias("_seq"),
        F.when(F.col("p_hash").isNotNull(), F.when(usable, code(F.col("p_hash"))).otherwise(F.lit(0))).alias("code"),
        F.when(usable, F.lit("")).otherwise(F.col("p_hash")).alias("_text"),
    )
    several = photos.groupBy("claim_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("claim_id")
    rows = stored(rows.hint("merge").join(several, "claim_id", "left_semi"), "claim-photos")
    same = ["claim_id", "code", "_text"]
    firsts = stored(rows.groupBy(*same).agg(F.min(F.struct("_seq", "file_id")).alias("_first"), F.count("*").alias("n")), "claim-hashes")
    mine = F.struct("_seq", "file_id")
    again = firsts.where(F.col("n") > 1).select(*same, "_first")
    copies = rows.hint("merge").join(again, same).where(mine > F.col("_first"))
    equal = copies.select("claim_id", "file_id", F.col("_first.file_id").alias("earlier_file_id"), F.lit(0).alias("distance"))

    hashes = firsts.where(F.col("_text") == "").select("claim_id", "_first", "code")
    masks = _signed([((1 << width) - 1) << start for start, width in _blocks(threshold + 1)])
    bands = lambda df, *kept: df.select(*kept, "code", masked(masks).alias("band"))
    shared = bands(hashes, "claim_id").groupBy("claim_id", "band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    hashes = hashes.hint("merge").join(shared.select("claim_id").distinct(), "claim_id", "left_semi")
    later = bands(hashes, "claim_id", "_first")
    earlier = later.select("claim_id", "band", F.col("_first").alias("_earlier"), F.col("code").alias("_earlier_code"))
    near = (
        later.join(earlier.hint("merge"), ["claim_id", "band"])
        .where(F.col("_first") > F.col("_earlier"))
        .withColumn("distance", F.bit_count(F.col("code").bitwiseXOR(F.col("_earlier_code"))))
        .where(F.col("distance") <= threshold)
        .groupBy("claim_id", "_first")
        .agg(F.min(F.struct("distance", "_earlier")).alias("m"))
        .select("claim_id", F.col("_first.file_id").alias("file_id"), F.col("m._earlier.file_id").alias("earlier_file_id"), "m.distance")
    )
    return equal.unionByName(near)


def foreign_counts(photos: DataFrame, own: DataFrame, runs: DataFrame) -> DataFrame:
    """claim_id, n_hashes (its pictures in ``own``), n_foreign (pictures of other claims in ``photos`` that its run could see).

    Pictures are counted per moment and summed in order within each day, then
    over the days, so no task sees more than the moments of a day.  Without a
    time of the run all pictures count.
    """
    marks = photos.groupBy(F.col("created_at").alias("at")).agg(F.count("*").alias("n"))
    asked = runs.where(F.col("run_at").isNotNull()).select(F.col("run_at").alias("at"), F.lit(0).cast("long").alias("n")).distinct()
    rows = marks.where(F.col("at").isNotNull()).unionByName(asked).withColumn("day", F.to_date("at"))
    until = W.partitionBy("day").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    # one row a day
    days = rows.groupBy("day").agg(F.sum("n").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    seen = rows.withColumn("inside", F.sum("n").over(until)).join(before, "day").groupBy(F.col("at").alias("run_at")).agg(
        F.max(F.col("inside") + F.col("before")).alias("n_seen")
    )
    total = photos.agg(F.lit(None).cast("timestamp").alias("run_at"), F.count("*").alias("n_seen"))
    seen = seen.unionByName(total).withColumnRenamed("run_at", "_at")
    known = F.col("run_at").isNull() | (F.col("created_at") <= F.col("run_at"))
    mine = own.join(runs, "claim_id").groupBy("claim_id").agg(F.count("*").alias("n_hashes"), F.count_if(known).alias("n_own"))
    per_claim = runs.join(seen, F.col("run_at").eqNullSafe(F.col("_at")), "left").join(mine, "claim_id", "left")
    n_foreign = F.coalesce("n_seen", F.lit(0)) - F.coalesce("n_own", F.lit(0))
    return per_claim.select("claim_id", F.coalesce("n_hashes", F.lit(0)).alias("n_hashes"), n_foreign.alias("n_foreign"))


def shared_files(evidence: DataFrame) -> DataFrame:
    """File digests found under more than one claim (off in the verdict)."""
    return (
        evidence.where(F.col("sha256").isNotNull())
        .groupBy("sha256", "claim_id")
        .agg(F.count("*").alias("n"))
        .groupBy("sha256")
        .agg(F.count("*").alias("n_claims"), F.sum("n").alias("n_files"), F.min("claim_id").alias("first_claim_id"))
        .where(F.col("n_claims") > 1)
    )
