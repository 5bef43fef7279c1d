"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints at most RADIUS bits apart agree on some blocks when the 64 bits
are cut into a few more blocks than RADIUS.  Each choice of agreeing blocks and
their value names a shard, and the members of a shard form one or more BK-trees
of bounded size: the children of a node are keyed by their Hamming distance to
it, and a search follows only edges within the radius.  A tree lives in the task
that its shard's fingerprints are sent to, so no tree and no list of
fingerprints passes through the driver.  A tree reports one link for each
member to its group's first member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallygrain.llm.links import components
from tallygrain.llm.shared import fresh, quoted, raw_texts, saved, tidy

SHINGLE = 3
SEED = 42
RADIUS = 3
TREE_SIZE = 4096  # members of one tree; a larger shard is cut into several
SHARD_AIM = 512  # blocks are chosen so that random fingerprints make shards of at most this size
LARGEST = 2**63 - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE, chunk: int = 1 << 16) -> int:
    """64 bits, each set when over half of the shingles' hashes have it set; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), chunk):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + chunk], ends[at : at + chunk])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row for every row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in raw_texts(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, fp long")


class Tree:
    """A BK-tree over 64-bit integers; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Indices of the members at most ``radius`` bits from ``x``."""
        todo = [0] if self.value else []
        while todo:
            node = todo.pop()
            d = (x ^ self.value[node]).bit_count()
            if d <= radius:
                yield node
            todo += [child for edge, child in self.children[node].items() if d - radius <= edge <= d + radius]

    def add(self, x: int) -> int:
        node, new = 0, len(self.value)
        self.value.append(x)
        self.children.append({})
        while new:
            d = (x ^ self.value[node]).bit_count()
            if d not in self.children[node]:
                self.children[node][d] = new
                break
            node = self.children[node][d]
        return new


def tree_links(values: list[int], members: list[bool], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (value, first value of its group) among one shard's values; rows that are no members only search."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree, at = Tree(), []
    for i in [j for j, m in enumerate(members) if m]:
        for node in tree.within(values[i], radius):
            root[find(i)] = find(at[node])
        tree.add(values[i])
        at.append(i)
    for i in [j for j, m in enumerate(members) if not m]:
        for node in tree.within(values[i], radius):
            root[find(i)] = find(at[node])
    return [(values[i], values[find(i)]) for i in range(len(values)) if find(i) != i]


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """One mask for every choice of blocks that values within the radius may all share."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(pick) for pick in combinations(one, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks whose shards hold SHARD_AIM random values at most; it changes layout, not results."""
    for blocks in range(radius + 1, 10):
        if n >> min(m.bit_count() for m in block_masks(blocks, radius)) <= SHARD_AIM:
            break
    return blocks


def links(values: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b) links that connect all distinct longs ``fp`` at most ``radius`` bits apart."""
    masks = block_masks(blocks_for(values.count(), radius), radius)
    keyed = values.select("fp", F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])).alias("pick", "mask"))
    keyed = keyed.select("fp", "pick", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    # a large shard is cut into trees; a member searches the trees before its own as well
    large = keyed.groupBy("pick", "part").count().where(F.col("count") > tree_size).select("pick", "part", F.ceil(F.col("count") / tree_size).alias("trees"))
    placed = keyed.join(large, ["pick", "part"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("trees", F.lit(1))))
    spread = placed.select("pick", "part", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("tree"))
    rows = spread.select("pick", "part", "tree", "fp", (F.col("own") == F.col("tree")).alias("member"))
    rows = rows.repartition("pick", "part", "tree").sortWithinPartitions("pick", "part", "tree", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _shards(batches):
            out = [pair for fp, member in shards for pair in tree_links(fp, member, radius)]
            if out:
                a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[list[int], list[bool]]]]:
    """Groups of two rows or more from rows sorted by shard and tree; the last group waits for the next batch."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        cols = [b[c].to_numpy(zero_copy_only=False) for c in ("pick", "part", "tree", "fp", "member")]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        n = len(cols[0])
        new = np.ones(n, bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        starts = np.flatnonzero(new)
        rest = [c[starts[-1] :] for c in cols] if n else None
        yield _groups(cols, starts)
    if rest is not None:
        yield _groups([*rest], np.array([0, len(rest[0])]))


def _groups(cols: list[np.ndarray], starts: np.ndarray) -> list[tuple[list[int], list[bool]]]:
    many = np.flatnonzero(np.diff(starts) > 1)
    fp, member = cols[3].astype(np.int64).view(np.uint64), cols[4]
    return [(fp[starts[i] : starts[i + 1]].tolist(), member[starts[i] : starts[i + 1]].tolist()) for i in many]


def hexadecimal(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id: one row for every row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows
    with a null doc_id take part; component_id is the smallest id that is not
    null, or null when no row of the group has one.  Equal fingerprints are one
    node, so copies are never compared.
    """
    rows = saved(fingerprints(docs), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    nodes = components(links(classes), "simhash").withColumnRenamed("node", "fp")
    linked = saved(classes.join(nodes, "fp"), "linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = linked.join(smallest, "root").select("fp", "component", F.lit(True).alias("linked"))
    every = classes.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(every, "fp").select("doc_id", "text_hash", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id", "fp")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the smallest doc_id, then the smallest text hash.

    Ids that are null lose against any other.  Of repeated rows one stays.
    """
    found = simhash_components(docs)
    # a group without any id is named by its fingerprint's smallest text hash alone, so it is kept apart by it
    place = F.coalesce("component_id", F.col("fp"))
    best = found.groupBy(F.col("component_id").isNull().alias("nameless"), place.alias("group")).agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(LARGEST)).alias("id"), "text_hash")).alias("best")
    )
    kept = best.select("best.id", "best.text_hash")
    a, b = fresh(docs.columns, "_id", "_th")
    keyed = docs.withColumns({a: F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)), b: F.xxhash64("text")})
    chosen = kept.select(F.col("id").alias(a), F.col("text_hash").alias(b)).distinct()
    return keyed.join(chosen, [a, b], "left_semi").dropDuplicates([a, b]).select(*quoted(docs.columns))
