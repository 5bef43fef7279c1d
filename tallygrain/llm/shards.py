"""Shards by k-d tree partitioning, with DataFrame functions alone.

Documents with equal texts are one unit that weighs its bytes.  A node of the
tree is split where its widest metadata dimension reaches the weighted median,
until every leaf holds its share of the bytes.  Medians are found by histograms:
each round sums weights in buckets between the bounds of every node and narrows
the bounds to the bucket that holds the cut, so a round moves a bounded number
of sums however many documents there are.  Ties on a dimension are cut on the
text's digest, and only a unit that alone weighs more than the slack is cut
inside, by its documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallygrain.llm.shared import saved

SHARDS = 8
BUCKETS = 256  # of a histogram, per node that is split
SLACK = 0.0005  # share of a leaf's target by which a cut may miss it
NUMBERED = 65_536  # documents that are numbered together
# what a cut compares after the widest dimension, in order
TIES = ("digest", "piece")


@dataclass
class Node:
    """A range of leaves and how its documents are told from its sibling's."""

    id: int
    first: int
    leaves: int
    dim: str = ""
    cut: list[int] = field(default_factory=list)  # values of (dimension, digest, piece); up to it goes left


def _dimensions() -> dict[str, Column]:
    """Metadata of a unit as whole numbers: size, mean length of its words, share of signs, number of line ends."""
    text, size = F.coalesce("text", F.lit("")), F.col("size")
    spaces = F.length(text) - F.length(F.translate(text, " ", ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    signs = F.length(text) - F.length(F.translate(text, ".,;:!?|#$%&*", ""))
    # logarithms, so that one very long text does not stretch a dimension
    scaled = lambda c: F.floor(F.log2(c + F.lit(1.0)) * 4096).cast("long")
    return {"d_size": scaled(size), "d_words": scaled(size * 16 / (spaces + 1)), "d_signs": scaled(signs * 1024 / size), "d_lines": scaled(lines * 4096 / size)}


def documents_with_units(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, the digest of the text and the document's number inside its unit."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", *[c.alias(n) for n, c in _dimensions().items()], F.xxhash64("text", "size").alias("digest"), F.xxhash64("doc_id").alias("piece"))


def _key(node: Node, level: int) -> Column:
    return F.col(node.dim) if level == 0 else F.col(TIES[level - 1])


def _right(node: Node) -> Column:
    """Whether a document lies beyond the node's cut."""
    beyond: Column = F.lit(False)
    for level in reversed(range(len(node.cut))):
        key, at = _key(node, level), F.lit(node.cut[level])
        beyond = (key > at) | ((key == at) & beyond)
    return beyond


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small local table without Python on its way."""
    made = F.array(*[F.struct(*[F.lit(v).cast("string" if isinstance(v, str) else "long").alias(n) for v, n in zip(r, names)]) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(made))


def _split(base: DataFrame, nodes: list[Node], target: float) -> None:
    """Find the dimension and the cut of every node; ``base`` has their documents with column node."""
    spark, dims = base.sparkSession, list(_dimensions())
    spans = base.groupBy("node").agg(*[F.min(d).alias(f"{d}_low") for d in dims], *[F.max(d).alias(f"{d}_high") for d in dims], F.sum("size").alias("bytes"))
    spans = {r["node"]: r for r in spans.collect()}  # one row per node
    todo: dict[int, dict] = {}
    for n in nodes:
        r = spans.get(n.id)
        n.dim = max(dims, key=lambda d: (r[f"{d}_high"] - r[f"{d}_low"], d)) if r else dims[0]
        if r is None:
            n.cut = [0]
            continue
        want = r["bytes"] * (n.leaves // 2) / n.leaves
        todo[n.id] = {"node": n, "want": want, "level": 0, "fixed": [], "low": r[f"{n.dim}_low"], "high": r[f"{n.dim}_high"]}
    while todo:
        # the value that a node's bounds are about, with equal values fixed at the levels before
        value, held = F.lit(None).cast("long"), F.lit(False)
        kinds = {}
        for s in todo.values():
            kinds.setdefault((s["node"].dim, s["level"]), []).append(s)
        bounds = _rows(spark, [(i, s["node"].dim, s["level"], s["low"], s["high"], *(s["fixed"] + [0, 0])[:2]) for i, s in sorted(todo.items())], ["node", "dim", "level", "low", "high", "fix0", "fix1"])
        rows = base.join(F.broadcast(bounds), "node")  # as many rows as nodes of a level
        for dim, level in kinds:
            mine = (F.col("dim") == dim) & (F.col("level") == level)
            key = F.col(dim) if level == 0 else F.col(TIES[level - 1])
            same = F.lit(True) if level == 0 else F.col(dim) == F.col("fix0")
            same = same & (F.col(TIES[0]) == F.col("fix1")) if level == 2 else same
            value, held = F.when(mine, key).otherwise(value), held | (mine & same)
        rows = rows.where(held).withColumn("value", value).where(F.col("value").between(F.col("low"), F.col("high")))
        step = (F.col("high").cast("decimal(20,0)") - F.col("low") + 1) / BUCKETS
        width = F.greatest(F.ceil(step), F.lit(1)).cast("decimal(20,0)")
        bucket = F.floor((F.col("value").cast("decimal(20,0)") - F.col("low")) / width).cast("int")
        # at most BUCKETS sums for each node of the level
        sums = rows.groupBy("node", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.min("value").alias("least"), F.max("value").alias("most"))
        found: dict[int, list] = {}
        for r in sums.collect():
            found.setdefault(r["node"], []).append(r)
        for i, s in list(todo.items()):
            _narrow(s, sorted(found.get(i, []), key=lambda r: r["bucket"]), target)
            if s["node"].cut:
                del todo[i]


def _narrow(s: dict, sums: list, target: float) -> None:
    """Move the bounds of one node to the bucket that holds its cut, or set the cut."""
    node, before = s["node"], s.get("before", 0)
    for r in sums:
        after = before + r["bytes"]
        if after >= s["want"]:
            break
        before = after
    else:
        node.cut = [*s["fixed"], s["high"]]
        return
    # near enough on one side of this bucket
    for total, at in ((after, r["most"]), (before, r["least"] - 1)):
        if abs(total - s["want"]) <= SLACK * target:
            node.cut = [*s["fixed"], at]
            return
    if r["least"] < r["most"]:
        s.update(low=r["least"], high=r["most"], before=before)
    elif s["level"] < len(TIES):
        # one value weighs too much: cut among its digests, then among the documents of one text
        s.update(level=s["level"] + 1, fixed=[*s["fixed"], r["least"]], low=-(1 << 63), high=(1 << 63) - 1, before=before)
    else:
        node.cut = [*s["fixed"], r["least"] - (s["want"] - before < after - s["want"])]  # the nearer side of one document


def kd_tree(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` with column shard: leaves of the tree, numbered from left to right."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    level, base = [Node(0, 0, shards)], rows.withColumns({"node": F.lit(0).cast("long"), "shard": F.lit(0)})
    count = 1
    while True:
        inner = [n for n in level if n.leaves > 1]
        if not inner:
            return base.drop("node")
        going = base.where(F.col("node").isin([n.id for n in inner])) if len(inner) < 1000 else base
        _split(going, inner, target)
        below, moves = [], []
        for n in inner:
            left, right = Node(count, n.first, n.leaves // 2), Node(count + 1, n.first + n.leaves // 2, n.leaves - n.leaves // 2)
            count += 2
            below += [left, right]
            known = (n.cut + [0, 0])[:3]
            moves.append((n.id, n.dim, len(n.cut), *known, left.id, right.id, left.first, right.first))
        names = ["node", "dim", "levels", "cut0", "cut1", "cut2", "left", "right", "left_first", "right_first"]
        moved = base.join(F.broadcast(_rows(rows.sparkSession, moves, names)), "node", "left")
        value = F.lit(None).cast("long")
        for d in _dimensions():
            value = F.when(F.col("dim") == d, F.col(d)).otherwise(value)
        third = (F.col("levels") > 2) & (F.col("piece") > F.col("cut2"))
        second = (F.col("levels") > 1) & ((F.col("digest") > F.col("cut1")) | ((F.col("digest") == F.col("cut1")) & third))
        beyond = (value > F.col("cut0")) | ((value == F.col("cut0")) & second)
        went = F.when(beyond, F.col("right")).otherwise(F.col("left"))
        first = F.when(beyond, F.col("right_first")).otherwise(F.col("left_first")).cast("int")
        base = moved.withColumns({"shard": F.when(F.col("dim").isNull(), F.col("shard")).otherwise(first), "node": F.when(F.col("dim").isNull(), F.col("node")).otherwise(went)})
        base = base.select(*rows.columns, "node", "shard")
        level = below


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with column slot: gapless numbers from 0 in every shard, in the order of id and digest inside hashed parts."""
    n = rows.count()
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(max(1, n // NUMBERED))))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("shard", "_part").orderBy("doc_id", "digest", "text_crc32")
    return rows.join(offsets, ["shard", "_part"]).withColumn("slot", (F.row_number().over(inside) - 1 + F.col("_before")).cast("long"))


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for every row of ``docs``.

    The law is ``bytes``: shards hold nearly equal bytes.  Documents with equal
    texts share all dimensions and the digest, so a cut leaves them together
    unless they alone outweigh its slack.  A null text weighs one byte, like an
    empty one.  Null ids and repeated rows are placed like others.
    """
    rows = saved(documents_with_units(docs), "shard-rows")
    placed = numbered(saved(kd_tree(rows, shards), "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
