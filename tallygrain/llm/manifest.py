"""A Merkle manifest of a dataset with a proof for every row, by butterfly exchange.

Leaves of one group (a source) stand in order and are cut into aligned blocks of
FANOUT^LEVELS leaves.  A block's task hashes its own subtree.  Then blocks
exchange roots round by round: in round r a block meets those whose number
differs from its own in the r-th digit to the base FANOUT only, all of the group
hash their common ancestor, and so every block ends with the root and with the
siblings on its own way up.  Nothing is sent down again.  A group of blocks that
is not a power of FANOUT is filled up with empty ones, which pass on what they
receive.  The subroots of all groups form a tree of the same kind above.

Places are counted along range partitions of the leaves, so that a source which
holds a third of all rows is numbered and hashed by many tasks.  What travels is
two digests a row, never a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallygrain.llm.shared import saved, tidy

FANOUT = 3
LEVELS = 7  # a block has FANOUT^LEVELS leaves


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """Byte count, colon and value; a hyphen for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, source, leaf, altered): digests of each row, and of the row as tampered with.

    Where 2 divides the crc32 of doc_id as text, line feeds go from the text;
    elsewhere, and where doc_id is null, ``altered`` equals ``leaf``.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return docs.select(
        # null comes first, then names in the order of their bytes
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(*own, F.col("text")).alias("leaf"),
        leaf(*own, cut).alias("altered"),
    )


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at``, the place (from 0) inside ``grp`` by the columns of ``order``, and ``n``, the group's
    size; and (grp, n) of every group.  Rows must differ in ``order``."""
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for g in b["grp"].to_pylist():
                n = n + 1 if g == last else 0
                last = g
                at.append(n)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*names, "part", "local"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    # written, so that numbers and parts stay together when a task is run again
    counted = saved(ranged.mapInArrow(tidy(count), f"{types}, part int, local long"), "manifest-places")
    whole = W.partitionBy("grp")
    # one row per range partition and group that meets it
    base = counted.groupBy("grp", "part").agg(F.count("*").alias("k"))
    before = F.sum("k").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = saved(base.select("grp", "part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("k").over(whole).alias("n")), "manifest-bases")
    rows = counted.join(base, ["grp", "part"]).withColumn("at", F.col("base") + F.col("local")).drop("part", "local", "base")
    return rows, base.select("grp", "n").distinct()


def climbed(nodes: list[str], levels: int | None) -> list[list[str]]:
    """Levels of a tree from its leaves up: so many, or until one node is left."""
    out = [nodes]
    while (len(out) <= levels) if levels is not None else (len(out[-1]) > 1):
        low = out[-1]
        out.append([digest(*low[i : i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return out


def way(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The siblings left and right of leaf ``i`` on each level below the top."""
    out = []
    for level in tree[:-1]:
        begin = i - i % FANOUT
        out.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + FANOUT])))
        i //= FANOUT
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


@dataclass
class Block:
    grp: str
    block: int
    whole: bool  # the only one of its group
    rows: list


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[Block]:
    """Rows of one block after the other from rows sorted by (grp, block); at most one block is held."""
    held: Block | None = None
    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("grp", "block", "whole", *names))):
            if held is None or (held.grp, held.block) != row[:2]:
                if held is not None:
                    yield held
                held = Block(*row[:3], [])
            held.rows.append(row[3:])
    if held is not None:
        yield held


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *order)


class Tree:
    """Trees over the groups of placed rows: (grp, leaf, at, n) and any other columns."""

    def __init__(self, rows: DataFrame, groups: DataFrame, levels: int = LEVELS) -> None:
        size = FANOUT**levels
        self.levels = levels
        most, self.rounds = -(-(groups.agg(F.max("n")).first()[0] or 0) // size), 0
        while most > FANOUT**self.rounds:
            self.rounds += 1
        blocks = F.ceil(F.col("n") / size).cast("long")
        # exact powers; a logarithm in floating point would not be
        rounds = sum(((F.col("blocks") > FANOUT**r).cast("int") for r in range(self.rounds)), F.lit(0))
        self.groups = groups.withColumn("blocks", blocks).withColumn("rounds", rounds)
        self.rows = rows.withColumn("whole", F.col("n") <= size).withColumn("block", F.floor(F.col("at") / size).cast("long"))
        self.ways = self._exchanged(self._roots())

    def _roots(self) -> DataFrame:
        """(grp, block, node): the root of each block's own subtree."""
        levels = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _blocks(batches, ["leaf"]):
                top = climbed([r[0] for r in b.rows], None if b.whole else levels)[-1][0]
                yield pa.RecordBatch.from_pydict({"grp": [b.grp], "block": [b.block], "node": [top]})

        return _dealt(self.rows.select("grp", "block", "whole", "at", "leaf"), "at").mapInArrow(tidy(run), "grp string, block long, node string")

    def _exchanged(self, roots: DataFrame) -> DataFrame:
        """(grp, block, whole, node, path): the group's root at every block, and the siblings from the block to it."""
        path = "array<struct<l:string,r:string>>"
        full = F.pow(F.lit(float(FANOUT)), F.col("rounds")).cast("long")
        empty = self.groups.where(full > F.col("blocks")).select("grp", F.explode(F.sequence("blocks", full - 1)).alias("block"), F.lit(None).cast("string").alias("node"))
        state = roots.unionByName(empty).join(self.groups.select("grp", "rounds"), "grp").withColumn("path", F.array().cast(path))
        for r in range(self.rounds):
            step = FANOUT**r
            digit = F.pmod(F.floor(F.col("block") / step), F.lit(FANOUT))
            state = state.withColumn("digit", digit.cast("int")).withColumn("meets", F.col("block") - F.col("digit") * step)
            # a block whose group is done meets itself alone; otherwise FANOUT blocks meet
            state = state.withColumn("meets", F.when(F.col("rounds") > r, F.col("meets")).otherwise(F.col("block")))
            met = F.sort_array(F.collect_list(F.struct("digit", "node")).over(W.partitionBy("grp", "meets")))
            state = state.withColumn("met", F.filter(met, lambda m: m["node"].isNotNull()))

            def nodes(keep) -> Column:
                return F.array_join(F.transform(F.filter("met", keep), lambda m: m["node"]), "")

            beside = F.struct(nodes(lambda m: m["digit"] < F.col("digit")).alias("l"), nodes(lambda m: m["digit"] > F.col("digit")).alias("r"))
            above = F.when(F.size("met") > 0, F.sha2(nodes(lambda m: F.lit(True)), 256))
            going = F.col("rounds") > r
            state = state.select(
                "grp",
                "block",
                F.when(going, above).otherwise(F.col("node")).alias("node"),
                "rounds",
                F.when(going, F.concat("path", F.array(beside))).otherwise(F.col("path")).alias("path"),
            )
            if r % 4 == 3:
                state = saved(state, "manifest-blocks")
        state = state.join(self.groups.select("grp", "blocks"), "grp").where(F.col("block") < F.col("blocks"))
        return saved(state.select("grp", "block", (F.col("blocks") == 1).alias("whole"), "node", "path"), "manifest-ways")

    def roots(self) -> DataFrame:
        """(grp, node): the root of each group."""
        return self.ways.where("block = 0").select("grp", "node")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified: one row for every row of ``docs``.

    A null in any column has its own sign in the leaf; null sources form the
    first group.  Within a source rows ascend by doc_id, null first; rows that
    share it ascend by their leaf, and rows that repeat whole are leaves of
    their own, next to each other.  An empty table has no rows and no root.
    """
    rows = saved(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    tree = Tree(*placed(rows, ["doc_id", "leaf", "row"]), levels)
    tops = tree.roots().select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("node").alias("leaf"))
    top = Tree(*placed(tops, ["name"]), levels)
    upper = _finished(top, ["name"], "grp string, name string, leaf string, root string, path array<struct<l:string,r:string>>", _upper)
    # one header per block before its leaves: the ways up travel once a block, not once a row
    heads = tree.ways.join(saved(upper, "manifest-upper").select(F.col("name").alias("grp"), "root", F.col("path").alias("more")), "grp")
    header = heads.select("grp", "block", "whole", F.col("node").alias("subroot"), "root", F.concat("path", "more").alias("path"))
    return _finished(tree, ["doc_id", "altered"], _RESULT, _results, header).select(
        "doc_id", F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1)).alias("source"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


_RESULT = "grp string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _finished(tree: Tree, extra: list[str], schema: str, emit, header: DataFrame | None = None) -> DataFrame:
    """Rows of ``emit`` for each block, from its header and its leaves."""
    levels = tree.levels
    own = tree.rows.select("grp", "block", "whole", "at", "leaf", *extra)
    header = tree.ways.select("grp", "block", "whole", F.col("node").alias("subroot"), F.col("node").alias("root"), "path") if header is None else header
    both = own.unionByName(header.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, ["subroot", "root", "path", "leaf", *extra]):
            subroot, root, path = b.rows[0][:3]
            path = [(p["l"], p["r"]) for p in path]
            nodes = [r[3:] for r in b.rows[1:]]
            below = climbed([n[0] for n in nodes], None if b.whole else levels)
            yield emit(b.grp, subroot, root, path, nodes, below)

    return _dealt(both, "at").mapInArrow(tidy(run), schema)


def _upper(grp: str, subroot: str, root: str, path: list, nodes: list, below: list) -> pa.RecordBatch:
    paths = [[{"l": a, "r": b} for a, b in way(below, i) + path] for i in range(len(nodes))]
    n = len(nodes)
    return pa.RecordBatch.from_arrays(
        [pa.array([grp] * n, pa.string()), pa.array([x[1] for x in nodes], pa.string()), pa.array([x[0] for x in nodes], pa.string()), pa.array([root] * n, pa.string()), pa.array(paths, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))],
        ["grp", "name", "leaf", "root", "path"],
    )


def _results(grp: str, subroot: str, root: str, path: list, nodes: list, below: list) -> pa.RecordBatch:
    out = []
    above = "".join(l + r for l, r in path)
    for i, (own, doc_id, altered) in enumerate(nodes):
        steps = way(below, i)
        proof = digest(*[l + r for l, r in steps], above)
        fold = folded(altered, steps + path)
        out.append((grp, doc_id, own, subroot, root, proof, fold, fold == root))
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.bool_()]
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
