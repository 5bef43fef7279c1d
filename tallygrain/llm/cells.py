"""Embedding near-duplicates by spherical k-means cells.

Unit vectors of one label are assigned to the cell of the nearest centroid, and
vectors are compared inside cells only.  A vector also visits a cell beyond the
border when a partner at the threshold could live there: its distance to the
plane between both centroids is at most the sine of the greatest allowed angle.
That bound is exact, so cells lose no pair.  Cells are cut into blocks of
bounded size; a block is held as a matrix, the vectors that meet it stream past
in batches, and only counts and one link to the group's first member leave.

The centroids are fitted on a bounded sample (SAMPLE vectors per cell, MAX_CELLS
cells in all); every vector is assigned and compared.  Equal vectors are folded
to one before anything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallygrain.llm.links import components
from tallygrain.llm.shared import saved, tidy

SIMILARITY = 0.98
CELL = 512  # vectors that a cell should hold
MAX_CELLS = 4096
SAMPLE = 16
BLOCK = 2048
ROUNDS = 12


def comparable(v: Column, label: Column, key: Column) -> Column:
    """Whether a vector may link: key and label there, all components finite, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(key.isNotNull() & label.isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one in double precision."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(1, keepdims=True)  # squares stay in range
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def spherical_kmeans(u: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of unit length; an empty cell keeps its centroid."""
    k = min(k, len(u))
    c = u[np.sort(np.random.default_rng(seed).choice(len(u), k, replace=False))].copy()
    for _ in range(rounds):
        home = (u @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, u)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def fit(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by (label, dimension) for the groups that need more than one cell."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / CELL), F.floor(F.col("n") * MAX_CELLS / max(total, 1)))).alias("cells")
    large = sizes.select("label", "dim", "n", share).where(F.col("cells") > 1)  # at most MAX_CELLS / 2 groups
    part = F.least(F.lit(1.0), SAMPLE * F.col("cells") / F.col("n"))
    drawn = classes.join(F.broadcast(large), ["label", "dim"]).where(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < part * 1_000_000)
    rows = drawn.select("label", "dim", "cells", "vec").toArrow()
    found: dict[tuple[int, int], np.ndarray] = {}
    if rows.num_rows:
        keys = list(zip(rows["label"].to_pylist(), rows["dim"].to_pylist(), rows["cells"].to_pylist()))
        vectors = rows["vec"].combine_chunks()
        for key in sorted(set(keys)):
            at = pa.array([i for i, x in enumerate(keys) if x == key])
            found[key[:2]] = spherical_kmeans(unit(vectors.take(at), key[1]), key[2])
    return found


def assigned(classes: DataFrame, similarity: float) -> DataFrame:
    """label, dim, cid, weight, vec with the home cell and the later cells that each vector visits."""
    centroids = classes.sparkSession.sparkContext.broadcast(fit(classes))
    reach = math.sqrt(1 - similarity * similarity) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart: dict = {}
        for b in batches:
            home, visits = np.zeros(b.num_rows, np.int32), [[]] * b.num_rows
            keys = list(zip(b["label"].to_pylist(), b["dim"].to_pylist()))
            for key in set(keys) & centroids.value.keys():
                c = centroids.value[key]
                if key not in apart:
                    apart[key] = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
                at = np.array([i for i, x in enumerate(keys) if x == key])
                s = unit(b["vec"].take(pa.array(at)), key[1]) @ c.T
                own = s.argmax(1)
                home[at] = own
                near = s[np.arange(len(at)), own][:, None] - s <= apart[key][own] * reach + 1e-9
                near &= np.arange(len(c))[None, :] > own[:, None]  # each pair of cells meets in the later one
                for i, row in zip(at, near):
                    visits[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("label", "dim", "cid", "weight", "vec")), pa.array(home), pa.array(visits, pa.list_(pa.int32()))],
                ["label", "dim", "cid", "weight", "vec", "home", "visits"],
            )

    kind = dict(classes.dtypes)
    return classes.select("label", "dim", "cid", "weight", "vec").mapInArrow(
        tidy(run), f"label {kind['label']}, dim int, cid long, weight long, vec {kind['vec']}, home int, visits array<int>"
    )


def meetings(placed: DataFrame) -> DataFrame:
    """One row per vector and block that it belongs to (role 0) or is compared with (role 1)."""
    sizes = placed.groupBy("label", "dim", "home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnRenamed("home", "cell").where("blocks > 1")
    own = placed.join(sizes.withColumnRenamed("cell", "home"), ["label", "dim", "home"], "left")
    own = own.withColumn("own", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))))
    at_home = own.select("label", "dim", F.col("home").alias("cell"), "cid", "weight", "vec", "own", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("block"))
    at_home = at_home.withColumn("role", (F.col("block") < F.col("own")).cast("int")).drop("own")
    away = placed.select("label", "dim", "cid", "weight", "vec", F.explode("visits").alias("cell")).join(sizes, ["label", "dim", "cell"], "left")
    away = away.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks").withColumn("role", F.lit(1))
    return at_home.unionByName(away)


class Block:
    """One block's members, and what has been found about them."""

    def __init__(self, key: tuple) -> None:
        self.key, self.parts, self.m = key, [], None

    def add(self, cid: np.ndarray, weight: np.ndarray, u: np.ndarray) -> None:
        self.parts.append((cid, weight, u))

    def close(self, similarity: float) -> None:
        """Compare the members with each other."""
        if self.m is not None:
            return
        self.cid, self.weight, self.m = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1)))
        self.root = np.arange(len(self.cid))
        self.count = np.zeros(len(self.cid), np.int64)
        if len(self.cid):
            near = self.m @ self.m.T >= similarity
            np.fill_diagonal(near, False)
            self.count = near @ self.weight
            for i in np.flatnonzero(near.any(1)):
                self.join(np.append(np.flatnonzero(near[i]), i))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, members: np.ndarray) -> int:
        roots = {self.find(i) for i in members}
        least = min(roots)
        for r in roots:
            self.root[r] = least
        return least

    def meet(self, cid: np.ndarray, weight: np.ndarray, u: np.ndarray, similarity: float) -> list[tuple[int, int | None, int]]:
        """(cid, partner or None, links) of vectors that stream past."""
        if not len(self.cid):
            return []
        near = u @ self.m.T >= similarity
        self.count += weight @ near
        out = []
        for i in np.flatnonzero(near.any(1)):
            hits = np.flatnonzero(near[i])
            out.append((int(cid[i]), int(self.cid[self.join(hits)]), int(self.weight[hits].sum())))
        return out

    def result(self) -> list[tuple[int, int | None, int]]:
        found = np.flatnonzero(self.count > 0)
        return [(int(self.cid[i]), int(self.cid[self.find(i)]), int(self.count[i])) for i in found]


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n): n links of class a to others, and b, a class of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        for b in batches:
            out: list = []
            cols = [b[c].to_numpy(zero_copy_only=False) for c in ("label", "dim", "cell", "block", "role")]
            edge = np.ones(b.num_rows, bool)
            edge[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = np.append(np.flatnonzero(edge), b.num_rows)
            for s, e in zip(starts[:-1], starts[1:]):
                key, part = tuple(int(c[s]) for c in cols[:4]), b.slice(s, e - s)
                if block is None or block.key != key:
                    if block is not None:
                        block.close(similarity)
                        out += block.result()
                    block = Block(key)
                args = part["cid"].to_numpy(), part["weight"].to_numpy(), unit(part["vec"], key[1])
                if cols[4][s] == 0:
                    block.add(*args)
                else:
                    block.close(similarity)
                    for at in range(0, e - s, BLOCK):
                        out += block.meet(*(x[at : at + BLOCK] for x in args), similarity)
            yield _found(out)
        if block is not None:
            block.close(similarity)
            yield _found(block.result())

    keys = ["label", "dim", "cell", "block"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "role", "cid")
    return ordered.mapInArrow(tidy(run), "a long, b long, n long")


def _found(rows: list) -> pa.RecordBatch:
    a, b, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])


def embedding_dedup(embeddings: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for every row of ``embeddings``.

    Vectors with a null id or label, null, empty or zero vectors, and those with
    null or non-finite components link with nothing and are kept.  Vectors of
    different length are not compared.  Rows that repeat id and vector count
    as separate vectors of one class.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").alias("vec"))
    rows = rows.withColumn("ok", comparable(F.col("vec"), F.col("label"), F.col("vec_id")))
    fine = rows.where("ok")
    grouped = fine.groupBy("label", "vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    # the number is given once and written, so it stays the same for all readers
    classes = saved(grouped.withColumns({"dim": F.size("vec"), "cid": F.monotonically_increasing_id()}), "vector-classes")
    found = saved(compared(meetings(saved(assigned(classes, similarity), "cells")), similarity), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cid")
    nodes = components(found.select("a", "b"), "vectors").withColumnRenamed("node", "cid")
    named = nodes.join(classes.select("cid", "least"), "cid")
    groups = named.join(named.groupBy("root").agg(F.min("least").alias("smallest")), "root").select("cid", "smallest")
    known = classes.join(counts, "cid", "left").join(groups, "cid", "left")
    known = known.select("label", "vec", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("smallest", "least").alias("component"))
    linked = fine.select("vec_id", "label", "vec").join(known, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
