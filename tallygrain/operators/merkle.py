"""Merkle roots and inclusion proofs over the record hashes of each claim.

A tree is built in rounds.  One round groups a level's nodes by
``(claim, index div FAN)`` and folds up to ten levels inside each group, so a
group never holds more than FAN nodes however long a trail is, and as many
rounds follow as the longest trail needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.digest import Digest, sha2_digest

FAN_BITS = 10
FAN = 1 << FAN_BITS


def leaf_hash(leaf: Column, digest: Digest = sha2_digest) -> Column:
    return digest(digest(leaf))


def _pair(left: Column, right: Column, digest: Digest) -> Column:
    return digest(F.concat(left, right))


def _next_level(level: Column, digest: Digest) -> Column:
    """Parents of one level; an odd last node is paired with itself."""
    last = F.floor((F.size(level) - 1) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: _pair(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.get(level, 2 * i)), digest),
    )


def _levels_above(n: Column) -> Column:
    """Levels between n leaves and the root: the least h with 2**h >= n."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def rounds_for(trail: DataFrame) -> int:
    """Rounds that the longest trail needs; one job that counts records per claim."""
    longest = trail.groupBy("claim_id").count().agg(F.max("count")).first()[0] or 1
    return max(1, -(-(longest - 1).bit_length() // FAN_BITS))


def _rounds(leaves: DataFrame, digest: Digest, rounds: int):
    """Yield (nodes of a level, grouped nodes with all inner levels), round by round.

    ``leaves`` has claim_id, idx, hash and the claim's leaf count n.
    """
    nodes = leaves
    for k in range(rounds):
        todo = F.greatest(F.lit(0), F.least(F.lit(FAN_BITS), _levels_above(F.col("n")) - FAN_BITS * k))
        chunks = (
            nodes.groupBy("claim_id", F.shiftright("idx", FAN_BITS).alias("chunk"))
            # at most FAN nodes per group, by construction
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("_members"))
            .withColumn("steps", todo)
            .withColumn("_base", F.transform("_members", lambda m: m["hash"]))
        )
        levels = F.aggregate(
            F.sequence(F.lit(1), F.col("steps")),
            F.array(F.col("_base")),
            lambda acc, _: F.concat(acc, F.array(_next_level(F.element_at(acc, -1), digest))),
        )
        chunks = chunks.withColumn(
            "levels", F.when(F.col("steps") > 0, levels).otherwise(F.array(F.col("_base")))
        )
        yield nodes, chunks
        nodes = chunks.select(
            "claim_id", F.col("chunk").alias("idx"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), "n"
        )


def _leaves(trail: DataFrame, digest: Digest) -> DataFrame:
    counts = trail.groupBy("claim_id").agg(F.count("*").alias("n"))
    return trail.join(counts, "claim_id").select(
        "claim_id", F.col("seq").alias("idx"), leaf_hash(F.col("record_hash"), digest).alias("hash"), "n",
        F.col("record_hash").alias("leaf"),
    )


def merkle_roots(trail: DataFrame, digest: Digest = sha2_digest, counted: DataFrame | None = None) -> DataFrame:
    """claim_id, leaves, root; ``seq`` must number each claim 0, 1, 2, ...

    ``counted`` may be the same records before they were sealed: the longest
    trail is then counted there, without sealing twice.
    """
    chunks = None
    for _, chunks in _rounds(_leaves(trail, digest).drop("leaf"), digest, rounds_for(trail if counted is None else counted)):
        pass
    return chunks.select(
        "claim_id", F.col("n").alias("leaves"), F.get(F.element_at("levels", -1), F.lit(0)).alias("root")
    )


# --- trees that grow by appending -------------------------------------------------

LEVELS = 60  # slots of a frontier, more than any trail needs
FRONTIER = "claim_id string, n long, frontier array<string>"


def frontier_of(trail: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """The state of a first batch: claim_id, n, and the root of the complete subtree of every level, if there is one."""
    empty = trail.sparkSession.createDataFrame([], FRONTIER)
    return append_leaves(empty, trail, digest)


def append_leaves(state: DataFrame, batch: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """The state after a batch (claim_id, seq, record_hash); a claim's seq goes on at its n.

    Level by level the new nodes, with the stored root of that level before them
    where there is one, are paired; one that is left over is the level's new
    root.  Older records are not read.  Nodes of ten levels meet by
    ``(claim, index div FAN)``, so a group never holds more than FAN.
    """
    counts = batch.groupBy("claim_id").agg(F.count("*").alias("m"))
    sizes = state.join(counts, "claim_id", "full_outer").select(
        "claim_id", F.coalesce("n", F.lit(0)).alias("n0"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n1"),
        F.coalesce("frontier", F.array_repeat(F.lit(None).cast("string"), LEVELS)).alias("frontier"),
    )
    longest = sizes.agg(F.max("n1")).first()[0] or 1
    rounds = max(1, -(-longest.bit_length() // FAN_BITS))
    nodes = batch.select("claim_id", F.col("seq").alias("idx"), leaf_hash(F.col("record_hash"), digest).alias("hash"))
    out = sizes
    for k in range(rounds):
        base = FAN_BITS * k
        groups = nodes.groupBy("claim_id", F.shiftright("idx", FAN_BITS).alias("chunk")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("_m")
        )
        # the stored roots of these levels stand before the first new node
        first = F.shiftright(F.shiftright("n0", base), FAN_BITS) == F.col("chunk")
        groups = groups.join(sizes, "claim_id").select(
            "claim_id", "chunk", F.transform("_m", lambda m: m["hash"]).alias("new"),
            F.when(first, F.slice("frontier", base + 1, FAN_BITS)).otherwise(F.array_repeat(F.lit(None).cast("string"), FAN_BITS)).alias("old"),
        )
        folded = groups.withColumn("f", _folded(F.col("new"), F.col("old"), digest)).select("claim_id", "chunk", "f.*")
        last = folded.groupBy("claim_id").agg(F.max_by("left", "chunk").alias(f"left{k}"))
        out = out.join(last, "claim_id", "left")
        nodes = folded.where(F.size("list") > 0).select("claim_id", F.col("chunk").alias("idx"), F.get("list", F.lit(0)).alias("hash"))
    kept = [F.coalesce(F.col(f"left{k}"), F.slice("frontier", FAN_BITS * k + 1, FAN_BITS)) for k in range(rounds)]
    rest = F.slice("frontier", FAN_BITS * rounds + 1, LEVELS - FAN_BITS * rounds)
    return out.select("claim_id", F.col("n1").alias("n"), F.concat(*kept, rest).alias("frontier"))


def _folded(new: Column, old: Column, digest: Digest) -> Column:
    """Struct (list: nodes ten levels up, at most one; left: what each level keeps)."""
    nothing = F.array().cast("array<string>")

    def after(root: Column, nodes: Column) -> Column:
        return F.when(root.isNotNull(), F.concat(F.array(root), nodes)).otherwise(nodes)

    def step(acc: Column, j: Column) -> Column:
        nodes = acc["list"]
        half = F.floor(F.size(nodes) / 2).cast("int")
        up = F.when(half > 0, F.transform(F.sequence(F.lit(1), half), lambda i: _pair(F.get(nodes, 2 * i - 2), F.get(nodes, 2 * i - 1), digest))).otherwise(nothing)
        alone = F.when(F.size(nodes) % 2 == 1, F.element_at(nodes, -1))
        return F.struct(after(F.get(old, j + 1), up).alias("list"), F.concat(acc["left"], F.array(alone)).alias("left"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(FAN_BITS - 1)), F.struct(after(F.get(old, F.lit(0)), new).alias("list"), nothing.alias("left")), step)


def frontier_roots(state: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """claim_id, leaves, root of a state; equal to ``merkle_roots`` over all its records.

    From the lowest stored root upwards: a level without one pairs what has come
    up with itself, as an odd last node is.
    """
    state = state.where(F.col("n") > 0)
    top = _levels_above(F.col("n"))
    low = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda l: F.get("frontier", l).isNotNull())[0]

    def step(h: Column, level: Column) -> Column:
        root = F.get("frontier", level)
        return F.when((level == F.col("low")) | root.isNull(), _pair(h, h, digest)).otherwise(_pair(root, h, digest))

    climbed = F.aggregate(F.sequence(F.col("low"), F.col("top") - 1), F.get("frontier", F.col("low")), step)
    return state.withColumns({"low": low, "top": top}).select(
        "claim_id", F.col("n").alias("leaves"), F.when(F.col("top") > F.col("low"), climbed).otherwise(F.get("frontier", F.col("low"))).alias("root")
    )


def roots_of(claim_ids: DataFrame, trail: DataFrame, digest: Digest = sha2_digest) -> DataFrame:
    """Roots for a list of claims; a claim without records has the zero hash."""
    return claim_ids.join(merkle_roots(trail, digest), "claim_id", "left").select(
        "claim_id", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("root", F.lit(C.ZERO_HASH)).alias("root")
    )


def merkle_proofs(trail: DataFrame, digest: Digest = sha2_digest, counted: DataFrame | None = None) -> DataFrame:
    """One row per record: claim_id, leaf_index, leaf, siblings, root; ``counted`` as for the roots."""
    leaves = _leaves(trail, digest)
    paths, roots, rounds = [], None, rounds_for(trail if counted is None else counted)
    for _, chunks in _rounds(leaves.drop("leaf"), digest, rounds):
        levels, steps = F.col("levels"), F.col("steps")

        def sibling(i: Column, step: Column) -> Column:
            at = F.call_function("shiftright", i, step)
            other = at.bitwiseXOR(F.lit(1))
            level = F.element_at(levels, step + 1)
            return F.struct(
                F.get(level, F.least(other, F.size(level) - 1)).alias("hash"), (other > at).alias("is_right")
            )

        path = F.transform(
            F.element_at(levels, 1),
            lambda _, i: F.struct(
                i.alias("slot"),
                F.when(
                    steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), lambda s: sibling(i, s))
                ).otherwise(F.array().cast("array<struct<hash:string,is_right:boolean>>")).alias("path"),
            ),
        )
        paths.append(
            chunks.select("claim_id", "chunk", F.explode(path).alias("p")).select(
                "claim_id", (F.col("chunk") * FAN + F.col("p.slot")).alias("node"), F.col("p.path").alias("path")
            )
        )
        roots = chunks.select("claim_id", F.get(F.element_at("levels", -1), F.lit(0)).alias("root"))
    out = leaves.select("claim_id", "idx", "leaf").join(
        paths[0].select("claim_id", F.col("node").alias("idx"), F.col("path").alias("p0")), ["claim_id", "idx"]
    )
    for k in range(1, rounds):
        upper = paths[k].select("claim_id", F.col("node").alias("up"), F.col("path").alias(f"p{k}"))
        out = out.withColumn("up", F.shiftright("idx", FAN_BITS * k)).join(upper, ["claim_id", "up"]).drop("up")
    return out.join(roots, "claim_id").select(
        "claim_id",
        F.col("idx").alias("leaf_index"),
        "leaf",
        F.concat(*[F.col(f"p{k}") for k in range(rounds)]).alias("siblings"),
        "root",
    )


def proof_holds(leaf: Column, siblings: Column, root: Column, digest: Digest = sha2_digest) -> Column:
    folded = F.aggregate(
        siblings,
        leaf_hash(leaf, digest),
        lambda h, s: F.when(s["is_right"], _pair(h, s["hash"], digest)).otherwise(_pair(s["hash"], h, digest)),
    )
    return folded == root
