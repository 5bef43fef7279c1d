"""Scores of image vectors: nearest remembered cases and prompt margins.

Images are a large table and so may be the memory: what a run sees of it is
bounded, but differs with the run's time, so entries carry the interval in which
they are seen, and images meet those of their epoch in one group.  The prompts are a
fixed list (MAX_PROMPTS at most, a documented bound) that goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrain import constants as C
from tallygrain.operators.spread import dense_sequence

# far above the fixed prompt list, far below what a task can hold
MAX_PROMPTS = 10_000
DAY = 86_400_000_000  # microseconds


def _small_side(df: DataFrame, limit: int, what: str) -> pd.DataFrame:
    """Bring a bounded table to the driver; refuse one that breaks its bound."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def _matrix(vectors: pd.Series) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.asarray(np.vstack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _dot(images: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Products over the shorter of the two lengths."""
    n = min(images.shape[1], others.shape[1])
    return images[:, :n] @ others[:, :n].T


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


# query rows that one task scores; busier epochs are dealt to several tasks
EPOCH_QUERIES = 20_000
MAX_EPOCHS = 50_000  # bound of what the driver gathers: one number each
_ALWAYS = 2**62  # a run without a time sees the whole memory; an entry that still stands ends here
_NEVER = -(2**62)  # an entry without a time precedes all runs


def with_intervals(memory: DataFrame, per_label: int = C.MEMORY_PER_LABEL) -> DataFrame:
    """Memory entries with ``n``, ``since`` and ``until`` (long, microseconds).

    ``n`` numbers the entries of a label in the order of (at, seq, file_id).  A run
    at time t sees an entry if since < t <= until: it was there before, and fewer
    than ``per_label`` entries of its label came after it and before t.  ``until``
    is null for those that still stand.
    """
    rows = memory.withColumn("since", F.coalesce(F.unix_micros("at"), F.lit(_NEVER)))
    order = [F.col(c) for c in ("since", "seq", "file_id", "claim_id")]
    rows = dense_sequence(rows, "label", F.floor(F.col("since") / DAY), order, "n")
    ends = rows.select("label", (F.col("n") - per_label).alias("n"), F.col("since").alias("until"))
    return rows.join(ends, ["label", "n"], "left")


def _cuts(held: DataFrame, per_label: int) -> np.ndarray:
    """Times at which a new epoch starts, at most MAX_EPOCHS a label."""
    size = held.groupBy("label").agg(F.max("n").alias("n")).agg(F.max("n")).first()[0]
    step = max(per_label, -(-(size or 0) // MAX_EPOCHS))
    starts = held.where(F.col("n") % step == 0).select("since").distinct().toPandas()["since"]
    return np.sort(starts.to_numpy(np.int64))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    lists = column.combine_chunks()
    if len(lists) == 0:
        return np.zeros((0, 0))
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def _best(sims: np.ndarray, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest usable similarities of every row, nearest
    first; the earlier column wins ties."""
    masked = np.where(usable & ~np.isnan(sims), sims, -np.inf)
    if masked.shape[1] > k:
        least = -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((masked >= least) & (masked > -np.inf))
    else:
        rows, cols = np.nonzero(masked > -np.inf)
    order = np.lexsort((cols, -masked[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


_VOTE = (
    "claim_id string, file_id string, seq int, fraud_score int, knn int, "
    "matches array<struct<claim_id:string,label:string,similarity:double,pos:int>>"
)
_MATCHES = pa.list_(pa.struct([("claim_id", pa.string()), ("label", pa.string()), ("similarity", pa.float64()), ("pos", pa.int32())]))


def knn_votes(
    queries: DataFrame, memory: DataFrame, k: int = C.KNN_K, exclude_self: bool = True,
    per_label: int = C.MEMORY_PER_LABEL,
) -> DataFrame:
    """Vote of the k nearest remembered vectors for every query vector.

    ``queries`` has claim_id, file_id, seq, vec and, for as-of semantics, run_at:
    a run sees the newest ``per_label`` vectors of each label among those
    remembered before ``run_at``; without a time it sees the newest of all.
    Output, one row per query: claim_id, file_id, seq, fraud_score, knn, matches
    (array of claim_id, label, similarity, pos), nearest first, of equal ones the
    earlier enrolment.  A query without a vector sees nothing; entries without one
    are not seen.

    ``memory`` either has the columns of ``with_intervals``, as the stream that
    keeps them writes them, or gets them here.  Every ``per_label``-th entry of a
    label starts a new epoch, and what runs of one epoch see is at most twice
    ``per_label`` entries of each label (above MAX_EPOCHS times ``per_label`` entries of
    a label: its share of an epoch and ``per_label`` more).  The driver gathers one
    number an epoch, and how many queries each has.  A query
    vector goes to the one group of its epoch and is voted on there; an entry goes
    to the epochs that its interval touches.
    """
    time = F.coalesce(F.unix_micros("run_at"), F.lit(_ALWAYS)) if "run_at" in queries.columns else F.lit(_ALWAYS)
    asked = queries.select("claim_id", "file_id", F.col("seq").cast("int").alias("seq"), "vec", time.cast("long").alias("time"))
    held = memory if {"n", "since", "until"} <= set(memory.columns) else with_intervals(memory, per_label)
    held = held.select("claim_id", "file_id", "label", "seq", "vec", "n", "since", F.coalesce("until", F.lit(_ALWAYS)).alias("until"))

    cuts = _cuts(held, per_label)

    @F.pandas_udf("long")
    def epoch_of(times: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, times.to_numpy(np.int64)))

    sizes = asked.groupBy("time").count().groupBy(epoch_of("time").alias("epoch")).agg(F.sum("count").alias("size")).toPandas()
    copies = np.zeros(len(cuts) + 1, np.int64)
    copies[sizes["epoch"].to_numpy(np.int64)] = -(-sizes["size"].to_numpy(np.int64) // EPOCH_QUERIES)
    # groups of an epoch follow one another, and so do those of an interval
    base = np.concatenate([[0], np.cumsum(copies)])

    @F.pandas_udf("long")
    def group_of(times: pd.Series, hashes: pd.Series) -> pd.Series:
        epoch = np.searchsorted(cuts, times.to_numpy(np.int64))
        return pd.Series(base[epoch] + hashes.to_numpy(np.int64) % copies[epoch])

    @F.pandas_udf("long")
    def first_group(since: pd.Series) -> pd.Series:
        return pd.Series(base[np.searchsorted(cuts, since.to_numpy(np.int64), side="right")])

    @F.pandas_udf("long")
    def end_group(until: pd.Series) -> pd.Series:
        return pd.Series(base[np.searchsorted(cuts, until.to_numpy(np.int64)) + 1])

    left = asked.withColumn("group", group_of("time", F.xxhash64("file_id", "claim_id")))
    spread = held.where(F.col("vec").isNotNull()).drop("n").withColumns({"first": first_group("since"), "end": end_group("until")})
    right = spread.where("first < end").withColumn("group", F.explode(F.sequence("first", F.col("end") - 1))).drop("first", "end")

    def score(ask: pa.Table, known: pa.Table) -> pa.Table:
        ask = pa.concat_tables([ask.filter(ask["vec"].is_valid()), ask.filter(ask["vec"].is_null())])
        known = known.sort_by([("seq", "ascending"), ("file_id", "ascending"), ("claim_id", "ascending"), ("label", "ascending")])
        n = len(ask) - ask["vec"].null_count
        vectors, since, until = _vectors(known["vec"]), known["since"].to_numpy(), known["until"].to_numpy()
        owner = pd.factorize(np.concatenate([ask["claim_id"].to_numpy(), known["claim_id"].to_numpy()]))[0]
        mine, theirs, times = owner[: len(ask)], owner[len(ask) :], ask["time"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, n, 1024) if len(known) else ():
            to = min(at + 1024, n)
            sims = _dot(_vectors(ask["vec"].slice(at, to - at)), vectors)
            usable = (since < times[at:to, None]) & (times[at:to, None] <= until)
            if exclude_self:
                usable &= mine[at:to, None] != theirs
            rows, cols = _best(sims, usable, k)
            found.append((rows + at, cols, sims[rows, cols]))
        rows, cols, sims = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        knn = np.bincount(rows, minlength=len(ask))
        offsets = np.concatenate([[0], np.cumsum(knn)])
        picked = known.select(["claim_id", "label"]).take(pa.array(cols)).combine_chunks()
        names = [pa.array(picked[c].to_pylist(), pa.string()) for c in ("claim_id", "label")]
        fraud = np.bincount(rows, weights=np.array([x == "fraud" for x in names[1].to_pylist()], dtype=float), minlength=len(ask))
        fields = [*names, pa.array(np.floor(sims * 1000 + 0.5) / 1000), pa.array((np.arange(len(rows)) - offsets[rows]).astype(np.int32))]
        matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_MATCHES.value_type)))
        vote = np.floor(100.0 * fraud / np.maximum(knn, 1) + 0.5).astype(np.int32)
        return pa.table(
            {
                "claim_id": ask["claim_id"], "file_id": ask["file_id"], "seq": ask["seq"],
                "fraud_score": pa.array(vote), "knn": pa.array(knn.astype(np.int32)), "matches": matches,
            }
        )

    return left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(score, _VOTE)


def similar_rows(votes: DataFrame) -> DataFrame:
    """Neighbours as rows: claim_id, matched_claim_id, label, similarity, file_id, pos."""
    return votes.select("claim_id", "file_id", "seq", F.explode("matches").alias("m")).select(
        "claim_id",
        F.col("m.claim_id").alias("matched_claim_id"),
        "m.label",
        "m.similarity",
        "file_id",
        (F.col("seq") * C.KNN_K + F.col("m.pos")).alias("pos"),
    )


def _margin(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    return _half_up(np.clip((pos.max(axis=1) - neg.max(axis=1) + 1) / 2, 0, 1) * 100)


def _ladder(sims: np.ndarray, rung_of: np.ndarray, shift: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    per_rung = np.stack([sims[:, rung_of == i].max(axis=1) for i in range(len(C.LADDER))], axis=1)
    weight = np.exp((per_rung - per_rung.min(axis=1, keepdims=True)) * C.LADDER_FACTOR)
    shares = weight / weight.sum(axis=1, keepdims=True)
    mean = shares @ np.array([w for _, w in C.LADDER], dtype=np.float64)
    return np.clip(_half_up(mean + shift), 0, 100), per_rung.argmax(axis=1)


def prompt_scores(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every prompt score of every image.

    Adds staged, ai_gen, rel_flood, rel_drought, rel_livestock (0..100, null when
    the prompts of that signal are missing) and the ladder's percent and rung.
    ``ref_vec``, when ``images`` has it, is a picture from before the event.
    """
    spark: SparkSession = images.sparkSession
    small = _small_side(prompts, MAX_PROMPTS, "prompts").sort_values("pos").reset_index(drop=True)
    rungs = [name for name, _ in C.LADDER]
    kept = [c for c in images.columns if c not in ("vec", "ref_vec")]
    with_ref = "ref_vec" in images.columns
    shared = spark.sparkContext.broadcast(
        {
            "matrix": _matrix(small["vec"]),
            "signal": small["signal"].to_numpy(dtype=object),
            "side": small["side"].to_numpy(dtype=object),
            "loss": small["loss_type"].to_numpy(dtype=object),
            "rung": np.array([rungs.index(r) if r in rungs else -1 for r in small["rung"]]),
        }
    )
    signals = [("staged", "staged", None), ("ai_gen", "ai_gen", None)] + [
        (f"rel_{loss}", "relevance", loss) for loss in C.LOSS_TYPES
    ]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in batches:
            if len(batch) == 0:
                continue
            sims = _dot(_matrix(batch["vec"]), p["matrix"])
            out = {c: batch[c] for c in kept}
            for name, signal, loss in signals:
                mine = p["signal"] == signal
                if loss is not None:
                    mine = mine & (p["loss"] == loss)
                pos, neg = mine & (p["side"] == "pos"), mine & (p["side"] == "neg")
                if pos.any() and neg.any():
                    out[name] = _margin(sims[:, pos], sims[:, neg]).astype(int)
                else:
                    out[name] = pd.array([pd.NA] * len(batch), dtype="Int64")
            ladder = p["signal"] == "ladder"
            if all((p["rung"][ladder] == i).any() for i in range(len(rungs))):
                shift: np.ndarray | int = 0
                if with_ref:
                    shift = np.zeros(len(batch))
                    has = batch["ref_vec"].notna().to_numpy()
                    if has.any():
                        ref = _dot(_matrix(batch["ref_vec"][has]), p["matrix"])
                        intact = ref[:, ladder & (p["rung"] == 0)].max(axis=1)
                        flooded = p["signal"] == "flooded"
                        if flooded.any():
                            shift[has] = np.where(
                                intact > ref[:, flooded].max(axis=1), C.LADDER_REFERENCE_SHIFT, 0
                            )
                pct, best = _ladder(sims[:, ladder], p["rung"][ladder], shift)
                out["destruction_pct"] = pct.astype(int)
                out["rung"] = [rungs[i] for i in best]
            else:
                out["destruction_pct"] = pd.array([pd.NA] * len(batch), dtype="Int64")
                out["rung"] = None
            yield pd.DataFrame(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields if f.name in kept)
    columns = ", ".join(f"{name} int" for name, _, _ in signals)
    return images.mapInPandas(score, f"{schema}, {columns}, destruction_pct int, rung string")


def calibration_table(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """All signals of every image, one row per image."""
    return prompt_scores(images.select("file_id", "vec"), prompts).select(
        "file_id", "staged", "ai_gen", *[f"rel_{loss}" for loss in C.LOSS_TYPES]
    )
