"""Mixture-controlled packing of token sequences.

Documents queue up by source, and every window of the output is filled from all
queues in the target proportions.  The deficit that a queue carries from one
window to the next is the part of a token its share does not fill, so the
number of tokens a queue has given after any window follows from that window's
number alone: the boundary below queue q after x tokens is
``floor(x * shares below q / all shares)``.  That closed form of a deficit
round-robin needs no pass over earlier windows.  Each task cuts its own
documents, and deficits carry across windows and partitions alike.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tallygrain.llm.shared import saved, tidy
from tallygrain.llm.wordpiece import encoded_ids, forget

LENGTH = 2048
END = 1
REST = "\x00rest"  # the queue of all sources too small for a token or two of each window
NAMED = 4096  # sources that may have a queue of their own


@dataclass
class Phase:
    """A stretch of the output with fixed shares; it ends where a window ends, but for the last."""

    begin: int  # tokens before it
    size: int
    total: int  # sum of the shares
    below: dict[str, tuple[int, int]]  # queue -> shares below it, and with it
    given: dict[str, int]  # queue -> tokens given before


def schedule(tokens: dict[str, int], shares: dict[str, int] | None = None, length: int = LENGTH) -> list[Phase]:
    """Phases that use up every queue's tokens.

    Without ``shares`` the queues' own sizes are the target and there is one
    phase.  With them, the targets hold as long as every queue with a share can
    fill its part; a queue that runs short leaves, and what is left in the end
    is mixed by size.
    """
    left = {q: n for q, n in sorted(tokens.items()) if n > 0}
    given, at, phases = dict.fromkeys(left, 0), 0, []

    def add(active: dict[str, int], size: int) -> None:
        nonlocal at
        total, low, below = sum(active.values()), 0, {}
        for q, share in active.items():
            below[q] = (low, low + share)
            low += share
        phases.append(Phase(at, size, total, below, dict(given)))
        for q, (a, b) in below.items():
            n = b * size // total - a * size // total
            given[q] += n
            left[q] -= n
        at += size

    active = {q: shares[q] for q in left if shares.get(q, 0) > 0} if shares else {}
    while active:
        total = sum(active.values())
        windows = min((left[q] - 2) * total // (active[q] * length) for q in active)
        if windows > 0:
            add(active, windows * length)
        short = [q for q in active if (left[q] - 2) * total < active[q] * length]
        active = {q: n for q, n in active.items() if q not in short}
        if not short:
            break
    rest = {q: n for q, n in left.items() if n > 0}
    if rest:
        add(rest, sum(rest.values()))
    return phases


def pieces(phases: list[Phase], begins: list[int], queue: str, first: int, n: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(start, size, window, offset) of the document that holds tokens first .. first + n of its queue.

    ``begins`` are the numbers of queue tokens given before each phase.
    """
    at, k = first, bisect_right(begins, first) - 1
    while at < first + n:
        while k + 1 < len(phases) and begins[k + 1] <= at:
            k += 1
        p = phases[k]
        if queue not in p.below:
            k += 1
            continue
        a, b = p.below[queue]
        got = at - p.given[queue]
        # the window in which the queue's token number ``got`` of this phase lies
        window = max(0, got * p.total // (b - a) // length - 1)
        while True:
            end = min((window + 1) * length, p.size)
            upto = b * end // p.total - a * end // p.total
            if upto > got:
                break
            window += 1
        begin = window * length
        before = b * begin // p.total - a * begin // p.total
        # queues stand in order inside a window
        offset = a * end // p.total - a * begin // p.total + got - before
        size = min(upto - got, first + n - at)
        yield at - first, size, p.begin // length + window, p.begin % length + offset
        at += size


def pack(docs: DataFrame, ids: DataFrame | None = None, shares: dict[str, int] | None = None, length: int = LENGTH, least: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source: one row per piece.

    A null text counts as empty and is the end token alone; a null source is a
    source of its own.  Repeated rows are packed as often as they occur.  All
    sequences are full but the last, which is padded.  Sources that would give
    fewer than ``least`` tokens to a window share one queue, and so do all but
    the NAMED largest sources, so the schedule's size is bounded.
    """
    spark = docs.sparkSession
    rows = saved((ids if ids is not None else token_rows(docs)), "token-ids")
    sizes = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    totals = sizes.groupBy("source").agg(F.sum("n").alias("tokens"))
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    large = totals.where(F.col("tokens") * length >= least * everything).orderBy(F.desc("tokens"), "source").limit(NAMED).collect()
    tokens = {r["source"]: r["tokens"] for r in large}
    if everything > sum(tokens.values()):
        tokens[REST] = everything - sum(tokens.values())
        if tokens[REST] * length < least * everything and len(tokens) > 1:  # too small even together
            small = min((q for q in tokens if q != REST), key=lambda q: (tokens[q], q))
            tokens[REST] += tokens.pop(small)
    named = [q for q in tokens if q != REST]
    phases = schedule(tokens, shares, length)
    queue = F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(REST)) if named else F.lit(REST)
    before = W.partitionBy("queue").orderBy("part", "source").rowsBetween(W.unboundedPreceding, -1)
    # one row per task and source: written, so that Spark knows its size when it chooses the join
    bases = saved(sizes.withColumn("queue", queue).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "queue-bases")
    placed = rows.join(bases, ["part", "source"]).select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    plan = spark.sparkContext.broadcast(phases)
    begins = {q: [p.given.get(q, 0) for p in phases] for q in tokens}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, own, cols = [], [], []
            for i, (q, first, n, blob) in enumerate(zip(*(b[c].to_pylist() for c in ("queue", "first", "n", "ids")))):
                four = np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32).astype("<u4").tobytes()
                for start, size, window, offset in pieces(plan.value, begins[q], q, first, n, length):
                    doc.append(i)
                    own.append(n)
                    cols.append((start, size, zlib.crc32(four[4 * start : 4 * (start + size)]), window, offset))
            c = np.array(cols, np.int64).reshape(-1, 5)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(at), *map(pa.array, (c[:, 0], c[:, 1], c[:, 2])), pa.array(own, pa.int64()), *map(pa.array, (c[:, 3], c[:, 4])), b["source"].take(at)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return placed.mapInArrow(
        tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    )


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, part, at, n, ids: token ids of each text and the end token, with the place in the task's queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), {}
        for b in batches:
            at, n, blobs = [], [], []
            for source, text in zip(b["source"].to_pylist(), b["text"].to_pylist()):
                ids = encoded_ids(text or "")
                blob = np.append(ids, np.asarray([END], ids.dtype)).tobytes()
                at.append(met.get(source, 0))
                n.append(len(ids) + 1)
                met[source] = at[-1] + n[-1]
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["source"], pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())],
                ["doc_id", "source", "part", "at", "n", "ids"],
            )
        forget()

    # a null source is told from every text by a character that ends no name
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("source"), F.col("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, source string, part int, at long, n long, ids binary")
