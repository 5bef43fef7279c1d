"""How filters interact: what each removes, in every order of application.

Each document fails some of five filters.  Per part of the corpus the documents
are counted by their pattern of failures, which gives a contingency tensor of
2x2x2x2x2 cells (0: passes, 1: fails, one axis a filter); two more tensors count
good and toxic documents.  What a filter removes at a step of some order is a
contraction of that tensor: axes of earlier filters select ``pass``, its own
``fail``, all others are summed (``all``).  So documents are read once, whatever
the number of orders, and only counts travel.

Whether a text equals one of a smaller id needs no join on the text: the
documents that pass are those with the smallest id of their text, and the cells
of those that fail follow by subtraction.  A crowd of copies is folded to one
row a task before any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallygrain.llm.shared import raw_texts, saved, tidy

FILTERS = "ABCDE"  # the last one compares documents, the others look at one text
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # per cent of the words
MOST_CAPITALS = 2  # per cent of the code points
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
LARGEST = 2**63 - 1
SPREAD = 1024  # rows without an id, which meet no label, are spread over so many keys
PARTS = 256  # parts contracted together
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

ORDERS = ["".join(p) for p in permutations(FILTERS)]
_CELLS = 2 ** len(FILTERS)


def failures(text: bytes, n_chars: int) -> int:
    """The filters on one text that it fails, as bits (A is the highest of the four)."""
    words = text.split()  # bytes split at ASCII white space only
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * n_chars,
        len(text.translate(None, SIGNS)) < len(text),
    )
    return sum(f << (len(fails) - 1 - i) for i, f in enumerate(fails))


def marked(docs: DataFrame) -> DataFrame:
    """(id, part, pattern, h1, h2): failures and 128 digest bits of every text; the text itself stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = raw_texts(b["text"]), pc.utf8_length(b["text"]).to_pylist()
            pattern = pa.array([failures(t, n) for t, n in zip(texts, sizes)], pa.int32())
            digests = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
            h1, h2 = (pa.array(np.ascontiguousarray(digests[:, i])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b["id"], b["part"], pattern, h1, h2], ["id", "part", "pattern", "h1", "h2"])

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(tidy(run), "id long, part string, pattern int, h1 long, h2 long")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): documents by failures; ``cell`` has A as its highest bit and E as its lowest.

    A cell may have several rows, which add up.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    marks = marks.where((F.col("id") != LARGEST) & ((F.col("good") > 0) | (F.col("toxic") > 0))).withColumn("spread", F.lit(0).cast("long"))
    rows = marked(docs).withColumn("spread", F.when(F.col("id") == LARGEST, F.pmod(F.col("h1"), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long")))
    rows = saved(rows.join(marks, ["id", "spread"], "left").drop("spread").fillna(0, ["good", "toxic"]), "audit-marks")

    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    counts = [F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")]
    every = rows.groupBy("part", "pattern").agg(*counts)
    unique = rows.join(first, ["h1", "h2", "id"], "left_semi").groupBy("part", "pattern").agg(*counts)

    def at(df: DataFrame, last: int, sign: int) -> DataFrame:
        return df.select("part", (2 * F.col("pattern") + last).alias("cell"), *[(sign * F.col(c)).alias(c) for c in ("n", "good", "toxic")])

    return at(every, 1, 1).unionByName(at(unique, 1, -1)).unionByName(at(unique, 0, 1))


def contracted(tensor: np.ndarray, order: str, step: int) -> dict[str, np.ndarray]:
    """What happens at a step (from 1) of an order, for tensors [part, count, A, B, C, D, E].

    ``kept`` and ``removed`` carry all counts (documents, good, toxic).
    """

    def chosen(passing: str, failing: str = "", rest: tuple[int, int] = ALL) -> np.ndarray:
        axes = [PASS if f in passing else FAIL if f in failing else rest for f in FILTERS]
        return np.einsum("pkabcde,a,b,c,d,e->pk", tensor, *[np.array(v, np.int64) for v in axes])

    before, mine = order[: step - 1], order[step - 1]
    removed = chosen(before, mine)
    return {
        "kept": chosen(before + mine),
        "removed": removed,
        "redundant": chosen("", mine) - removed,
        "unique_fails": chosen("", mine, PASS),
    }


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(parts: list[str], tensor: np.ndarray) -> pa.RecordBatch:
    steps = range(1, len(FILTERS) + 1)
    found = [contracted(tensor, o, s) for o in ORDERS for s in steps]
    mine = [o[s - 1] for o in ORDERS for s in steps]
    shapley = {f: sum(x["removed"][:, 0] for x, m in zip(found, mine) if m == f) for f in FILTERS}
    numbers = [np.stack([x[name][:, k] for x in found], 1) for name, k in (("kept", 0), ("removed", 0), ("redundant", 0), ("unique_fails", 0), ("removed", 1), ("removed", 2))]
    numbers.append(np.stack([shapley[m] for m in mine], 1))
    n = len(found)
    names = pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), n)))
    orders = pa.array([o for o in ORDERS for _ in steps] * len(parts), pa.string())
    which = pa.array(list(steps) * len(ORDERS) * len(parts), pa.int32())
    columns = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([names, orders, which, *[pa.array(x.reshape(-1).astype(np.int64)) for x in numbers]], columns)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts: one row per part, order of the five filters and step.

    A part is a value of ``source``; null counts as the empty string.  A null
    text is empty; the empty text fails filter A only, and E where a smaller id
    is empty too.  A null doc_id is greater than any other, rows that share the
    smallest id of their text all pass E, and a document with several label rows
    is good or toxic if any of them says so.  An empty table has no parts.
    """
    sums = cells(docs, labels).groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # a part has at most as many entries as the tensor has cells
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                b = batch.slice(at, PARTS)
                tensor = np.zeros((b.num_rows, 3, _CELLS), np.int64)
                entries = b["cells"].flatten()
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["cells"]).to_numpy())
                cell = entries.field("cell").to_numpy()
                for k, name in enumerate(("n", "good", "toxic")):
                    tensor[row, k, cell] = entries.field(name).to_numpy()
                yield _audited(b["part"].to_pylist(), tensor.reshape(-1, 3, *[2] * len(FILTERS)))

    return parts.mapInArrow(tidy(run), _RESULT)
