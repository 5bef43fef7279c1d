"""Quality scores from compressed sizes.

Two zstandard dictionaries are built from texts labelled good and bad.  A text
is compressed with either; the difference of the two sizes, divided by the
size without a dictionary, tells which kind of text it resembles.  A logistic
curve fitted on labelled rows that were not used for the dictionaries turns the
difference into a probability.  Dictionaries and curve are fitted on a bounded
sample (SAMPLE rows per label); the curve's rows weigh as much as the eligible
rows of their label that they stand for, so the share of each label is that of
the whole table.  Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallygrain.llm.shared import crc_mod, raw_texts, tidy

SAMPLE = 1500  # rows per label, half for the dictionaries and half for the curve
SAMPLE_BYTES = 20_000  # longer texts are not chosen for fitting
DICTIONARY = 64 << 10
BLOCK = 8 << 10  # texts are compressed in blocks of this size, so the dictionary counts everywhere
LEVEL = 3
THRESHOLD = 0.3
SALTS = 64


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Gauge:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        kinds = [zstandard.ZstdCompressionDict(d) if d else None for d in (good, bad)]
        self.press = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in (*kinds, None)]

    def difference(self, text: bytes) -> float:
        """(size by the bad dictionary - size by the good one) / size without; 0 for an empty text."""
        if not text:
            return 0.0
        good, bad, plain = (sum(len(p.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for p in self.press)
        return (bad - good) / plain


def _usable() -> Column:
    return (F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES)


def eligible(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality): every labelled document that may be chosen for fitting, once."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", 5) != 0))
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = docs.select("doc_id", _usable().alias("usable")).where("usable").select("doc_id").distinct()
    return marks.join(sizes, "doc_id")


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, half, text): a bounded sample of labelled rows whose remainder is not 0, chosen by key."""
    keys = eligible(docs, labels).withColumn("_h", F.xxhash64("doc_id")).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    for by in (["quality", "_salt"], ["quality"]):
        w = W.partitionBy(*by).orderBy("_h", "doc_id")
        keys = keys.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label)
    chosen = keys.select("doc_id", "quality", (F.col("_rn") % 2).alias("half"))  # two labels times per_label rows
    return docs.where(_usable()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "half", "text")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Model | None:
    """None when either label is missing from the sample."""
    rows = sample(docs, labels, per_label).toPandas().sort_values(["doc_id", "text"])
    rows["text"] = [t.encode() for t in rows["text"]]
    first, second = rows[rows["half"] == 1], rows[rows["half"] == 0]
    if min((first["quality"] == q).sum() for q in (0, 1)) == 0:
        return None
    dictionaries = [_dictionary(first.loc[first["quality"] == q, "text"].tolist()) for q in (1, 0)]
    gauge = Gauge(*dictionaries)
    curve = second if len(set(second["quality"])) == 2 else rows
    x = np.array([gauge.difference(t) for t in curve["text"]])
    counts = {r["quality"]: r["count"] for r in eligible(docs, labels).groupBy("quality").count().collect()}
    chosen = curve.groupby("quality")["doc_id"].nunique()
    weight = curve["quality"].map({q: counts[q] / n for q, n in chosen.items()}).to_numpy(float)
    return Model(*dictionaries, *_logistic(x, curve["quality"].to_numpy(float), weight))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    blocks = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 8)), blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton's method, with a small ridge; rows count by ``weight``."""
    scale = x.std() or 1.0
    weight = weight / weight.mean()  # the ridge keeps its strength
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (weight * (y - p)) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, difference: one row for every row of ``docs``.

    Null and empty texts have difference 0 and the curve's score for it.
    Without labels of both kinds every score is 0.5.  A null doc_id is not held
    out; repeated rows are scored alike.
    """
    model = fit(docs, labels, per_label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gauge = Gauge(m.good, m.bad) if m else None
        for b in batches:
            x = np.array([gauge.difference(t or b"") if gauge else 0.0 for t in raw_texts(b["text"])])
            score = 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30))) if m else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array(x)], ["doc_id", "held_out", "score", "difference"])

    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), held, "text")
    found = rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, difference double")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
