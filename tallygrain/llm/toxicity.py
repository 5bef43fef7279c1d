"""Toxic spans by a linear-chain conditional random field.

Every text is one chain of words with two tags, clean and toxic.  A word's
features are the word itself and its beginnings; a tag also depends on the tag
before it.  Forward-backward gives the marginal probability that a word is
toxic, the marginals of a text add up to its score, and neighbouring words above
one half are a span with its offsets.

Documents are labelled, words are not, so the field learns from tokens that get
labels in rounds: every word of a clean document is clean; in a toxic document
first those words are toxic whose features are far commoner in toxic documents,
then those that the field itself finds toxic; where it is unsure, its own
marginal stands for the label.  Fitting uses a bounded sample (SAMPLE rows
a label, chosen by key, texts up to SAMPLE_BYTES); every text is scored whole.

The chain is evaluated for many texts at once: transition matrices are
multiplied inside blocks of words, then across blocks, and a text's first word
forgets what came before, so the cost is linear in the number of words however
long one text is.  A text of more than CHUNK characters is cut into several
chains at white space, which bounds memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallygrain.llm.shared import MIX_A, crc_mod, mixed, tidy

SAMPLE = 1200  # rows per label, two thirds for the field and one third for the curve
SAMPLE_BYTES = 20_000  # longer texts are not chosen for fitting
BEGINNINGS = (3, 4, 5, 6, 7)  # bytes of a word's beginning that are features
FEATURE_Z = 3.0  # standard errors by which a feature's shares in clean and toxic texts must differ
ROUNDS = 3  # of labelling tokens and fitting
STEPS = 24  # of gradient ascent in a round
RATE = 0.3
PARTS = 4  # of the sample; a step looks at one of them
RIDGE = 0.5  # strength of the prior that holds weights near 0
SEED_RATIO = 3.0  # how much commoner a feature must be in toxic texts, at SURE_Z, to mark a word
SURE_Z = 4.0
SURE = 0.9  # a field's own marginals beyond this, or below the rest, become labels
THRESHOLD = 0.5
SALTS = 64
CHUNK = 1 << 19  # characters evaluated at once
_BIAS = np.uint64(1)  # a feature of every word; hashes are odd, but not this small
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_INVERSE = np.uint64(pow(int(MIX_A), -1, 1 << 64))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGNS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")  # signs beyond ASCII that part words


def lowered(text: str) -> str:
    """Lower case, character by character where that would change the length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low if low.isascii() else _SIGNS.sub(" ", low)


@dataclass
class Words:
    """Words of some texts, one after the other."""

    start: np.ndarray  # byte offsets in the texts joined by line feeds
    end: np.ndarray
    bounds: np.ndarray  # where each text's words begin, and one more
    features: np.ndarray  # hashes [different word, feature]; 0 where a word has no such feature
    kind: np.ndarray  # each word's row in ``features``
    data: np.ndarray  # bytes of the joined texts

    @property
    def first(self) -> np.ndarray:
        """Whether each word is the first of its text."""
        out = np.zeros(len(self.start), bool)
        out[self.bounds[:-1][np.diff(self.bounds) > 0]] = True
        return out


def words_of(texts: list[str]) -> Words:
    """Runs of ASCII letters, digits and all bytes beyond ASCII."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[data], [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    bounds = np.searchsorted(start, begins)
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), MIX_A)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(start[-1]) if len(start) else 0, _INVERSE)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * up[:-1], dtype=np.uint64)])

    def hashes(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mixed((total[b] - total[a]) * down[a] + np.uint64(salt)) | np.uint64(1)

    whole = hashes(start, end, 0)
    _, one, kind = np.unique(whole, return_index=True, return_inverse=True)
    a, b = start[one], end[one]
    columns = [np.full(len(one), _BIAS), whole[one]]
    columns += [np.where(b - a > k, hashes(a, np.minimum(a + k, b), k), np.uint64(0)) for k in BEGINNINGS]
    return Words(start, end, bounds, np.stack(columns, 1), kind, data)


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(toxic, pairs) of chains that stand one after the other.

    ``score`` is each word's score for the toxic tag (the clean one has 0),
    ``trans[a, b]`` the score of tag b after tag a, ``first`` where a chain
    begins.  ``toxic`` are the marginals, ``pairs[a, b]`` the expected number of
    such neighbours.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    long = int(np.sqrt(n)) + 1
    blocks = -(-n // long)

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        """[place in block, block]"""
        return np.ascontiguousarray(np.concatenate([x, np.full(blocks * long - n, fill)]).reshape(blocks, long).T)

    # the matrix of a word leads from the tag before to its own; the first word of a chain forgets
    high = np.maximum(score, 0)
    clean, toxic, t = np.exp(-high), np.exp(score - high), np.exp(trans - trans.max())
    a, b, c, d = (
        laid(np.where(first, 1.0, t[x, y]) * emit, float(x == y)) for x, y, emit in ((0, 0, clean), (0, 1, toxic), (1, 0, clean), (1, 1, toxic))
    )
    one, none = np.ones(blocks), np.zeros(blocks)
    p, q, r, s = one, none, none, one
    for i in range(long):
        p, q, r, s = p * a[i] + q * c[i], p * b[i] + q * d[i], r * a[i] + s * c[i], r * b[i] + s * d[i]
        whole = 1 / (p + q + r + s)
        p, q, r, s = p * whole, q * whole, r * whole, s * whole
    product = list(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist()))
    before, after = np.empty((blocks, 2)), np.empty((blocks, 2))
    u, v = 1.0, 0.0
    for k, (p, q, r, s) in enumerate(product):
        before[k] = u, v
        u, v = u * p + v * r, u * q + v * s
        u, v = u / (u + v), v / (u + v)
    u, v = 0.5, 0.5
    for k in range(blocks - 1, -1, -1):
        after[k] = u, v
        p, q, r, s = product[k]
        u, v = p * u + q * v, r * u + s * v
        u, v = u / (u + v), v / (u + v)
    shape = (long, blocks)
    f0, f1, l0, l1, g0, g1 = (np.empty(shape) for _ in range(6))
    u, v = before[:, 0].copy(), before[:, 1].copy()
    for i in range(long):
        l0[i], l1[i] = u, v
        u, v = u * a[i] + v * c[i], u * b[i] + v * d[i]
        whole = 1 / (u + v)
        u, v = u * whole, v * whole
        f0[i], f1[i] = u, v
    u, v = after[:, 0].copy(), after[:, 1].copy()
    for i in range(long - 1, -1, -1):
        g0[i], g1[i] = u, v
        u, v = a[i] * u + b[i] * v, c[i] * u + d[i] * v
        whole = 1 / (u + v)
        u, v = u * whole, v * whole

    def flat(x: np.ndarray) -> np.ndarray:
        return x.T.reshape(-1)[:n]

    found = flat(f1 * g1 / (f0 * g0 + f1 * g1))
    joint = [l0 * a * g0, l0 * b * g1, l1 * c * g0, l1 * d * g1]
    whole = sum(joint)
    pairs = np.array([flat(j / whole)[~first].sum() for j in joint]).reshape(2, 2)
    return found, pairs


@dataclass
class Model:
    known: np.ndarray  # sorted feature hashes
    weight: np.ndarray
    trans: np.ndarray
    curve: np.ndarray  # offset, and slopes of the document's two measures
    centre: np.ndarray
    spread: np.ndarray

    def toxic(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, words.features), len(self.known) - 1)
        scores = np.where(self.known[at] == words.features, self.weight[at], 0.0).sum(1)
        return marginals(scores[words.kind], self.trans, words.first)[0]

    def score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (measures(total, n) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def measures(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words are toxic, and which share, on logarithmic scales."""
    return np.stack([np.log(total + 0.05), np.log((total + 0.05) / (n + 20))], 1)


def _sums(x: np.ndarray, words: Words) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    # rounded, so that equal texts have equal sums whatever stands beside them
    return np.round(total[words.bounds[1:]] - total[words.bounds[:-1]], 6)


@dataclass
class Counts:
    """How many clean and toxic texts hold each feature."""

    values: np.ndarray  # sorted hashes
    ratio: np.ndarray  # logarithm of how much commoner it is in toxic texts
    z: np.ndarray  # the same in standard errors of the difference of shares

    @classmethod
    def of(cls, words: Words, toxic: np.ndarray) -> Counts:
        owner = np.repeat(np.arange(len(toxic)), np.diff(words.bounds)).astype(np.uint64)
        parts = []
        for column in words.features.T[1:]:
            pairs = np.stack([column[words.kind], owner], 1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs
            values, number = np.unique(pairs[:, 0], return_inverse=True)
            bad = np.bincount(number, toxic[pairs[:, 1].astype(np.int64)], len(values))
            parts.append((values, np.bincount(number, minlength=len(values)) - bad, bad))
        values, clean, bad = (np.concatenate(x) for x in zip(*parts))
        clean, bad = clean[values > 0], bad[values > 0]
        values = values[values > 0]
        n0, n1 = max((~toxic).sum(), 1), max(toxic.sum(), 1)
        pooled = (clean + bad) / (n0 + n1)
        z = (bad / n1 - clean / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n0 + 1 / n1))
        ratio = np.log((bad + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
        order = np.argsort(values)
        return cls(values[order], ratio[order], z[order])


def seeds(words: Words, toxic: np.ndarray, counts: Counts) -> np.ndarray:
    """First guesses for each word: 1 in toxic texts where a feature is surely commoner there, 0 elsewhere."""
    owner = np.repeat(np.arange(len(toxic)), np.diff(words.bounds))
    marks = counts.values[(counts.z >= SURE_Z) & (counts.ratio >= np.log(SEED_RATIO))]
    guess = np.isin(words.features[:, 1:], marks).any(1).astype(float)
    return np.where(toxic[owner], guess[words.kind], 0.0)


class _Part:
    """Some of the texts, with what a step of the ascent needs of them."""

    def __init__(self, words: Words, known: np.ndarray, toxic: np.ndarray) -> None:
        self.words, self.toxic, self.first = words, toxic, words.first
        self.owner = np.repeat(np.arange(len(toxic)), np.diff(words.bounds))
        at = np.minimum(np.searchsorted(known, words.features), len(known) - 1)
        self.row, column = np.nonzero(known[at] == words.features)
        self.feature = at[self.row, column]

    def marginals(self, weight: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.bincount(self.row, weight[self.feature], len(self.words.features))
        return marginals(score[self.words.kind], trans, self.first)

    def mark(self, label: np.ndarray) -> None:
        """Give each word the probability that it is toxic, and each pair of neighbours what follows from that."""
        self.label = label
        after = np.flatnonzero(~self.first)
        x, y = label[after - 1], label[after]
        self.wanted = np.array([((1 - x) * (1 - y)).sum(), ((1 - x) * y).sum(), (x * (1 - y)).sum(), (x * y).sum()])

    def slope(self, weight: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts under the labels less counts that the field expects: of features, and of neighbouring tags."""
        found, pairs = self.marginals(weight, trans)
        by_word = np.bincount(self.words.kind, self.label - found, len(self.words.features))
        return np.bincount(self.feature, by_word[self.row], len(weight)), self.wanted - pairs.reshape(-1)


def fitted_field(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, weight, trans) from labelled texts."""
    counts = Counts.of(words_of([lowered(t) for t in texts]), toxic)
    # what is as common in either kind of text tells nothing
    known = np.sort(np.concatenate([[_BIAS], counts.values[np.abs(counts.z) >= FEATURE_Z]]))
    parts = [_Part(words_of([lowered(t) for t in texts[i::PARTS]]), known, toxic[i::PARTS]) for i in range(min(PARTS, len(texts)))]
    weight, trans = np.zeros(len(known)), np.zeros((2, 2))
    weight[known == _BIAS] = -3.0
    m, v = np.zeros(len(known) + 4), np.zeros(len(known) + 4)
    for p in parts:
        p.mark(seeds(p.words, p.toxic, counts))
    for step in range(1, rounds * steps + 1):
        if step > steps and step % steps == 1:
            for p in parts:
                found = p.marginals(weight, trans)[0]
                p.mark(np.where(p.toxic[p.owner], np.where(found >= SURE, 1.0, np.where(found <= 1 - SURE, 0.0, found)), 0.0))
        slope, pairs = parts[step % len(parts)].slope(weight, trans)
        g = len(parts) * np.concatenate([slope, pairs]) - RIDGE * np.concatenate([weight, trans.reshape(-1)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weight, trans = weight + move[: len(known)], trans + move[len(known) :].reshape(2, 2)
    return known, weight, trans


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Offset and slopes of the logistic curve by Newton's method, with a small ridge."""
    a, weight = np.concatenate([np.ones((len(x), 1)), x], 1), weight / weight.mean()
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-3, *[0.05] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _usable() -> Column:
    return (F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES)


def eligible(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): every labelled document that may be chosen for fitting, once."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where(_usable()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return marks.join(usable, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Model | None:
    """None when either label is missing."""
    every = eligible(docs, labels)
    counts = {r["toxic"]: r["count"] for r in every.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    keys = every.withColumn("_h", F.xxhash64("doc_id")).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    for by in (["toxic", "_salt"], ["toxic"]):
        w = W.partitionBy(*by).orderBy("_h", "doc_id")
        keys = keys.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label)
    chosen = keys.select(F.col("doc_id").alias("_id"), "toxic", (F.col("_rn") % 3 == 0).alias("second"))  # two labels times per_label rows
    texts = docs.where(_usable()).select(F.col("doc_id").cast("long").alias("_id"), "text")
    rows = texts.join(F.broadcast(chosen), "_id").distinct().toPandas().sort_values(["_id", "text"])
    first = rows[~rows["second"]]
    if first["toxic"].nunique() < 2:
        first = rows
    known, weight, trans = fitted_field(first["text"].tolist(), first["toxic"].to_numpy() == 1)
    second = rows[rows["second"]]
    if second["toxic"].nunique() < 2:
        second = rows
    model = Model(known, weight, trans, np.zeros(3), np.zeros(2), np.ones(2))
    words = words_of([lowered(t) for t in second["text"]])
    x = measures(_sums(model.toxic(words), words), np.diff(words.bounds))
    model.centre, model.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    y = second["toxic"].to_numpy(float)
    stands_for = second["toxic"].map({q: counts[q] / (second["toxic"] == q).sum() for q in counts}).to_numpy(float)
    model.curve = curve((x - model.centre) / model.spread, y, stands_for)
    return model


def pieces(text: str, size: int = CHUNK) -> list[str]:
    """The text cut at white space into parts of at most ``size`` characters, where it has white space."""
    out, at = [], 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
        cut = cut if cut > at else at + size
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def tagged(model: Model, texts: list[str]) -> list[tuple[float, int, list[dict]]]:
    """(expected toxic words, words, spans) of each text, evaluated together."""
    words = words_of([lowered(t) for t in texts])
    toxic = model.toxic(words)
    total, n = _sums(toxic, words), np.diff(words.bounds)
    spans: list[list[dict]] = [[] for _ in texts]
    hit = np.flatnonzero(toxic >= 0.5)
    if len(hit):
        chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        owner = np.searchsorted(words.bounds, hit, "right") - 1
        base = np.cumsum([0, *[len(t) + 1 for t in texts]])
        new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner) > 0)])
        for a, b in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(hit)]):
            o = owner[a]
            begin, end = chars[words.start[hit[a]]] - base[o], chars[words.end[hit[b - 1]]] - base[o]
            spans[o].append({"begin": int(begin), "end": int(end), "p": float(toxic[hit[a:b]].max())})
    return list(zip(total.tolist(), n.tolist(), spans))


_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words, spans: one row for every row of ``docs``.

    ``spans`` are offsets of code points with the largest marginal inside.  Null
    and empty texts and texts without words have no toxic words and the curve's
    score for that.  Without labels of both kinds every score is 0 and there are
    no spans.  A null doc_id is not held out; repeated rows are scored alike; of
    several labels of one document the toxic one counts.
    """
    model = fit(docs, labels, per_label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "score", "toxic_words", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            total, count, spans = np.zeros(n), np.zeros(n), [[] for _ in range(n)]

            def learn(held: list[tuple[int, int, str]]) -> None:
                for (i, begin, _), (t, k, found) in zip(held, tagged(m, [x[2] for x in held])):
                    total[i] += t
                    count[i] += k
                    spans[i] += [s | {"begin": s["begin"] + begin, "end": s["end"] + begin} for s in found]

            held, size = [], 0
            for i, text in enumerate(b["text"].to_pylist() if m else []):
                begin = 0
                for piece in pieces(text or ""):
                    held.append((i, begin, piece))
                    begin += len(piece)
                    size += len(piece)
                    if size >= CHUNK:
                        learn(held)
                        held, size = [], 0
            if held:
                learn(held)
            score = m.score(total, count) if m else np.zeros(n)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array(total), pa.array(spans, _SPAN)], names)

    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), held_out, "text")
    found = rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, toxic_words double, spans array<struct<begin:long,end:long,p:double>>")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "toxic_words", "spans")
