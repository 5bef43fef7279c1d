"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes, frozen after
training: a context of up to three bytes knows how often each byte followed it.
A byte that a context has not seen is coded by an escape and the next shorter
context, without the bytes already ruled out, down to a uniform order.  The
trees of all languages share one set of nodes, so the exact code length of a
byte in every language is one row of a table, and a text is scored by walking
the nodes with array look-ups.

The model is fitted on a bounded sample of labelled rows (``TRAIN_DOCS`` texts
per language); every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallygrain.llm.shared import LETTER, crc_mod, fresh, quoted, raw_texts, tidy

TRAIN_DOCS = 600  # texts per language that the trees are fitted on
LANGUAGES = 256  # languages that get trees, those with most labelled texts
SALTS = 64
MAX_CONTEXTS = 12_000  # contexts of three bytes that are kept, every language's most frequent in turn
TABLE_BYTES = 256 << 20  # size of the frozen table; many languages or symbols leave room for fewer contexts
ORDER = 3
START = b"\n" * ORDER  # every text is read as if it followed line ends
CHUNK = 1 << 20
SCORE_BYTES = 64  # the score is the posterior of a text of at most this length
UNKNOWN = "und"


@dataclass
class Model:
    """Frozen trees: node tables, and code lengths in bits per (node, byte, language)."""

    languages: list[str]
    letter: np.ndarray  # byte -> symbol
    pair: np.ndarray  # symbol * n + symbol -> node of the last two bytes or less
    triple: np.ndarray  # node of two * n + symbol -> node of the last three or less
    bits: np.ndarray  # (node of three * n + symbol, language)

    @property
    def symbols(self) -> int:
        return int(self.letter.max()) + 1


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """A bounded sample (lang, text) of the rows whose remainder is not 1.

    The rows are chosen by short keys, ranked first within salted parts of a
    language, so neither texts nor one language meet in a task.  Of more than
    LANGUAGES labels those with most different texts are taken (ties: the
    alphabetically first), so mistyped labels cannot push a language out.
    """
    rows = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & (crc_mod("doc_id", 3) != 1)
    )
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    keys = rows.select("lang", "_h", (F.col("_h") % SALTS).alias("_salt")).distinct()
    first = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    for by in (["lang", "_salt"], ["lang"]):
        w = W.partitionBy(*by).orderBy("_h")
        keys = keys.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_language).drop("_rn")
    # at most per_language keys for each of LANGUAGES languages, so the broadcast is bounded
    chosen = keys.drop("_salt").join(F.broadcast(first), "lang", "left_semi")
    return rows.join(F.broadcast(chosen), ["lang", "_h"], "left_semi").select("lang", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, dict[int, int]] = {}
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), raw_texts(b["text"])):
            own = totals.setdefault(lang, {})
            for at in range(0, len(text), CHUNK):
                head = (START + text[:CHUNK]) if at == 0 else text[at - ORDER : at + CHUNK]
                x = np.frombuffer(head, np.uint8).astype(np.int64)
                grams = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
                for g, n in zip(*map(np.ndarray.tolist, np.unique(grams, return_counts=True))):
                    own[g] = own.get(g, 0) + n
    for lang, own in totals.items():
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(own), pa.string()),
                "gram": pa.array(list(own.keys()), pa.int64()),
                "n": pa.array(list(own.values()), pa.int64()),
            }
        )


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS, max_contexts: int = MAX_CONTEXTS) -> Model | None:
    """Count in Spark over the bounded sample, then freeze the trees; None when nothing is labelled."""
    counts = training_rows(docs, per_language).mapInArrow(tidy(_count), "lang string, gram long, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    return freeze(rows["lang"].to_numpy(), rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), max_contexts)


def freeze(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, max_contexts: int = MAX_CONTEXTS) -> Model:
    languages = sorted(set(lang))
    which = np.searchsorted(languages, lang)
    parts = [(gram >> s) & 255 for s in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate([*parts, [10]]))
    letter = np.zeros(256, np.int64)
    letter[seen] = np.arange(1, len(seen) + 1)  # symbol 0: any byte never met
    a, (p, q, r, x), k = len(seen) + 1, [letter[v] for v in parts], len(languages)

    # contexts by length; the longer ones are kept by frequency in each language, and all of their suffixes with them
    room = max(TABLE_BYTES // (4 * a * k) - a, 0)
    deep, short = (p * a + q) * a + r, q * a + r
    keys = _most_frequent(deep, which, n, min(max_contexts, room // 3))
    two = _most_frequent(short, which, n, room // 3)
    two = np.union1d(two, keys % (a * a))
    base2, base3 = 1 + a, 1 + a + len(two)
    nodes = base3 + len(keys)

    pair = np.tile(np.arange(1, a + 1), a)  # the node of the last byte alone
    pair[two] = base2 + np.arange(len(two))
    triple = np.empty((base3, a), np.int64)
    triple[0] = np.arange(1, a + 1)
    triple[1 : 1 + a] = pair.reshape(a, a)
    triple[base2:] = pair.reshape(a, a)[two % a]
    owner, right = _places(two, keys // a)
    triple[base2 + owner[right], keys[right] % a] = base3 + np.flatnonzero(right)
    suffix = np.zeros(nodes, np.int64)
    suffix[base2:base3] = 1 + two % a
    suffix[base3:] = base2 + np.searchsorted(two, keys % (a * a))

    bits = np.empty((nodes, a, k), np.float32)
    (at2, known), (at3, kept) = _places(two, short), _places(keys, deep)
    for j in range(k):
        own = which == j
        c = np.zeros((nodes, a), np.float64)
        np.add.at(c[0], x[own], n[own])
        np.add.at(c, (1 + r[own], x[own]), n[own])
        both = own & known
        np.add.at(c, (base2 + at2[both], x[both]), n[both])
        both = own & kept
        np.add.at(c, (base3 + at3[both], x[both]), n[both])
        bits[:, :, j] = _code_lengths(c, suffix)
    return Model(languages, letter, pair, triple.ravel(), bits.reshape(nodes * a, k))


def _most_frequent(context: np.ndarray, which: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` contexts, sorted: every language's first, every language's second, and so on."""
    pairs, inverse = np.unique(np.stack([which, context]), axis=1, return_inverse=True)
    weight = np.bincount(inverse.ravel(), n)
    order = np.lexsort((pairs[1], -weight, pairs[0]))
    lang, own = pairs[0][order], pairs[1][order]
    rank = np.arange(len(lang)) - np.searchsorted(lang, lang)
    own = own[np.lexsort((lang, rank))]
    _, first = np.unique(own, return_index=True)
    return np.sort(own[np.sort(first)[:most]])


def _places(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def _code_lengths(c: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Bits per (node, symbol): escape to the suffix node, whose seen symbols lose those ruled out before."""
    total = np.zeros(c.shape)
    done = np.zeros(c.shape, bool)
    excluded = np.zeros(c.shape, bool)
    node = np.arange(len(c))
    for step in range(ORDER + 1):
        left = np.where(excluded, 0.0, c[node])
        n, kinds = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
        met = (left > 0) & ~done
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(met, np.log2((n + kinds) / np.where(left > 0, left, 1)), 0)
            total += np.where(~done & ~met & (n > 0), np.log2((n + kinds) / np.maximum(kinds, 1)), 0)
        done |= met
        excluded |= c[node] > 0
        if step < ORDER:
            stop = node == 0  # the root is read once
            excluded |= stop[:, None] & (c[0] > 0)[None, :]
            node = np.where(stop, 0, suffix[node])
    rest = 256 - np.minimum(excluded.sum(1, keepdims=True), 255)
    return total + np.where(done, 0, np.log2(rest))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Total bits of each whole text in each language."""
    a, out = model.symbols, np.zeros((len(texts), len(model.languages)))
    pieces: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal pieces, size
        if not pieces:
            return
        s = model.letter[np.frombuffer(b"".join(p for _, p in pieces), np.uint8)]
        one = model.pair[s[:-1] * a + s[1:]]
        two = model.triple[one[:-1] * a + s[2:]]
        cost = model.bits[two[:-1] * a + s[3:]]
        ends = np.cumsum([len(p) for _, p in pieces])
        begins = ends - [len(p) for _, p in pieces]
        marks = np.stack([begins, ends - ORDER], 1).ravel()  # what crosses into the next piece is not counted
        marks = np.minimum(marks, len(cost))
        sums = np.add.reduceat(np.vstack([cost, np.zeros((1, cost.shape[1]), cost.dtype)]), marks, axis=0, dtype=np.float64)[::2]
        np.add.at(out, [i for i, _ in pieces], sums)
        pieces, size = [], 0

    for i, t in enumerate(texts):
        for at in range(0, len(t), CHUNK):
            piece = (START + t[:CHUNK]) if at == 0 else t[at - ORDER : at + CHUNK]
            pieces.append((i, piece))
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    return out


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and three more: lang_pred, score (0 to 1) and bits_per_byte.

    Where ``keep`` has such a name, the new one is lengthened by underscores.
    A text that is null or has no letter gets ``und``, score 0.  Of equally
    short codes the alphabetically first language wins.  Without a model every
    text is ``und``.  Rows are never merged, so repeated rows and null ids stay.
    """
    keep = keep or ["doc_id"]
    added = fresh(keep, "lang_pred", "score", "bits_per_byte")
    inner = [f"c{i}" for i in range(len(keep))]  # any name may stand in a table, but not in a Python stage
    spark, has_letter = docs.sparkSession, re.compile(LETTER)
    shared = spark.sparkContext.broadcast(model) if model else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw_texts(b["whole"])
            lang = [UNKNOWN] * len(texts)
            points, rate = np.zeros(len(texts)), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if shared and t and has_letter.search(t.decode("utf-8", "replace"))]
            if todo:
                m = shared.value
                length = np.array([len(texts[i]) for i in todo], float)
                bits = code_lengths(m, [texts[i] for i in todo])
                best = bits.argmin(1)
                over = (bits - bits.min(1, keepdims=True)) * np.minimum(1, SCORE_BYTES / length)[:, None]
                points[todo] = 1 / np.exp2(-np.minimum(over, 1000)).sum(1)
                rate[todo] = bits.min(1) / length
                for i, j in zip(todo, best):
                    lang[i] = m.languages[j]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in inner), pa.array(lang, pa.string()), pa.array(points), pa.array(rate)],
                [*inner, "lang", "score", "bits"],
            )

    rows = docs.select(*quoted(keep), F.col("text")).toDF(*inner, "whole")
    schema = rows.drop("whole").schema.add("lang", "string").add("score", "double").add("bits", "double")
    return rows.mapInArrow(tidy(score), schema).toDF(*keep, *added)


def language_id(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every document."""
    found = identify(docs, fit(docs, per_language))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
