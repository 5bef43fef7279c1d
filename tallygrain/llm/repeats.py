"""Removal of repeated word windows by level-wise doubling.

A window of ``WINDOW`` words can only be repeated if every shorter window in it
is.  The search starts at BASE words and doubles: only windows whose part of
the present length is repeated go on to twice that length, until the full
length is reached or no candidate is left.  At each shorter length one part
stands for the window, the one with the smallest hash (equal windows choose
equal parts), so about one position in eight is looked up, not every one.

Whole copies of a text are settled first by digest.  Within a task repeated
hashes are folded to one row before any shuffle, so a passage that a third of
all documents share sends one row per task.  Lookups are window counts over
(hash), which sort and spill; no list of positions of a hash is ever built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType

from tallygrain.llm.shared import MIX_A, MIX_B, batches_of, mixed, raw_texts, saved, swept, tidy

BASE = 5
WINDOW = 20
CHUNK = 1 << 20  # bytes of text that are hashed together
FOLD = 600_000  # lookup rows that a task folds at a time
LARGEST = 2**63 - 1
CHECK_BITS = 24  # bits of a second hash beside the 64 of a full window
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_INVERSE = np.uint64(pow(int(MIX_A), -1, 1 << 64))

Emit = Callable[..., tuple[np.ndarray, ...]]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, words being runs of bytes other than ASCII white space."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(b), MIX_A)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(start[-1]) if len(start) else 0, _INVERSE)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[b] * up[:-1], dtype=np.uint64)])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's words begin (one more entry than texts)."""
    words = [w for group in batches_of(iter(texts), CHUNK) for w in _split(group)]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), bounds


def _split(group: list[bytes]) -> list[np.ndarray]:
    together = word_hashes(b"\n".join(group))
    counts = [len(t.split()) for t in group]
    return np.split(together, np.cumsum(counts)[:-1])


def doubled(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of windows of ``want`` words from those of ``have``, by repeated doubling."""
    while have < want:
        n = max(0, len(h) - have)
        h = h[:n] * np.uint64(pow(int(MIX_B), have, 1 << 64)) + h[have : have + n]
        have *= 2
    return h


def level(words: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Hash of the window of ``length`` words at each position, 0 where there is none; length is base doubled."""
    n = max(0, len(words) - base + 1)
    h = np.zeros(n, np.uint64)
    for i in range(base):
        h = h * MIX_B + words[i : i + n]
    h = mixed(doubled(h, base, length)) | np.uint64(1)
    return np.concatenate([h, np.zeros(len(words) - len(h), np.uint64)])


def sliding(x: np.ndarray, width: int, least: bool, fill: int) -> np.ndarray:
    """Least or greatest of x[i : i + width]; positions beyond the end count as ``fill``."""
    pick, have = (np.minimum if least else np.maximum), 1
    x = np.concatenate([x, np.full(width, fill, x.dtype)])
    while have < width:
        step = min(have, width - have)
        x[: len(x) - step] = pick(x[: len(x) - step], x[step:])
        have += step
    return x[: len(x) - width]


def inside(bounds: np.ndarray, window: int) -> np.ndarray:
    """Which positions begin a full window of one text."""
    n = int(bounds[-1])
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + window <= end


def parts(h: np.ndarray, length: int, window: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest part hash of each valid window (0 elsewhere), and the positions of those parts."""
    width = window - length + 1
    low = np.where(valid, sliding(h, width, True, 0), np.uint64(0))
    reach = sliding(low[::-1], width, False, 0)[::-1]
    return low, np.flatnonzero((reach == h) & (h > 0))


def _folded(value: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by value and order; state 0: met once, 1: first of several, 2: a later one."""
    at = np.lexsort((*order[::-1], value))
    v = value[at]
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    last = np.concatenate([v[1:] != v[:-1], [True]]) if len(v) else np.zeros(0, bool)
    return at, np.where(first & last, 0, np.where(first, 1, 2)).astype(np.int8)


def _lookups(pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (value, id, copy, state) of part hashes, folded within the task."""

    def fold(held: list) -> pa.RecordBatch:
        value, key, copy = (np.concatenate(x) for x in zip(*held))
        at, state = _folded(value, key)
        # one row is enough for a value's later occurrences in one text
        v, k, c = value[at], key[at], copy[at]
        same = np.concatenate([[False], (v[1:] == v[:-1]) & (k[1:] == k[:-1]) & (c[1:] == c[:-1]) & (state[1:] == 2)])
        keep = ~same
        return pa.RecordBatch.from_arrays(
            [pa.array(v[keep].view(np.int64)), pa.array(k[keep]), pa.array(c[keep]), pa.array(state[keep])], ["value", "id", "copy", "state"]
        )

    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= FOLD:
            yield fold(held)
            held, size = [], 0
    if held:
        yield fold(held)


def _repeated(rows: DataFrame) -> DataFrame:
    """(id, copy, values): the part hashes of each text that occur elsewhere or twice."""
    # rows that are known to be repeated need not meet the others and are spread by their text
    met = W.partitionBy(F.when(F.col("state") == 2, F.xxhash64("id", "copy")).otherwise(F.col("value")), "value")
    seen = rows.withColumn("n", F.count("*").over(met)).where((F.col("state") > 0) | (F.col("n") > 1))
    return seen.groupBy("id", "copy").agg(F.collect_set("value").alias("values"))


def _keyed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """id (a null one last), two text digests, text, and columns that are carried along."""
    return docs.select(
        *carried,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("id"),
        F.xxhash64("text").alias("th"),
        F.xxhash64(F.lit(1), F.col("text")).alias("th2"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _with(fields: list[StructField], ddl: str) -> StructType:
    """A schema of carried columns, whatever their types, and of one's own."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def _sets(lists: pa.Array) -> list[np.ndarray | None]:
    """The values of a list column as sorted arrays."""
    flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lists.offsets.to_numpy()
    return [np.sort(flat[a:b]) if b > a else None for a, b in zip(offsets, offsets[1:])]


def member(values: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    if values is None or not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _runs(mask: np.ndarray) -> bytes:
    """Begin and end of each run of true positions."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8))).astype(np.int64).tobytes()


def _runs_of(key: np.ndarray, copy: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each text's positions as runs: (key, copy, begin and end of its runs)."""
    order = np.lexsort((at, copy, key))
    key, copy, at = key[order], copy[order], at[order]
    other = np.ones(len(at), bool)
    other[1:] = (key[1:] != key[:-1]) | (copy[1:] != copy[:-1])
    new = other.copy()
    new[1:] |= at[1:] != at[:-1] + 1
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:] - 1, [len(at) - 1]])[: len(begin)]
    both = np.stack([at[begin], at[last] + 1], 1).astype(np.int64)
    cut = np.searchsorted(begin, np.flatnonzero(other))
    return key[other], copy[other], [both[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(both)])]


def _mask(runs: bytes, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    both = np.frombuffer(runs, np.int64)
    np.add.at(edge, both[::2], 1)
    np.add.at(edge, both[1::2], -1)
    return np.cumsum(edge[:n]).astype(bool)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


class Repeats:
    """The search for one window length; see :func:`repeated_spans`."""

    def __init__(self, window: int = WINDOW, base: int = BASE) -> None:
        lengths = [base]
        while lengths[-1] < window:
            lengths.append(lengths[-1] * 2)
        if base < 1 or lengths[-1] != window:
            raise ValueError("window must be base doubled some times")
        self.window, self.base, self.lengths = window, base, lengths

    def start(self, docs: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
        """(state, candidates): all texts after the shortest length, and those that go on.

        With ``carried`` columns, every text stays in the state, to be written in the end.
        """
        window, base = self.window, self.base
        keyed, extra = _keyed(docs, carried), [docs.schema[c] for c in carried]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator:
                for b in batches:
                    ids = b["id"].to_numpy()
                    at = 0
                    for group in batches_of(iter(raw_texts(b["text"])), CHUNK):
                        words, bounds = hashed(group)
                        h = level(words, base, base)
                        _, where = parts(h, base, window, inside(bounds, window))
                        owner = np.searchsorted(bounds, where, "right") - 1
                        yield h[where], ids[at : at + len(group)][owner], np.zeros(len(where), np.int32)
                        at += len(group)

            return _lookups(pieces())

        rows = keyed.select("id", "text").mapInArrow(tidy(emit), "value long, id long, copy int, state byte")
        found = _repeated(rows).select("id", "values", F.lit(None).cast("long").alias("th"))
        # whole copies: all but the smallest id of equal texts
        names = keyed.where(F.length("text") >= 2 * window - 1).select("id", "th", "th2").distinct()
        first = names.groupBy("th", "th2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
        copies = names.join(first, ["th", "th2"]).where(F.col("id") > F.col("first")).select("id", F.lit(None).cast("array<long>").alias("values"), "th")
        known = found.unionByName(copies).groupBy("id").agg(F.flatten(F.collect_list("values")).alias("values"), F.collect_set("th").alias("copied"))

        def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdCompressor(level=3)
            for b in batches:
                blobs = pa.array([press.compress(t) for t in raw_texts(b["text"])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b[c] for c in carried], b["id"], b["th"], blobs], [*carried, "id", "th", "blob"])

        packed = keyed.select(*carried, "id", "th", "text").mapInArrow(tidy(squeeze), _with(extra, "id long, th long, blob binary"))
        joined = packed.join(known, "id", "left").sortWithinPartitions("id", "th")

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, copy = (None, None), 0
            for b in batches:
                ids, ths, blobs = b["id"].to_pylist(), b["th"].to_pylist(), b["blob"].to_pylist()
                copied, values = b["copied"].to_pylist(), _sets(b["values"])
                out: list[tuple] = []
                for i, key in enumerate(zip(ids, ths)):
                    if key[0] != last[0]:
                        copy = 0
                    elif key[1] != last[1]:
                        copy += 1
                    last = key
                    text = _text(blobs[i])
                    words = text.split()
                    if len(words) >= window and copied[i] and key[1] in copied[i]:
                        out.append((key[0], key[1], copy, len(words), np.array([0, len(words)], np.int64).tobytes(), digest([]), blobs[i] if carried else None, None))
                        continue
                    runs = b""
                    if len(words) >= window and values[i] is not None:
                        h, bounds = hashed([text])
                        low, _ = parts(level(h, base, base), base, window, inside(bounds, window))
                        runs = _runs(member(values[i], low) & (low > 0))
                    going = bool(runs)
                    out.append((key[0], key[1], copy, len(words), b"", None if going else digest(words), blobs[i] if going or carried else None, runs if going else None))
                own = pa.RecordBatch.from_pylist([dict(zip(_STARTED.names, r)) for r in out], _STARTED)
                yield pa.RecordBatch.from_arrays([*[b[c] for c in carried], *own.columns], [*carried, *own.schema.names])

        state = saved(joined.mapInArrow(tidy(narrow), _with(extra, _STARTED_SQL)), "repeats")
        candidates = state.where(F.col("runs").isNotNull()).select("id", "copy", "blob", "runs")
        return state, candidates

    def narrowed(self, candidates: DataFrame, length: int) -> DataFrame:
        """Candidates whose parts of ``length`` words are repeated too."""
        window, base = self.window, self.base

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator:
                for key, copy, words, valid in _open(batches):
                    h = level(words, length, base)
                    _, where = parts(h, length, window, valid)
                    yield h[where], np.full(len(where), key, np.int64), np.full(len(where), copy, np.int32)

            return _lookups(pieces())

        found = _repeated(candidates.mapInArrow(tidy(emit), "value long, id long, copy int, state byte"))

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                runs = []
                for blob, old, values in zip(b["blob"].to_pylist(), b["runs"].to_pylist(), _sets(b["values"])):
                    words = word_hashes(_text(blob))
                    low, _ = parts(level(words, length, base), length, window, _mask(old, len(words)))
                    runs.append(_runs(member(values, low) & (low > 0)))
                yield pa.RecordBatch.from_arrays([b["id"], b["copy"], b["blob"], pa.array(runs, pa.binary())], ["id", "copy", "blob", "runs"])

        return candidates.join(found, ["id", "copy"]).mapInArrow(tidy(narrow), "id long, copy int, blob binary, runs binary")

    def decided(self, candidates: DataFrame) -> DataFrame:
        """(id, copy, starts, found): the full windows of each text whose words also start earlier, as single
        starts and as runs of them."""
        window, base = self.window, self.base

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["value", "packed", "id", "copy", "state", "runs"]

            def fold(held: list) -> list[pa.RecordBatch]:
                value, check, key, copy, at = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((at, copy, key, check, value))
                value, check, key, copy, at = (x[order] for x in (value, check, key, copy, at))
                # a row that is repeated whole is one document, not a later one
                new = np.ones(len(at), bool)
                new[1:] = np.any([x[1:] != x[:-1] for x in (value, check, key, copy, at)], axis=0)
                value, check, key, copy, at = (x[new] for x in (value, check, key, copy, at))
                later = np.concatenate([[False], (value[1:] == value[:-1]) & (check[1:] == check[:-1])])
                first = ~later
                packed = (check.astype(np.int64) << 39) | at  # positions below 2^39
                n, (owners, copies, runs) = int(first.sum()), _runs_of(key[later], copy[later], at[later])
                blank = pa.nulls(len(runs), pa.int64())
                columns = [
                    pa.chunked_array([pa.array(value[first].view(np.int64)), blank]),
                    pa.chunked_array([pa.array(packed[first]), blank]),
                    pa.array(np.concatenate([key[first], owners])),
                    pa.array(np.concatenate([copy[first], copies])),
                    pa.array(np.repeat(np.array([0, 1], np.int8), [n, len(runs)])),
                    pa.chunked_array([pa.nulls(n, pa.binary()), pa.array(runs, pa.binary())]),
                ]
                return pa.table(columns, names).combine_chunks().to_batches()

            held, size = [], 0
            for key, copy, words, valid in _open(batches):
                where = np.flatnonzero(valid)
                value = level(words, window, base)[where]
                check = mixed(level(words ^ (words >> np.uint64(7)), window, base)[where]) >> np.uint64(64 - CHECK_BITS)
                held.append((value, check, np.full(len(where), key, np.int64), np.full(len(where), copy, np.int32), where))
                size += len(where)
                if size >= FOLD:
                    yield from fold(held)
                    held, size = [], 0
            if held:
                yield from fold(held)

        rows = candidates.mapInArrow(tidy(emit), "value long, packed long, id long, copy int, state byte, runs binary")
        rows = rows.select("value", F.shiftright("packed", 39).alias("check"), "packed", "id", "copy", "state", "runs")
        # what a task has found to be later ones is one row a text, and spread by it
        met = W.partitionBy(F.when(F.col("state") == 1, F.xxhash64("id", "copy")).otherwise(F.col("value")), "value", "check", "state")
        me = F.struct("id", "copy", "packed")
        later = rows.withColumn("first", F.min(me).over(met)).where((F.col("state") == 1) | (me > F.col("first")))
        place = F.col("packed").bitwiseAND((1 << 39) - 1)
        return later.select("id", "copy", place.alias("at"), "runs").groupBy("id", "copy").agg(F.collect_list("at").alias("starts"), F.collect_list("runs").alias("found"))


_STARTED = pa.schema(
    [("id", pa.int64()), ("th", pa.int64()), ("copy", pa.int32()), ("n_words", pa.int64()), ("gone", pa.binary()), ("kept_sha256", pa.string()), ("blob", pa.binary()), ("runs", pa.binary())]
)
_STARTED_SQL = "id long, th long, copy int, n_words long, gone binary, kept_sha256 string, blob binary, runs binary"


def _text(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        for key, copy, blob, runs in zip(*(b[c].to_pylist() for c in ("id", "copy", "blob", "runs"))):
            words = word_hashes(_text(blob))
            yield key, copy, words, _mask(runs, len(words))


def _searched(docs: DataFrame, window: int, base: int, carried: list[str]) -> DataFrame:
    """The state of every row, with the windows that were found to be repeated."""
    search = Repeats(window, base)
    state, candidates = search.start(docs, carried)
    swept(docs.sparkSession)
    for length in search.lengths[1:-1]:
        if length > search.lengths[1]:
            candidates = saved(candidates, "narrowed")
        candidates = search.narrowed(candidates, length)
    decided = search.decided(candidates)
    columns = [*carried, "id", "th", "copy", "n_words", "gone", "kept_sha256", "blob"]
    going = F.col("runs").isNotNull()
    open_rows = state.where(going).select(*columns).join(decided, ["id", "copy"], "left").withColumn("open", F.lit(True))
    none = [F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<binary>").alias("found"), F.lit(False).alias("open")]
    return open_rows.unionByName(state.where(~going).select(*columns, *none))


def _kept(words: int, window: int, starts: pa.Scalar, found: pa.Scalar) -> np.ndarray:
    """Which words are in no repeated window."""
    edge = np.zeros(words + 1, np.int64)
    if starts.is_valid:
        at = starts.values.to_numpy()
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        for runs in found.as_py():
            both = np.frombuffer(runs, np.int64)
            np.add.at(edge, both[::2], 1)
            np.add.at(edge, both[1::2] - 1 + window, -1)
    return np.cumsum(edge[:-1]) == 0


def repeated_spans(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, gone, kept_sha256: one row for every row of ``docs``.

    ``gone`` holds begin and end word numbers of the removed spans (pairs of
    64-bit integers), ``kept_sha256`` the digest of the kept words joined by one
    space.  Windows are judged on the input.  A null or empty text has no words;
    texts shorter than a window stay whole.  A null doc_id counts as the
    greatest.  Rows that share id and text are one document and get equal
    results; rows that share only the id are ordered by their text's hash.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, sha = b["gone"].to_pylist(), b["kept_sha256"].to_pylist()
            for i, (is_open, blob, starts, found) in enumerate(zip(b["open"].to_pylist(), b["blob"].to_pylist(), b["starts"], b["found"])):
                if is_open:
                    words = _text(blob).split()
                    keep = _kept(len(words), window, starts, found)
                    gone[i] = _runs(~keep)
                    sha[i] = digest([words[j] for j in np.flatnonzero(keep)])
            pairs = [np.frombuffer(g, np.int64) for g in gone]
            removed = [int((p[1::2] - p[::2]).sum()) for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["th"], b["n_words"], pa.array(removed, pa.int64()), pa.array(gone, pa.binary()), pa.array(sha, pa.string())],
                ["id", "text_hash", "n_words", "n_removed", "gone", "kept_sha256"],
            )

    rows = _searched(docs, window, base, []).mapInArrow(
        tidy(finish), "id long, text_hash long, n_words long, n_removed long, gone binary, kept_sha256 string"
    )
    return rows.withColumn("doc_id", F.when(F.col("id") != LARGEST, F.col("id"))).drop("id")


def without_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """``docs`` with repeated spans cut from the texts; texts of which no word is left are dropped.

    A text without repeats is unchanged; otherwise its kept words are joined by
    one space.  ``n_chars`` follows the text where the column exists.  All other
    columns travel with the compressed text, so that no text is joined again.
    """
    names = docs.columns
    inner = [f"c{i}_" for i in range(len(names))]  # any name may stand in a table, but not in a Python stage
    at, key = inner[names.index("text")], inner[names.index("doc_id")]
    carried = [*[c for c in inner if c != at], "null_"]
    plain = docs.toDF(*inner).withColumns({"text": F.col(at), "doc_id": F.col(key), "null_": F.col(at).isNull()}).drop(at)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep_row = [], []
            columns = (b["open"].to_pylist(), b["null_"].to_pylist(), b["gone"].to_pylist(), b["n_words"].to_pylist(), b["blob"].to_pylist(), b["starts"], b["found"])
            for is_open, is_null, gone, n, blob, starts, found in zip(*columns):
                keep = _kept(n, window, starts, found) if is_open else ~_mask(gone, n)
                whole = bool(keep.all())
                if whole:
                    text = None if is_null else _text(blob).decode()
                else:
                    words = _text(blob).split() if keep.any() else []
                    text = b" ".join([words[j] for j in np.flatnonzero(keep)]).decode() if words else ""
                texts.append(text)
                keep_row.append(whole or bool(text))
            out = [pa.array(texts, pa.string()) if c == at else b[c] for c in inner]
            yield pa.RecordBatch.from_arrays(out, inner).filter(pa.array(keep_row, pa.bool_()))

    schema = StructType([StructField(c, f.dataType) for c, f in zip(inner, docs.schema)])
    rows = _searched(plain, window, base, carried).mapInArrow(tidy(cut), schema)
    out = rows.toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
