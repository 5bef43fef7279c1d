"""Benchmark decontamination by template windows.

Texts are canonicalised: numbers, number words, names and units become typed
placeholders, other words are lower-cased.  Neighbouring capitalised words are
one name, however many there are.  Windows of WINDOW template tokens are
hash-joined with the benchmark's, so a question whose numbers or names were
changed still meets its source.  Names have three forms, and a window is met if
any of them meets: capitalised words inside a sentence are typed; none is typed
and every word stands for itself, so that a copy in other case meets; every
capitalised word is typed, also where a sentence begins or after a quote, colon
or bracket.  A meeting counts only where the slots are consistent: along one
alignment of document and item, equal values of the item must stand for equal
values of the document, and different ones for different ones; windows that hold
a slot which conflicts are left out.  A document leaks an item when consistent
windows cover COVERAGE of it.

Documents send only windows that a fixed-size bitmap of the benchmark's hashes
lets through; the join itself is exact and left to Spark's size estimates.  Texts
are cut into tokens by array operations over code points, many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallygrain.llm.repeats import inside, level
from tallygrain.llm.shared import MIX_A, fresh, mixed, tidy

WINDOW = 5
COVERAGE = 0.8
BITS = 22  # the bitmap has 2^BITS bits, whatever the size of the benchmark
CHUNK = 1 << 18
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
INNER, LITERAL, LOOSE = range(3)  # the forms: names inside sentences, no names, all capitalised words
SIGNS = {NUMBER: "\x01", NAME: "\x02", UNIT: "\x03"}
# fixed values: words that count as units after a number
UNITS = (
    "mm cm dm km mg kg lb lbs oz ml cl dl mi ft yd sec secs min mins hr hrs second seconds minute minutes hour hours day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons degree degrees percent dollar dollars "
    "cent cents euro euros"
).split()
# fixed values: words that count as numbers
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "forty fifty sixty seventy eighty ninety hundred thousand million dozen"
).split()
_LETTER, _DIGIT, _UPPER, _SMALL, _SPACE = 1, 2, 4, 8, 16
_JOINS = ".,:/"  # a number goes on after one of them
_BEFORE = ",;"  # besides small letters and digits, what may stand before the blank before a name inside a sentence
_INVERSE = np.uint64(pow(int(MIX_A), -1, 1 << 64))


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane its classes, and a hash of its small letter."""
    chars = [chr(i) for i in range(1 << 16)]
    kind = np.zeros(1 << 16, np.uint8)
    for flag, test in ((_LETTER, str.isalnum), (_UPPER, str.isupper), (_SMALL, str.islower), (_SPACE, str.isspace)):
        kind |= np.fromiter((flag * test(c) for c in chars), np.uint8, len(chars))
    digit = np.fromiter((c.isdecimal() for c in chars), bool, len(chars))
    kind[digit] = _DIGIT
    small = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)), np.uint64, len(chars))
    return kind, mixed((small + np.uint64(1)) * MIX_A)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash's factor and of its inverse."""
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, f)])) for f in (MIX_A, _INVERSE))


@dataclass
class Tokens:
    """Tokens of some texts, one after the other."""

    text: str  # the texts joined by line feeds
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # where each text's tokens begin, and one more
    hash: np.ndarray
    kind: np.ndarray  # WORD, NUMBER or UNIT
    capital: np.ndarray
    inner: np.ndarray
    follows: np.ndarray  # capitalised, after another capitalised word and white space

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        text = "\n".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # letters and signs beyond the first plane are letters without case
        low = np.where(points < 1 << 16, points, 0x4E00) if len(points) and points.max() >> 16 else points
        classes, hashes = _alphabet()
        c = classes[low]
        n = len(c)
        digit = (c & _DIGIT) > 0
        join = np.zeros(n, bool)
        join[1:-1] = digit[:-2] & digit[2:]
        join[join] = np.isin(points[join], [ord(j) for j in _JOINS])
        code = np.zeros(n + 2, np.uint8)  # a gap before and after
        code[1:-1] = np.where(digit | join, np.uint8(2), c & _LETTER)
        change = np.flatnonzero(code[1:] != code[:-1])
        start = change[code[change + 1] > 0]
        end = change[code[change] > 0]
        code = code[1:]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))

        up, down = _powers(1 << max(n, 1).bit_length())
        each = hashes[low] if low is points else np.where(points < 1 << 16, hashes[low], mixed(points.astype(np.uint64) * MIX_A))
        total = np.concatenate([[np.uint64(0)], np.cumsum(each * up[:n], dtype=np.uint64)])
        own = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

        def so_far(mask: np.ndarray) -> np.ndarray:
            out = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
            np.cumsum(mask.view(np.uint8), out=out[1:])
            return out

        small, other = so_far((c & _SMALL) > 0), so_far((code[:n] == 0) & ((c & _SPACE) == 0))
        number, m = code[start] == 2, len(start)
        capital = ~number & ((c[start] & _UPPER) > 0) & (small[end] > small[np.minimum(start + 1, end)])
        blank = start - 1
        before = np.maximum(start - 2, 0)
        fits = (c[before] & (_SMALL | _DIGIT) > 0) | np.isin(points[before], [ord(b) for b in _BEFORE]) if m else np.zeros(0, bool)
        inner = capital & (start >= 2) & (points[np.maximum(blank, 0)] == ord(" ")) & fits if m else capital
        near = np.zeros(m, bool)  # white space alone before it, in the same text
        near[1:] = other[start[1:]] == other[end[:-1]]
        near[bounds[:-1][np.diff(bounds) > 0]] = False
        follows = capital.copy()
        follows[1:] &= capital[:-1] & near[1:] & (start[1:] > end[:-1])
        follows[:1] = False
        kind = np.where(number, NUMBER, WORD).astype(np.int8)
        if m and texts is not _FIXED:
            units, numbers = _fixed()
            kind[np.isin(own, numbers)] = NUMBER
            after = near.copy()
            after[1:] &= kind[:-1] == NUMBER
            kind[after & np.isin(own, units)] = UNIT
        return cls(text, start, end, bounds, own, kind, capital & (kind == WORD), inner & (kind == WORD), follows & (kind == WORD))

    def value(self, a: int, b: int) -> str:
        """Tokens a to b (exclusive) in small letters with one blank between them."""
        return " ".join(self.text[self.start[a] : self.end[b - 1]].lower().split())


_FIXED = [" ".join(UNITS), " ".join(NUMBER_WORDS)]


@cache
def _fixed() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit words and of the number words."""
    t = Tokens.of(_FIXED)
    return t.hash[: t.bounds[1]], t.hash[t.bounds[1] :]


_PLACED = {k: mixed(np.full(1, 1000 + k, np.uint64))[0] for k in SIGNS}


@dataclass
class Stream:
    """The template tokens of one form."""

    at: np.ndarray  # the first token of each; a name has one or more
    bounds: np.ndarray
    hash: np.ndarray
    kind: np.ndarray

    def slots(self, tokens: Tokens, i: int, window: int) -> list[str]:
        """What the placeholders in the window at ``i`` stand for."""
        out = []
        for j in range(i, min(i + window, len(self.at))):
            if self.kind[j] != WORD and self.at[j] < tokens.bounds[np.searchsorted(tokens.bounds, self.at[i], "right")]:
                after = self.at[j + 1] if j + 1 < len(self.at) else len(tokens.start)
                last = self.at[j] + 1
                while self.kind[j] == NAME and last < after and tokens.follows[last]:
                    last += 1
                out.append(f"{self.kind[j]}{tokens.value(self.at[j], last)}")
        return out


def streams(t: Tokens) -> list[Stream]:
    """The three forms.  INNER and LOOSE count a run of capitalised words as one token, LITERAL every word."""
    at = np.flatnonzero(~t.follows)
    bounds = np.searchsorted(at, t.bounds)
    placed = np.zeros(4, np.uint64)
    placed[list(_PLACED)] = list(_PLACED.values())
    if len(at):
        inner = np.logical_or.reduceat(t.inner, at)
        words = np.add.reduceat(np.where(t.follows, mixed(t.hash), t.hash), at)
    else:
        inner, words = np.zeros(0, bool), np.zeros(0, np.uint64)
    out = []
    for name in (inner, None, t.capital[at]):
        kind = t.kind if name is None else np.where(name & t.capital[at], NAME, t.kind[at])
        own = t.hash if name is None else words
        stream = Stream(np.arange(len(t.start)) if name is None else at, t.bounds if name is None else bounds, own, kind)
        stream.hash = np.where(kind == WORD, own, placed[kind])
        out.append(stream)
    return out


def canonical(text: str) -> str:
    """Template tokens of the first form with a blank between them."""
    t = Tokens.of([text])
    first = streams(t)[INNER]
    return " ".join(SIGNS.get(int(k), "") or t.value(a, a + 1) for a, k in zip(first.at, first.kind))


def slots(text: str, window: int = WINDOW) -> list[list[str]]:
    """The placeholders' values in the window at each template token, in the first form."""
    t = Tokens.of([text])
    first = streams(t)[INNER]
    return [first.slots(t, i, window) for i in range(len(first.at))]


def windows(t: Tokens, forms: list[Stream], window: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each form window hashes, and whether they are whole and differ from earlier forms at the same token."""
    hashes, new, met = [], [], []
    for f in forms:
        h = level(f.hash, window, window)
        fresh_ = inside(f.bounds, window)
        for other in met:
            fresh_ &= h != other[f.at]
        everywhere = np.zeros(len(t.start), np.uint64)
        everywhere[f.at] = h
        met.append(everywhere)
        hashes.append(h)
        new.append(fresh_)
    return hashes, new


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, place, at, value, slots, n, form: the windows of each item, in each form in which they differ.

    Items shorter than a window have none.  A window of placeholders alone says
    nothing and is left out; ``n`` counts the others by the first form.  ``place``
    is a window's number in its form, ``at`` that of its first token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b["item_id"].to_pylist(), b["text"].to_pylist()):
                t = Tokens.of([text])
                forms = streams(t)
                hashes, new = windows(t, forms, window)
                at, n = set(), 0
                for form, (f, h, those) in enumerate(zip(forms, hashes, new)):
                    told = [i for i in np.flatnonzero(those).tolist() if (f.kind[i : i + window] == WORD).any()]
                    if form == INNER:
                        at, n = {int(f.at[i]) for i in told}, len(told)
                    for i in told:
                        if int(f.at[i]) in at:
                            out.append({"item_id": item, "place": i, "at": int(f.at[i]), "value": int(h[i].view(np.int64)), "slots": f.slots(t, i, window), "n": n, "form": form})
            yield pa.RecordBatch.from_pylist(out, _ITEMS)

    rows = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(tidy(run), "item_id long, place long, at long, value long, slots array<string>, n long, form int")


_ITEMS = pa.schema([("item_id", pa.int64()), ("place", pa.int64()), ("at", pa.int64()), ("value", pa.int64()), ("slots", pa.list_(pa.string())), ("n", pa.int64()), ("form", pa.int32())])
_HITS = pa.schema([("doc_id", pa.int64()), ("doc_place", pa.int64()), ("value", pa.int64()), ("doc_slots", pa.list_(pa.string())), ("literal", pa.bool_())])


def _bitmap(items: DataFrame) -> np.ndarray:
    """Which of 2^BITS buckets the benchmark's hashes fall in; Spark builds it in parts of 4 KB."""
    bucket = F.shiftrightunsigned("value", 64 - BITS)
    parts = items.select(bucket.alias("b")).groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("part"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("bits")).collect()
    full = np.zeros(1 << BITS, bool)
    for r in parts:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")[: 1 << BITS]
        full[(r["part"] - 1) * len(bits) :][: len(bits)] = bits
    return full


def document_windows(docs: DataFrame, bitmap: np.ndarray, window: int = WINDOW) -> DataFrame:
    """doc_id, doc_place, value, doc_slots, literal: the windows of whole texts, in each form, that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            ids, texts, at = b["doc_id"].to_pylist(), b["text"].to_pylist(), 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (size < CHUNK or end == at):
                    size += len(texts[end])
                    end += 1
                t = Tokens.of(texts[at:end])
                forms = streams(t)
                out = []
                for form, (f, h, those) in enumerate(zip(forms, *windows(t, forms, window))):
                    hits = np.flatnonzero(known[h >> np.uint64(64 - BITS)] & those)
                    owner = np.searchsorted(f.bounds, hits, "right") - 1
                    placed, values = (hits - f.bounds[owner]).tolist(), h[hits].view(np.int64).tolist()
                    for i, doc, place, value in zip(hits.tolist(), owner.tolist(), placed, values):
                        out.append({"doc_id": ids[at + doc], "doc_place": place, "value": value, "doc_slots": f.slots(t, i, window), "literal": form == LITERAL})
                yield pa.RecordBatch.from_pylist(out, _HITS)
                at = end

    rows = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(tidy(run), "doc_id long, doc_place long, value long, doc_slots array<string>, literal boolean")


def _conflicts(windows: Column) -> Column:
    """The item's values that stand for several values of the document, and the other way round."""
    pairs = F.array_distinct(F.flatten(F.transform(windows, lambda w: w["pairs"])))

    def twice(values: Column) -> Column:
        # the array of one binds the sorted values, so that they are sorted once
        return F.transform(F.array(F.array_sort(values)), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))[0]

    return F.transform(F.array(pairs), lambda p: F.struct(twice(p["slots"]).alias("slots"), twice(p["doc_slots"]).alias("doc_slots")))[0]


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_windows, reparameterised: one row for each item that a document leaks.

    Rows that share a doc_id count as one document, rows with a null id too.
    Null, empty and short texts leak nothing; items with fewer tokens than a
    window cannot be told from chance and are never reported.
    """
    # repeated rows of an item are one item
    items = item_windows(benchmark.select("item_id", "text").distinct(), window)
    met = document_windows(docs, _bitmap(items), window).join(items, "value")
    # places are counted alike in the two forms that fold names, and otherwise without them
    met = met.withColumn("literals", 2 * F.col("literal").cast("int") + (F.col("form") == LITERAL).cast("int")).withColumn("loose", F.col("form") == LOOSE)
    line = ["doc_id", "item_id", "n", "literals", "shift"]
    met = met.withColumn("shift", F.col("doc_place") - F.col("place"))
    aligned = met.groupBy(*line, "at", "value", "loose").agg(F.min(F.struct("slots", "doc_slots")).alias("s"))
    # one alignment has at most the item's windows, each in three forms
    windows = F.collect_list(F.struct("at", "loose", F.arrays_zip("s.slots", "s.doc_slots").alias("pairs")))
    lines = aligned.groupBy(*line).agg(windows.alias("windows"))
    # names typed loosely may hide no conflict, nor make one between other windows
    lines = lines.withColumn("strict", _conflicts(F.filter("windows", lambda w: ~w["loose"]))).withColumn("all", _conflicts(F.col("windows")))

    def consistent(w: Column) -> Column:
        against = F.when(w["loose"], F.col("all")).otherwise(F.col("strict"))
        return ~F.arrays_overlap(w["pairs"]["slots"], against["slots"]) & ~F.arrays_overlap(w["pairs"]["doc_slots"], against["doc_slots"])

    lines = lines.select("doc_id", "item_id", "n", F.filter("windows", consistent).alias("windows"))
    changed = F.exists("windows", lambda w: F.exists(w["pairs"], lambda p: p["slots"] != p["doc_slots"]))
    found = lines.select("doc_id", "item_id", "n", F.explode("windows.at").alias("at"), changed.alias("changed"))
    each = found.groupBy("doc_id", "item_id", "n", "at").agg(F.min(F.col("changed").cast("int")).alias("changed"))
    total = each.groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_windows"), F.max("changed").alias("changed"))
    share = F.col("n_windows") / F.col("n")
    return total.where(share >= coverage).select("doc_id", "item_id", share.alias("coverage"), "n_windows", (F.col("changed") == 1).alias("reparameterised"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document leaks no item."""
    leak = fresh(docs.columns, "_leak")[0]
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[leak]), "left_anti")
