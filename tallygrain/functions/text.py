"""Text, scripts and names as Catalyst expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallygrain import constants as C

# fixed values: white space outside ASCII that must count as white space
WIDE_BLANKS = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
DEVA_DIGITS = "०१२३४५६७८९"
# fixed values: letters that Unicode composition takes apart or puts together
SPLIT_LETTERS = {
    "\u0958": "क", "\u0959": "ख", "\u095a": "ग", "\u095b": "ज",
    "\u095c": "ड", "\u095d": "ढ", "\u095e": "फ", "\u095f": "य",
}
JOINED_LETTERS = {"न": "\u0929", "र": "\u0931", "ळ": "\u0934"}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    An expression that is used twice is otherwise evaluated twice wherever it
    stands in a branch, and the plan grows with every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_if_empty(s: Column) -> Column:
    return F.get(F.array_remove(F.array(s), F.lit("")), F.lit(0))


def _where_wide(s: Column, changed: Column) -> Column:
    """``changed`` for texts with letters outside ASCII; others hold nothing to change."""
    return F.when(F.octet_length(s) > F.length(s), changed).otherwise(s)


def plain_blanks(s: Column) -> Column:
    """Turn every wide blank into an ordinary one."""
    return _where_wide(s, F.translate(s, WIDE_BLANKS, " " * len(WIDE_BLANKS)))


def plain_signs(s: Column) -> Column:
    """Ordinary blanks and ASCII digits, in one pass."""
    return _where_wide(s, F.translate(s, WIDE_BLANKS + DEVA_DIGITS, " " * len(WIDE_BLANKS) + "0123456789"))


def flatten(s: Column) -> Column:
    return F.regexp_replace(plain_blanks(s), r"\s+", " ")


def ascii_digits(s: Column) -> Column:
    return F.translate(s, DEVA_DIGITS, "0123456789")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, ASCII_UPPER, ASCII_LOWER)


def is_hindi(s: Column) -> Column:
    return s.rlike("[ऀ-ॿ]")


def short_hash(h: Column) -> Column:
    return F.when(F.length(h) > 14, F.concat(F.substring(h, 1, 8), F.lit("…"), F.right(h, F.lit(4)))).otherwise(h)


def indian_digits(n: Column) -> Column:
    """12,34,567 grouping of a whole number."""
    def grouped(digits: Column) -> Column:
        head = F.regexp_extract(digits, r"^(-?\d*?)(\d{1,3})$", 1)
        tail = F.regexp_extract(digits, r"^(-?\d*?)(\d{1,3})$", 2)
        return let(
            head,
            lambda h: F.when(h.isin("", "-"), digits).otherwise(
                F.concat(F.regexp_replace(h, r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), tail)
            ),
        )

    return let(n.cast("long").cast("string"), grouped)


def transliterate(s: Column) -> Column:
    """Devanagari to lower-case Latin letters; other scripts are dropped."""
    return F.when(is_hindi(s), _from_devanagari(s)).otherwise(_from_latin(s))


def _from_latin(s: Column) -> Column:
    """``transliterate`` of a text without Devanagari."""
    kept = F.lower(F.regexp_replace(s, "[^A-Za-z0-9 \\-_./]+", ""))
    return F.trim(F.regexp_replace(kept, "[ \\-_./]+", " "))


def _from_devanagari(s: Column) -> Column:
    consonants = "".join(C.CONSONANTS)
    matras = "".join(C.MATRAS)
    out = s
    for letter, base in SPLIT_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(base + C.NUKTA))
    for base, joined in JOINED_LETTERS.items():
        out = F.replace(out, F.lit(base + C.NUKTA), F.lit(joined))
    # a consonant keeps its own vowel unless a vowel sign or a virama follows
    out = F.regexp_replace(out, f"([{consonants}])[{C.NUKTA}\\u200D\\u200C]+", "$1")
    out = F.regexp_replace(out, f"([{consonants}])(?![{matras}{C.VIRAMA}])", "$1a")
    out = F.regexp_replace(out, f"([{consonants}]){C.VIRAMA}", "$1")
    letters = {**C.CONSONANTS, **C.VOWELS, **C.MATRAS, **C.SIGNS}
    for letter, latin in letters.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in letters.items() if len(v) == 1}
    blanks = C.DANDAS + "-_./"
    out = F.translate(
        out, "".join(single) + blanks + ASCII_UPPER, "".join(single.values()) + " " * len(blanks) + ASCII_LOWER
    )
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]", ""), " +", " "))


def name_tokens(latin: Column) -> Column:
    """Usable tokens of a transliterated name."""
    cleaned = F.transform(F.split(latin, " "), lambda t: F.regexp_replace(t, "[^a-z]", ""))
    return F.filter(cleaned, lambda t: (F.length(t) >= 3) & ~t.isin(*C.NAME_STOPS))


def token_match(x: Column, y: Column) -> Column:
    """Same token: equal, one a prefix of the other, or a small edit distance."""
    lx, ly = F.length(x), F.length(y)
    near = F.when(
        (lx >= 5) & (ly >= 5), F.levenshtein(x, y, 2) >= 0
    ).otherwise(F.levenshtein(x, y, 1) >= 0)
    prefix = (lx >= 4) & (ly >= 4) & (x.startswith(y) | y.startswith(x))
    return (x == y) | prefix | near


def token_score(a: Column, b: Column) -> Column:
    """0..100: share of the shorter token list with a partner in the longer one."""
    def score(p: Column) -> Column:
        hits = F.size(F.filter(p["short"], lambda x: F.exists(p["long"], lambda y: token_match(x, y))))
        n = F.size(p["short"])
        return F.when(n > 0, F.floor(hits * F.lit(100.0) / n + F.lit(0.5))).otherwise(F.lit(0)).cast("int")

    def order(p: Column) -> Column:
        swap = F.size(p["a"]) > F.size(p["b"])
        return F.struct(
            F.when(swap, p["b"]).otherwise(p["a"]).alias("short"), F.when(swap, p["a"]).otherwise(p["b"]).alias("long")
        )

    return let(let(F.struct(a.alias("a"), b.alias("b")), order), score)


def name_score(name_a: Column, name_b: Column) -> Column:
    return token_score(name_tokens(transliterate(name_a)), name_tokens(transliterate(name_b)))


def word_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in a lower-cased text."""
    hits = F.lit(0)
    for word in words:
        hits = hits + F.contains(text, F.lit(word)).cast("int")
    return hits


def document_role(text: Column, filename: Column) -> Column:
    """struct of signature counts per role and the best role (ties: aadhaar, registry, policy)."""
    lowered = F.lower(F.concat(text, F.lit(" "), F.coalesce(filename, F.lit(""))))
    names = list(C.ROLE_SIGNS)
    hits = let(
        lowered, lambda t: F.struct(*[word_hits(t, words).alias(f"{role}_hits") for role, words in C.ROLE_SIGNS.items()])
    )

    def choose(h: Column) -> Column:
        counts = [h[f"{role}_hits"] for role in names]
        best = F.greatest(*counts)
        role = F.when(best == 0, F.lit(None).cast("string"))
        for name, count in zip(names, counts):
            role = role.when(count == best, F.lit(name))
        return F.struct(*[c.alias(f"{n}_hits") for n, c in zip(names, counts)], role.alias("role"))

    return let(hits, choose)
