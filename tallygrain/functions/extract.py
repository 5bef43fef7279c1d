"""Fields of identity cards, land records, policy papers and bills.

Every function takes a text column and returns one struct column, built from
ordered ``coalesce`` chains of pattern extracts.  A pattern runs only on texts
that hold one of its anchor words (``patterns.ANCHORS``), which a byte search in
the lower-cased text tells; digits are looked for once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from tallygrain.functions import patterns as P
from tallygrain.functions.numeric import half_up, round_to
from tallygrain.functions.text import flatten, is_hindi, let, none_if_empty, plain_blanks, plain_signs


def _find(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, trimmed; null when there is none."""
    return none_if_empty(F.trim(F.regexp_extract(text, pattern, group)))


def _searched(texts: Column) -> Column:
    """A struct with ``flat`` and what the anchors are looked for in."""
    def more(t: Column) -> Column:
        return F.struct(t.alias("t"), F.lower(t["flat"]).alias("low"), t["flat"].rlike("[0-9]").alias("digit"))

    return let(texts, more)


def _worth(s: Column, pattern: str) -> Column:
    """Does a text hold an anchor of the pattern?"""
    words = P.ANCHORS.get(pattern)
    if words is None:
        return F.lit(True)
    if words is P.ANCHORS[P.CARD_DOB]:
        return s["digit"]
    return reduce(or_, [F.contains(s["low"], F.lit(w)) for w in words])


def _seek(s: Column, pattern: str, text: str = "flat") -> Column:
    """``_find`` in one of the texts, where it can find anything."""
    return F.when(_worth(s, pattern), _find(s["t"][text], pattern))


def _first_line(lines: Column, pattern: str) -> Column:
    line = F.get(F.filter(lines, lambda s: s.rlike(pattern)), F.lit(0))
    return _find(line, pattern)


def _number(digits: Column) -> Column:
    """Number written with thousands commas; only commas count as zero."""
    return let(
        F.replace(digits, F.lit(","), F.lit("")),
        lambda v: F.when(v == "", F.lit(0.0)).otherwise(v.try_cast("double")),
    )


def _with_confidence(fields: Column, names: list[str], counted: list) -> Column:
    """The fields plus the share of the counted ones that were found."""
    def close(f: Column) -> Column:
        found = sum((test(f).cast("int") for test in counted), F.lit(0))
        share = round_to(found / F.lit(float(len(counted))), 2)
        return F.struct(*[f[n].alias(n) for n in names], share.alias("confidence"))

    return let(fields, close)


def _has(name: str):
    return lambda f: f[name].isNotNull()


def identity_card(text: Column) -> Column:
    def fields(s: Column) -> Column:
        raw, flat = s["t"]["raw"], s["t"]["flat"]
        # the full number never leaves this expression
        digits = F.regexp_replace(F.regexp_extract(flat, P.CARD_NUMBER, 1), "[^0-9xX]", "")
        return F.struct(
            F.coalesce(_seek(s, P.CARD_LATIN_NAME, "raw"), _seek(s, P.CARD_LABELLED_NAME)).alias("name"),
            F.when(is_hindi(raw), _find(raw, P.CARD_DEVA_NAME)).alias("name_devanagari"),
            F.coalesce(_seek(s, P.CARD_DOB), _seek(s, P.CARD_DOB_ISO)).alias("dob"),
            let(
                digits, lambda d: F.when(F.length(d) >= 4, F.concat(F.lit("XXXX XXXX "), F.right(d, F.lit(4))))
            ).alias("aadhaar_masked"),
            F.when(_worth(s, P.CARD_FEMALE) & raw.rlike(P.CARD_FEMALE), F.lit("female"))
            .when(_worth(s, P.CARD_MALE) & raw.rlike(P.CARD_MALE), F.lit("male")).alias("gender"),
        )

    texts = let(
        plain_blanks(text),
        lambda t: F.struct(t.alias("raw"), F.regexp_replace(plain_signs(t), r"\s+", " ").alias("flat")),
    )
    return _with_confidence(
        let(_searched(texts), fields),
        ["name", "name_devanagari", "dob", "aadhaar_masked", "gender"],
        [
            lambda f: f["name"].isNotNull() | f["name_devanagari"].isNotNull(),
            _has("dob"),
            _has("aadhaar_masked"),
            _has("gender"),
        ],
    )


def _owner(s: Column) -> Column:
    """struct(name, relation) of the owner in a flattened land record."""
    def choose(buyer: Column) -> Column:
        relative = F.when(buyer.isNull(), _seek(s, P.DEED_RELATION))
        return let(
            relative,
            lambda r: F.struct(
                F.coalesce(buyer, r, _seek(s, P.DEED_LABELLED)).alias("name"),
                F.when(r.isNotNull(), F.lit("relative")).alias("relation"),
            ),
        )

    def clean(o: Column) -> Column:
        junk = F.regexp_replace(o["name"], r"\s+", "").rlike(P.DEED_JUNK_OWNER)
        return F.struct(F.when(~junk, o["name"]).alias("name"), o["relation"].alias("relation"))

    return let(let(_seek(s, P.DEED_BUYER), choose), clean)


def _flat(text: Column) -> Column:
    return F.struct(F.regexp_replace(plain_signs(text), r"\s+", " ").alias("flat"))


def land_record_owner(text: Column) -> Column:
    return let(_searched(_flat(text)), _owner)["name"]


def land_record(text: Column) -> Column:
    def fields(s: Column) -> Column:
        return let(
            _owner(s),
            lambda owner: F.struct(
                owner["name"].alias("owner_name"),
                owner["relation"].alias("owner_relation"),
                F.coalesce(_seek(s, P.DEED_DISTRICT), _seek(s, P.DEED_DISTRICT_KNOWN)).alias("district"),
                _seek(s, P.DEED_VILLAGE).alias("village"),
                _seek(s, P.DEED_TYPE).alias("deed_type"),
                F.coalesce(_seek(s, P.DEED_DATE_WORDS), _seek(s, P.DEED_DATE_DIGITS)).alias("execution_date"),
                _number(F.coalesce(_seek(s, P.DEED_AMOUNT), _seek(s, P.DEED_AMOUNT_SLASH))).alias("area_value"),
                _seek(s, P.DEED_KHASRA).alias("khasra_no"),
                _seek(s, P.DEED_AREA).alias("area_hectares"),
                _seek(s, P.DEED_STATE).alias("state"),
            ),
        )

    return _with_confidence(
        let(_searched(_flat(text)), fields),
        [
            "owner_name", "owner_relation", "district", "village", "deed_type", "execution_date", "area_value",
            "khasra_no", "area_hectares", "state",
        ],
        [_has("owner_name"), _has("district"), _has("deed_type"), _has("execution_date"), _has("khasra_no")],
    )


def policy_paper(text: Column) -> Column:
    def fields(s: Column) -> Column:
        t = s["t"]
        lines = F.split(t["text"], "\n+")

        def line(pattern: str) -> Column:
            return F.when(_worth(s, pattern), _first_line(lines, pattern))

        return F.struct(
            F.upper(
                F.coalesce(
                    line(P.PAPER_NUMBER_LINE),
                    _seek(s, P.PAPER_NUMBER_SLASHES),
                    _seek(s, P.PAPER_NUMBER_DASHES),
                )
            ).alias("policy_number"),
            F.coalesce(line(P.PAPER_INSURED_LINE), _seek(s, P.PAPER_INSURED_FLAT)).alias("insured_name"),
            _number(F.coalesce(_seek(s, P.PAPER_SUM), _seek(s, P.PAPER_SUM_ANY))).alias("sum_insured"),
            F.array_compact(
                F.array(*[F.when(t["text"].rlike(pattern), F.lit(loss)) for loss, pattern in P.PAPER_COVERAGE])
            ).alias("coverage"),
        )

    texts = let(
        plain_signs(text),
        lambda t: F.struct(t.alias("text"), F.regexp_replace(t, r"\s+", " ").alias("flat")),
    )
    return _with_confidence(
        let(_searched(texts), fields),
        ["policy_number", "insured_name", "sum_insured", "coverage"],
        [
            _has("policy_number"),
            _has("insured_name"),
            lambda f: F.coalesce(f["sum_insured"] != 0, F.lit(False)),
            lambda f: F.size(f["coverage"]) > 0,
        ],
    )


def bill(text: Column) -> Column:
    def amount(s: Column, pattern: str) -> Column:
        return let(
            _number(_seek(s, pattern)),
            lambda v: F.when((v > 0) & (v < P.BILL_AMOUNT_LIMIT), half_up(v).cast("long")),
        )

    def name(s: Column, pattern: str) -> Column:
        return let(
            _seek(s, pattern),
            lambda v: F.when((F.length(v) >= 3) & ~F.lower(v).isin(*P.BILL_NAME_STOPS), v),
        )

    def fields(s: Column) -> Column:
        return F.struct(
            F.upper(F.coalesce(*[_seek(s, p) for p in P.BILL_NUMBERS])).alias("policy_number"),
            F.coalesce(*[name(s, p) for p in P.BILL_NAMES]).alias("name"),
            F.coalesce(*[amount(s, p) for p in P.BILL_AMOUNTS]).alias("amount"),
        )

    return _with_confidence(
        let(_searched(F.struct(flatten(text).alias("flat"))), fields),
        ["policy_number", "name", "amount"],
        [_has("policy_number"), _has("amount"), _has("name")],
    )
