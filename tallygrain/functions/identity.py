"""Does the holder of an identity card appear in a land record?

Works on a DataFrame that has one card name and one land-record text per row.
Columns are added step by step so that each one is computed once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain.functions import patterns as P
from tallygrain.functions.extract import land_record_owner
from tallygrain.functions.text import name_tokens, plain_blanks, token_match, token_score, transliterate
from tallygrain import constants as C

_TMP = ["_low", "_latin", "_a", "_cands", "_scored", "_best_c", "_words", "_near", "_masks", "_starts", "_best_w", "_first", "_owner"]


def _mask(word: Column, tokens: Column, near: Column) -> Column:
    """Bit i is set when the word matches card token i; -1 marks an honorific.

    ``near`` holds the words that match any token.
    """
    bits = F.transform(
        tokens, lambda a, i: F.when(token_match(a, word), F.call_function("shiftleft", F.lit(1), i)).otherwise(0)
    )
    any_bits = F.aggregate(bits, F.lit(0), lambda acc, b: acc.bitwiseOR(b))
    return F.when(word.isin(*C.NAME_STOPS), F.lit(-1)).when(F.array_contains(near, word), any_bits).otherwise(F.lit(0))


def _window_score(masks: list[Column], n_tokens: Column) -> Column:
    """Name score of a run of words, from the words' masks."""
    usable = sum(((m >= 0).cast("int") for m in masks), F.lit(0))
    hit_words = sum(((m > 0).cast("int") for m in masks), F.lit(0))
    joined = F.lit(0)
    for m in masks:
        joined = joined.bitwiseOR(F.when(m > 0, m).otherwise(0))
    hits = F.when(n_tokens <= usable, F.bit_count(joined)).otherwise(hit_words)
    n = F.least(n_tokens, usable)
    return F.when(n > 0, F.floor(hits * 100.0 / n + 0.5)).otherwise(0).cast("int")


def with_identity(df: DataFrame, card_name: str, card_name_deva: str, deed_text: str) -> DataFrame:
    """Add ``identity``: struct(matched, inconclusive, score, aadhaar_name,
    registry_name, transliterated, detail)."""
    holder = F.coalesce(F.col(card_name), F.col(card_name_deva))
    before_kin = F.regexp_extract_all(plain_blanks(F.col(deed_text)), F.lit(P.DEED_PERSON_LINES), F.lit(1))
    out = (
        df.withColumn("_low", F.lower(F.col(deed_text)))
        .withColumn("_owner", land_record_owner(F.col(deed_text)))
        .withColumn("_latin", transliterate(holder))
        .withColumn("_a", name_tokens(F.col("_latin")))
        # candidates in order: parsed owner, then names before a relation marker
        .withColumn(
            "_cands",
            F.array_compact(
                F.concat(
                    F.array(F.col("_owner")),
                    # the pattern tries many lengths at every letter, so it runs only where a marker stands
                    F.when(F.col(deed_text).isNull(), F.lit(None))
                    .when(reduce(or_, [F.contains(F.col("_low"), F.lit(w)) for w in P.KIN]), F.transform(before_kin, F.trim))
                    .otherwise(F.array().cast("array<string>")),
                )
            ),
        )
        .withColumn(
            "_scored",
            F.transform(
                F.col("_cands"),
                lambda c, i: F.struct(
                    token_score(F.col("_a"), name_tokens(transliterate(c))).alias("score"), (-i).alias("rank"), c.alias("name")
                ),
            ),
        )
        .withColumn("_best_c", F.array_max("_scored"))
        # every run of two or three words of the whole text that holds a word near a card token; others score 0
        .withColumn("_words", F.regexp_extract_all(transliterate(F.col(deed_text)), F.lit("(?<![^ ])[a-z]{3,}(?![^ ])"), F.lit(0)))
        .withColumn(
            "_near",
            F.filter(
                F.array_distinct("_words"), lambda w: ~w.isin(*C.NAME_STOPS) & F.exists(F.col("_a"), lambda a: token_match(a, w))
            ),
        )
        .withColumn(
            "_masks", F.when(F.size("_near") > 0, F.transform("_words", lambda w: _mask(w, F.col("_a"), F.col("_near"))))
        )
        .withColumn(
            "_starts",
            F.array_distinct(
                F.flatten(
                    F.filter(
                        F.transform(
                            F.col("_masks"), lambda m, i: F.when(m > 0, F.sequence(F.greatest(i - 2, F.lit(0)), i))
                        ),
                        lambda near: near.isNotNull(),
                    )
                )
            ),
        )
    )
    n_words, n_tokens = F.size("_words"), F.size("_a")

    def at(i: Column, step: int) -> Column:
        return F.get(F.col("_masks"), i + step)

    def runs(length: int) -> Column:
        return F.array_max(
            F.transform(
                F.filter("_starts", lambda i: i + length <= n_words),
                lambda i: F.struct(
                    _window_score([at(i, s) for s in range(length)], n_tokens).alias("score"),
                    (-(i * 2 + (length - 2))).alias("rank"),
                    F.lit(length).alias("length"),
                    i.alias("start"),
                ),
            )
        )

    out = out.withColumn("_best_w", F.greatest(runs(2), runs(3))).withColumn(
        "_first", F.get(F.filter(F.split(F.col("_latin"), " "), lambda w: F.length(w) >= 3), F.lit(0))
    )
    c_score = F.coalesce(F.col("_best_c.score"), F.lit(0))
    w_score = F.coalesce(F.col("_best_w.score"), F.lit(0))
    from_words = w_score > c_score
    name = F.when(
        from_words,
        F.array_join(F.slice("_words", F.col("_best_w.start") + 1, F.col("_best_w.length")), " "),
    ).when(c_score > 0, F.col("_best_c.name"))
    best = F.greatest(c_score, w_score)
    weak = (best < 50) & (F.length("_first") >= 4) & F.array_contains("_words", F.col("_first"))
    out = out.withColumn(
        "identity",
        F.struct(
            F.when(weak, F.lit(45)).otherwise(best).alias("score"),
            F.when(weak, F.col("_first")).otherwise(name).alias("name"),
            holder.alias("holder"),
        ),
    )
    score, name, holder = F.col("identity.score"), F.col("identity.name"), F.col("identity.holder")
    no_holder = holder.isNull()
    matched = score >= 50
    inconclusive = ~matched & F.col("_owner").isNull()
    detail = (
        F.when(
            no_holder,
            F.lit("no readable name extracted from the Aadhaar — identity cross-check inconclusive"),
        )
        .when(matched, F.format_string('Aadhaar "%s" ↔ registry "%s" (match %d%%)', holder, name, score))
        .when(
            inconclusive,
            F.format_string(
                "registry scan too degraded to extract a name — identity cross-check inconclusive "
                "(best %d%%); human review advised",
                score,
            ),
        )
        .when(
            score > 0,
            F.format_string(
                'weak: Aadhaar "%s" only partially found in registry ("%s", %d%%) — manual review required',
                holder,
                name,
                score,
            ),
        )
        .otherwise(F.format_string('Aadhaar "%s" does not appear in the registry (best %d%%)', holder, score))
    )
    return out.withColumn(
        "identity",
        F.struct(
            F.when(no_holder, F.lit(False)).otherwise(matched).alias("matched"),
            F.when(no_holder, F.lit(True)).otherwise(inconclusive).alias("inconclusive"),
            F.when(no_holder, F.lit(0)).otherwise(score).alias("score"),
            holder.alias("aadhaar_name"),
            F.when(~no_holder, F.coalesce(F.trim(name), F.col("_owner"))).alias("registry_name"),
            F.col("_latin").alias("transliterated"),
            detail.alias("detail"),
        ),
    ).drop(*_TMP)
