"""Which status may follow which, and what may be paid."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.operators.spread import previous_row

# fixed values: what counts as white space around a note
WHITE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def payout_code(current: Column) -> Column:
    return (
        F.when(current == "AI_FLAGGED", "FLAGGED_LOCKED")
        .when(~current.isin(*C.PAYABLE), "INVALID_STATE")
        .otherwise("OK")
    )


def transition_code(current: Column, requested: Column, note: Column) -> Column:
    """``OK`` or the first rule that refuses the request."""
    code = (
        F.when(requested.isin(*C.COMPUTED_VERDICTS), "AI_VERDICTS_ARE_COMPUTED")
        .when(requested == "PAID", "USE_PAY_ENDPOINT")
        .when(requested.isin(*C.NEVER_REQUESTED), "INVALID_TRANSITION")
        .when(current.isin(*C.TERMINAL), "TERMINAL_STATE")
    )
    length = F.length(F.trim(F.coalesce(note, F.lit("")), F.lit(WHITE)))
    for target, (allowed, least) in C.HUMAN_STEPS.items():
        code = code.when((requested == target) & ~current.isin(*allowed), "INVALID_TRANSITION")
        code = code.when((requested == target) & (length < least), "REASON_TOO_SHORT")
    return code.when(requested.isin(*C.HUMAN_STEPS), "OK").otherwise("INVALID_TRANSITION")


def judge(current: str, kind: str, requested: str, note: str | None) -> str:
    """The same rules for one request, where requests are walked one after the other."""
    if kind == "verdict":
        return "OK" if current not in C.TERMINAL else "TERMINAL_STATE"
    if kind == "pay":
        if current == "AI_FLAGGED":
            return "FLAGGED_LOCKED"
        return "OK" if current in C.PAYABLE else "INVALID_STATE"
    if requested in C.COMPUTED_VERDICTS:
        return "AI_VERDICTS_ARE_COMPUTED"
    if requested == "PAID":
        return "USE_PAY_ENDPOINT"
    if requested in C.NEVER_REQUESTED:
        return "INVALID_TRANSITION"
    if current in C.TERMINAL:
        return "TERMINAL_STATE"
    allowed, least = C.HUMAN_STEPS.get(requested, ([], 0))
    if current not in allowed:
        return "INVALID_TRANSITION"
    return "OK" if len((note or "").strip(WHITE)) >= least else "REASON_TOO_SHORT"


def walk_requests(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Human requests with ``current``, the status each one meets, and ``code``.

    The requests of a claim are judged in the order of ts, seq where there is
    one, and then their content; an accepted one changes the status that the
    next one meets.  Sorted rows stream through a task with one status in
    memory, so a claim with very many requests needs no group in memory.
    """
    now = claims.select(F.col("id").alias("claim_id"), F.col("status").alias("current"))
    joined = requests.join(now, "claim_id").withColumn("code", F.lit("")).select(*requests.columns, "current", "code")
    order = ["claim_id", "ts", *(["seq"] if "seq" in requests.columns else []), "requested", "note", "reviewer"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim, status = None, ""
        for rows in batches:
            met, codes = [], []
            for key, requested, note, first in zip(rows["claim_id"], rows["requested"], rows["note"], rows["current"]):
                if key != claim:
                    claim, status = key, first
                code = judge(status, "human", requested, note)
                met.append(status)
                codes.append(code)
                status = requested if code == "OK" else status
            yield rows.assign(current=met, code=codes)

    return joined.repartition("claim_id").sortWithinPartitions(*order).mapInPandas(walk, joined.schema)


def may_reopen(status: Column) -> Column:
    """Terminal claims take neither new evidence nor a new run."""
    return ~status.isin(*C.TERMINAL)


def check_payouts(claims: DataFrame) -> DataFrame:
    return claims.withColumn("payout_code", payout_code(F.col("status")))


def check_requests(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """One step: each request against the claim's present status."""
    now = claims.select(F.col("id").alias("claim_id"), F.col("status").alias("current"))
    return requests.join(now, "claim_id").withColumn(
        "code", transition_code(F.col("current"), F.col("requested"), F.col("note"))
    )


def audit_history(history: DataFrame) -> DataFrame:
    """Judge each recorded step against the status recorded before it.

    ``history`` has claim_id, seq, status, note.  The first record of a claim is
    judged from SUBMITTED.
    """
    stepped = previous_row(history, "claim_id", "seq", {"status": "previous"})
    previous = F.coalesce(F.col("previous"), F.lit("SUBMITTED"))
    return stepped.withColumn("previous", previous).withColumn(
        "code", transition_code(F.col("previous"), F.col("status"), F.col("note"))
    )
