"""Digests over claims, runs and trail records.

``Digest`` is any function from a string column to a hex string column, so a
trail that was sealed with another hash can be checked by passing that hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Digest = Callable[[Column], Column]


def sha2_digest(text: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(text, 256))


def packed(*parts: Column) -> Column:
    """Join parts so that no two different lists give the same text.

    Each part is written with its length in front; a missing part is ``-``.
    """
    pieces = []
    for part in parts:
        text = part.cast("string")
        pieces.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*pieces)


def claim_key(claim_id: Column, digest: Digest = sha2_digest) -> Column:
    return digest(claim_id)


def evidence_digests(
    image_hashes: Column, evidence_hashes: Column, p_hashes: Column, digest: Digest = sha2_digest
) -> Column:
    """The ordered digest list of a claim: labels, file digests, hashed image hashes."""
    as_digest = lambda h: F.when(h.startswith("0x"), h).otherwise(digest(h))
    empty = F.array().cast("array<string>")
    return F.concat(
        F.transform(F.coalesce(image_hashes, empty), as_digest),
        F.transform(F.coalesce(evidence_hashes, empty), as_digest),
        F.transform(F.coalesce(p_hashes, empty), lambda p: digest(p)),
    )


def state_hash(
    claim_id: Column,
    loss_type: Column,
    claimant: Column,
    amount: Column,
    digests: Column,
    sealed_at: Column,
    run_digest: Column | None = None,
    digest: Digest = sha2_digest,
) -> Column:
    """Commitment to a claim's content.  ``digests`` is one text, e.g. a joined list."""
    parts = [claim_id, loss_type, claimant, amount, digests]
    if run_digest is not None:
        parts.append(run_digest)
    return digest(packed(*parts, sealed_at))


def record_payload(state: Column, status: Column, ts: Column, by: Column, note: Column, digest: Digest) -> Column:
    """Everything a record commits to apart from its predecessor.

    The note enters as a digest, so the payload has a bounded length whatever
    the note says.
    """
    return packed(state, status, ts, by, digest(F.coalesce(note, F.lit(""))))


def record_hash(prev: Column, payload: Column, digest: Digest = sha2_digest) -> Column:
    return digest(F.concat(prev, F.lit("|"), payload))


def run_digest(claim_id: Column, verdict: Column, score: Column, stages: Column, digest: Digest = sha2_digest) -> Column:
    """Digest of a stage log, free of timings so that a re-run gives the same."""
    lines = F.transform(stages, lambda s: F.concat_ws(":", s["stage"], s["result"], s["details"]))
    return digest(
        F.to_json(
            F.struct(claim_id.alias("claimId"), score.alias("score"), lines.alias("stages"), verdict.alias("verdict"))
        )
    )


def sorted_json(**fields: Column) -> Column:
    """JSON text with keys in alphabetical order and no blanks."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
