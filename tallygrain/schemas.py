"""Explicit schemas of every table.  Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d, _b, _ts = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


VECTOR = T.ArrayType(T.FloatType(), False)
GPS = _struct(("lat", _d), ("lon", _d))
EXIF = _struct(("present", _b), ("software", _s), ("device", _s), ("taken_at", _ts), ("gps", GPS))

CLAIMS = _struct(
    ("id", _s, False), ("claimant_name", _s), ("loss_type", _s), ("amount_requested", _i), ("status", _s),
    ("policy_number", _s), ("destruction_pct_claimed", _i), ("submitted_at", _ts), ("decided_at", _ts),
    ("duration_ms", _l), ("verdict", _s), ("score", _i), ("latest_state_hash", _s), ("assigned_to", _s),
)
EVIDENCE = _struct(
    ("file_id", _s, False), ("claim_id", _s, False), ("seq", _i), ("kind", _s), ("filename", _s),
    ("mime_type", _s), ("size_bytes", _l), ("sha256", _s), ("p_hash", _s), ("exif", EXIF), ("created_at", _ts),
)
OCR_PAGES = _struct(("file_id", _s, False), ("page", _i), ("text", _s))
OCR_TEXT = _struct(("file_id", _s, False), ("text", _s), ("hindi", _b))
IMAGE_VECTORS = _struct(("file_id", _s, False), ("claim_id", _s), ("seq", _i), ("kind", _s), ("vec", VECTOR))
PROMPT_VECTORS = _struct(
    ("pos", _i, False), ("signal", _s), ("loss_type", _s), ("side", _s), ("rung", _s), ("weight", _i), ("vec", VECTOR)
)
MEMORY = _struct(
    ("claim_id", _s), ("file_id", _s), ("label", _s), ("source", _s), ("vec", VECTOR), ("at", _ts), ("seq", _l)
)
POLICIES = _struct(("policy_number", _s, False), ("claimant", _s), ("limit_inr", _i), ("loss_types", T.ArrayType(_s)))
TRAIL = _struct(
    ("claim_id", _s, False), ("seq", _l, False), ("state_hash", _s), ("prev_record_hash", _s), ("record_hash", _s),
    ("status", _s), ("ts", _l), ("recorded_by", _s), ("note", _s),
)
SEALED_EVENTS = T.StructType(
    TRAIL.fields + _struct(("tx_hash", _s), ("block_number", _l), ("log_index", _l)).fields
)
AUDIT_RECORDS = _struct(
    ("claim_id", _s), ("state_hash", _s), ("status", _s), ("recorded_by", _s), ("note", _s), ("ts", _ts)
)
USERS = _struct(
    ("id", _s, False), ("email", _s), ("password_hash", _s), ("name", _s), ("role", _s), ("district", _s),
    ("created_at", _ts),
)
ASSIGNMENTS = _struct(("claim_id", _s), ("assigned_to", _s), ("assigned_by", _s), ("assigned_at", _ts))
TRANSITIONS = _struct(
    ("claim_id", _s), ("seq", _l), ("requested", _s), ("note", _s), ("reviewer", _s), ("ts", _ts)
)
REFLECTANCE = _struct(("tile_id", _s), ("obs_date", T.DateType()), ("band", _s), ("value", _d))

STAGE_LOG = _struct(("stage", _s), ("result", _s), ("details", _s))
RUN_STAGE = _struct(("stage", _s), ("result", _s), ("details", _s), ("reasons", T.ArrayType(_s)))
# a verification run without its document summary
RUNS = _struct(
    ("claim_id", _s), ("run_id", _s), ("run_at", _ts), ("claimant_name", _s), ("loss_type", _s),
    ("amount_requested", _i), ("verdict", _s), ("score", _i), ("reasons", T.ArrayType(_s)),
    ("stages", T.ArrayType(RUN_STAGE)), ("run_digest", _s),
)
# one snapshot file: {savedAt, contract, claims: [...]}
SNAPSHOT_CLAIM = _struct(
    ("id", _s), ("claimantName", _s), ("lossType", _s), ("amountRequested", _i), ("status", _s),
    ("submittedAt", _s), ("policyNumber", _s), ("destructionPctClaimed", _i), ("latestStateHash", _s),
    ("verification", _struct(
        ("verificationId", _s), ("startedAt", _s), ("finishedAt", _s), ("durationMs", _l), ("verdict", _s),
        ("score", _i), ("stages", T.ArrayType(STAGE_LOG)), ("explanation", _s),
    )),
)
SNAPSHOT = _struct(("savedAt", _s), ("contract", _s), ("claims", T.ArrayType(SNAPSHOT_CLAIM)))
MANIFEST = _struct(("lossType", _s), ("district", _s), ("note", _s))

# the five relational tables, by name
RELATIONAL = {
    "users": USERS,
    "claims": CLAIMS,
    "evidence": EVIDENCE,
    "audit_records": AUDIT_RECORDS,
    "assignments": ASSIGNMENTS,
}

EVENTS_RAW = _struct(
    ("event_id", _l), ("ts", T.TimestampNTZType()), ("user_id", _l), ("event_type", _s), ("value", _d), ("props", _s)
)
ORDERS_RAW = _struct(
    ("o_orderkey", _l), ("o_custkey", _l), ("o_orderstatus", _s), ("o_totalprice", _d),
    ("o_orderdate", T.TimestampNTZType()), ("o_orderpriority", _s),
)
LINEITEM_RAW = _struct(
    ("l_orderkey", _l), ("l_partkey", _l), ("l_suppkey", _l), ("l_linenumber", _i), ("l_quantity", _d),
    ("l_extendedprice", _d), ("l_discount", _d), ("l_tax", _d), ("l_returnflag", _s), ("l_linestatus", _s),
    ("l_shipdate", T.TimestampNTZType()),
)
