"""The same questions as ANSI SQL, for checking in another engine.

Written independently of the DataFrame code: plain cross joins, row_number and
recursion where the jobs use banded joins, group limits and chunked folds.
"""

from __future__ import annotations

from tallygrain import constants as C
from tallygrain.sources import driver_views as V


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(key: str, mapping: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _person_deva(k: str) -> str:
    return f"({_list(V.FIRST_DEVA)})[({k}) % 8 + 1] || ' ' || ({_list(V.LAST_DEVA)})[(({k}) // 8) % 8 + 1]"


def _person(k: str) -> str:
    return f"({_list(V.FIRST_NAMES)})[({k}) % 8 + 1] || ' ' || ({_list(V.LAST_NAMES)})[(({k}) // 8) % 8 + 1]"


def _bits(hex_text: str) -> str:
    return "(" + " || ".join(
        f"to_base(CAST('0x' || substr({hex_text}, {at}, 8) AS BIGINT), 2, 32)" for at in (1, 9)
    ) + ")"


_POLICY_LIST = _list([p[0] for p in C.POLICIES])
_FILE = "concat_ws('-', 'ev', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER))"
_KIND = f"({_list(V.EVIDENCE_KINDS)})[(l_partkey + l_linenumber) % 7 + 1]"
_LAT = "(17.5::DOUBLE + CAST(l_partkey % 40 * 9 AS DOUBLE) / 100)"
_LON = "(72.9::DOUBLE + CAST(l_partkey % 40 * 13 % 52 AS DOUBLE) / 10)"
_TILE = (
    "('T' || CAST(CAST(floor({lat} * 100 + 0.5) AS BIGINT) AS VARCHAR) || "
    "CAST(CAST(floor({lon} * 100 + 0.5) AS BIGINT) AS VARCHAR))"
)
_ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_ms({t}) % 1000 AS VARCHAR), 3, '0') || 'Z'"
_SEC = "strftime({t}, '%Y-%m-%d %H:%M:%S')"

VIEWS = f"""
WITH RECURSIVE staff AS (SELECT count(*) AS n FROM supplier),
claims AS (
  SELECT *, CASE WHEN verdict IS NOT NULL THEN make_timestamp(epoch_us(submitted_at) + duration_ms * 1000) END AS decided_at
  FROM (
    SELECT o_orderkey AS k, 'CLM-' || o_orderkey AS id, c_name AS claimant_name,
      ({_list(C.LOSS_TYPES)})[o_orderkey % 3 + 1] AS loss_type,
      CAST(floor(o_totalprice / 5) AS BIGINT) AS amount_requested,
      ({_list(C.STATUSES)})[o_orderkey % 10 + 1] AS status,
      CASE WHEN o_orderkey % 5 < 4 THEN ({_POLICY_LIST})[o_orderkey % 4 + 1] END AS policy_number,
      CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 101 END AS destruction_pct_claimed,
      o_orderdate AS submitted_at,
      CASE WHEN o_orderkey % 10 <> 0 THEN 1000 + (o_orderkey * 37) % 9000 END AS duration_ms,
      CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'AI_APPROVED' WHEN 2 THEN 'AI_FLAGGED' WHEN 4 THEN 'AI_APPROVED'
        WHEN 5 THEN 'AI_REJECTED' WHEN 9 THEN 'AI_REJECTED' ELSE 'AI_FLAGGED' END AS verdict,
      CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey * 7) % 101 END AS score,
      '0x' || sha256('state-' || o_orderkey) AS latest_state_hash,
      CASE WHEN o_orderkey % 4 = 0 THEN 'USR-' || (o_custkey % (SELECT n FROM staff)) END AS assigned_to
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
),
users AS (
  SELECT 'USR-' || s_suppkey AS id, 'user' || s_suppkey || '@example.org' AS email, sha256(s_name) AS password_hash,
    s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'inspector' ELSE 'supervisor' END AS role, n_name AS district,
    make_timestamp((1704067200 + s_suppkey * 86400) * 1000000) AS created_at
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
),
assignments AS (
  SELECT 'CLM-' || o_orderkey AS claim_id, 'USR-' || ((o_custkey + r * 3) % ((SELECT n FROM staff) + 2)) AS assigned_to,
    make_timestamp(epoch_us(o_orderdate) + r * 3600000000) AS assigned_at
  FROM orders, (VALUES (0), (1)) v(r) WHERE o_orderkey % 4 = 0 AND (r = 0 OR o_orderkey % 8 = 0)
),
evidence AS (
  SELECT {_FILE} AS file_id, 'CLM-' || l_orderkey AS claim_id, l_linenumber AS seq, {_KIND} AS kind, l_partkey AS part,
    ({_list(["image/jpeg", "image/png", "application/pdf", "image/gif"])})[l_partkey % 4 + 1] AS mime_type,
    CAST(l_quantity * 300000 AS BIGINT) AS size_bytes,
    '0x' || sha256(CASE WHEN l_partkey % 10 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE {_FILE} END) AS sha256,
    CASE WHEN {_KIND} IN ('photo', 'satellite') THEN
      CASE WHEN l_partkey % 10 = 0
        THEN substr({_bits("sha256('part-' || l_partkey)")}, 1, 64 - l_linenumber) || repeat('0', l_linenumber)
        ELSE {_bits(f"sha256({_FILE})")} END END AS p_hash,
    l_partkey % 3 <> 0 AS exif_present, CASE WHEN l_partkey % 11 = 0 THEN 'Photoshop' END AS software,
    CASE WHEN l_partkey % 5 <> 0 THEN {_LAT} END AS lat, CASE WHEN l_partkey % 5 <> 0 THEN {_LON} END AS lon,
    l_shipdate AS created_at, l_orderkey, l_extendedprice
  FROM lineitem
),
ocr AS (
  SELECT *, CASE
    WHEN part % 13 = 0 THEN ''
    WHEN kind = 'photo' THEN 'field ' || (['flood water', 'dry cracked soil', 'dead cattle', 'green crop'])[part % 4 + 1]
    WHEN kind = 'bill' THEN 'policy ' || number || ' insured: ' || {_person("l_orderkey")} || ' claim amount '
      || CAST(trunc(l_extendedprice / 4) AS BIGINT)
    WHEN kind = 'id' THEN 'Name: ' || {_person("l_orderkey")} || chr(10) || 'voter card'
    WHEN kind = 'registry' THEN 'sale deed khasra no 45/' || (part % 90 + 1) || chr(10) || 'District Nanded' || chr(10) || CASE
      WHEN part % 7 = 1 THEN '## ## ##' WHEN part % 2 = 0 THEN 'क्रेता: ' || {_person_deva("owner")} || ' पुत्र ' ELSE 'owner: ' || {_person("owner")} END
    WHEN kind = 'aadhaar' THEN 'GOVERNMENT OF INDIA' || chr(10) || 'Name: ' || {_person("l_orderkey")} || chr(10) || 'DoB: 03/01/1995' || chr(10) || 'MALE' || chr(10)
      || '5522 6616 ' || lpad(CAST(part % 10000 AS VARCHAR), 4, '0')
    WHEN kind = 'policy' THEN 'Policy No: ' || number || chr(10) || 'Insured Name: ' || {_person("l_orderkey")} || chr(10) || 'Sum Insured: Rs '
      || (part * 50 + 5000) || chr(10) || 'flood drought'
    ELSE '' END AS text
  FROM (SELECT *, CASE WHEN part % 3 = 0 THEN l_orderkey + 9 ELSE l_orderkey END AS owner, ({_list([p[0] for p in C.POLICIES] + ["MH-99-0001"])})[part % 5 + 1] AS number FROM evidence)
),
docs AS (
  SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN 'GOVERNMENT OF INDIA' || chr(10) || 'Name: ' || {_person("doc_id")} || chr(10) || 'DoB: 03/01/1995' || chr(10)
      || 'MALE' || chr(10) || '5522 6616 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || chr(10)
    WHEN 1 THEN 'sale deed khasra no 45/' || (doc_id % 90 + 1) || chr(10)
      || 'District Nanded village Rampur area 2.5 hectare maharashtra' || chr(10) || '12/03/2019 Rs 50,000' || chr(10)
      || 'owner: ' || {_person("doc_id")} || ' 77' || chr(10)
    WHEN 2 THEN 'policy no: ' || ({_POLICY_LIST})[(doc_id // 4) % 4 + 1] || chr(10) || 'Insured Name: ' || {_person("doc_id")}
      || chr(10) || 'Sum Insured: Rs ' || (doc_id * 10 + 5000) || chr(10) || 'flood drought' || chr(10)
    ELSE '' END || text AS text
  FROM documents
),
flat AS (SELECT doc_id, text, regexp_replace(text, '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g') AS flat FROM docs),
event_rows AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, 'CLM-' || user_id AS claim_id FROM events
),
trail AS (
  SELECT claim_id, seq, '0x' || sha256('state-' || event_id) AS state_hash, {_case("event_type", V.EVENT_STATUS)} AS status,
    CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, 'svc' AS recorded_by, props AS note
  FROM event_rows
),
pack AS (
  SELECT *, concat(length(state_hash), ':', state_hash, length(status), ':', status, length(CAST(ts AS VARCHAR)), ':', ts,
      '3:svc', '66:0x', sha256(note)) AS payload
  FROM trail
),
sealed AS (
  SELECT claim_id, seq, state_hash, status, ts, note, '{C.ZERO_HASH}' AS prev_record_hash,
    '0x' || sha256('{C.ZERO_HASH}|' || payload) AS record_hash
  FROM pack WHERE seq = 0
  UNION ALL
  SELECT p.claim_id, p.seq, p.state_hash, p.status, p.ts, p.note, s.record_hash, '0x' || sha256(s.record_hash || '|' || p.payload)
  FROM sealed s JOIN pack p ON p.claim_id = s.claim_id AND p.seq = s.seq + 1
),
transitions AS (
  SELECT claim_id, seq, {_case("event_type", V.EVENT_REQUEST)} AS requested, repeat(props, CAST(1 + event_id % 3 AS INTEGER)) AS note, ts
  FROM event_rows
),
bits0 AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS b FROM embeddings),
hashes AS (
  SELECT 'IMG-' || vec_id AS file_id, 'CLM-' || vec_id AS claim_id, vec_id, array_to_string(b, '') AS p_hash FROM bits0
  UNION ALL
  SELECT 'IMG-' || (vec_id + {V.PLANTED}), 'CLM-' || (vec_id + {V.PLANTED}), vec_id + {V.PLANTED},
    array_to_string([CASE WHEN ((i - 1) * 31 + vec_id) % 64 < vec_id % 9 THEN 1 - b[i] ELSE b[i] END FOR i IN range(1, 65)], '')
  FROM bits0
),
halves AS (
  SELECT *, CAST(from_hex32(substr(p_hash, 1, 32)) AS BIGINT) AS hi, CAST(from_hex32(substr(p_hash, 33, 32)) AS BIGINT) AS lo FROM hashes
),
memory AS (
  SELECT 'CLM-' || vec_id AS claim_id, 'mem-' || vec_id AS file_id, CASE WHEN label % 2 = 1 THEN 'fraud' ELSE 'genuine' END AS label,
    CAST(embedding AS DOUBLE[]) AS vec, vec_id AS seq FROM embeddings WHERE vec_id % 2 = 0
),
asked AS (
  SELECT 'CLM-' || vec_id AS claim_id, 'IMG-' || vec_id AS file_id, CAST(embedding AS DOUBLE[]) AS vec, vec_id FROM embeddings WHERE vec_id % 2 = 1
),
seen AS (
  SELECT * FROM (
    SELECT a.claim_id AS asked_by, a.file_id, a.vec AS avec, m.claim_id, m.label, m.vec, m.seq, row_number() OVER (PARTITION BY a.file_id, m.label ORDER BY m.seq DESC) AS age
    FROM asked a JOIN memory m ON m.seq < a.vec_id)
  WHERE age <= 500
),
near AS (
  SELECT * FROM (
    SELECT asked_by AS claim_id, file_id, claim_id AS matched, label, list_dot_product(avec, vec) AS sim, seq,
      row_number() OVER (PARTITION BY file_id ORDER BY list_dot_product(avec, vec) DESC, seq) AS rn
    FROM seen WHERE claim_id <> asked_by)
  WHERE rn <= 5
),
prompts AS (
  SELECT vec_id AS pos, CAST(embedding AS DOUBLE[]) AS vec,
    CASE WHEN vec_id <= 5 THEN 'staged' WHEN vec_id <= 12 THEN 'ai_gen' WHEN vec_id <= 24 THEN 'rel_flood'
      WHEN vec_id <= 36 THEN 'rel_drought' WHEN vec_id <= 48 THEN 'rel_livestock' ELSE 'ladder' END AS signal,
    vec_id BETWEEN 0 AND 2 OR vec_id BETWEEN 6 AND 9 OR vec_id BETWEEN 13 AND 15 OR vec_id BETWEEN 25 AND 27
      OR vec_id BETWEEN 37 AND 39 AS positive,
    (vec_id - 49) // 2 AS rung
  FROM embeddings WHERE vec_id <= 60
),
sims AS (SELECT a.file_id, p.signal, p.positive, p.rung, list_dot_product(a.vec, p.vec) AS s
  FROM (SELECT 'IMG-' || vec_id AS file_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) a, prompts p),
margins AS (
  SELECT file_id, signal, CAST(floor(100 * greatest(0, least(1,
      (max(s) FILTER (WHERE positive) - max(s) FILTER (WHERE NOT positive) + 1) / 2)) + 0.5) AS BIGINT) AS score
  FROM sims WHERE signal <> 'ladder' GROUP BY 1, 2
),
rungs AS (SELECT file_id, rung, max(s) AS s FROM sims WHERE signal = 'ladder' GROUP BY 1, 2),
reflectance AS (
  SELECT {_TILE.format(lat=_LAT, lon=_LON)} AS tile_id, CAST(l_shipdate AS DATE) AS obs_date,
    CASE WHEN l_linenumber % 2 = 0 THEN 'red' ELSE 'nir' END AS band,
    CASE WHEN l_linenumber % 2 = 0 THEN 0.04::DOUBLE + l_tax ELSE 0.12::DOUBLE + l_discount * 4 END AS value
  FROM lineitem
),
points AS (
  SELECT claim_id, {_TILE.format(lat="lat", lon="lon")} AS tile_id, lat, lon FROM (
    SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq, file_id) AS rn FROM evidence WHERE kind = 'photo' AND lat IS NOT NULL)
  WHERE rn = 1
),
plots AS (
  SELECT p.claim_id, p.tile_id, CAST(c.submitted_at AS DATE) AS event_date FROM points p JOIN claims c ON c.id = p.claim_id
),
refl AS (
  SELECT tile_id, event_date,
    avg(value) FILTER (WHERE band = 'red' AND obs_date <= event_date) AS red_pre,
    avg(value) FILTER (WHERE band = 'nir' AND obs_date <= event_date) AS nir_pre,
    avg(value) FILTER (WHERE band = 'red' AND obs_date >= event_date) AS red_post,
    avg(value) FILTER (WHERE band = 'nir' AND obs_date >= event_date) AS nir_post
  FROM (SELECT DISTINCT tile_id, event_date FROM plots) JOIN reflectance r USING (tile_id)
  WHERE obs_date BETWEEN event_date - {C.WINDOW_BEFORE_DAYS} AND event_date + {C.WINDOW_AFTER_DAYS}
  GROUP BY 1, 2
),
policies(policy_number, holder, limit_inr, losses) AS (
  VALUES {", ".join(f"('{n}', '{h}', {l}, {_list(t)})" for n, h, l, t in C.POLICIES)}
),
districts(pos, name, lat, lon) AS (
  VALUES {", ".join(f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE)" for i, (n, a, b) in enumerate(C.DISTRICTS))}
),
places AS (SELECT DISTINCT lat, lon FROM evidence WHERE lat IS NOT NULL),
fixes AS (
  SELECT lat, lon, name, km FROM (
    SELECT p.lat, p.lon, d.name, d.km_ AS km, row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY d.km_, d.pos) AS rn
    FROM places p, LATERAL (SELECT pos, name, 2 * 6371 * asin(sqrt(pow(sin(radians(d.lat - p.lat) / 2), 2)
      + cos(radians(p.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - p.lon) / 2), 2))) AS km_ FROM districts d) d)
  WHERE rn = 1
),
geo AS (
  SELECT e.claim_id, e.file_id, e.seq, c.loss_type, f.name AS nearest, CAST(floor(f.km + 0.5) AS BIGINT) AS nearest_km,
    CASE WHEN f.km <= 45 THEN f.name END AS resolved, f.km > 120 AS out_of_area
  FROM evidence e JOIN fixes f ON e.lat = f.lat AND e.lon = f.lon JOIN claims c ON c.id = e.claim_id
  WHERE e.kind IN ('photo', 'satellite')
),
loss_districts(loss_type, district) AS (
  VALUES {", ".join(f"('{l}', '{x}')" for l, m in C.LOSS_META.items() for x in m["districts"])}
),
geo_reasons AS (
  SELECT claim_id, file_id, CASE
    WHEN out_of_area THEN 'R4 gps-out-of-area: ' || file_id || ' is ' || nearest_km || 'km from ' || nearest
      || ' (outside the ' || loss_type || ' service area)'
    WHEN resolved IS NOT NULL AND (loss_type, resolved) NOT IN (SELECT (loss_type, district) FROM loss_districts)
      THEN 'R4 district-mismatch: ' || file_id || ' geotagged in ' || resolved || ' — not a covered district for ' || loss_type || ' claims'
    WHEN resolved IS NULL AND nearest_km > 80
      THEN 'R4 gps-unresolved: ' || file_id || ' is ' || nearest_km || 'km from the nearest covered district (' || nearest || ')' END AS reason
  FROM geo
)
"""

# a bit string of 32 characters as a number
VIEWS = VIEWS.replace(
    "CAST(from_hex32(substr(p_hash, 1, 32)) AS BIGINT)", "CAST(from_base2(substr(p_hash, 1, 32)) AS BIGINT)"
).replace("CAST(from_hex32(substr(p_hash, 33, 32)) AS BIGINT)", "CAST(from_base2(substr(p_hash, 33, 32)) AS BIGINT)")
_B32 = "list_sum([CASE WHEN substr(p_hash, {o} + i, 1) = '1' THEN 1::BIGINT << (32 - i) ELSE 0 END FOR i IN range(1, 33)])"
VIEWS = VIEWS.replace("from_base2(substr(p_hash, 1, 32))", _B32.format(o=0)).replace(
    "from_base2(substr(p_hash, 33, 32))", _B32.format(o=32)
)

ORACLES: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    ORACLES[name] = VIEWS + sql


def _guard(current: str) -> str:
    steps = " ".join(
        f"WHEN requested = '{t}' AND {current} NOT IN {_in(a)} THEN 'INVALID_TRANSITION' "
        f"WHEN requested = '{t}' AND length(trim(note, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160))) < {n} THEN 'REASON_TOO_SHORT'"
        for t, (a, n) in C.HUMAN_STEPS.items()
    )
    return f"""CASE WHEN requested IN {_in(C.COMPUTED_VERDICTS)} THEN 'AI_VERDICTS_ARE_COMPUTED'
      WHEN requested = 'PAID' THEN 'USE_PAY_ENDPOINT' WHEN requested IN {_in(C.NEVER_REQUESTED)} THEN 'INVALID_TRANSITION'
      WHEN {current} IN {_in(C.TERMINAL)} THEN 'TERMINAL_STATE' {steps} ELSE 'OK' END"""


_SNAP = _ISO.format(t="submitted_at")
_add("src4_src5_snapshot", f"""SELECT id, claimant_name AS "claimantName", amount_requested AS amount, status, {_SNAP} AS "submittedAt",
  coalesce(verdict, '') AS verdict, '' AS explanation FROM claims""")
_add("src6_relational_tables", """SELECT status, coalesce(role, 'none') AS role, count(*) AS n, CAST(sum(amount_requested) AS BIGINT) AS amount
  FROM claims c LEFT JOIN users u ON u.id = c.assigned_to GROUP BY 1, 2""")
_add("src7_recent_events", f"""SELECT '0x' || sha256(claim_id) AS claim_key, seq, status,
  {_ISO.format(t="make_timestamp(ts * 1000000)")} AS sealed_at_iso,
  '0x' || sha256('0x' || sha256(claim_id || '-' || seq) || 'tx') AS tx_hash FROM trail
  WHERE ts // 60 >= (SELECT max(ts // 60) FROM trail) - 9999 ORDER BY ts // 60 DESC, seq DESC, '0x' || sha256(claim_id) DESC LIMIT 25""")
_add("src8_csv_export", f"""SELECT id, concat_ws(',', id, claimant_name, loss_type, amount_requested, status, coalesce(verdict, ''),
  coalesce(CAST(score AS VARCHAR), ''), {_SNAP}, coalesce({_ISO.format(t="decided_at")}, ''),
  coalesce(CAST(duration_ms AS VARCHAR), ''), latest_state_hash) AS line FROM claims""")
_add("src9_dossier_records", f"""SELECT claim_id, seq, '{{"index":' || seq || ',"note":"' || replace(note, '"', '\\"') || '","prevRecordHash":"p","recordHash":"r","recordedBy":"svc","sealedAtIso":"'
  || {_ISO.format(t="make_timestamp(ts * 1000000)")} || '","stateHash":"' || state_hash || '","status":"' || status || '"}}' AS record FROM trail""")
_add("src10_ocr_pages", """SELECT CAST(doc_id AS VARCHAR) AS file_id, md5(t) AS text_md5, length(t) AS n_chars FROM (
  SELECT doc_id, trim(coalesce(string_agg('[Page ' || page || ']' || chr(10) || line, chr(10) || chr(10) ORDER BY page) FILTER (WHERE trim(line) <> ''), '')) AS t FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
  GROUP BY doc_id)""")

_add("flt1_intake_validation", """SELECT id, concat_ws('|', CASE WHEN claimant_name IS NULL OR length(claimant_name) NOT BETWEEN 1 AND 120 THEN 'claimant_name' END,
  CASE WHEN amount_requested NOT BETWEEN 1 AND 100000 THEN 'amount_requested' END, CASE WHEN score * 4 > 280 THEN 'note' END,
  CASE WHEN destruction_pct_claimed NOT BETWEEN 0 AND 100 THEN 'destruction_pct_claimed' END) AS issues FROM claims""")
_add("flt2_file_validation", f"""SELECT *, n_too_large = 0 AND n_bad_type = 0 AND overfull = '' AND n_files <= 11 AS accepted FROM (
  SELECT claim_id, count(*) AS n_files, count(*) FILTER (WHERE size_bytes > {C.MAX_FILE_BYTES}) AS n_too_large,
  count(*) FILTER (WHERE mime_type NOT IN {_in(C.ALLOWED_MIME)}) AS n_bad_type,
  concat_ws('|', {", ".join(f"CASE WHEN count(*) FILTER (WHERE kind = '{k}') > {n} THEN '{k}' END" for k, n in C.MAX_PER_KIND.items())}) AS overfull
  FROM evidence GROUP BY 1)""")
_add("flt3_photo_required", "SELECT id, loss_type FROM claims WHERE id IN (SELECT claim_id FROM evidence WHERE kind = 'photo')")
_HIST = "FROM claims c LEFT JOIN users u ON u.id = c.assigned_to"
_add("flt4_history_filter", f"""SELECT c.id, status, claimant_name, u.name AS inspector_name, {_SEC.format(t="submitted_at")} AS submitted_at {_HIST}
  WHERE status IN {_in(C.STATUS_GROUPS["flagged"])} AND loss_type = 'flood'
  AND (c.id ILIKE '%mer#0_0%' OR claimant_name ILIKE '%mer#0_0%' OR policy_number ILIKE '%mer#0_0%')""")
_add("flt5_status_groups", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE status IN {_in(v)}) AS {k}" for k, v in {**C.STATUS_GROUPS, "ai_rejected": ["AI_REJECTED"]}.items()
) + " FROM claims")
_add("flt6_live_only", "SELECT id, status FROM claims WHERE id NOT IN (SELECT 'CLM-' || user_id FROM events)")
_add("flt7_decided", "SELECT id, status FROM claims WHERE status <> 'SUBMITTED'")
_add("flt8_roster", f"SELECT id, email, name, role, district, {_SEC.format(t='created_at')} AS created_at FROM users ORDER BY created_at")
_PAY = "CASE WHEN status = 'AI_FLAGGED' THEN 'FLAGGED_LOCKED' WHEN status NOT IN ('AI_APPROVED', 'HUMAN_APPROVED') THEN 'INVALID_STATE' ELSE 'OK' END"
_add("flt9_payout_eligibility", f"SELECT id, status, {_PAY} AS payout_code FROM claims")
_add("flt10_transition_guard", f"""SELECT claim_id, seq, status AS current, requested, {_guard("status")} AS code
  FROM transitions t JOIN claims c ON c.id = t.claim_id""")
_add("flt11_run_status", "SELECT id, CASE WHEN verdict IS NULL THEN 'RUNNING' ELSE 'COMPLETE' END AS run_status FROM claims")
_add("flt12_point_lookups", """SELECT 'claim' AS what, id AS key FROM claims WHERE id = 'CLM-7' UNION ALL
  SELECT 'evidence', file_id FROM evidence WHERE claim_id = 'CLM-7' UNION ALL
  SELECT 'file', claim_id FROM evidence WHERE file_id = 'ev-5979-6-1616-79-23' UNION ALL
  SELECT 'email', id FROM users WHERE email = 'user3@example.org' UNION ALL SELECT 'user', email FROM users WHERE id = 'USR-5'""")
_add("flt13_reopen_eligibility", "SELECT id, status NOT IN ('PAID', 'HUMAN_REJECTED') AS may_reopen FROM claims")

_add("jn1_history_join", f"SELECT c.id, c.assigned_to, u.name AS inspector_name, u.district AS inspector_district {_HIST}")
_pieces = []
_start = 0
for _width in [6] * 9 + [5] * 2:
    _pieces.append((_start, _width))
    _start += _width
_CHUNK = " OR ".join(
    f"(substr(a.p_hash, 1, {s}) = substr(b.p_hash, 1, {s}) AND substr(a.p_hash, {s + w + 1}) = substr(b.p_hash, {s + w + 1}))"
    for s, w in _pieces
)
_add("jn2_near_duplicates", f"""SELECT claim_id, file_id, tier, match_claim_id, match_file_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tier, seen, match_claim_id, match_file_id) AS rn FROM (
    SELECT a.claim_id, a.file_id, CASE WHEN a.p_hash = b.p_hash THEN 0 WHEN {_CHUNK} THEN 1 ELSE 2 END AS tier, b.vec_id AS seen,
      b.claim_id AS match_claim_id, b.file_id AS match_file_id,
      CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS BIGINT) AS distance
    FROM halves a JOIN halves b ON a.claim_id <> b.claim_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6))
  WHERE rn = 1""")
_PHOTOS = f"""(SELECT e.*, coalesce(c.decided_at, c.submitted_at) AS run_at,
      {_B32.format(o=0)} AS hi, {_B32.format(o=32)} AS lo FROM evidence e JOIN claims c ON c.id = e.claim_id WHERE p_hash IS NOT NULL)"""
_add("jn2_near_duplicates_as_of", f"""SELECT claim_id, file_id, tier, match_claim_id, match_file_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tier, seen, match_claim_id, match_file_id) AS rn FROM (
    SELECT a.claim_id, a.file_id, CASE WHEN a.p_hash = b.p_hash THEN 0 WHEN {_CHUNK} THEN 1 ELSE 2 END AS tier, b.created_at AS seen,
      b.claim_id AS match_claim_id, b.file_id AS match_file_id, CAST(a.distance AS BIGINT) AS distance
    FROM (
      SELECT x.*, y.h AS other, bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS distance
      FROM photo_hash x JOIN (SELECT DISTINCT p_hash AS h, hi, lo FROM photo_hash) y
        ON bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 6) a
    JOIN photo_hash b ON b.p_hash = a.other AND b.claim_id <> a.claim_id AND b.created_at <= a.run_at))
  WHERE rn = 1""".replace("photo_hash", _PHOTOS))
_add("jn2_stored_index_as_of", ORACLES["jn2_near_duplicates_as_of"][len(VIEWS):])
_add("jn2_hash_neighbours", """SELECT p_hash, count(*) AS n_neighbours, min(dist) AS least_distance, arg_min(other, (dist, other)) AS nearest_hash FROM (
  SELECT a.p_hash, b.p_hash AS other, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS BIGINT) AS dist
  FROM (SELECT DISTINCT p_hash, hi, lo FROM halves) a, (SELECT DISTINCT p_hash, hi, lo FROM halves) b WHERE a.p_hash <> b.p_hash)
  WHERE dist <= 6 GROUP BY 1""".replace("arg_min(other, (dist, other))", "min(printf('%02d', dist) || other)[3:]"))
_add("jn3_within_claim", f"""SELECT 'CLM-' || a.vec_id AS claim_id, b.file_id, a.file_id AS earlier_file_id,
  CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS BIGINT) AS distance
  FROM halves a JOIN halves b ON b.vec_id = a.vec_id + {V.PLANTED} WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 2""")
_add("jn4_policy_lookup", """SELECT id, c.policy_number, p.holder AS policy_holder, CAST(coalesce(limit_inr, -1) AS BIGINT) AS policy_limit,
  coalesce(list_contains(losses, loss_type), false) AS covered FROM claims c LEFT JOIN policies p ON p.policy_number = c.policy_number""")
_add("jn5_nearest_district", """SELECT file_id, name AS nearest, CAST(floor(km + 0.5) AS BIGINT) AS nearest_km,
  CASE WHEN km <= 45 THEN name END AS resolved, km > 120 AS out_of_area FROM evidence e JOIN fixes f ON e.lat = f.lat AND e.lon = f.lon""")
_add("jn6_knn_vote", """SELECT a.claim_id, coalesce(CAST(floor(100.0 * count(*) FILTER (WHERE label = 'fraud') / greatest(1, count(label)) + 0.5) AS BIGINT), 0) AS fraud_score,
  count(label) AS knn, coalesce(max(matched) FILTER (WHERE rn = 1), '') AS nearest FROM asked a LEFT JOIN near n ON n.file_id = a.file_id GROUP BY 1""")
_add("jn7_prompt_margin", """SELECT file_id, max(score) FILTER (WHERE signal = 'staged') AS staged, max(score) FILTER (WHERE signal = 'ai_gen') AS ai_gen,
  max(score) FILTER (WHERE signal = 'rel_flood') AS rel_flood FROM margins GROUP BY 1""")
_SIM = """SELECT n.claim_id, matched AS matched_claim_id, label, row_number() OVER (PARTITION BY n.claim_id ORDER BY floor(sim * 1000 + 0.5) DESC, rn) AS rank FROM near n"""
_add("jn9_similar_cases", f"""SELECT s.*, c.loss_type AS matched_loss_type, c.amount_requested AS matched_amount, c.status AS matched_status
  FROM ({_SIM}) s LEFT JOIN claims c ON c.id = s.matched_claim_id WHERE rank <= 5""")
_add("jn10_reflectance_window", """SELECT tile_id, CAST(event_date AS VARCHAR) AS event_date, round(red_pre, 6) AS red_pre, round(nir_pre, 6) AS nir_pre,
  round(red_post, 6) AS red_post, round(nir_post, 6) AS nir_post FROM refl""")
_add("jn11_event_search", """SELECT seq, 'claimId' AS interpreted_as, '0x' || sha256(claim_id) AS claim_key, state_hash, status FROM sealed WHERE claim_id = 'CLM-5'
  UNION ALL SELECT seq, 'hash', '0x' || sha256(claim_id), state_hash, status FROM sealed WHERE seq = 0""")
_add("jn11_indexed_search", ORACLES["jn11_event_search"][len(VIEWS):])
_add("jn12_claim_reference", """SELECT '0x' || sha256(claim_id) AS claim_key, c.id AS claim_ref, count(*) AS n
  FROM trail t LEFT JOIN claims c ON c.id = t.claim_id GROUP BY 1, 2""")
_LABEL = f"CASE WHEN status IN {_in(C.GENUINE_STATUSES)} THEN 'genuine' WHEN status IN {_in(C.FRAUD_STATUSES)} THEN 'fraud' END"
_add("jn13_untrained_claims", f"""SELECT id, status, {_LABEL} AS label FROM claims WHERE {_LABEL} IS NOT NULL
  AND id IN (SELECT claim_id FROM evidence WHERE kind = 'photo') AND id NOT IN (SELECT claim_id FROM memory)""")
_add("jn14_gap_fill", """SELECT id, status FROM claims WHERE status <> 'PAID' UNION ALL
  SELECT DISTINCT 'CLM-' || (user_id + 14000), 'SPARE' FROM events WHERE 'CLM-' || (user_id + 14000) NOT IN (SELECT id FROM claims WHERE status <> 'PAID')""")
_add("jn15_shared_files", """SELECT sha256, count(DISTINCT claim_id) AS n_claims, count(*) AS n_files, min(claim_id) AS first_claim_id
  FROM evidence GROUP BY 1 HAVING count(DISTINCT claim_id) > 1""")

_add("agg1_agg2_kpi_strip", f"""SELECT count(*) AS total, count(*) FILTER (WHERE submitted_at > TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 24 HOUR) AS claims_today,
  count(*) FILTER (WHERE status IN ('AI_APPROVED', 'PAID')) AS auto_approved,
  CAST(floor(100.0 * count(*) FILTER (WHERE status IN ('AI_APPROVED', 'PAID')) / count(*) + 0.5) AS BIGINT) AS auto_approval_pct,
  count(*) FILTER (WHERE status IN ('AI_FLAGGED', 'HUMAN_REVIEW')) AS flagged, count(*) FILTER (WHERE status IN ('AI_FLAGGED', 'HUMAN_REVIEW')) AS flagged_locked,
  CAST(coalesce(sum(amount_requested) FILTER (WHERE status IN {_in(C.LEAKAGE_STATUSES)}), 0) AS BIGINT) AS leakage_prevented_inr,
  CAST(coalesce(sum(amount_requested) FILTER (WHERE status = 'PAID'), 0) AS BIGINT) AS paid_inr,
  (SELECT duration_ms FROM (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM claims WHERE duration_ms IS NOT NULL) WHERE i = n // 2) AS verification_p50_ms
  FROM claims""")
_add("agg3_agg4_memory_statistics", """SELECT count(*) AS size, count(*) FILTER (WHERE label = 'genuine') AS genuine, count(*) FILTER (WHERE label = 'fraud') AS fraud,
  CAST(floor(100.0 * count(*) FILTER (WHERE label = 'fraud') / count(*) + 0.5) AS BIGINT) AS fraud_share_pct FROM memory""")
_SCORED = """SELECT claim_id, fails, warns, greatest(0, least(100, 100 - 25 * fails - 12 * warns)) AS score FROM (
  SELECT user_id AS claim_id, count(*) FILTER (WHERE event_id % 9 <> 0 AND event_id % 31 = 0) AS fails,
    count(*) FILTER (WHERE event_id % 9 <> 0 AND event_id % 31 <> 0 AND event_id % 29 = 0) AS warns FROM events GROUP BY 1)"""
_add("agg5_agg6_score_verdict", f"""SELECT *, CASE WHEN fails = 0 AND score >= 50 THEN 'AI_APPROVED' WHEN score < 20 THEN 'AI_REJECTED' ELSE 'AI_FLAGGED' END AS verdict FROM ({_SCORED})""")
_add("agg7_decision_reasons", """SELECT claim_id, string_agg(r, '|' ORDER BY i) AS reasons FROM (
  SELECT claim_id, r, i, row_number() OVER (PARTITION BY claim_id ORDER BY i) AS n FROM (
    SELECT claim_id, r, min(i) AS i FROM (
      SELECT o_orderkey AS claim_id, unnest([CAST(o_orderkey % m AS VARCHAR) FOR m IN [3, 5, 2, 3, 7, 4, 9]]) AS r, unnest(range(7)) AS i FROM orders)
    GROUP BY 1, 2)) WHERE n <= 4 GROUP BY 1""")
_add("agg8_similar_dedup", "SELECT claim_id, matched AS matched_claim_id, label, file_id FROM near")
_add("agg9_trail_counters", """SELECT claim_id, count(*) AS trail_length, max(seq) AS last_seq, arg_max(record_hash, seq) AS head_hash FROM sealed GROUP BY 1""")
_add("agg10_exif_counters", """SELECT claim_id, count(*) FILTER (WHERE kind = 'photo') AS n_photos, count(*) FILTER (WHERE kind = 'photo' AND NOT exif_present) AS n_no_exif,
  count(*) FILTER (WHERE kind = 'photo' AND software IS NOT NULL) AS n_edited, count(*) FILTER (WHERE kind = 'photo' AND lat IS NOT NULL) AS n_geotagged FROM evidence GROUP BY 1""")
_add("agg12_audit_dedup", f"""SELECT 'CLM-' || user_id AS claim_id, {_case("event_type", V.EVENT_STATUS)} AS status,
  {_SEC.format(t="CAST(CAST(ts AS DATE) AS TIMESTAMP)")} AS ts, min(event_id) AS event_id FROM events GROUP BY 1, 2, CAST(ts AS DATE), event_type""")
_H2 = "'0x' || sha256(l || r)"
_add("agg13_merkle_roots", f""", tree AS (
  SELECT claim_id, 0 AS lvl, seq AS idx, '0x' || sha256('0x' || sha256(record_hash)) AS h, count(*) OVER (PARTITION BY claim_id) AS n FROM sealed
  UNION ALL
  SELECT claim_id, lvl + 1, idx // 2, '0x' || sha256(h || h2), (n + 1) // 2 FROM (
    SELECT *, coalesce(lead(h) OVER (PARTITION BY claim_id ORDER BY idx), h) AS h2 FROM tree WHERE n > 1) WHERE idx % 2 = 0
) SELECT t.claim_id, c.leaves, t.h AS root FROM tree t JOIN (SELECT claim_id, count(*) AS leaves FROM sealed GROUP BY 1) c USING (claim_id) WHERE t.n = 1""")
_add("agg13_merkle_frontier", ORACLES["agg13_merkle_roots"][len(VIEWS):])
_add("agg16_destruction_ladder", f"""SELECT file_id, greatest(0, least(100, CAST(floor(sum(e * w) / sum(e) + 0.5) AS BIGINT))) AS destruction_pct,
  ({_list([r for r, _ in C.LADDER])})[arg_max(rung, s) + 1] AS rung FROM (
    SELECT file_id, rung, s, exp((s - min(s) OVER (PARTITION BY file_id)) * 12) AS e, ({[w for _, w in C.LADDER]})[rung + 1] AS w FROM rungs) GROUP BY 1""")
_NDVI = "({nir} - {red}) / greatest({nir} + {red}, 1e-6)"
_PRE, _POST = _NDVI.format(nir="nir_pre", red="red_pre"), _NDVI.format(nir="nir_post", red="red_post")
_add("agg17_ndvi_drop", f"""SELECT claim_id, tile_id, pct AS destruction_pct, CASE {" ".join(f"WHEN pct >= {n} THEN '{r}'" for n, r in C.NDVI_RUNGS)} END AS rung FROM (
  SELECT p.claim_id, p.tile_id, greatest(0, least(100, CAST(floor(greatest({_PRE} - {_POST}, 0) / 0.25 * 100 + 0.5) AS BIGINT))) AS pct
  FROM plots p JOIN refl USING (tile_id, event_date) WHERE red_pre + nir_pre + red_post + nir_post IS NOT NULL)""")
_add("agg18_calibration_table", "SELECT file_id, " + ", ".join(
    f"max(score) FILTER (WHERE signal = '{s}') AS {s}" for s in ["staged", "ai_gen", "rel_flood", "rel_drought", "rel_livestock"]
) + " FROM margins GROUP BY 1")
_add("agg19_integrity_report", """SELECT claim_id, NOT (claim_id LIKE '%7' AND count(*) > 3) AS off_chain_valid,
  CAST(CASE WHEN claim_id LIKE '%7' AND count(*) > 3 THEN 3 ELSE -1 END AS BIGINT) AS off_chain_break_at, true AS on_chain_valid,
  CAST(-1 AS BIGINT) AS on_chain_break_at FROM trail GROUP BY 1""")

_add("win1_trail_verification", """SELECT c.id AS claim_id, coalesce(n, 0) AS records, CAST(CASE WHEN c.id LIKE '%7' AND n > 3 THEN 3 ELSE -1 END AS BIGINT) AS break_at,
  NOT coalesce(c.id LIKE '%7' AND n > 3, false) AS valid FROM claims c LEFT JOIN (SELECT claim_id, count(*) AS n FROM trail GROUP BY 1) t ON t.claim_id = c.id""")
_add("win1_check_since", ORACLES["win1_trail_verification"][len(VIEWS):])
_add("win2_trail_sealing", "SELECT claim_id, seq, prev_record_hash, record_hash FROM sealed")
_add("win3_chain_head", "SELECT claim_id, arg_max(status, seq) AS status, arg_max(state_hash, seq) AS state_hash FROM trail GROUP BY 1")
_add("win4_memory_cap", "SELECT claim_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS r FROM memory) WHERE r <= 500")
_add("win5_memory_upsert", """, fresh AS (
  SELECT *, rank() OVER (PARTITION BY claim_id ORDER BY batch DESC) AS r FROM (
    SELECT 'CLM-' || CAST(floor(vec_id / 4.0 + 0.5) AS BIGINT) AS claim_id, file_id, vec_id AS batch FROM asked)
) SELECT claim_id, file_id, 'fraud' AS label, 'human' AS source FROM fresh WHERE r = 1
  UNION ALL SELECT claim_id, file_id, label, 'pipeline' FROM memory WHERE claim_id NOT IN (SELECT claim_id FROM fresh)""")
_add("win6_ma6_first_plot", "SELECT claim_id, tile_id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM points")
_add("win7_first_photos", """SELECT claim_id, file_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq, file_id) AS rank FROM evidence WHERE kind = 'photo') WHERE rank <= 3""")
_add("win8_last_papers", """SELECT claim_id, kind, count(*) AS n_files, max(CASE WHEN r = 1 AND text <> '' THEN file_id END) AS last_file_id,
  max(CASE WHEN f = 1 THEN file_id END) AS first_file_id FROM (
    SELECT *, row_number() OVER (PARTITION BY claim_id, kind ORDER BY text <> '' DESC, seq DESC, file_id DESC) AS r,
      row_number() OVER (PARTITION BY claim_id, kind ORDER BY seq, file_id) AS f FROM ocr) GROUP BY 1, 2""")
_add("win9_transition_audit", f"""SELECT claim_id, seq, previous, requested AS status, {_guard("previous")} AS code FROM (
  SELECT *, coalesce(lag(requested) OVER (PARTITION BY claim_id ORDER BY seq), 'SUBMITTED') AS previous FROM transitions)""")

_add("top1_history_newest_first", f"SELECT id, {_SEC.format(t='submitted_at')} AS submitted_at FROM claims ORDER BY submitted_at DESC")
_add("top2_top_similar", f"SELECT claim_id, matched_claim_id, rank FROM ({_SIM}) WHERE rank <= 4")
_add("top3_neighbours", "SELECT claim_id, matched AS matched_claim_id, label, floor(sim * 1000 + 0.5) / 1000 AS similarity, rn - 1 AS pos FROM near")
_ROLE = {r: " + ".join(f"CAST(contains(t, '{w}') AS BIGINT)" for w in ws) for r, ws in C.ROLE_SIGNS.items()}
_add("top5_str1_classify", f"""SELECT *, CASE WHEN greatest(aadhaar_hits, registry_hits, policy_hits) = 0 THEN NULL
  WHEN aadhaar_hits >= registry_hits AND aadhaar_hits >= policy_hits THEN 'aadhaar' WHEN registry_hits >= policy_hits THEN 'registry' ELSE 'policy' END AS role
  FROM (SELECT doc_id, {", ".join(f"{e} AS {r}_hits" for r, e in _ROLE.items())} FROM (SELECT doc_id, lower(text) AS t FROM docs))""")

_add("set1_evidence_list", f"SELECT claim_id, CAST(list_position({_list(C.KIND_ORDER)}, kind) AS BIGINT) AS kind_rank, file_id, kind FROM evidence")
_add("set2_st6_addendum", f"""SELECT claim_id, count(*) AS n, 'SUBMITTED' AS status,
  'ADDENDUM · +' || count(*) || ' evidence file(s) appended (immutable addendum, re-verification queued)' AS note, {_SEC.format(t="max(created_at)")} AS ts
  FROM evidence WHERE claim_id IN (SELECT id FROM claims WHERE status NOT IN ('PAID', 'HUMAN_REJECTED')) GROUP BY 1""")
_add("set4_evidence_digests", f""", files AS (
  SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY seq, file_id) - 1 AS idx,
    '0x' || sha256(coalesce(length(CAST(seq AS VARCHAR)) || ':' || seq, '-') || coalesce(length(file_id) || ':' || file_id, '-')
      || coalesce(length(sha256) || ':' || sha256, '-') || coalesce('66:0x' || sha256(p_hash), '-')) AS h FROM evidence
), tree AS (
  SELECT claim_id, 0 AS lvl, idx, '0x' || sha256('0x' || sha256(h)) AS h, count(*) OVER (PARTITION BY claim_id) AS n FROM files
  UNION ALL
  SELECT claim_id, lvl + 1, idx // 2, '0x' || sha256(h || h2), (n + 1) // 2 FROM (
    SELECT *, coalesce(lead(h) OVER (PARTITION BY claim_id ORDER BY idx), h) AS h2 FROM tree WHERE n > 1) WHERE idx % 2 = 0
) SELECT t.claim_id, c.n_files, t.h AS evidence_digest FROM tree t JOIN (SELECT claim_id, count(*) AS n_files FROM files GROUP BY 1) c USING (claim_id) WHERE t.n = 1""")

_UPD = """(SELECT CASE WHEN k % 2 = 0 THEN id ELSE 'NEW-' || k END AS id, amount_requested + 1 AS amount_requested FROM claims WHERE k % 3 = 0)"""
_add("mnt1_claim_upsert", f"""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'HUMAN_REVIEW' ELSE o.status END AS status,
  coalesce(n.amount_requested, o.amount_requested) AS amount_requested,
  {_SEC.format(t="CASE WHEN o.id IS NULL THEN TIMESTAMP '2001-08-01 12:00:00' ELSE o.submitted_at END")} AS submitted_at,
  coalesce(CASE WHEN o.id IS NULL THEN 'USR-1' ELSE o.assigned_to END, '') AS assigned_to
  FROM claims o FULL OUTER JOIN {_UPD} n ON n.id = o.id""")
_add("mnt2_evidence_insert", """SELECT 'p' || part AS file_id, claim_id, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY created_at, claim_id, seq, sha256) AS r FROM evidence
  WHERE part NOT IN (SELECT part FROM evidence WHERE kind = 'photo')) WHERE r = 1""")
_add("mnt3_assignment_sync", """SELECT c.id, coalesce(a.assigned_to, c.assigned_to, '') AS assigned_to FROM claims c LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY assigned_at DESC, assigned_to DESC) AS r FROM assignments
    WHERE assigned_to IN (SELECT id FROM users)) WHERE r = 1) a ON a.claim_id = c.id""")
_PAYS = """SELECT o_orderkey AS k, 'UPI-' || o_custkey AS ref, CASE WHEN o_orderkey % 2 = 0 THEN 500 END AS amount, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders
  UNION ALL SELECT o_orderkey, 'UPI-' || o_custkey || '-again', NULL, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY FROM orders"""
_add("mnt4_payout_records", f"""SELECT id AS claim_id, {_PAY} AS code, paid AS paid_inr, CASE WHEN {_PAY} = 'OK' THEN 'PAID' ELSE status END AS status,
  'UPI payout ₹' || paid || ' · ref ' || ref || ' · sealed by disbursement' AS note, {_SEC.format(t="ts")} AS ts FROM (
  SELECT c.id, CASE WHEN earlier > 0 AND c.status IN ('AI_APPROVED', 'HUMAN_APPROVED') THEN 'PAID' ELSE c.status END AS status, ref, ts,
    coalesce(amount, amount_requested) AS paid
  FROM claims c JOIN (SELECT *, count(*) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM ({_PAYS})) p ON p.k = c.k)""")
_add("mnt5_rerun_records", f"""SELECT id AS claim_id, verdict AS status, 'RETRY · AI ' || verdict || ' · score ' || score || ' (re-run appended, history intact)' AS note,
  {_SEC.format(t="CAST(CAST(submitted_at AS DATE) + 3 AS TIMESTAMP)")} AS ts
  FROM claims WHERE verdict IS NOT NULL AND status NOT IN ('PAID', 'HUMAN_REJECTED')""")
_add("mnt6_human_decisions", f""", ordered AS (
  SELECT t.*, c.status AS begun, row_number() OVER (PARTITION BY t.claim_id ORDER BY t.ts, t.seq) AS turn FROM transitions t JOIN claims c ON c.id = t.claim_id
), walk AS (
  SELECT claim_id, CAST(0 AS BIGINT) AS turn, begun AS after, '' AS requested, '' AS met, '' AS code, '' AS note, CAST(NULL AS TIMESTAMP) AS ts
  FROM (SELECT DISTINCT claim_id, begun FROM ordered)
  UNION ALL
  SELECT claim_id, turn, CASE WHEN code = 'OK' THEN requested ELSE met END, requested, met, code, note, ts FROM (
    SELECT o.claim_id, o.turn, o.requested, w.after AS met, o.note, o.ts, {_guard("w.after").replace("requested", "o.requested").replace("(note,", "(o.note,")} AS code
    FROM walk w JOIN ordered o ON o.claim_id = w.claim_id AND o.turn = w.turn + 1)
) SELECT claim_id, requested, met AS current, code, after AS status, substr('[ops-agent] ' || requested || ': ' || note, 1, 280) AS note,
  CASE WHEN code = 'OK' AND requested = 'HUMAN_APPROVED' THEN 'genuine' WHEN code = 'OK' AND requested = 'HUMAN_REJECTED' THEN 'fraud' ELSE '' END AS label,
  {_SEC.format(t="ts")} AS ts FROM walk WHERE turn > 0""")
_add("mnt7_resync", """SELECT count(*) AS n, CAST(sum(amount_requested) AS BIGINT) AS total, 'claims' AS what FROM claims
  UNION ALL SELECT count(*), CAST(sum(size_bytes) AS BIGINT), 'evidence' FROM evidence""")

_add("str3_transliterate", f"""SELECT o_orderkey AS claim_id, ({_list(V.FIRST_DEVA)})[o_orderkey % 8 + 1] || ' ' || ({_list(V.LAST_DEVA)})[(o_orderkey // 8) % 8 + 1] AS name,
  (['roshana', 'ramesha', 'sunita', 'devendra', 'vitthala', 'anita', 'kishora', 'mira'])[o_orderkey % 8 + 1] || ' ' ||
  (['pandeya', 'kumara', 'pavara', 'sinha', 'rava', 'patila', 'shinde', 'joshi'])[(o_orderkey // 8) % 8 + 1] AS latin FROM orders""")
_TM = """({x} = {y} OR (length({x}) >= 4 AND length({y}) >= 4 AND (starts_with({x}, {y}) OR starts_with({y}, {x})))
  OR levenshtein({x}, {y}) <= CASE WHEN length({x}) >= 5 AND length({y}) >= 5 THEN 2 ELSE 1 END)"""
_add("str4_name_match", f"""SELECT claim_id, CAST(floor(100.0 * len(list_filter(a, lambda x: len(list_filter(b, lambda y: {_TM.format(x="x", y="y")})) > 0)) / 2 + 0.5) AS BIGINT) AS score
  FROM (SELECT o_orderkey AS claim_id, [t FOR t IN string_split(lower({_person("o_orderkey")}), ' ')] AS a, string_split(lower({_person("o_custkey")}), ' ') AS b FROM orders)""".replace("/ 2 +", "/ least(len(a), len(b)) +"))
_add("str6_devanagari_digits", f"SELECT o_orderkey AS k, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '०१२३४५६७८९') AS deva, CAST(o_orderkey AS VARCHAR) AS ascii FROM orders")
_TERMS = {loss: " OR ".join(f"contains(t, '{w}')" for w in m["terms"]) for loss, m in C.LOSS_META.items()}
_add("str7_damage_words", f"""SELECT doc_id, {", ".join(f"({e}) AS {l}" for l, e in _TERMS.items())},
  CAST(CASE WHEN {_TERMS["flood"]} THEN 80 ELSE 35 END AS BIGINT) AS severity_one_photo FROM (SELECT doc_id, lower(text) AS t FROM docs)""")
_add("str9_indian_digits", """SELECT k, CASE WHEN length(d) <= 3 THEN d ELSE
    reverse(regexp_replace(reverse(substr(d, 1, length(d) - 3)), '(\\d\\d)', '\\1,', 'g')).ltrim(',') || ',' || right(d, 3) END AS grouped
  FROM (SELECT o_orderkey AS k, CAST(CAST(floor(o_totalprice * o_orderkey) AS BIGINT) AS VARCHAR) AS d FROM orders)""")
_add("str10_policy_holder", """SELECT id, lower(holder) <> lower(claimant_name) AND holder <> 'Generic Farmer Policy' AS differs FROM claims c JOIN policies p ON p.policy_number = c.policy_number""")
_add("str11_short_hash", """SELECT id, substr(latest_state_hash, 1, 8) || '…' || right(latest_state_hash, 4) AS a,
  CASE WHEN length(id) > 14 THEN substr(id, 1, 8) || '…' || right(id, 4) ELSE id END AS b FROM claims""")

# fixed values: the extraction patterns in RE2 notation, for the whole documents
_add("str2a_identity_card", r"""SELECT doc_id, nullif(trim(coalesce(
    nullif(regexp_extract(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b\s*\n?\s*(?:DoB|DOB|जन्म)', 1), ''),
    nullif(regexp_extract(flat, '(?i)(?:name|naam|नाम)\s*[:\-]\s*([A-Za-z\x{0900}-\x{097F}][A-Za-z\x{0900}-\x{097F} .]{2,60})', 1), ''))), '') AS name,
  coalesce(nullif(regexp_extract(flat, '\b(\d{2}[/-]\d{2}[/-]\d{4})\b', 1), ''), nullif(regexp_extract(flat, '\b(\d{4}[-/]\d{2}[-/]\d{2})\b', 1), '')) AS dob,
  CASE WHEN length(digits) >= 4 THEN 'XXXX XXXX ' || right(digits, 4) END AS aadhaar_masked,
  CASE WHEN regexp_matches(text, '(?i)\bfemale\b|महिला') THEN 'female' WHEN regexp_matches(text, '(?i)\bmale\b|पुरुष') THEN 'male' END AS gender
  FROM (SELECT *, regexp_replace(regexp_extract(flat, '\b([0-9oOlI]{4}[\s-]?[0-9oOlIxX]{4}[\s-]?[0-9oOlIxX]{4})\b', 1), '[^0-9xX]', '', 'g') AS digits FROM flat)""")
_D = "|".join(C.KNOWN_DISTRICTS)
_add("str2b_land_record", rf"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(flat, '(?i)(?:जिला|\b(?:district|dist\.?))\s*[:\-]?\s*([A-Za-z\x{{0900}}-\x{{097F}}]{{3,25}})', 1)), ''),
    nullif(regexp_extract(flat, '(?i)\b({_D})\b', 1), '')) AS district,
  nullif(regexp_extract(flat, '(?i)(?:ग्राम|गांव|मौजा|\bvillage)\s*[:\-]?\s*([\x{{0900}}-\x{{097F}}]{{2,25}}|[A-Za-z]{{2,25}})', 1), '') AS village,
  nullif(regexp_extract(flat, '(?i)(विक्रय विलेख|खतौनी|खसरा|फर्द|sale deed|registry|khatauni|khasra|इकरारनामा)', 1), '') AS deed_type,
  coalesce(nullif(regexp_extract(flat, '\b(\d{{1,2}}\s+[A-Z][a-z]{{2,8}}\s+\d{{4}})\b', 1), ''), nullif(regexp_extract(flat, '\b(\d{{2}}[/-]\d{{2}}[/-]\d{{4}})\b', 1), '')) AS execution_date,
  nullif(regexp_extract(flat, '(?i)(?:खसरा\s*(?:नं0?|संख्या)?|khasra\s*(?:no\.?|num)?|survey\s*(?:no\.?|num)?|गाटा\s*(?:संख्या)?)\s*[:\-#]?\s*([0-9]+(?:/[0-9]+)?)', 1), '') AS khasra_no,
  nullif(trim(regexp_extract(flat, '(?i)(?:रकबा|क्षेत्रफल|area)\s*[:\-]?\s*([0-9.]+\s*(?:हेक्टेयर|हे0|बीघा|एकड़|hectare|acre)?)', 1)), '') AS area_hectares,
  nullif(regexp_extract(flat, '(?i)(उत्तर प्रदेश|महाराष्ट्र|मध्य प्रदेश|राजस्थान|बिहार|हरियाणा|गुजरात|\b(?:uttar pradesh|maharashtra|madhya pradesh|bihar)\b)', 1), '') AS state
  FROM flat""")
_add("str2c_policy_paper", r"""SELECT doc_id, upper(coalesce(
    nullif(regexp_extract(text, '(?i)policy[ \t]*(?:no\.?|number|संख्या)[ \t]*[:\-]?[ \t]*([A-Z0-9][A-Z0-9/-]{5,24})', 1), ''),
    nullif(regexp_extract(flat, '\b([A-Z]{2,5}/\d{2,4}/[A-Z]{2,4}/\d{3,8})\b', 1), ''), nullif(regexp_extract(flat, '\b([A-Z]{2,5}[-/]\d{2}[-/]\d{3,6})\b', 1), ''))) AS policy_number,
  CAST(replace(coalesce(nullif(regexp_extract(flat, '(?i)(?:sum insured|insured amount|बीमा राशि|विमा राशि)\s*[:\-]?\s*(?:₹|rs\.?|inr)?\s*([\d,]+(?:\.\d{1,2})?)', 1), ''),
    nullif(regexp_extract(flat, '(?i)(?:₹|rs\.?)\s*([\d,]{4,12})', 1), '')), ',', '') AS DOUBLE) AS sum_insured,
  concat_ws('|', CASE WHEN regexp_matches(text, '(?i)\bflood|बाढ़') THEN 'flood' END, CASE WHEN regexp_matches(text, '(?i)\bdrought|सूखा|अनावृष्टि') THEN 'drought' END,
    CASE WHEN regexp_matches(text, '(?i)\blivestock|पशु|cattle') THEN 'livestock' END) AS coverage FROM flat""")

_V = r"[\x{0900}-\x{097F}]"
_VS = r"[\x{0900}-\x{097F}\s]"


def _found(pattern: str, text: str = "flat") -> str:
    return f"nullif(trim(regexp_extract({text}, '{pattern}', 1)), '')"


_add("str2b_land_record_owner", f"""SELECT doc_id, owner_name, owner_relation, CAST(CASE WHEN amount = '' THEN '0' ELSE amount END AS DOUBLE) AS area_value,
  floor(((owner_name IS NOT NULL)::INT + (district IS NOT NULL)::INT + (deed_type IS NOT NULL)::INT + (execution_date IS NOT NULL)::INT + (khasra_no IS NOT NULL)::INT) / 5.0 * 100 + 0.5) / 100.0 AS confidence
  FROM (SELECT *, CASE WHEN NOT regexp_matches(regexp_replace(raw_name, '\\s+', '', 'g'), '(?i)^(?:wo|go0|af|urpha|shri|sri|mr|the|and|[a-z]{{1,2}})$') THEN raw_name END AS owner_name
    FROM (SELECT *, coalesce(buyer, relative, labelled) AS raw_name, CASE WHEN relative IS NOT NULL THEN 'relative' END AS owner_relation
      FROM (SELECT *, CASE WHEN buyer IS NULL THEN kin END AS relative FROM (
        SELECT doc_id, {_found(rf"(?i)(?:क्रेता|खरीदार|प्रथम\s*पक्ष|हकदार)\s*[:\-]?\s*([A-Za-z{_V[1:-1]}][A-Za-z{_VS[1:-1]}]{{2,35}}?)(?:\s+(?:पुत्र|पुत्री|पत्नी|निवासी|उम्र|जाति|पार्टी)|\z)")} AS buyer,
          {_found(rf"(?i)(?:पुत्र|पुत्री|पत्नी|s/o|d/o|w/o|son of|daughter of|wife of)\s*[:\-]?\s*({_V}{_VS}{{2,40}}|[A-Z][A-Za-z\s]{{2,40}})")} AS kin,
          {_found(rf"(?:नाम|स्वामी|खातेदार|owner|name)\s*[:\-]?\s*({_V}{_VS}{{2,40}}|[A-Z][A-Za-z\s]{{2,40}})")} AS labelled,
          replace(coalesce({_found(r"(?i)(?:₹|rs\.?|रू0?|रु)\s*([\d,]{4,12})")}, {_found(r"\b([\d,]{6,12})\s*/")}), ',', '') AS amount FROM flat))))
  JOIN (__FIELDS__) USING (doc_id)""".replace("__FIELDS__", ORACLES["str2b_land_record"][len(VIEWS):]))
_BILL_AMOUNT = "CASE WHEN CAST(replace({a}, ',', '') AS DOUBLE) > 0 AND CAST(replace({a}, ',', '') AS DOUBLE) < 10000000 THEN CAST(floor(CAST(replace({a}, ',', '') AS DOUBLE) + 0.5) AS BIGINT) END"
_add("str2d_bill", f"""SELECT doc_id, upper(coalesce(n1, n2, n3, n4)) AS policy_number, coalesce({_BILL_AMOUNT.format(a="nullif(replace(a1, ',', ''), '')")}, {_BILL_AMOUNT.format(a="nullif(replace(a2, ',', ''), '')")}, -1) AS amount
  FROM (SELECT doc_id, {_found(r"(?i)\b(MH-\d{2}-\d{4})\b")} AS n1, {_found(r"(?i)\b(PMFBY/[A-Z0-9/-]{4,28})\b")} AS n2,
    {_found(r"(?i)\b(?:policy|pol|cover|cert(?:ificate)?)\s*(?:no\.?|num|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9/-]{4,24})\b")} AS n3,
    {_found(r"(?i)\b([A-Z]{2,5}[-/]\d{2,4}[-/][A-Z0-9/-]{4,16})\b")} AS n4,
    {_found(r"(?i)(?:rs\.?|inr|₹|रू0?|रु)\s*([\d,]+(?:\.\d{1,2})?)")} AS a1,
    {_found(r"(?i)(?:claim|bill|total|loss|net|insured|sum insured)\s*(?:amount|value|sum)?\s*[:\-]?\s*(?:rs\.?|inr|₹|रू)?\s*([\d,]+(?:\.\d{1,2})?)")} AS a2 FROM flat)""")
_add("str4_name_match_bilingual", f"""SELECT claim_id, CAST(floor(100.0 * len(list_filter(a, lambda x: len(list_filter(b, lambda y: {_TM.format(x="x", y="y")})) > 0)) / 2 + 0.5) AS BIGINT) AS score
  FROM (SELECT o_orderkey AS claim_id, string_split(lower({_person("o_orderkey")}), ' ') AS a,
    [(['roshana', 'ramesha', 'sunita', 'devendra', 'vitthala', 'anita', 'kishora', 'mira'])[o_custkey % 8 + 1],
     (['pandeya', 'kumara', 'pavara', 'sinha', 'rava', 'patila', 'shinde', 'joshi'])[(o_custkey // 8) % 8 + 1]] AS b FROM orders)""")
_add("top6_text_snippets", f"""SELECT claim_id, file_id, kind, md5(substr(text, 1, CASE WHEN kind IN {_in(C.FARMER_DOCS)} THEN 2000 ELSE 1500 END)) AS snippet
  FROM evidence JOIN (SELECT file_id, text FROM ocr WHERE length(text) > 0) USING (file_id)
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'doc', 'bill', md5(substr(text, 1, 1500)) FROM documents""")
_TREE, _, _ROOTS = ORACLES["agg13_merkle_roots"][len(VIEWS):].rpartition("\n) SELECT ")
_add("agg14_agg15_merkle_proofs", f"""{_TREE}
), roots AS (SELECT {_ROOTS}) SELECT s.claim_id, s.seq AS leaf_index, s.record_hash AS leaf,
  CAST(CASE WHEN r.leaves > 1 THEN length(bin(r.leaves - 1)) ELSE 0 END AS BIGINT) AS path_length, r.root, true AS verifies
  FROM sealed s JOIN roots r USING (claim_id)""")

_add("dt1_dt4_times", f"""SELECT id, submitted_at > TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 24 HOUR AS today, CAST(CAST(submitted_at AS DATE) - 10 AS VARCHAR) AS window_start,
  CAST(CAST(submitted_at AS DATE) AS VARCHAR) AS event_day, CAST(CAST(submitted_at AS DATE) + 5 AS VARCHAR) AS window_end, {_SNAP} AS iso,
  coalesce(duration_ms, -1) AS duration_ms FROM claims""")
_KM = f"2 * 6371 * asin(sqrt(pow(sin(radians(19.8697::DOUBLE - {_LAT}) / 2), 2) + cos(radians({_LAT})) * cos(radians(19.8697::DOUBLE)) * pow(sin(radians(77.3091::DOUBLE - {_LON}) / 2), 2)))"
_add("ma1_ma2_geometry", f"""SELECT DISTINCT l_partkey, round({_KM}, 3) AS km, CAST(floor({_KM} + 0.5) AS BIGINT) AS km_whole,
  CAST(floor(2.5 - l_partkey % 7 + 0.5) AS BIGINT) AS half_up, {_TILE.format(lat=_LAT, lon=_LON)} AS tile_id FROM lineitem""")
_add("ma3_ma5_vectors", """SELECT vec_id, round(list_dot_product(v, o), 3) + 0.0 AS dot, round(list_dot_product(v, o) / sqrt(list_dot_product(v, v)), 3) + 0.0 AS normalised_dot,
  round(list_sum([floor(x * 1000 + 0.5) / 1000 FOR x IN v]), 3) + 0.0 AS rounded_sum
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS o FROM embeddings)""")
_add("ma4_hamming", f"""SELECT vec_id AS k, vec_id % 9 AS distance, CAST(64 AS BIGINT) AS unequal_length FROM embeddings""")
_SH = "length({c}) || ':' || {c}"
_add("hs1_hs2_state_hashes", "SELECT id, '0x' || sha256(id) AS claim_key, '0x' || sha256(" + " || ".join(
    _SH.format(c=c) for c in ["id", "loss_type", "claimant_name", "CAST(amount_requested AS VARCHAR)", "latest_state_hash", f"({_SNAP})"]
) + ") AS state_hash FROM claims")
_add("hs3_run_digest", """SELECT id, '0x' || sha256('{"claimId":"' || id || '","score":' || score || ',"stages":["EXIF_INTEGRITY:PASS:' || loss_type || '","DECISION:' || verdict || ':' || status || '"],"verdict":"' || verdict || '"}') AS run_digest
  FROM claims WHERE verdict IS NOT NULL""")
_add("js1_sorted_json", """SELECT id, '{"amount":' || amount_requested || ',"loss":"' || loss_type || '","status":"' || status || '"}' AS json FROM claims""")

_EXIF = """SELECT claim_id, count(*) FILTER (WHERE kind = 'photo') AS p, count(*) FILTER (WHERE kind = 'photo' AND NOT exif_present) AS m,
  count(*) FILTER (WHERE kind = 'photo' AND software IS NOT NULL) AS e FROM evidence GROUP BY 1"""
_add("rul1_exif_integrity", f"""SELECT id AS claim_id, CASE WHEN coalesce(p, 0) = 0 OR e > 0 THEN 'FAIL' WHEN m > 0 THEN 'WARN' ELSE 'PASS' END AS result,
  CAST(CASE WHEN coalesce(p, 0) = 0 THEN 1 ELSE CAST(m > 0 AS INTEGER) + CAST(e > 0 AS INTEGER) END AS BIGINT) AS n_reasons FROM claims LEFT JOIN ({_EXIF}) x ON x.claim_id = id""")
_FLAGGED = ORACLES["jn2_near_duplicates_as_of"][len(VIEWS):]
_add("rul2_duplicate_phash", f""", photo_hash AS {_PHOTOS} SELECT id AS claim_id, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS result, coalesce(n, 0) AS n_dup, coalesce(n_inner, 0) AS n_inner,
  CASE WHEN coalesce(n, n_inner) IS NULL THEN coalesce(own, 0) || ' photo pHash(es) unique across ' || (coalesce(seen, 0) - coalesce(own_seen, 0)) || ' stored foreign photos' END AS "unique"
  FROM (SELECT *, coalesce(decided_at, submitted_at) AS run_at FROM claims) c LEFT JOIN (SELECT claim_id, count(*) AS n FROM ({_FLAGGED}) GROUP BY 1) f ON f.claim_id = id
  LEFT JOIN (SELECT b.claim_id, count(DISTINCT b.file_id) AS n_inner FROM photo_hash a JOIN photo_hash b ON a.claim_id = b.claim_id AND (b.seq, b.file_id) > (a.seq, a.file_id)
    AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 2 GROUP BY 1) i ON i.claim_id = id
  ASOF LEFT JOIN (SELECT created_at, sum(count(*)) OVER (ORDER BY created_at)::BIGINT AS seen FROM photo_hash GROUP BY 1) s ON c.run_at >= s.created_at
  LEFT JOIN (SELECT p.claim_id, count(*) AS own, count(*) FILTER (WHERE p.created_at <= coalesce(k.decided_at, k.submitted_at)) AS own_seen
    FROM photo_hash p JOIN claims k ON k.id = p.claim_id GROUP BY 1) o ON o.claim_id = id""")
_add("rul3_ocr_extract", """SELECT id AS claim_id, CASE WHEN coalesce(docs, 0) = 0 THEN 'INFO' WHEN read = 0 THEN 'WARN' ELSE 'PASS' END AS result
  FROM claims LEFT JOIN (SELECT claim_id, count(*) FILTER (WHERE kind <> 'photo') AS docs, count(*) FILTER (WHERE kind IN ('bill', 'id', 'satellite') AND text <> '') AS read
    FROM ocr GROUP BY 1) x ON x.claim_id = id""")
_add("rul7_geography", "SELECT claim_id, file_id, reason FROM geo_reasons WHERE reason IS NOT NULL")
_add("rul7_exaggeration", """SELECT id, 'R5 destruction-exaggeration: claimed ' || destruction_pct_claimed || '% but satellite imagery measures ' || amount_requested % 100
  || '% (delta ' || abs(destruction_pct_claimed - amount_requested % 100) || ' pts > 40)' AS reason
  FROM claims WHERE loss_type = 'flood' AND abs(destruction_pct_claimed - amount_requested % 100) > 40""")
_add("rul7_file_reasons", f"""SELECT claim_id, count(*) FILTER (WHERE rule = 1) AS n_geo, count(*) FILTER (WHERE rule = 2) AS n_duplicate FROM (
  SELECT claim_id, 1 AS rule FROM geo_reasons WHERE reason IS NOT NULL UNION ALL SELECT claim_id, 2 FROM ({_FLAGGED})) GROUP BY 1""")
_add("rul10_training_labels", f"""SELECT id, {_LABEL} AS bulk, CASE status WHEN 'HUMAN_APPROVED' THEN 'genuine' WHEN 'HUMAN_REJECTED' THEN 'fraud' END AS human,
  CASE WHEN verdict IS NOT NULL THEN CASE WHEN verdict = 'AI_APPROVED' THEN 'genuine' ELSE 'fraud' END END AS live FROM claims""")


# streams give what the same rows give in a batch
_add("st2_sealing", ORACLES["win2_trail_sealing"][len(VIEWS):])
_add("st5_audit_forever", ORACLES["agg12_audit_dedup"][len(VIEWS):])
_add("st5_audit_append", f"SELECT claim_id, status, ts FROM ({ORACLES['agg12_audit_dedup'][len(VIEWS):]})")
_add("st6_late_evidence", ORACLES["set2_st6_addendum"][len(VIEWS):])
_add("st8_live_kpi", ORACLES["agg1_agg2_kpi_strip"][len(VIEWS):])
_add("st4_intake_velocity", f"""SELECT user_id, {_SEC.format(t="CAST(CAST(ts AS DATE) AS TIMESTAMP)")} AS window_start, count(*) AS n
  FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING count(*) > 3""")
_KINDS = """SELECT *, CASE WHEN event_type = 'purchase' THEN 'pay' WHEN event_type IN ('view', 'signup') THEN 'verdict' ELSE 'human' END AS kind,
  CASE event_type WHEN 'view' THEN 'AI_FLAGGED' WHEN 'signup' THEN 'AI_APPROVED' WHEN 'click' THEN 'HUMAN_APPROVED' WHEN 'error' THEN 'HUMAN_REJECTED' ELSE 'PAID' END AS requested,
  repeat(props, CAST(1 + event_id % 3 AS INTEGER)) AS note, epoch_us(ts) AS pos FROM event_rows"""
_CODE = f"""CASE WHEN r.kind = 'verdict' THEN CASE WHEN cur IN {_in(C.TERMINAL)} THEN 'TERMINAL_STATE' ELSE 'OK' END
  WHEN r.kind = 'pay' THEN CASE WHEN cur = 'AI_FLAGGED' THEN 'FLAGGED_LOCKED' WHEN cur NOT IN {_in(C.PAYABLE)} THEN 'INVALID_STATE' ELSE 'OK' END
  ELSE {_guard("cur")} END"""
_add("st3_transition_guard", f""", reqs AS ({_KINDS}), walk AS (
  SELECT claim_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS pos, '' AS requested, '' AS previous, '' AS code, 'SUBMITTED' AS status
  FROM (SELECT DISTINCT claim_id FROM reqs)
  UNION ALL
  SELECT claim_id, seq, pos, requested, cur, code, CASE WHEN code = 'OK' THEN requested ELSE cur END FROM (
    SELECT r.claim_id, r.seq, r.pos, r.requested, w.cur, {_CODE} AS code
    FROM (SELECT claim_id, seq, status AS cur FROM walk) w JOIN reqs r ON r.claim_id = w.claim_id AND r.seq = w.seq + 1)
) SELECT claim_id, pos, requested, previous, code, status FROM walk WHERE seq >= 0""")
_add("st7_memory_upkeep", f"""SELECT claim_id, file_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY seen DESC, seq DESC, file_id DESC) AS r FROM (
    SELECT e.claim_id, e.file_id, CASE WHEN c.verdict = 'AI_APPROVED' THEN 'genuine' ELSE 'fraud' END AS label, c.decided_at AS seen, CAST(e.seq AS BIGINT) AS seq
    FROM evidence e JOIN claims c ON c.id = e.claim_id WHERE e.kind IN ('photo', 'satellite') AND c.verdict IS NOT NULL
    UNION ALL
    SELECT claim_id, file_id, label, make_timestamp((820454400 + seq * 3600) * 1000000), seq FROM memory
    WHERE claim_id NOT IN (SELECT e.claim_id FROM evidence e JOIN claims c ON c.id = e.claim_id WHERE e.kind IN ('photo', 'satellite') AND c.verdict IS NOT NULL)))
  WHERE r <= 500""")
