"""SQL twins of the queries that SQL can express; the others are tested against brute force."""

SUBSTRING_DEDUP = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc),
span AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER nxt) AS s, count(*) OVER nxt AS n FROM word
  WINDOW nxt AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
first AS (SELECT s, min(struct_pack(d := doc_id, i := i)) AS f FROM span WHERE n = 20 GROUP BY s),
later AS (SELECT span.doc_id, span.i FROM span JOIN first USING (s) WHERE n = 20 AND struct_pack(d := doc_id, i := i) > f),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM later),
kept AS (
  SELECT word.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed,
         coalesce(string_agg(word.word, ' ' ORDER BY word.i) FILTER (gone.i IS NULL), '') AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT doc.doc_id, len(doc.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id
"""

CHAT_FORMAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|im_(start|end)\|>'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0
),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (SELECT a AS node, b AS other FROM pair UNION SELECT reach.node, pair.b FROM reach JOIN pair ON reach.other = pair.a),
comp AS (SELECT node, min(other) AS least FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM pair GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, least(v.vec_id, coalesce(least, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(least, v.vec_id)) AS kept
FROM v LEFT JOIN comp ON v.vec_id = comp.node LEFT JOIN n ON v.vec_id = n.a
"""

MANIFEST = r"""
WITH RECURSIVE crc_row AS (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))
),
crc AS (SELECT list(v ORDER BY n) AS t FROM crc_row),
d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS grp, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(1 - xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1]))) & 1, 0) AS tampered
  FROM documents, crc
),
leaf AS (
  SELECT doc_id, source, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS altered
  FROM (SELECT *, CASE WHEN tampered = 1 THEN replace(text, chr(10), '') ELSE text END AS cut FROM d)
),
place AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM leaf),
node AS (
  SELECT grp, 0 AS level, i, h, n FROM place
  UNION ALL
  SELECT grp, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max((n + 2) // 3) FROM node WHERE n > 1 GROUP BY grp, level, i // 3
),
sub AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
),
top AS (
  SELECT 0 AS level, i, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, i // 3
),
beside AS (
  SELECT a.grp, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM node a JOIN node b ON a.grp = b.grp AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.grp, a.level, a.i
),
beside_top AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.i
),
step AS (
  SELECT p.grp, p.i, b.level, b.l, b.r FROM place p JOIN beside b ON p.grp = b.grp AND b.i = p.i // CAST(pow(3, b.level) AS BIGINT)
  UNION ALL
  SELECT p.grp, p.i, 1000 + b.level, b.l, b.r FROM place p JOIN sub ON p.grp = sub.grp JOIN beside_top b ON b.i = sub.i // CAST(pow(3, b.level) AS BIGINT)
),
way AS (SELECT grp, i, list(struct_pack(l := l, r := r) ORDER BY level) AS w, string_agg(l || r, '' ORDER BY level) AS proof FROM step GROUP BY grp, i)
SELECT *, folded_root = root AS verified FROM (
  SELECT p.doc_id, p.source, p.h AS leaf, sub.subroot, root.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(p.altered, list_transform(coalesce(w, []), lambda s: s.l || '/' || s.r)), lambda x, s: sha256(split_part(s, '/', 1) || x || split_part(s, '/', 2))) AS folded_root
  FROM place p JOIN sub USING (grp) JOIN (SELECT h FROM top WHERE n = 1) root ON true LEFT JOIN way ON p.grp = way.grp AND p.i = way.i
)
"""

FILTER_AUDIT = r"""
WITH word AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
mark AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
doc AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(word.doc_id, 9223372036854775807) > min(coalesce(word.doc_id, 9223372036854775807)) OVER (PARTITION BY t)} AS fails
  FROM word LEFT JOIN mark ON word.doc_id = mark.doc_id
),
pattern AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM doc GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ord AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)
),
hit AS (
  SELECT part, o, step, n, good, toxic, o[step] AS mine, fails[o[step]] AS bad,
         len(list_filter(string_split(o[1:step - 1], ''), lambda x: x <> '' AND fails[x])) AS earlier, len(list_filter(map_values(fails), lambda x: x)) AS every
  FROM pattern, ord, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
row_ AS (
  SELECT part, o AS filter_order, CAST(step AS INT) AS step, mine, CAST(coalesce(sum(n) FILTER (NOT bad AND earlier = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (bad AND earlier = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (bad AND earlier > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (bad AND every = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (bad AND earlier = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (bad AND earlier = 0), 0) AS BIGINT) AS toxic_lost
  FROM hit GROUP BY part, o, step, mine
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley FROM row_
"""

ORACLES = {
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op7_chat_format": CHAT_FORMAT,
    "op9_embedding_dedup": EMBEDDING_DEDUP,
    "op11_merkle_manifest": MANIFEST,
    "op13_filter_audit": FILTER_AUDIT,
}
