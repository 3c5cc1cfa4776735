"""Queries of this subpackage, each over its whole table."""

from __future__ import annotations

from . import chunk_dedup, decontamination, licenses, mixing, quality, secrets, sharding, simhash, token_counts, toxicity

QUERIES = {
    "op1_ring_sharding": sharding.op1,
    "op2_license_scan": licenses.op2,
    "op3_toxicity": toxicity.op3,
    "op4_chunk_dedup": chunk_dedup.op4,
    "op5_secret_scan": secrets.op5,
    "op6_fm_decontamination": decontamination.op6,
    "op7_token_counts": token_counts.op7,
    "op8_quality_rules": quality.op8,
    "op9_source_mixing": mixing.op9,
    "op10_simhash_dedup": simhash.op10,
}

#: Words and windows spelled out, without an index.
OP6_SQL = r"""
WITH b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), pos AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: {'k': k, 'p': array_to_string(w[k : k + n - 1], ' ')})) AS x
  FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), met AS (
  SELECT pos.doc_id, pos.x.k AS k, pos.n, win.item_id FROM pos JOIN win ON win.n = pos.n AND win.p = pos.x.p
), hit AS (
  SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS h FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id AS i FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Windows compared as text, rules spelled out anew, and the rounds of expectation maximisation as a recursive query.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM (SELECT id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w)
), r AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY id
), s AS (
  SELECT w.id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:;»”"'')\]][\x20\x09-\x0D]*$'))) AS n_ended,
    len(list_distinct(list_filter(w, lambda x: list_contains(WORDS, x)))) AS n_function, length(regexp_replace(t, '[^0-9@/\\_=]', '', 'g')) AS n_odd
  FROM w LEFT JOIN r ON r.id = w.id
), v AS (
  SELECT *, CASE WHEN n_words = 0 THEN [-1, -1, -1, -1, -1, -1, -1, -1] ELSE [
    CASE WHEN n_words < 30 THEN -1 WHEN n_words <= 100000 AND n_words >= 70 THEN 1 ELSE 0 END,
    CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN -1 WHEN word_chars >= 3 * n_words AND word_chars <= 9 * n_words THEN 1 ELSE 0 END,
    CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END,
    CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN 20 * n_dup_lines <= n_lines AND n_lines > 1 THEN 1 ELSE 0 END,
    CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 WHEN 10 * n_repeat_words <= n_words THEN 1 ELSE 0 END,
    CASE WHEN 5 * n_ended < n_lines THEN -1 WHEN 5 * n_ended >= 3 * n_lines THEN 1 ELSE 0 END,
    CASE WHEN n_function = 0 THEN -1 WHEN n_function >= 3 THEN 1 ELSE 0 END,
    CASE WHEN 5 * n_odd > word_chars THEN -1 WHEN 50 * n_odd <= word_chars THEN 1 ELSE 0 END] END AS votes FROM s
), pats AS (
  SELECT list({'votes': votes, 'n': n}) AS ps FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY votes)
), em AS (
  SELECT 0 AS k, CAST(0.85 AS DOUBLE) AS prior, list_transform(range(0, 8), lambda j: [CAST(0.02 AS DOUBLE), 0.18, 0.80]) AS good, list_transform(range(0, 8), lambda j: [CAST(0.45 AS DOUBLE), 0.25, 0.30]) AS bad
  UNION ALL
  SELECT k + 1, (yes + 20 * 0.85) / (yes + no + 20),
    list_transform(range(1, 9), lambda j: list_transform([-1, 0, 1], lambda x: (coalesce(list_sum(list_transform(list_filter(sc, lambda q: q.votes[j] = x), lambda q: q.n * q.p)), 0) + 20 * [0.02, 0.18, 0.80][x + 2]) / (yes + 20))),
    list_transform(range(1, 9), lambda j: list_transform([-1, 0, 1], lambda x: (coalesce(list_sum(list_transform(list_filter(sc, lambda q: q.votes[j] = x), lambda q: q.n * (1 - q.p))), 0) + 20 * [0.45, 0.25, 0.30][x + 2]) / (no + 20)))
  FROM (SELECT *, coalesce(list_sum(list_transform(sc, lambda q: q.n * q.p)), 0) AS yes, coalesce(list_sum(list_transform(sc, lambda q: q.n * (1 - q.p))), 0) AS no FROM (
    SELECT k, list_transform(ps, lambda q: {'votes': q.votes, 'n': q.n, 'p': 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 9), lambda j: ln(good[j][q.votes[j] + 2] / bad[j][q.votes[j] + 2]))))))}) AS sc FROM em, pats WHERE k < 30))
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS p_good
FROM (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 9), lambda j: ln(good[j][votes[j] + 2] / bad[j][votes[j] + 2])))))) AS p FROM v, em WHERE k = 30)
""".replace("WORDS", str(list(quality.FUNCTION_WORDS)))

#: Matches get marks around them, from which their places follow; CRC-32 and its base-62 digits are worked out in lists.
OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), kinds(kind, rank, pattern, least) AS (VALUES
  ('assign', 1, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  ('access', 2, '(AKIA)([A-Z0-9]+)', 16), ('hex', 3, '()([0-9a-f]+)', 24),
  ('github', 4, '(gh[pousr]_)([0-9A-Za-z]{36,})', 36), ('npm', 5, '(npm_)([0-9A-Za-z]{36,})', 36)
), seg AS (
  SELECT id, kind, rank, pattern, least, string_split(regexp_replace(t, pattern, chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS s FROM d, kinds
), hit AS (
  SELECT id, kind, rank, pattern, least, CAST(k AS BIGINT) AS k, string_split(s[k], chr(57345))[1] AS m, length(array_to_string(s[1 : k - 1], '')) - (k - 2) AS start FROM (SELECT *, unnest(range(2, len(s) + 1)) AS k FROM seg)
), crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), ok AS (
  SELECT id, kind, rank, start, start + length(m) AS stop FROM hit WHERE rank <= 3 AND length(regexp_extract(m, '^' || pattern || '$', 2)) >= least
  UNION ALL
  SELECT id, kind, rank, start, start + length(m) FROM (
    SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, 31), lambda i: CAST(ascii(b[i]) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS v
    FROM (SELECT *, right(m, 36) AS b FROM hit WHERE rank > 3 AND length(m) - position('_' IN m) = 36), crc)
  WHERE right(m, 6) = array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda q: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(v // q % 62 + 1 AS BIGINT), 1)), '')
), found AS (
  SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM ok GROUP BY id
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (id)
"""

ORACLE_SQL = {"op5_secret_scan": OP5_SQL, "op6_fm_decontamination": OP6_SQL, "op8_quality_rules": OP8_SQL}
