"""DuckDB forms of the queries on quality rules, prefix trie and centroid clustering."""

from __future__ import annotations

from ticketlake.llm.quality_rules import ALPHA, DELTA, LIFT, MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STEPS, WINDOW


def _crc32(ids: str, name: str) -> str:
    """CTEs ``name`` (id, crc) with the CRC-32 of the decimals of every id of ``ids`` (id),
    a bit a step."""
    return f"""
{name}_bits AS (
  SELECT id, id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS v FROM {ids}
  UNION ALL
  SELECT id, s, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)
  FROM (SELECT id, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(s[i // 8 + 1])::BIGINT) ELSE v END AS x
        FROM {name}_bits WHERE i < 8 * length(s))),
{name} AS (SELECT id, xor(v, 4294967295::BIGINT) AS crc FROM {name}_bits WHERE i = 8 * length(s))"""


def _rung(over: str, under: str, more: bool, ladder: tuple[int, ...]) -> str:
    broken = " + ".join(f"(100 * {over} {'>' if more else '<'} {cut} * {under})::INT" for cut in ladder)
    return f"{STEPS + 1} - CASE WHEN {under} > 0 THEN {broken} ELSE 0 END"


# Labelled documents are counted one by one here, without cells.
QUALITY_RULES = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM split
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT docs.r, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines
  FROM docs JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    [{", ".join(_rung(*rule) for rule in RULES.values())}] AS rung
  FROM m),
own AS (SELECT doc_id AS id, max(quality) AS y FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
{_crc32("own", "crc")},
cells AS (
  SELECT lang, crc % 5 >= 3 AS certify, y, rung FROM v JOIN own ON own.id = doc_id JOIN crc ON crc.id = doc_id
  WHERE NOT base_failed AND crc % 5 <> 0),
strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang FROM cells)),
totals AS (SELECT lang, count(*) FILTER (y = 1) AS good, count(*) FILTER (y = 0) AS bad FROM cells WHERE NOT certify GROUP BY lang),
proposed AS (
  SELECT lang, k, g, count(*) FILTER (y = 1 AND rung[k] <= g) AS lost, count(*) FILTER (y = 0 AND rung[k] <= g) AS hit
  FROM cells, range(1, {len(RULES) + 1}) a(k), range(1, {STEPS + 1}) b(g) WHERE NOT certify GROUP BY ALL),
target AS (
  SELECT p.lang, k, max(g) AS g FROM proposed p JOIN totals t ON p.lang IS NOT DISTINCT FROM t.lang
  WHERE good > 0 AND bad > 0 AND lost * {len(RULES)} <= {ALPHA} * good AND hit > 0 AND hit * good >= {LIFT} * lost * bad
  GROUP BY p.lang, k),
sure AS (SELECT row_number() OVER () AS d, lang, rung FROM cells WHERE certify AND y = 1),
steps AS (
  SELECT d, s.lang, min(rung[k] - g + {STEPS}) AS step FROM sure s JOIN target t ON s.lang IS NOT DISTINCT FROM t.lang
  GROUP BY d, s.lang),
counted AS (SELECT lang, t, count(*) AS n, count(*) FILTER (step <= t) AS k FROM steps, range(1, {STEPS + 1}) a(t) GROUP BY ALL),
tail AS (
  SELECT lang, t, CASE WHEN k >= {ALPHA} * n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END AS p FROM counted),
best AS (SELECT lang, max(t) AS t FROM tail, strata WHERE p <= {DELTA} / strata.n GROUP BY lang),
cut AS (SELECT x.lang, k, g - ({STEPS} - t) AS g FROM target x JOIN best b ON x.lang IS NOT DISTINCT FROM b.lang),
rejected AS (SELECT DISTINCT r FROM v JOIN cut c ON v.lang IS NOT DISTINCT FROM c.lang AND v.rung[k] <= g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND j.r IS NULL AS kept
FROM v LEFT JOIN rejected j ON j.r = v.r
"""

# A node's subtree: the nodes whose key, a list of turn digests, begins with the node's.
PREFIX_TRIE = rf"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL),
{_crc32("ids", "crc")},
heads AS (SELECT id, id - id % 5 AS base, crc % 9 AS h FROM crc),
turns AS (
  SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, strlen(coalesce(text, '')) AS bytes
  FROM conversations),
seq AS (
  SELECT heads.id, 0 AS part, k, turn, bytes FROM heads JOIN turns ON turns.id = base AND k <= h
  UNION ALL
  SELECT heads.id, 1, k, turn, bytes FROM heads JOIN turns ON turns.id = heads.id AND k > h),
paths AS (
  SELECT ids.id, coalesce(list(turn ORDER BY part, k) FILTER (turn IS NOT NULL), []) AS p,
    coalesce(list(bytes ORDER BY part, k) FILTER (turn IS NOT NULL), []) AS b FROM ids LEFT JOIN seq USING (id) GROUP BY ids.id),
members AS (
  SELECT id, d, array_to_string(p[1:d], '') AS key, array_to_string(p[1:d - 1], '') AS above, len(p) = d AS ends,
    CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes
  FROM (SELECT id, p, b, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT key, d, any_value(above) AS above, min(id) AS conv, count(*) AS n, any_value(bytes) AS bytes,
    coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (ends), '') AS ids
  FROM members GROUP BY key, d),
kids AS (SELECT above AS key, count(*) AS c FROM nodes WHERE d > 0 GROUP BY above),
full_nodes AS (SELECT nodes.*, coalesce(c, 0) AS c FROM nodes LEFT JOIN kids USING (key)),
sums AS (
  SELECT v.key, count(*) FILTER (u.c = 0) AS leaves, sum((u.n - 1) * u.bytes) AS saved
  FROM full_nodes v JOIN full_nodes u ON starts_with(u.key, v.key) GROUP BY v.key)
SELECT v.conv AS conv_id, v.d AS depth, p.conv AS parent_conv_id, v.n AS n_convs, v.c AS n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM full_nodes v JOIN sums USING (key) LEFT JOIN nodes p ON v.d > 0 AND p.key = v.above
"""


def centroid_clustering(dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> str:
    """All distances of every round, without bisectors."""
    ctes = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
long AS (SELECT r, vec_id, d, v[d] AS x FROM (SELECT r, vec_id, v, unnest(range(1, {dim + 1})) AS d FROM kept))""", f"""
c0 AS (
  SELECT cluster, d, v[d] AS x FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL),
  range(1, {dim + 1}) t(d) WHERE cluster < {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""
a{i} AS (
  SELECT r, vec_id, cluster, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS place
    FROM (SELECT r, vec_id, cluster, sum((l.x - c.x) * (l.x - c.x)) AS distance FROM long l JOIN c{i} c USING (d) GROUP BY ALL)) WHERE place = 1)""")
        if i < rounds:
            ctes.append(f"""
s{i} AS (SELECT cluster, d, sum(x)::HUGEINT AS s, count(*) AS n FROM a{i} JOIN long USING (r) GROUP BY ALL),
c{i + 1} AS (
  SELECT cluster, d, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} LEFT JOIN s{i} USING (cluster, d))""")
    return "WITH " + ",".join(ctes) + f""",
shas AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN shas USING (cluster)
"""
