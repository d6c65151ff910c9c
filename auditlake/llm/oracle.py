"""DuckDB counterparts of the registered queries that SQL can express."""

from __future__ import annotations

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""

SUFFIX_DEDUP = r"""
WITH pieces AS (
  SELECT doc_id, p, i, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 1 AS start
  FROM (
    SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]')) AS p,
           generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), 1) AS i
    FROM documents
  )
), words AS (
  SELECT doc_id, p, start, start + length(p) AS stop,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS w
  FROM pieces WHERE p <> ''
), windows AS (
  SELECT doc_id, w, md5(string_agg(p, ' ') OVER span) AS h, count(*) OVER span AS n
  FROM words WINDOW span AS (PARTITION BY doc_id ORDER BY w ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), shared AS (
  SELECT h, min(doc_id) AS low FROM windows WHERE n = 50 GROUP BY h HAVING min(doc_id) <> max(doc_id)
), hits AS (
  SELECT doc_id, w, low, max(w + 50) OVER (PARTITION BY doc_id ORDER BY w
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM windows JOIN shared USING (h) WHERE n = 50
), islands AS (
  SELECT doc_id, w, low, sum(CASE WHEN w <= reach THEN 0 ELSE 1 END)
           OVER (PARTITION BY doc_id ORDER BY w) AS island FROM hits
), spans AS (
  SELECT doc_id, min(w) AS w0, max(w) + 49 AS w1, min(low) AS first_id
  FROM islands GROUP BY doc_id, island
)
SELECT s.doc_id, CAST(a.start AS BIGINT) AS start, CAST(b.stop AS BIGINT) AS "end",
       CAST(w1 - w0 + 1 AS BIGINT) AS n_words, first_id
FROM spans s JOIN words a ON a.doc_id = s.doc_id AND a.w = w0
JOIN words b ON b.doc_id = s.doc_id AND b.w = w1
"""

_ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, whole, gaps, held, unnest(range(1, len(whole) + 1)) AS i,
         {least} AS least
  FROM (SELECT doc_id, regexp_extract_all(text, {quoted}) AS whole,
               string_split_regex(text, {quoted}) AS gaps,
               regexp_extract_all(text, {quoted}, {group}) AS held FROM texts)"""


# a run of hex digits or an access id is matched with its least length at once
SECRET_SCAN = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join((
    _kind(0, "assign", _ASSIGN, 2, 6), _kind(1, "access", "AKIA[A-Z0-9]{16,}", 0, 20),
    _kind(2, "hex", "[0-9a-f]{24,}", 0, 24)))}),
placed AS (
  SELECT doc_id, rank, kind, length(whole[i]) AS n,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
  FROM matches WHERE length(held[i]) >= least
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
         count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ','
                    ORDER BY start, rank) AS spans
  FROM placed GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2),
                                        lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS p
  FROM worded, (VALUES (1), (2), (3), (4)) AS lengths(m) WHERE len(ws) >= m
), counts AS (
  SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, m, p, f AS a, string_split(p, ' ') AS ws FROM counts WHERE m > 1 AND f >= 30
), cuts AS (
  SELECT lang, m, p, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : m], ' ') AS rest
  FROM candidates, (VALUES (1), (2), (3)) AS cut(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS score,
         row_number() OVER (PARTITION BY c.lang, c.p
                            ORDER BY CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f), c.k) AS place
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.m = c.k AND x.p = c.head
  JOIN counts y ON y.lang = c.lang AND y.m = c.m - c.k AND y.p = c.rest
), inside AS (
  SELECT lang, array_to_string(ws[i : i + n - 1], ' ') AS p, max(a) AS longer
  FROM candidates, (VALUES (2), (3)) AS size(n), (VALUES (1), (2), (3)) AS first(i)
  WHERE n < m AND i + n - 1 <= m GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, p) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.p = s.p
  WHERE place = 1 AND NOT coalesce(100 * longer >= 80 * a, false)
), totals AS (
  SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang
)
SELECT lang, rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_line_dedup": LINE_DEDUP,
    "op5_secret_scan": SECRET_SCAN,
    "op13_collocations": COLLOCATIONS,
}
