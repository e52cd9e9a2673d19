"""The contracts of this subpackage in DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)"
_KEYED = f"SELECT *, {_LOWER.format(f'trim(line, {_WHITE})')} AS k FROM ({_LINES})"
_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

LINE_DEDUP = f"""
WITH l AS ({_KEYED}),
f AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.top AS gone FROM l LEFT JOIN f ON f.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM d),
v AS (SELECT doc_id, j, array_to_string(ws[j:j + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS j FROM d WHERE len(ws) >= 20)),
late AS (SELECT doc_id, j, row_number() OVER (PARTITION BY win ORDER BY doc_id, j) > 1 AS late FROM v),
c AS (SELECT w.doc_id, w.j, w.word, coalesce(max(late::INT) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
      FROM w LEFT JOIN late ON late.doc_id = w.doc_id AND late.j = w.j)
SELECT d.doc_id, count(c.j) AS n_words, count(c.j) FILTER (c.gone) AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.j) FILTER (NOT c.gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(ws[j:j + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS j FROM d WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
l AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT *, len({_WORDS.format('line')}) AS n FROM ({_KEYED})),
dup AS (SELECT doc_id, count(*) FILTER (r > 1) AS n_dup_lines FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM l WHERE n > 0) GROUP BY doc_id),
host AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
f AS (SELECT l.source, k, min(doc_id) AS first FROM l JOIN host ON host.source IS NOT DISTINCT FROM l.source WHERE l.n > 0 GROUP BY l.source, k, host.n HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > 0.02 * host.n),
lost AS (SELECT doc_id, sum(l.n) AS lost FROM l JOIN f ON f.k = l.k AND f.source IS NOT DISTINCT FROM l.source WHERE doc_id > first GROUP BY doc_id),
g AS (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM (SELECT doc_id, j, array_to_string(ws[j:j + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS j FROM d WHERE len(ws) >= 5))),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j FROM d),
c AS (SELECT w.doc_id, coalesce(max(twice::INT) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS r FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.j = w.j),
rep AS (SELECT doc_id, sum(r)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_frequent_words
      FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_frequent_words >= 10 AND n_words - n_frequent_words >= 0.2 * n_words AS kept
FROM b"""
