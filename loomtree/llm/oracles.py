"""DuckDB SQL for the queries of this folder that SQL expresses on whole tables. The others are tested against brute force."""

from __future__ import annotations

from .url_rules import RULES

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT source, source_size, 3 * source_size AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)]::DOUBLE AS w FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS r, (SELECT sum(source_size) FROM s0)::BIGINT AS total, (SELECT sum(w) FROM s1) AS weights FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER below, 0)::BIGINT) / (weights - coalesce(sum(w) OVER below, 0)) AS level FROM s2 WINDOW below AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, r) FROM s3 WHERE level * w <= cap) * w) AS target FROM s3),
queued AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (SELECT size, (e * source_size + ends - size / 2) / target AS time FROM queued, range(3) t(e) WHERE size > 0),
ordered AS (SELECT time, size, sum(size) OVER (ORDER BY time, size ROWS UNBOUNDED PRECEDING)::BIGINT AS through FROM copies),
cut AS (SELECT max(time) AS last FROM ordered WHERE through - size / 2 <= (SELECT sum(size) FROM sized))
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN size * ((CASE WHEN (ends - size / 2) / target <= last THEN 1 ELSE 0 END) + (CASE WHEN (source_size + ends - size / 2) / target <= last THEN 1 ELSE 0 END)
    + (CASE WHEN (2 * source_size + ends - size / 2) / target <= last THEN 1 ELSE 0 END)) ELSE 0 END AS taken
FROM queued, cut"""

_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
_HOST = r"translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "(CASE WHEN strpos(coalesce({0}, ''), '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END)"


def _url(column: str) -> tuple[str, str, str]:
    """host, path and node of a url column."""
    rest = _REST.format(column)
    host = _HOST.format(rest)
    path = rf"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = rf"regexp_extract({rest}, '^[^?#]*(\?[^#]*)?', 1)"
    return host, path, f"({host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query})"


_URLS = rf"""
WITH RECURSIVE rules(action, rhost, rpath) AS (VALUES {_VALUES}),
tags AS (SELECT page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url LIKE '%://%'),
aimed AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)
                   WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i);\s*url\s*=\s*([^"''>]*)', 1) END AS goal
  FROM tags WHERE regexp_matches(tag, '(?i)\b(canonical|refresh)\b')),
link AS (SELECT {_url('url')[2]} AS a, {_url('goal')[2]} AS b, {_url('goal')[0]} AS bhost, {_url('goal')[1]} AS bpath FROM aimed WHERE goal LIKE '%://%'),
own AS (SELECT page_id, {_url('url')[0]} AS host, {_url('url')[1]} AS path, {_url('url')[2]} AS node FROM pages),
nodes AS (SELECT node, host, path FROM own UNION SELECT b, bhost, bpath FROM link),
fits AS (SELECT node, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY node ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS r
         FROM nodes, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT node, rule, action FROM fits WHERE r = 1),
reach(start, node) AS (SELECT a, a FROM link UNION SELECT b, b FROM link
  UNION SELECT r.start, CASE WHEN l.a = r.node THEN l.b ELSE l.a END FROM reach r JOIN link l ON l.a = r.node OR l.b = r.node),
blocked AS (SELECT DISTINCT start AS node FROM reach JOIN best USING (node) WHERE action = 'block')
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host <> '' AND node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN best USING (node)"""

ORACLES: dict[str, str] = {"op1_mix_sources": _MIX, "op5_url_rules": _URLS}
