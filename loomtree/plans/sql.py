"""DuckDB SQL fragments that several oracles share."""

from __future__ import annotations

from ..functions.text import INDEX_STOP_WORDS, KEYWORD_STOP_WORDS_E, KEYWORD_STOP_WORDS_H

quoted = lambda items: ", ".join(f"'{x}'" for x in items)
STOP = quoted(INDEX_STOP_WORDS)
STOP_H = quoted(sorted(set(KEYWORD_STOP_WORDS_H)))
STOP_E = quoted(sorted(set(KEYWORD_STOP_WORDS_E)))
BLANK = r"'^\s+|\s+$'"

MESSAGES = """m AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS content,
         'conv-' || conv_id AS session_id, 'agent-' || (conv_id % 5) AS agent_id,
         1704067200 + conv_id * 3600 + turn * 60 AS created,
         CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS is_first
  FROM conversations)"""


def split_sentences(text: str) -> str:
    """SQL for the list of raw parts of a text that is already stripped, abbreviations masked."""
    masked = text
    for a in ("Mr.", "Mrs.", "Dr.", "etc.", "e.g.", "i.e."):
        masked = f"replace({masked}, '{a}', '{a}'.replace('.', chr(2)))"
    return rf"string_split(regexp_replace({masked}, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1))"


SENTENCES = rf"""p0 AS (SELECT conv_id, turn, unnest(string_split_regex(content, '\n\s*\n')) AS raw, generate_subscripts(string_split_regex(content, '\n\s*\n'), 1) AS ix FROM m),
p1 AS (SELECT conv_id, turn, ix, regexp_replace(raw, {BLANK}, '', 'g') AS para FROM p0),
p AS (SELECT conv_id, turn, para, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ix) - 1 AS block_ix,
             regexp_matches(para, '^([-*+] |\d+\.\s)') AS listed FROM p1 WHERE para <> ''),
s0 AS (SELECT conv_id, turn, block_ix, listed, CASE WHEN listed THEN [para] ELSE {split_sentences('para')} END AS parts FROM p),
s1 AS (SELECT conv_id, turn, block_ix, listed, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM s0),
s2 AS (SELECT *, regexp_replace(replace(part, chr(2), '.'), {BLANK}, '', 'g') AS stmt FROM s1 WHERE k = n OR listed OR NOT regexp_matches(part, '^[.!?]+$')),
s AS (SELECT conv_id, turn, block_ix, listed, stmt, row_number() OVER (PARTITION BY conv_id, turn, block_ix ORDER BY k) - 1 AS stmt_ix FROM s2 WHERE stmt <> '')"""

NODES = f"""{MESSAGES},
{SENTENCES},
raw AS (
  SELECT conv_id, turn, -2 AS b, -1 AS s, 3 AS level, '' AS content, NULL::VARCHAR AS role, NULL::VARCHAR AS block_type, NULL::VARCHAR AS stmt_type FROM m WHERE is_first = 1
  UNION ALL SELECT conv_id, turn, -1, -1, 2, content, role, NULL, NULL FROM m
  UNION ALL SELECT conv_id, turn, block_ix, -1, 1, para, NULL, CASE WHEN listed THEN 'list' ELSE 'paragraph' END, NULL FROM p
  UNION ALL SELECT conv_id, turn, block_ix, stmt_ix, 0, stmt, NULL, NULL, CASE WHEN listed THEN 'list_item' ELSE 'sentence' END FROM s),
ids AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, b, s) AS node_id FROM raw),
nodes AS (
  SELECT i.node_id, i.level, CASE i.level WHEN 3 THEN NULL WHEN 2 THEN r.node_id WHEN 1 THEN h.node_id ELSE k.node_id END AS parent_id,
         m.session_id, m.agent_id, CASE WHEN i.level = 3 THEN NULL ELSE m.role END AS role, i.content, i.block_type, i.stmt_type, m.created, i.conv_id, i.turn
  FROM ids i JOIN m ON m.conv_id = i.conv_id AND m.turn = i.turn
  JOIN ids r ON r.conv_id = i.conv_id AND r.level = 3
  JOIN ids h ON h.conv_id = i.conv_id AND h.turn = i.turn AND h.level = 2
  LEFT JOIN ids k ON k.conv_id = i.conv_id AND k.turn = i.turn AND k.level = 1 AND k.b = i.b AND i.level = 0)"""


def tokens(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{Nd}}_]+'), lambda t: strlen(t) >= 2 AND t NOT IN ({STOP}))"


POSTINGS = f"""tok AS (SELECT doc_id AS node_id, unnest({tokens("coalesce(text, '')")}) AS token FROM documents),
postings AS (SELECT token, node_id, count(*) AS tf FROM tok GROUP BY ALL),
doc_stats AS (SELECT node_id, sum(tf)::BIGINT AS doc_len FROM postings GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM doc_stats)"""


def bm25(query: str, name: str = "scores", all_tokens: bool = False) -> str:
    """CTEs q (token, times), <name> (node_id, score)."""
    having = "HAVING count(*) = (SELECT count(*) FROM q)" if all_tokens else ""
    return f"""q AS (SELECT token, count(*) AS times FROM (SELECT unnest({tokens(f"'{query}'")}) AS token) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM postings WHERE token IN (SELECT token FROM q) GROUP BY ALL),
{name} AS (SELECT p.node_id, sum(q.times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score
  FROM postings p JOIN q USING (token) JOIN df USING (token) JOIN doc_stats USING (node_id), corpus GROUP BY p.node_id {having})"""


def values(rows: tuple, names: str) -> str:
    """SELECT of literal rows; None is NULL."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


def times_hash(text: str, factor: int, start: int) -> str:
    """hash * factor + byte over a text's bytes, modulo 2**32."""
    return f"list_reduce(list_prepend({start}::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda h, x: (h * {factor} + x) & 4294967295)"
