"""Queries on sessions, extraction, events, the log and hooks."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources import hooks, wal
from ..streaming import events as X
from . import sql
from .ingest import build_nodes, conversations
from .registry import query, table


def _sessions(spark, sf):
    messages = conversations(table(spark, sf, "conversations"))
    return S.build_sessions(build_nodes(messages), messages)


_S = f"""WITH {sql.NODES},
counts AS (SELECT session_id, min(node_id) FILTER (level = 3) AS root_node_id, count(*) FILTER (level = 2) AS message_count, count(*) FILTER (level = 1) AS block_count, count(*) FILTER (level = 0) AS statement_count FROM nodes GROUP BY ALL),
t AS (SELECT session_id, min_by(agent_id, turn) AS agent_id, min(created) AS created, max(created) AS last FROM m GROUP BY ALL)"""


@query(_S + " SELECT session_id, agent_id, root_node_id, message_count, block_count, statement_count, created, last FROM counts JOIN t USING (session_id)")
def sessions(spark, sf):
    return _sessions(spark, sf).select("session_id", "agent_id", "root_node_id", "message_count", "block_count", "statement_count", F.unix_seconds("created_at").alias("created"), F.unix_seconds("last_active_at").alias("last"))


@query(_S + " SELECT session_id FROM t WHERE agent_id = 'agent-2'")
def sessions_by_agent(spark, sf):
    return S.list_sessions(_sessions(spark, sf), "agent-2").select("session_id")


_KW = rf"""kw0 AS (SELECT session_id, turn, lower(unnest(list_filter(regexp_extract_all(content, '[\p{{L}}\p{{Nd}}]+'), lambda w: strlen(w) >= 3 AND lower(w) NOT IN ({sql.STOP_H})))) AS word FROM m),
kw1 AS (SELECT session_id, turn, word, count(*) AS n FROM kw0 GROUP BY ALL), kw2 AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY n DESC, word) AS r FROM kw1),
kw3 AS (SELECT session_id, word, min((turn, r)) AS seen FROM kw2 WHERE r <= 20 GROUP BY ALL), kw AS (SELECT session_id, word, row_number() OVER (PARTITION BY session_id ORDER BY seen, word) AS r FROM kw3)"""


@query(f"WITH {sql.MESSAGES}, {_KW} SELECT session_id, word, r FROM kw WHERE r <= 32")
def session_keywords(spark, sf):
    return _sessions(spark, sf).select("session_id", F.posexplode("keywords").alias("r", "word")).select("session_id", "word", (F.col("r") + 1).cast("long").alias("r"))


@query(f"WITH {sql.MESSAGES}, {_KW} SELECT session_id FROM m WHERE session_id IN (SELECT session_id FROM kw WHERE r <= 32 AND contains(word, 'tion')) GROUP BY session_id HAVING min(created) >= 1704110400 ORDER BY session_id LIMIT 5")
def sessions_filtered(spark, sf):
    return S.list_sessions(_sessions(spark, sf), since=datetime(2024, 1, 1, 12), keyword="tion", limit=5).select("session_id")


@query("SELECT count(DISTINCT conv_id) AS total_sessions, count(DISTINCT conv_id % 5) AS unique_agents FROM conversations")
def session_stats(spark, sf):
    return S.session_stats(_sessions(spark, sf))


@query(_S + " SELECT session_id, message_count + 2 AS message_count, block_count + 1 AS block_count, statement_count FROM counts")
def session_counters(spark, sf):
    s = _sessions(spark, sf)
    activity = s.select("session_id", F.current_timestamp().alias("at"), F.explode(F.array(F.struct(F.lit(1).alias("messages"), F.lit(1).alias("blocks"), F.lit(0).alias("statements")), F.struct(F.lit(1).alias("messages"), F.lit(0).alias("blocks"), F.lit(0).alias("statements")))).alias("d")).select("session_id", "at", "d.*")
    return S.touch(s, activity).select("session_id", "message_count", "block_count", "statement_count")


CODE = (
    (1, "alpha", 1, "We edit src/auth/oauth.go and call handleTokenRefresh() there. See /etc/app/config.yaml and ./run.sh"),
    (2, "alpha", 2, "type UserStore struct; const MAX_RETRY = 3; func parse_token(x) in ../lib/parse.c"),
    (3, "beta", 1, "Fix MyClass and get_user_name, then C:\\work\\notes.txt or (/var/log/app)"),
    (4, "beta", 2, "if (x) return NULL; HTTP and fooBar; src/api/index.ts"),
)


def _code(spark):
    return spark.createDataFrame(list(CODE), "id int, session_id string, turn int, content string")


@query("SELECT * FROM (VALUES (1, 'handleTokenRefresh'), (2, 'UserStore'), (2, 'parse_token'), (3, 'MyClass'), (3, 'get_user_name'), (4, 'fooBar')) t(id, name)")
def identifiers(spark, sf):
    return _code(spark).select("id", F.explode(S.identifiers_h(F.col("content"))).alias("name"))


IDENTIFIERS_E = (
    (1, "We", "TYPE"), (1, "handleTokenRefresh", "FUNCTION"), (1, "See", "TYPE"), (2, "UserStore", "TYPE"), (2, "MAX_RETRY", "CONSTANT"),
    (2, "parse_token", "FUNCTION"), (3, "Fix", "TYPE"), (3, "MyClass", "TYPE"), (3, "or", "FUNCTION"), (4, "HTTP", "TYPE"),
)


@query(sql.values(IDENTIFIERS_E, "id, name, kind"))
def identifiers_e(spark, sf):
    return _code(spark).select("id", F.explode(S.identifiers_e(F.col("content"))).alias("i")).select("id", "i.name", "i.kind")


@query("SELECT * FROM (VALUES (1, '/etc/app/config.yaml'), (1, './run.sh'), (2, '../lib/parse.c'), (3, 'C:\\work\\notes.txt'), (3, '/var/log/app')) t(id, path)")
def file_paths(spark, sf):
    return _code(spark).select("id", F.explode(S.file_paths_h(F.col("content"))).alias("path"))


@query("SELECT * FROM (VALUES (1, 'src/auth/oauth.go'), (1, '/etc/app/config.yaml'), (1, './run.sh'), (2, '../lib/parse.c'), (3, '/var/log/app'), (4, 'src/api/index.ts')) t(id, path)")
def file_paths_e(spark, sf):
    return _code(spark).select("id", F.explode(S.file_paths_e(F.col("content"))).alias("path"))


@query("SELECT 'alpha' AS session_id UNION ALL SELECT 'beta'")
def find_by_file(spark, sf):
    found = _code(spark).select("session_id", "turn", F.posexplode(S.file_paths_e(F.col("content"))).alias("pos", "value"))
    merged = S.merge_first_seen(found, "session_id", "value", ["turn", "pos"], 64).withColumnRenamed("values", "files_touched")
    return S.find_by_file(merged, ".").select("session_id")


@query(f"""WITH w AS (SELECT doc_id, lower(unnest(list_filter(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 3 AND lower(w) NOT IN ({sql.STOP_H})))) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) SELECT doc_id, word, n, rank FROM r WHERE rank <= 20""")
def kw_freq_top20(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return S.top_keywords(docs, "doc_id", "text").withColumn("rank", F.col("rank").cast("long"))


_TFIDF = f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda w: strlen(w) BETWEEN 2 AND 63 AND NOT regexp_matches(w, '^[0-9]') AND w NOT IN ({sql.STOP_E}))) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM c GROUP BY ALL),
s AS (SELECT doc_id, word, (n::DOUBLE / total * ln((SELECT count(*) FROM documents)::DOUBLE / df) * least(greatest(1 + 0.1 * (strlen(word)::INT - 3), 1), 2)) AS score FROM c JOIN t USING (doc_id) JOIN df USING (word))"""


@query(_TFIDF + " SELECT doc_id, word, round(score * 1e9)::BIGINT AS score_e9 FROM s")
def kw_tfidf_e(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    rows = S.tfidf_keywords(docs, "doc_id", "text", 1 << 30, S.document_frequencies(docs, "text"), n)
    return rows.select("doc_id", "word", F.round(F.col("score") * 1e9).cast("long").alias("score_e9"))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda w: strlen(w) BETWEEN 2 AND 63 AND NOT regexp_matches(w, '^[0-9]') AND w NOT IN ({sql.STOP_E}))) AS word FROM documents)
SELECT doc_id, word, count(*) OVER (PARTITION BY word ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS df_before FROM w""")
def running_idf(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return S.running_frequencies(docs, "doc_id", "text")


@query("""WITH v AS (SELECT o_custkey % 3 AS k, o_orderkey AS seen, 'v' || (o_orderkey * 7 % 50) AS value FROM orders), f AS (SELECT k, value, min(seen) AS seen FROM v GROUP BY ALL),
r AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY seen, value) AS r FROM f) SELECT k, string_agg(value, ',' ORDER BY r) AS vals FROM r WHERE r <= 32 GROUP BY k""")
def merge_keywords_capped(spark, sf):
    v = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("k"), F.col("o_orderkey").alias("at"), F.concat(F.lit("v"), F.col("o_orderkey") * 7 % 50).alias("value"))
    return S.merge_first_seen(v, "k", "value", ["at"], 32).select("k", F.array_join("values", ",").alias("vals"))


@query("""WITH v AS (SELECT o_custkey % 3 AS k, o_orderkey AS seen, 'v' || (o_orderkey * 7 % 50) AS word, (o_orderkey % 100)::DOUBLE AS score FROM orders), f AS (SELECT k, word, min(seen) AS seen, max(score) AS score FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seen, word) AS r FROM f) SELECT k, word, score FROM r WHERE r <= 32""")
def merge_keywords_scored(spark, sf):
    v = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("k"), F.col("o_orderkey").alias("at"), F.concat(F.lit("v"), F.col("o_orderkey") * 7 % 50).alias("word"), (F.col("o_orderkey") % 100).cast("double").alias("score"))
    return S.merge_scored(v, "k", ["at"]).select("k", F.explode("words").alias("w")).select("k", "w.word", "w.score")


# Events.

_EPOCH = "floor(epoch(ts))::BIGINT"


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, sf):
    return X.count_by_type(X.source_events(table(spark, sf, "events")))


@query(f"SELECT event_id::VARCHAR AS id, event_type AS type, user_id, {_EPOCH} AS seconds, round(value, 6) AS value, json_extract_string(props, '$.k') AS k FROM events")
def event_json_roundtrip(spark, sf):
    e = X.source_events(table(spark, sf, "events"))
    back = e.select(F.from_json(F.to_json(F.struct(*e.columns)), "id string, type string, user_id long, timestamp timestamp, value double, data map<string,string>").alias("e")).select("e.*")
    return back.select("id", "type", "user_id", F.unix_seconds("timestamp").alias("seconds"), F.round("value", 6).alias("value"), F.col("data")["k"].alias("k"))


@query(f"SELECT {_EPOCH} // 3600 * 3600 AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return X.tumbling(X.source_events(table(spark, sf, "events"))).select(F.unix_seconds("start").alias("start"), "type", "n")


@query(f"SELECT {_EPOCH} // 900 * 900 - k * 900 AS start, count(*) AS n FROM events, range(4) r(k) GROUP BY ALL")
def sliding(spark, sf):
    return X.sliding(X.source_events(table(spark, sf, "events"))).select(F.unix_seconds("start").alias("start"), "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, sf):
    return X.user_sessions(X.source_events(table(spark, sf, "events"))).select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def event_counts_deduplicated(spark, sf):
    e = X.source_events(table(spark, sf, "events"))
    return X.count_by_type(X.once(e.unionByName(e)))


# The log.


def _log(spark, sf):
    e = table(spark, sf, "events")
    op = F.when(F.col("event_id") % 97 == 0, "CHECKPOINT").when(F.col("event_id") % 10 == 0, "NODE_DELETE").otherwise("NODE_INSERT")
    payload = F.to_json(F.struct((F.col("event_id") % 200).alias("id"), "event_type"))
    return wal.entries(e.select((F.col("event_id") + 1).alias("sequence"), op.alias("op"), F.col("ts").alias("ts"), payload.alias("payload")))


@query("SELECT event_id + 1 AS sequence FROM events WHERE event_id + 1 > 100 AND event_id % 97 <> 0")
def wal_replay(spark, sf):
    return wal.replay(_log(spark, sf), 100).select("sequence")


@query("SELECT event_id + 1 AS sequence FROM events WHERE event_id + 1 < 700 AND event_id % 97 <> 0")
def wal_truncated_tail(spark, sf):
    broken = _log(spark, sf).withColumn("payload", F.when(F.col("sequence").isin(700, 801), F.left("payload", F.lit(5))).otherwise(F.col("payload")))
    return wal.replay(broken).select("sequence")


@query("SELECT count(*) AS n FROM events WHERE event_id + 1 > (SELECT max(event_id + 1) FROM events WHERE event_id % 97 = 0)")
def wal_since_checkpoint(spark, sf):
    return wal.since_checkpoint(_log(spark, sf)).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT event_id, event_id % 200 AS id, event_id % 10 = 0 AS gone FROM events WHERE event_id % 97 <> 0), x AS (SELECT id, max_by(gone, event_id) AS gone, max(event_id) AS e FROM l GROUP BY id) SELECT id::VARCHAR AS key FROM x WHERE NOT gone""")
def wal_state(spark, sf):
    return wal.state(_log(spark, sf)).select("key")


HOOKS = (
    {"session_id": "s1", "hook_event_name": "UserPromptSubmit", "prompt": "hello there"},
    {"session_id": "s1", "hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_input": {"command": "ls -l", "description": "list"}, "tool_response": {"stdout": "a\nb"}},
    {"session_id": "s1", "hook_event_name": "PostToolUse", "tool_name": "Edit", "tool_input": {"file_path": "/a.py"}, "tool_response": {"structuredPatch": [{"lines": ["-x", "+y"]}]}},
    {"session_id": "s2", "hook_event_name": "PostToolUse", "tool_name": "Read", "tool_input": {"file_path": "/b.py"}, "tool_response": {"file": {"content": "text"}}},
    {"session_id": "s2", "hook_event_name": "PostToolUse", "tool_name": "Write", "tool_input": {"file_path": "/c.py", "content": "z" * 600}},
    {"session_id": "s2", "hook_event_name": "PostToolUse", "tool_name": "Grep", "tool_input": {"pattern": "foo"}, "tool_response": "3 matches"},
    {"session_id": "s2", "hook_event_name": "Notification", "message": "ignored"},
    {"hook_event_name": "Stop", "session_id": "s1", "transcript_path": "/t.jsonl"},
)
TRANSCRIPT = (("/t.jsonl", 1, {"type": "assistant", "message": {"content": [{"type": "text", "text": "first"}]}}), ("/t.jsonl", 2, {"type": "assistant", "message": {"content": [{"type": "text", "text": "the\nanswer"}, {"type": "tool_use"}]}}), ("/t.jsonl", 3, {"type": "user"}))


@query("""SELECT * FROM (VALUES ('s1', 'user', 'hello there'), ('s1', 'tool', 'Bash: list' || chr(10) || '$ ls -l' || chr(10) || 'a' || chr(10) || 'b'), ('s1', 'tool', 'Edit: /a.py' || chr(10) || '-x' || chr(10) || '+y'),
('s2', 'tool', 'Read: /b.py' || chr(10) || 'text'), ('s2', 'tool', 'Write: /c.py' || chr(10) || repeat('z', 500)), ('s2', 'tool', 'Grep: foo' || chr(10) || '3 matches'), ('s1', 'assistant', 'the answer')) t(session_id, role, content)""")
def hook_ingest(spark, sf):
    raw = spark.createDataFrame([(json.dumps(h),) for h in HOOKS], "raw string")
    lines = spark.createDataFrame([(p, n, json.dumps(x)) for p, n, x in TRANSCRIPT], "path string, line_no int, line string")
    return hooks.messages(raw, lines).select("session_id", "role", "content")


REQUESTS = ('{"jsonrpc":"2.0","method":"query","params":{},"id":1}', '{"jsonrpc":"2.0","method":"list_sessions"}', "{bad", '{"method":"query","id":2}', '{"jsonrpc":"1.0","method":"query"}', '{"jsonrpc":"2.0","id":3}', '{"jsonrpc":"2.0","method":"nope","id":4}')


@query("SELECT * FROM (VALUES (0, NULL), (1, NULL), (2, -32700), (3, -32600), (4, -32600), (5, -32600), (6, -32601)) t(n, code)")
def validate_requests(spark, sf):
    from .api import validate_requests as check

    rows = spark.createDataFrame(list(enumerate(REQUESTS)), "n int, raw string")
    return rows.join(check(rows.select("raw")).select("raw", "code"), "raw").select("n", "code")


@query(f"""WITH {sql.MESSAGES}, w0 AS (SELECT session_id, turn, lower(unnest(list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 3 AND lower(w) NOT IN ({sql.STOP_H})))) AS word FROM m),
w1 AS (SELECT session_id, turn, word, count(*) AS n FROM w0 GROUP BY ALL), w2 AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY n DESC, word) AS r FROM w1)
SELECT 'keyword' AS kind, word AS value, count(*) AS n_docs FROM w2 WHERE r <= 20 GROUP BY ALL""")
def extract_merged(spark, sf):
    m = conversations(table(spark, sf, "conversations")).select(F.struct("session_id", "turn").alias("key"), "content")
    return S.extract_many(m, "key", "content").filter("kind = 'keyword'")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts) * 1000 AS ns, epoch_us(ts) AS back FROM events")
def iso_times(spark, sf):
    from ..functions import text as T

    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", T.iso(at).alias("iso"), T.to_ns(at).alias("ns"), F.unix_micros(T.from_ns(T.to_ns(at))).alias("back"))


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf):
    """The same counts from a stream over the table's files, driven to its end."""
    raw = table(spark, sf, "events")
    stream = spark.readStream.schema(raw.schema).parquet(f"{sf}/event[s].parquet")
    return X.run_to_table(X.count_by_type(X.source_events(stream)), "stream_counts").select("type", "n")


@query(f"SELECT {_EPOCH} // 3600 * 3600 AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    raw = table(spark, sf, "events")
    stream = spark.readStream.schema(raw.schema).parquet(f"{sf}/event[s].parquet")
    found = X.run_to_table(X.tumbling(X.source_events(stream)), "stream_tumbling")
    return found.select(F.unix_seconds("start").alias("start"), "type", "n")
