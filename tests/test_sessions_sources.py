from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from loomtree.operators import sessions as S
from loomtree.plans.api import ConversationEngine, call_tool
from loomtree.sources import wal
from loomtree.sources.storage import Store, read_json_records
from loomtree.streaming import events as X
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 1)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


OAUTH = "We add OAuth to the service.\nThe token refresh lives in src/auth/oauth.go\nCall handleTokenRefresh() to refresh the OAuth token.\nToken auth needs tests."


def test_keywords(spark):
    docs = spark.createDataFrame([(1, OAUTH)], "id int, t string")
    top = [r.word for r in S.top_keywords(docs, "id", "t").orderBy("rank").collect()]
    assert top[:2] == ["token", "oauth"] or set(top[:3]) >= {"token", "oauth"}
    tf = S.tfidf_keywords(docs, "id", "t").collect()
    assert len(tf) <= 32 and max(tf, key=lambda r: r.score).word in {"handletokenrefresh", "token", "refresh", "oauth"}


def test_identifiers_and_paths(spark):
    assert one(spark, OAUTH, S.identifiers_h) == ["handleTokenRefresh"]
    kinds = [(i.name, i.kind) for i in one(spark, OAUTH + " MAX_SIZE Foo bar()", S.identifiers_e)]
    assert ("handleTokenRefresh", "FUNCTION") in kinds and ("MAX_SIZE", "CONSTANT") in kinds and ("bar", "FUNCTION") in kinds and ("Foo", "TYPE") in kinds
    assert one(spark, OAUTH, S.file_paths_e) == ["src/auth/oauth.go"]
    assert one(spark, "- ./src/auth/a.go\n- /x/auth\n- (../b)", S.file_paths_h) == ["./src/auth/a.go", "/x/auth", "../b"]


def test_caps_and_order(spark):
    rows = [(1, i, f"k{(i * 7) % 60}") for i in range(200)]
    merged = S.merge_first_seen(spark.createDataFrame(rows, "s int, at int, v string"), "s", "v", ["at"], 32).first()["values"]
    assert merged == [f"k{(i * 7) % 60}" for i in range(32)]


def engine(spark, messages):
    return ConversationEngine(spark, spark.createDataFrame(messages, "session_seq long, turn long, session_id string, agent_id string, role string, content string, created_at timestamp"), dim=16, as_of=NOW + timedelta(days=1))


@pytest.fixture(scope="module")
def loaded(spark):
    agents = ["alpha"] * 3 + ["beta"] * 2 + ["gamma"]
    files = ["src/api/a.go", "src/api/b.go", "src/db/c.go"] * 2
    return engine(spark, [(i + 1, 0, f"s{i}", a, "user", f"Work on ./{files[i]} now. Topic{i} matters", NOW) for i, a in enumerate(agents)])


def test_sessions_by_agent_and_file(loaded):
    assert [loaded.list_sessions(agent_id=a).count() for a in ("alpha", "beta", "gamma")] == [3, 2, 1]
    assert S.find_by_file(loaded.sessions, "api").count() == 4 and S.find_by_file(loaded.sessions, "db").count() == 2
    s = S.session_stats(loaded.sessions).first()
    assert (s.total_sessions, s.unique_agents) == (6, 3)


def test_rpc(loaded):
    call = lambda **r: json.loads(loaded.rpc(json.dumps({"jsonrpc": "2.0", "id": 1} | r)))
    assert json.loads(loaded.rpc("{bad"))["error"]["code"] == -32700
    assert json.loads(loaded.rpc('{"method":"query"}'))["error"]["code"] == -32600
    assert call(method="nope")["error"]["code"] == -32601
    assert call(method="drill_down", params={"bogus": 1})["error"]["code"] == -32602
    assert call(method="get_session", params={"session_id": "none"})["error"]["code"] == -32000
    found = call(method="query", params={"query": "topic3 matters", "level": "statement", "max_results": 3})["result"]
    assert 0 < len(found) <= 3 and all(r["level_name"] == "statement" for r in found)
    assert [r["level"] for r in call(method="zoom_out", params={"id": found[0]["node_id"]})["result"]] == [3, 2, 1, 0]
    assert len(call(method="list_sessions")["result"]) == 6
    assert "loomtree_requests" in loaded.metrics() and loaded.health()["errors"] >= 4
    assert call_tool(loaded, "memory_query", {"query": "topic1", "max_results": 2}).startswith("[")
    assert call_tool(loaded, "memory_list_sessions", {"agent_id": "gamma"}).startswith("s5 (agent gamma)")


def test_rest(loaded):
    from loomtree.plans.rest import handle

    assert handle(loaded, "GET", "/health")[0] == 200 and "loomtree_nodes" in handle(loaded, "GET", "/metrics")[1]
    status, body = handle(loaded, "GET", "/nodes/1")
    assert status == 200 and json.loads(body)["level"] == 3
    assert handle(loaded, "GET", "/nodes/9999")[0] == 404 and handle(loaded, "GET", "/sessions/none")[0] == 404
    assert json.loads(handle(loaded, "GET", "/sessions/s1")[1])[0]["session_id"] == "s1"
    assert handle(loaded, "POST", "/query", "{bad")[0] == 400 and handle(loaded, "PUT", "/query")[0] == 404
    assert len(json.loads(handle(loaded, "POST", "/drill_down", '{"id": 1}')[1])) == 1
    assert loaded.timings["run_us"] > 0


def test_store(spark):
    e = engine(spark, [(1, 0, "s", "a", "user", "First message.", NOW)])
    made = e.store("a", "s", "Second one. With two", "assistant").orderBy("node_id").collect()
    assert [r.level for r in made] == [2, 1, 0, 0] and made[0].node_id == 5
    e.store("b", "t", "New session")
    assert e.list_sessions().count() == 2
    assert e.store_block(2, "a block").collect()[0].level == 1
    assert e.store_statement(3, "a statement").collect()[0].parent_id == 3


def test_stored_messages_are_as_if_ingested_at_once(spark, monkeypatch):
    """Message by message in order, with rows folded in between, nodes and searches equal those of one ingest."""
    monkeypatch.setattr(ConversationEngine, "PENDING", 20)
    rows = [(1 + i // 3, i % 3, f"s{i // 3}", "a", "user", f"Topic{i} matters. It moved the parser.", NOW) for i in range(6)]
    e, whole = engine(spark, rows[:2]), engine(spark, rows)
    for r in rows[2:]:
        e.store(r[3], r[2], r[5], r[4], r[6])
    columns = ["node_id", "parent_id", "level", "level_name", "session_id", "agent_id", "role", "content", "sequence_num"]
    plain = lambda x: sorted(map(tuple, x.nodes.select(columns).collect()))
    assert plain(e) == plain(whole)
    ask = lambda x: [(r.node_id, round(r.combined_score, 9)) for r in x.query("topic4 parser", k=4).collect()]
    assert ask(e) == ask(whole)
    assert [tuple(r) for r in e.list_sessions().select("session_id", "message_count", "keywords").collect()] == [tuple(r) for r in whole.list_sessions().select("session_id", "message_count", "keywords").collect()]
    made = e.store_statement(3, "added later").first()
    assert e.get_node(made.node_id).first().level_name == "statement" and e.query("added later", k=1).first().node_id == made.node_id


def test_store_files(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "session_id string, title string, sequence_num long")
    s.append("sessions", rows(("a", "one", 1), ("b", "two", 2)))
    s.append("sessions", rows(("a", "new", 3)))
    s.append("sessions", rows(("b", None, 4)), deleted=True)
    assert [(r.session_id, r.title) for r in s.read("sessions").collect()] == [("a", "new")]
    s.compact("sessions")
    assert s.version("sessions") == 1 and s.log("sessions").count() == 1 and s.snapshot("sessions", 0).count() == 4
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"session_id": "q"}\n{broken\n')
    assert read_json_records(spark, str(tmp_path / "j"), "session_id string").count() == 1


def test_log(spark):
    rows = [(i + 1, "NODE_INSERT", NOW, json.dumps({"id": i, "agent": f"agent-{i % 10}"})) for i in range(100)]
    log = wal.entries(spark.createDataFrame(rows, "sequence long, op string, ts timestamp, payload string"))
    assert wal.replay(log).count() == 100 and wal.replay(log, 90).count() == 10
    cut = log.withColumn("payload", F.when(F.col("sequence") == 60, F.left("payload", F.lit(4))).otherwise(F.col("payload")))
    assert wal.replay(cut).count() == 59
    assert wal.needs_checkpoint(log, 10) and not wal.needs_checkpoint(log, 10**9)


def test_event_stream(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2, "s", "a"), (2, 1, "s", "a")], "node_id long, level int, session_id string, agent_id string")
    folder = str(tmp_path / "events")
    X.write(X.with_trace(X.stored(nodes), "t1"), folder)
    X.write(X.deleted(nodes), folder)
    back = X.read(spark, folder)
    assert back.count() == 4 and back.filter("trace_id = 't1'").count() == 2
    got = []
    emitter = X.Emitter(X.read_stream(spark, folder), str(tmp_path / "cp"))
    number = emitter.subscribe(lambda batch, epoch: got.append(batch.count()))
    emitter.start().awaitTermination()
    assert sum(got) == 4
    emitter.unsubscribe(number)
    assert not emitter.subscribers
    counts = {r.type: r.n for r in X.run_to_table(X.count_by_type(X.read_stream(spark, folder)), "counts").collect()}
    assert counts == {"memory_stored": 2, "memory_deleted": 2}
    X.index_stream(spark.readStream.schema("node_id long, content string").json(_texts(tmp_path)), str(tmp_path / "p"), str(tmp_path / "cp2")).awaitTermination()
    assert {r.token for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"hello", "world"}


def _texts(tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"node_id": 1, "content": "hello world"}\n')
    return str(tmp_path / "t")


def test_streaming_windows_match_batch(spark, tmp_path):
    rows = [(str(i), ["a", "b"][i % 2], i % 3, NOW + timedelta(minutes=11 * i)) for i in range(60)]
    e = spark.createDataFrame(rows, "id string, type string, user_id long, timestamp timestamp")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    for i, f in enumerate((X.tumbling, X.sliding)):
        assert sorted(map(tuple, X.run_to_table(f(stream), f"w{i}").collect())) == sorted(map(tuple, f(e).collect()))
    assert X.run_to_table(X.once(stream.union(stream)), "dd", "append").count() == 60
