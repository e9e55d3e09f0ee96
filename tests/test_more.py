"""Late appends, blocked searches, ranges of ingest, the stored index, and operators that have no query of their own."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from loomtree.functions import embedders, wordpiece
from loomtree.operators import fulltext, knn, sessions
from loomtree.plans import ingest
from loomtree.sources import index
from loomtree.sources.storage import Store
from pyspark.sql import functions as F


def test_rows_appended_during_compaction_stay(spark, tmp_path):
    """They went to the old version; they are read beside the new one, and by the next compaction."""
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "session_id string, title string, sequence_num long")
    s.append("sessions", rows(("a", "one", 1), ("b", "two", 2)))
    s.compact("sessions")
    s.append("sessions", rows(("c", "late", 3), ("a", "late", 4)), version=0)
    s.append("sessions", rows(("b", None, 5)), deleted=True)
    want = [("a", "late"), ("c", "late")]
    assert sorted((r.session_id, r.title) for r in s.read("sessions").collect()) == want
    s.compact("sessions")
    assert s.version("sessions") == 2 and s.log("sessions").count() == 2
    assert sorted((r.session_id, r.title) for r in s.read("sessions").collect()) == want


def test_late_rows_of_partitioned_tables(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "node_id long, level int, content string, sequence_num long")
    s.append("nodes", rows((1, 0, "a", 1), (2, 3, "b", 2)))
    s.compact("nodes")
    s.append("nodes", rows((1, 0, "new", 3), (4, 2, "c", 4)), version=0)
    assert sorted((r.node_id, r.level, r.content) for r in s.read("nodes").collect()) == [(1, 0, "new"), (2, 3, "b"), (4, 2, "c")]


def test_many_queries_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELLS", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, level int, embedding array<double>")
    queries = rows.filter("node_id < 9").select(F.col("node_id").alias("query_id"), "embedding")
    got = {}
    for r in knn.knn_many(rows, queries, 4).collect():
        got.setdefault(r.query_id, set()).add(r.node_id)
    for q in range(9):
        assert got[q] == set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:4].tolist())


def test_ranges_do_not_change_ids(spark):
    rows = [(s, t, f"s{s}", "a", "user", f"Message {t}. It has two.\n\n- list\n- more", datetime(2024, 1, 1)) for s in range(40) for t in range(1 + s % 3)]
    messages = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(ingest.MESSAGE_COLUMNS, ("long", "long", "string", "string", "string", "string", "timestamp"), strict=True)))
    trees = [sorted(map(tuple, ingest.build_nodes(messages, n).select("node_id", "parent_id", "session_id", "content", "sequence_num").collect())) for n in (None, 1, 7, 300)]
    assert trees[0] == trees[1] == trees[2] == trees[3] and [r[0] for r in trees[0]] == list(range(1, len(trees[0]) + 1))


def test_places_among_cuts(spark):
    cuts = [0, 1, 5, 9, 12, 40, 41, 77]
    got = spark.range(-2, 90).select("id", ingest._range_of(F.col("id"), cuts).alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) for r in got)


def test_stored_index(spark, tmp_path):
    """Built once, and again when the files change; equal to postings made at once."""
    made = []

    def docs():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "d"))

    def plain(df):
        return sorted(map(tuple, df.select("token", "node_id", "tf", "first_pos").collect()))

    for n in (5, 9):
        spark.createDataFrame([(i, f"alpha beta{i} gamma gamma") for i in range(n)], "node_id long, content string").write.mode("overwrite").parquet(str(tmp_path / "d"))
        for _ in range(2):
            postings, lengths = index.stored(spark, str(tmp_path / "d"), docs, f"test-{n}")
            assert plain(postings) == plain(fulltext.build_postings(spark.read.parquet(str(tmp_path / "d"))))
            assert {r.doc_len for r in lengths.collect()} == {4} and lengths.count() == n
    assert len(made) == 2


def test_vectors_put_removed_and_found(spark):
    old = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0]), (2, 1, [3.0])], "node_id long, level int, embedding array<double>")
    new = spark.createDataFrame([(2, 0, [9.0]), (5, 2, [5.0])], old.schema)
    both = knn.put(old, new)
    assert sorted(map(tuple, both.collect())) == [(1, 0, [1.0]), (2, 0, [9.0]), (2, 1, [3.0]), (5, 2, [5.0])]
    left = knn.remove(both, new.filter("node_id = 2"))
    assert sorted(r.node_id for r in left.collect()) == [1, 5] and knn.contains(left, 5) and not knn.contains(left, 2)


def test_sessions_updated_touched_and_deleted(spark):
    schema = "session_id string, title string, last_active_at timestamp, message_count long, block_count long, statement_count long"
    rows = spark.createDataFrame([("a", None, datetime(2024, 1, 1), 1, 1, 1), ("b", "t", None, 2, 2, 2)], schema)
    named = sessions.update_session(rows, "a", title="new")
    assert {r.session_id: r.title for r in named.collect()} == {"a": "new", "b": "t"}
    activity = spark.createDataFrame([("a", datetime(2024, 1, 3), 1, 2, 3), ("a", datetime(2024, 1, 2), 1, 0, 0), ("zz", datetime(2024, 1, 2), 9, 9, 9)], "session_id string, at timestamp, messages long, blocks long, statements long")
    got = {r.session_id: r for r in sessions.touch(rows, activity).collect()}
    assert got["a"].last_active_at == datetime(2024, 1, 3) and (got["a"].message_count, got["a"].block_count, got["a"].statement_count) == (3, 3, 4)
    assert len(got) == 2 and got["b"].message_count == 2
    assert [r.session_id for r in sessions.delete_sessions(rows, activity).collect()] == ["b"]


def test_word_pieces_in_a_column(spark, tmp_path):
    words = ["[PAD]", *(f"[unused{i}]" for i in range(99)), "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "now", "!"]
    (tmp_path / "vocab.txt").write_text("\n".join(words))
    vocabulary = wordpiece.load_vocabulary(str(tmp_path / "vocab.txt"))
    rows = spark.createDataFrame([(1, "Playing now!"), (2, None), (3, "zzz")], "id int, text string")
    got = {r.id: r.e for r in rows.select("id", wordpiece.encoded(F.col("text"), vocabulary, 8).alias("e")).collect()}
    assert got[1].input_ids == [wordpiece.CLS, 103, 104, 105, 106, wordpiece.SEP, 0, 0] and got[1].attention_mask == [1] * 6 + [0] * 2
    assert got[2].input_ids[:2] == [wordpiece.CLS, wordpiece.SEP] and got[2].length == 2
    assert got[3].input_ids[1] == wordpiece.UNK


def test_embedders_in_batches_and_models_that_fail(spark):
    """A broken model gives stub vectors; what there is says so."""
    model = embedders.OnnxSentenceModel("/nowhere/model.onnx", {}, dim=16)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "id int, text string")
    got = rows.select("text", embedders.embed(F.col("text"), model, 16, batch=8).alias("v")).collect()
    assert all(np.allclose(r.v, embedders.stub_e(r.text, 16)) for r in got)
    assert not embedders.capabilities("/nowhere/model.onnx")["onnx"]["available"] and embedders.capabilities()["stub_h"]["available"]
