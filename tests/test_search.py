from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from loomtree.functions import embedders, text, vectors, wordpiece
from loomtree.operators import fulltext, knn, ranking
from loomtree.profile import E, H
from pyspark.sql import functions as F

NOW = datetime(2024, 2, 1)


def index(spark, docs):
    return fulltext.build_postings(spark.createDataFrame(list(docs.items()), "node_id long, content string"))


def asked(spark, query):
    return spark.createDataFrame([(0, query)], "query_id int, query string")


def ids(df):
    return sorted(r.node_id for r in df.collect())


DOCS = {1: "hello world test", 2: "hello everyone test", 3: "goodbye world test"}


def test_tokens(spark):
    rows = ["hello world", "Hello, World!", "test_function", "a b c", "CamelCase", "", "été à"]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.index_tokens_h(F.col("t"))).collect()]
    assert found == [["hello", "world"], ["hello", "world"], ["test_function"], [], ["camelcase"], [], ["été", "à"]]


def test_boolean(spark):
    p = index(spark, DOCS)
    assert ids(fulltext.search_and(p, asked(spark, "hello world"))) == [1]
    assert ids(fulltext.search_and(p, asked(spark, "test"))) == [1, 2, 3]
    assert ids(fulltext.search_and(p, asked(spark, "foo bar"))) == []
    assert ids(fulltext.search_or(p, asked(spark, "everyone goodbye"))) == [2, 3]
    assert fulltext.contains_any(p, asked(spark, "hello world")).first().found


def test_bm25(spark):
    p = index(spark, {1: "alpha", 2: "alpha hello world"})
    best = fulltext.bm25_top(p, fulltext.doc_stats(p), asked(spark, "alpha hello"), 5).orderBy("rank").collect()
    assert [r.node_id for r in best] == [2, 1] and best[0].score == 1.0
    p = index(spark, {1: "word", 2: "word word word word"})
    scores = {r.node_id: r.score for r in fulltext.bm25_scores(p, fulltext.doc_stats(p), asked(spark, "word")).collect()}
    assert scores[2] != scores[1] and len(scores) == 2
    twice = {r.node_id: r.score for r in fulltext.bm25_scores(p, fulltext.doc_stats(p), asked(spark, "word word")).collect()}
    assert twice[1] == pytest.approx(2 * scores[1])


def test_replace_and_remove(spark):
    p = index(spark, {1: "hello world"})
    new = fulltext.replace_documents(p, spark.createDataFrame([(1, "goodbye everyone")], "node_id long, content string"))
    assert ids(fulltext.search_or(new, asked(spark, "hello"))) == [] and ids(fulltext.search_or(new, asked(spark, "goodbye"))) == [1]
    same = fulltext.replace_documents(p, spark.createDataFrame([(1, "a")], "node_id long, content string"))
    assert ids(fulltext.search_or(same, asked(spark, "hello"))) == [1]
    with pytest.raises(ValueError):
        fulltext.replace_documents(p, spark.createDataFrame([(1, "again here")], "node_id long, content string"), profile="E")
    p = index(spark, {1: "word", 2: "word"})
    assert ids(fulltext.remove_documents(p, spark.createDataFrame([(1,)], "node_id long"))) == [2]


def vec(*x):
    return [float(v) for v in x]


def test_vector_functions(spark):
    row = spark.createDataFrame([(vec(0, 0, 0), vec(3, 4, 0), vec(1, 2))], "a array<float>, b array<float>, c array<float>")
    d = row.select(vectors.l2(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("c")), vectors.cosine(F.col("a"), F.col("b")), vectors.norm(vectors.normalize(F.col("b"))), vectors.norm(vectors.normalize(F.col("a")))).first()
    assert [d[0], d[1], d[2], round(d[3], 9), d[4]] == [5.0, 1e10, 0.0, 1.0, 0.0]


def random_vectors(n, dim=32, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_knn_matches_brute_force(spark):
    x = random_vectors(200)
    e = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "node_id long, level int, embedding array<float>").repartition(5)
    first = knn.knn(e, x[42].tolist(), 5).collect()
    assert first[0].node_id == 42 and first[0].distance < 1e-6
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 200, 50)], "query_id int, embedding array<float>")
    got = {}
    for r in knn.knn_many(e, queries, 7).collect():
        got.setdefault(r.query_id, set()).add(r.node_id)
    for q, found in got.items():
        d = np.linalg.norm(x.astype(float) - x[q].astype(float), axis=1)
        assert found == set(np.argsort(d, kind="stable")[:7].tolist())
    assert knn.knn_many(e, queries, 7, per_level=True).groupBy("query_id", "level").count().filter("count <> 7").count() == 0
    hits = knn.knn_levels(e, x[1].tolist(), 10, 0, 2).collect()
    assert len(hits) == 10 and hits[0].node_id == 1


def test_knn_ties_and_odd_lengths(spark):
    e = spark.createDataFrame([(i, 0, vec(1, 0)) for i in range(50)] + [(99, 0, vec(1, 0, 0))], "node_id long, level int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(0, vec(1, 0))], "query_id int, embedding array<float>")
    assert ids(knn.knn_many(e, q, 5)) == [0, 1, 2, 3, 4]
    assert ids(knn.knn_many(e, q, 5, "inner")) == [0, 1, 2, 3, 4]


def test_pooling(spark):
    rows = spark.createDataFrame([(1, vec(1, 0, 0)), (1, vec(0, 1, 0)), (2, vec(0, 0, 0))], "k int, embedding array<float>")
    got = {r.k: r.embedding for r in knn.pool(rows, "k").collect()}
    assert got[1] == pytest.approx([0.70710678, 0.70710678, 0]) and got[2] == [0, 0, 0]


def test_stub_embedders():
    assert not embedders.stub_h("").any()
    v = embedders.stub_h("text")
    assert v.shape == (384,) and np.linalg.norm(v) == pytest.approx(1, abs=1e-5)
    h = 14695981039346656037
    for b in (1, 0, *b"text"):
        h = ((h ^ b) * 1099511628211) % 2**64
    hi = h >> 32
    hi = hi - 2**32 if hi >= 2**31 else hi
    ratio = v[1] / v[0]
    h0 = 14695981039346656037
    for b in (0, 0, *b"text"):
        h0 = ((h0 ^ b) * 1099511628211) % 2**64
    h0 = h0 >> 32
    h0 = h0 - 2**32 if h0 >= 2**31 else h0
    assert ratio == pytest.approx(hi / h0, rel=1e-4)


def test_wordpiece():
    v = {"un": 5, "##aff": 6, "##able": 7, "!": 8}
    assert wordpiece.encode("Unaffable!", v) == [101, 5, 6, 7, 8, 102]
    assert wordpiece.encode("xyz", v) == [101, 100, 102]
    assert wordpiece.encode("ab", {}) == [101, 100, 100, 102]
    assert len(wordpiece.encode("un " * 900, v, 64)) == 64


def budget(spark, levels, most):
    rows = [(i, level, 1.0 - i / 1000, "") for i, level in enumerate(levels)]
    df = spark.createDataFrame(rows, "node_id long, level int, combined_score double, content string")
    return ranking.within_budget(df, most, ranking.level_cost(F.col("level"), E)).count()


@pytest.mark.parametrize(("levels", "most", "n"), [([0] * 100, 150, 3), ([0] * 100, 1000, 20), ([0] * 100, 0, 0), ([0, 1, 2, 3], 250, 2), ([0, 1, 2, 3], 750, 3), ([0, 1, 2, 3], 1750, 4), ([0, 1, 2, 3], 49, 0)])
def test_budgets_by_level(spark, levels, most, n):
    assert budget(spark, levels, most) == n


def small_index(spark):
    x = random_vectors(30, seed=3)
    rows = [(i, i % 4, "common words here" if i % 2 else "other words there", f"a{i % 2}", "s", NOW - timedelta(hours=i)) for i in range(30)]
    nodes = spark.createDataFrame(rows, "node_id long, level int, content string, agent_id string, session_id string, created_at timestamp")
    e = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "node_id long, level int, embedding array<float>")
    return ranking.HybridIndex(nodes, fulltext.build_postings(nodes), e), x


def test_search(spark):
    ix, x = small_index(spark)
    got = ix.search(x[4].tolist(), ranking.SearchOptions(query="other", k=5), NOW).collect()
    scores = [r.combined_score for r in got]
    assert len(got) == 5 and scores == sorted(scores, reverse=True) and 4 in [r.node_id for r in got]
    e = ix.search(x[4].tolist(), ranking.SearchOptions(query="other", k=500), NOW, E)
    assert e.count() <= 100
    only = ix.search(x[4].tolist(), ranking.SearchOptions(query="other", k=5, agent_id="a1", prefilter=True), NOW).collect()
    assert len(only) == 5 and all(r.agent_id == "a1" for r in only)
    results, summary = ix.search_with_response(x[4].tolist(), ranking.SearchOptions(query="other", k=0, max_tokens=20), NOW)
    s = summary.first()
    assert s.returned == results.count() == 4 and s.truncated and s.tokens_used <= 20


def test_recency_prefers_new(spark):
    rows = [(1, 0, 0.995, 0.0, NOW - timedelta(days=30), "x"), (2, 0, 0.995, 0.0, NOW, "x")]
    df = spark.createDataFrame(rows, "node_id long, level int, semantic double, exact double, created_at timestamp, content string")
    for p in (H, E):
        assert ranking.score(df, F.lit(NOW), p).orderBy(F.desc("combined_score")).first().node_id == 2


def test_level_rules():
    o = ranking.SearchOptions(top_level="block", bottom_level=0).resolved()
    assert (o.top_level, o.bottom_level) == (1, 0)
    assert ranking.SearchOptions(top_level=0, bottom_level=0).resolved().top_level == 0
    assert ranking.SearchOptions(top_level=0, bottom_level=0, zero_range_is_all=True).resolved().top_level == 3
    assert ranking.SearchOptions(k=0).resolved().k == 10 and ranking.SearchOptions(k=900).resolved(E).k == 100


def test_stub_query_reads_whole_texts(spark, tmp_path):
    """Texts that share their first 64 characters get different vectors, of the full dimension."""
    from loomtree.plans import search_queries

    texts = ["a" * 64 + end for end in (" goes north", " stays south")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.i): r.x for r in search_queries.stub_embed_h(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert [got[i, k] for k in range(384)] == pytest.approx(embedders.stub_h(t).tolist(), abs=6e-6)
    assert [got[0, k] for k in range(384)] != [got[1, k] for k in range(384)]


def test_stub_query_rounds_once(spark, tmp_path):
    """Values that 32-bit floats carry over the middle of two results are rounded as doubles, as in the SQL."""
    import duckdb

    from loomtree.plans import catalog, search_queries

    texts = {61: "text 61", 131: "text 131", 1365: "text 1365", 2: "", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.i): r.x for r in search_queries.stub_embed_e(spark, str(tmp_path)).collect()}
    assert (got[61, 4], got[131, 53], got[1365, 160]) == (0.0709, -0.0130, -0.0460)
    assert embedders.stub_e("text 61").dtype == np.float32
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {(d, i): x for d, i, x in db.sql(catalog.oracle_sql()["stub_embed_e"]).fetchall()}
