"""Queries on the keyword index, vectors and hybrid ranking: documents and embeddings with doc_id = vec_id, level = id % 4."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import embedders, vectors
from ..operators import fulltext, knn, ranking
from ..profile import DIM, E, H
from ..sources import index
from . import sql
from .registry import query, table

AS_OF = datetime(2024, 2, 1)
Q = "the of the tion and stion"
P = f"WITH {sql.POSTINGS}, "


def docs(spark, sf):
    """Documents as nodes."""
    created = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(700)) * 3600)
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("node_id"), (F.col("doc_id") % 4).cast("int").alias("level"), F.coalesce("text", F.lit("")).alias("content"),
        F.concat(F.lit("agent-"), F.col("doc_id") % 3).alias("agent_id"), F.coalesce("source", F.lit("")).alias("session_id"), created.alias("created_at"),
    )


def vecs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), (F.col("vec_id") % 4).cast("int").alias("level"), "embedding")


def index_of(spark, sf):
    """postings and lengths, kept on disk, as an index is."""
    return index.stored(spark, f"{sf}/documents.parquet", lambda: docs(spark, sf))


def postings_of(spark, sf):
    return index_of(spark, sf)[0]


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def query_vector(spark, sf, vec_id=3):
    return table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


@query(P + "x AS (SELECT 1) SELECT token, node_id, tf FROM postings")
def postings(spark, sf):
    return postings_of(spark, sf).select("token", "node_id", F.col("tf").cast("long").alias("tf"))


@query(P + "x AS (SELECT 1) SELECT (SELECT count(DISTINCT token) FROM postings) AS unique_tokens, n_docs AS indexed_nodes, round(avg_len, 6) AS avg_doc_length FROM corpus")
def vocab_stats(spark, sf):
    return fulltext.index_stats(postings_of(spark, sf)).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query(P + "x AS (SELECT 1) SELECT token, sum(tf)::BIGINT AS tf, count(*) AS df FROM postings GROUP BY token")
def vocabulary(spark, sf):
    return fulltext.vocabulary(postings_of(spark, sf))


@query(P + sql.bm25("the of was") + " SELECT node_id FROM postings WHERE token IN (SELECT token FROM (SELECT unnest(['tion', 'ing']) AS token)) GROUP BY node_id HAVING count(*) = 2")
def bool_and(spark, sf):
    return fulltext.search_and(postings_of(spark, sf), asked(spark, "tion the ing")).select("node_id")


@query(P + "x AS (SELECT 1) SELECT DISTINCT node_id FROM postings WHERE token IN ('tion', 'ing')")
def bool_or(spark, sf):
    return fulltext.search_or(postings_of(spark, sf), asked(spark, "tion the ing")).select("node_id")


@query(P + "x AS (SELECT 1) SELECT 0 AS query_id, EXISTS (SELECT 1 FROM postings WHERE token IN ('tion', 'ing') GROUP BY node_id HAVING count(*) = 2) AS found UNION ALL SELECT 1, false")
def contains_any(spark, sf):
    return fulltext.contains_any(postings_of(spark, sf), asked(spark, "tion ing", "tion qqqqqq"))


_QT = "tion stion tion erne"


@query(P + sql.bm25(_QT) + " SELECT node_id, round(score / (SELECT max(score) FROM scores), 6) AS score FROM scores ORDER BY score DESC, node_id LIMIT 10")
def bm25_topk(spark, sf):
    p, lengths = index_of(spark, sf)
    return fulltext.bm25_top(p, lengths, asked(spark, _QT), 10).select("node_id", F.round("score", 6).alias("score"))


@query(P + sql.bm25("tion st", all_tokens=True) + " SELECT node_id, round(score, 6) AS score FROM scores ORDER BY score DESC, node_id LIMIT 10")
def bm25_and(spark, sf):
    p, lengths = index_of(spark, sf)
    return fulltext.bm25_top(p, lengths, asked(spark, "tion st"), 10, normalise=False, all_tokens=True).select("node_id", F.round("score", 6).alias("score"))


@query(P + sql.bm25(_QT) + " SELECT node_id, round(score, 6) AS score FROM scores")
def bm25_unnormalised(spark, sf):
    p, lengths = index_of(spark, sf)
    return fulltext.bm25_scores(p, lengths, asked(spark, _QT)).select("node_id", F.round("score", 6).alias("score"))


_MANY = ("tion st", "ing", "ed re", "la de", "der ung")
_MANY_SQL = "\nUNION ALL\n".join(f"SELECT {i} AS query_id, node_id, rank FROM (WITH {sql.bm25(t, 'sc')} SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM sc) WHERE rank <= 5" for i, t in enumerate(_MANY))


@query(f"WITH {sql.POSTINGS} {_MANY_SQL}")
def bm25_many_queries(spark, sf):
    p, lengths = index_of(spark, sf)
    return fulltext.bm25_top(p, lengths, asked(spark, *_MANY), 5).select("query_id", "node_id", F.col("rank").cast("long").alias("rank"))


@query(P + "x AS (SELECT 1) SELECT token, node_id, tf FROM postings WHERE node_id % 10 <> 3")
def remove_documents(spark, sf):
    gone = docs(spark, sf).filter("node_id % 10 = 3").select("node_id")
    return fulltext.remove_documents(postings_of(spark, sf), gone).select("token", "node_id", F.col("tf").cast("long").alias("tf"))


# Vectors.

_V = "v AS (SELECT vec_id AS node_id, (vec_id % 4)::INT AS level, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE node_id = 3)"
_DIST = "list_distance(e, qe)"


@query(f"WITH {_V} SELECT node_id, round(list_cosine_similarity(e, qe), 6) AS cosine FROM v, q")
def cosine(spark, sf):
    return vecs(spark, sf).select("node_id", F.round(vectors.cosine(F.col("embedding"), vectors.literal(query_vector(spark, sf))), 6).alias("cosine"))


@query(f"WITH {_V} SELECT node_id, round({_DIST}, 6) AS distance, round(1 - list_inner_product(e, qe), 6) AS inner_distance FROM v, q")
def l2_distance(spark, sf):
    q = vectors.literal(query_vector(spark, sf))
    return vecs(spark, sf).select("node_id", F.round(vectors.l2(F.col("embedding"), q), 6).alias("distance"), F.round(vectors.inner_distance(F.col("embedding"), q), 6).alias("inner_distance"))


@query("SELECT vec_id AS node_id, round(1.0::DOUBLE, 6) AS norm, true AS unit FROM embeddings")
def normalize_norm(spark, sf):
    n = vectors.norm(vectors.normalize(F.transform("embedding", lambda x: x * 3)))
    return vecs(spark, sf).select("node_id", F.round(n, 6).alias("norm"), (F.abs(n - 1) < 1e-9).alias("unit"))


@query("""WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
a AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM a GROUP BY label)
SELECT label, i - 1 AS i, round(m / n, 5) AS x FROM a JOIN n USING (label)""")
def mean_pool_by_label(spark, sf):
    rows = knn.pool(table(spark, sf, "embeddings").select("label", "embedding"), "label")
    return rows.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query(f"WITH {_V} SELECT node_id, round({_DIST}, 6) AS distance FROM v, q WHERE level = 1 ORDER BY {_DIST}, node_id LIMIT 10")
def knn_one_level(spark, sf):
    return knn.knn(vecs(spark, sf), query_vector(spark, sf), 10, 1).select("node_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V}, d AS (SELECT node_id, level, {_DIST} AS distance, row_number() OVER (PARTITION BY level ORDER BY {_DIST}, node_id) AS r FROM v, q WHERE level BETWEEN 0 AND 2) SELECT node_id, level, round(distance, 6) AS distance FROM d WHERE r <= 10 ORDER BY d.distance, node_id LIMIT 10")
def knn_multilevel(spark, sf):
    return knn.knn_levels(vecs(spark, sf), query_vector(spark, sf), 10, 0, 2).select("node_id", "level", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_V}, s AS (SELECT node_id AS query_id, e AS qq FROM v WHERE node_id % 50 = 0),
d AS (SELECT query_id, node_id, list_distance(e, qq) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(e, qq), 9), node_id) AS r FROM v, s)
SELECT query_id, node_id, round(distance, 5) AS distance FROM d WHERE r <= 5""")
def knn_many_queries(spark, sf):
    v = vecs(spark, sf)
    queries = v.filter("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    return knn.knn_many(v, queries, 5).select("query_id", "node_id", F.round("distance", 5).alias("distance"))


@query(f"WITH {_V} SELECT a.node_id AS a, b.node_id AS b, round(CASE WHEN a.level = b.level THEN list_cosine_similarity(a.e, b.e) ELSE 0 END, 6) AS similarity FROM v a JOIN v b ON b.node_id = a.node_id + a.node_id % 5")
def similarity_pairs(spark, sf):
    from ..operators import tree

    v = vecs(spark, sf)
    pairs = v.select(F.col("node_id").alias("a"), (F.col("node_id") + F.col("node_id") % 5).alias("b")).join(v.select(F.col("node_id").alias("b")), "b")
    return tree.similarity_to_parent_level(v.select("node_id", "level"), v, pairs.select("a", "b")).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT (vec_id % 4)::INT AS level, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_stats(spark, sf):
    return knn.index_stats(vecs(spark, sf))


_POOL = f"""WITH {sql.NODES}, v AS (SELECT n.parent_id, unnest(e.embedding::DOUBLE[]) AS x, generate_subscripts(e.embedding, 1) AS i FROM nodes n JOIN embeddings e ON e.vec_id = n.node_id WHERE n.parent_id IS NOT NULL),
a AS (SELECT parent_id, i, avg(x) AS m FROM v GROUP BY ALL), l AS (SELECT parent_id, sqrt(sum(m * m)) AS l FROM a GROUP BY ALL)
SELECT parent_id AS node_id, i - 1 AS i, round((m / l)::FLOAT::DOUBLE, 5) AS x FROM a JOIN l USING (parent_id)"""


@query(_POOL)
def pool_children(spark, sf):
    from .tree_queries import nodes_of

    pooled = knn.pool_children(nodes_of(spark, sf), vecs(spark, sf))
    rows = pooled.select("node_id", F.posexplode("embedding").alias("i", "x"))
    return rows.select("node_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


_UP_SQL = """{0}v AS (SELECT n.parent_id AS node_id, unnest(c.e) AS x, generate_subscripts(c.e, 1) AS i FROM {0}c c JOIN nodes n USING (node_id) WHERE n.parent_id IS NOT NULL),
{0}m AS (SELECT node_id, i, avg(x) AS m FROM {0}v GROUP BY ALL), {0}l AS (SELECT node_id, sqrt(sum(m * m)) AS l FROM {0}m GROUP BY ALL),
{1}c AS (SELECT node_id, list((m / l)::FLOAT::DOUBLE ORDER BY i) AS e FROM {0}m JOIN {0}l USING (node_id) GROUP BY node_id)"""


@query(f"""WITH {sql.NODES}, sc AS (SELECT e.vec_id AS node_id, e.embedding::DOUBLE[] AS e FROM embeddings e JOIN nodes n ON n.node_id = e.vec_id WHERE n.level = 0),
{_UP_SQL.format("s", "b")}, {_UP_SQL.format("b", "m")}, {_UP_SQL.format("m", "r")},
every AS (SELECT 0 AS level, * FROM sc UNION ALL SELECT 1, * FROM bc UNION ALL SELECT 2, * FROM mc UNION ALL SELECT 3, * FROM rc)
SELECT node_id, level, generate_subscripts(e, 1) - 1 AS i, round(unnest(e), 4) AS x FROM every""")
def pool_session(spark, sf):
    from .tree_queries import nodes_of

    nodes = nodes_of(spark, sf)
    statements = nodes.filter("level = 0").join(vecs(spark, sf).select("node_id", "embedding"), "node_id").select("node_id", "embedding")
    pooled = knn.pool_sessions(nodes.select("node_id", "parent_id"), statements)
    return pooled.select("node_id", "level", F.posexplode("embedding").alias("i", "x")).select("node_id", "level", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query()
def stub_embed_h(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", embedders.embed(F.coalesce("text", F.lit("")), "stub_h").alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def _steps(n: int) -> str:
    """i, and what i + 1 steps of h -> 1103515245 h + 12345 modulo 2**32 multiply by and add."""
    a, c, rows = 1, 0, []
    for i in range(n):
        a, c = a * 1103515245 % 2**32, (c * 1103515245 + 12345) % 2**32
        rows.append(f"({i}, {a}, {c})")
    return ", ".join(rows)


@query(f"""WITH h AS (SELECT doc_id, {sql.times_hash("coalesce(text, '')", 31, 0)} AS h FROM documents), steps(i, a, c) AS (VALUES {_steps(DIM)}),
x AS (SELECT doc_id, i, ((((h::UBIGINT * a::UBIGINT + c::UBIGINT) % 4294967296) & 2147483647) / 2147483647.0::DOUBLE) - 0.5 AS x FROM h, steps), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM x GROUP BY doc_id)
SELECT doc_id, i, round(x / n, 4) AS x FROM x JOIN n USING (doc_id)""")
def stub_embed_e(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", embedders.embed(F.coalesce("text", F.lit("")), "stub_e", element="double").alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("i", "x")).select("doc_id", F.col("i").cast("int").alias("i"), F.round("x", 4).alias("x"))


# Hybrid ranking.

K = 10
_N = "n AS (SELECT doc_id AS node_id, (doc_id % 4)::INT AS level, coalesce(text, '') AS content, 'agent-' || (doc_id % 3) AS agent_id, coalesce(source, '') AS session_id, 1704067200 + (doc_id % 700) * 3600 AS created FROM documents)"


def _hybrid_sql(n: int, low: int = 0, high: int = 3) -> str:
    """CTEs up to scored, profile H."""
    return f"""{sql.POSTINGS}, {sql.bm25(_QT)}, {_N},
v AS (SELECT vec_id AS node_id, (vec_id % 4)::INT AS level, embedding::DOUBLE[] AS e FROM embeddings), qv AS (SELECT e AS qe FROM v WHERE node_id = 3),
d0 AS (SELECT node_id, level, list_distance(e, qe) AS distance, row_number() OVER (PARTITION BY level ORDER BY list_distance(e, qe), node_id) AS r FROM v, qv WHERE level BETWEEN {low} AND {high}),
d AS (SELECT node_id, greatest(0, 1 - distance) AS semantic FROM d0 WHERE r <= {n} ORDER BY distance, node_id LIMIT {n}),
k AS (SELECT node_id, score / (SELECT max(score) FROM scores) AS exact FROM scores ORDER BY score DESC, node_id LIMIT {n}),
c AS (SELECT node_id, coalesce(semantic, 0) AS semantic, coalesce(exact, 0) AS exact FROM d FULL OUTER JOIN k USING (node_id)),
scored AS (SELECT n.*, semantic, exact, CASE WHEN semantic > 0 AND exact > 0 THEN 0.7 * semantic + 0.3 * exact WHEN semantic > 0 THEN semantic ELSE exact END AS relevance,
  1 / (1 + (1706745600 - created) / 86400.0::DOUBLE) AS recency, [1.0, 0.6, 0.3, 0.0][level + 1]::DOUBLE AS boost, (strlen(content) + 3) // 4 AS tokens FROM c JOIN n USING (node_id) WHERE level BETWEEN {low} AND {high}),
ranked AS (SELECT *, 0.6 * relevance + 0.3 * recency + 0.1 * boost AS combined FROM scored)"""


_OUT = "node_id, round(relevance, 6) AS relevance, round(recency, 6) AS recency, round(combined, 6) AS combined"


def _shown(df):
    return df.select("node_id", F.round("relevance_score", 6).alias("relevance"), F.round("recency_score", 6).alias("recency"), F.round("combined_score", 6).alias("combined"))


def _index(spark, sf):
    p, lengths = index_of(spark, sf)
    return ranking.HybridIndex(docs(spark, sf), p, vecs(spark, sf), lengths)


@query(f"WITH {_hybrid_sql(2 * K)} SELECT {_OUT} FROM ranked ORDER BY ranked.combined DESC, node_id LIMIT {K}")
def hybrid_h(spark, sf):
    return _shown(_index(spark, sf).search(query_vector(spark, sf), ranking.SearchOptions(query=_QT, k=K), AS_OF))


@query(f"WITH {_hybrid_sql(2 * K, 0, 2)} SELECT {_OUT} FROM ranked WHERE agent_id = 'agent-1' AND created >= 1704067200 + 86400 ORDER BY ranked.combined DESC, node_id LIMIT {K}")
def hybrid_h_filtered(spark, sf):
    options = ranking.SearchOptions(query=_QT, k=K, top_level="message", bottom_level="statement", agent_id="agent-1", after=datetime(2024, 1, 2))
    return _shown(_index(spark, sf).search(query_vector(spark, sf), options, AS_OF))


@query(f"""WITH {_hybrid_sql(4 * K)}, wide AS (SELECT * FROM ranked ORDER BY combined DESC, node_id LIMIT {2 * K}), cut AS (SELECT * FROM wide ORDER BY combined DESC, node_id LIMIT {K}),
b AS (SELECT *, sum(tokens) OVER (ORDER BY combined DESC, node_id ROWS UNBOUNDED PRECEDING) AS used FROM cut)
SELECT (SELECT count(*) FROM wide) AS total, count(*) AS returned, coalesce(sum(tokens), 0)::BIGINT AS tokens_used, count(*) < (SELECT count(*) FROM wide) AS truncated FROM b WHERE used <= 2000""")
def hybrid_response(spark, sf):
    _, summary = _index(spark, sf).search_with_response(query_vector(spark, sf), ranking.SearchOptions(query=_QT, k=K, max_tokens=2000), AS_OF)
    return summary.select("total", "returned", F.col("tokens_used").cast("long").alias("tokens_used"), "truncated")


@query(f"""WITH {_hybrid_sql(2 * K)}, cut AS (SELECT * FROM ranked ORDER BY combined DESC, node_id LIMIT {K}),
b AS (SELECT *, sum(tokens) OVER (ORDER BY combined DESC, node_id ROWS UNBOUNDED PRECEDING) AS used FROM cut) SELECT node_id, used::BIGINT AS used FROM b WHERE used <= 1500""")
def budget_bytes(spark, sf):
    found = _index(spark, sf).search(query_vector(spark, sf), ranking.SearchOptions(query=_QT, k=K, max_tokens=1500), AS_OF)
    return found.select("node_id", F.col("tokens_used").cast("long").alias("used"))


_E_SQL = f"""WITH {sql.POSTINGS}, {sql.bm25(_QT)}, {_N},
v AS (SELECT vec_id AS node_id, (vec_id % 4)::INT AS level, embedding::DOUBLE[] AS e FROM embeddings), qv AS (SELECT e AS qe FROM v WHERE node_id = 3),
d0 AS (SELECT node_id, list_inner_product(e, qe) AS semantic, row_number() OVER (PARTITION BY level ORDER BY list_inner_product(e, qe) DESC, node_id) AS r FROM v, qv),
k0 AS (SELECT node_id, score FROM scores ORDER BY score DESC, node_id LIMIT 100),
c0 AS (SELECT node_id, max(semantic) AS semantic, max(exact) AS exact FROM (SELECT node_id, semantic, 0.0::DOUBLE AS exact FROM d0 WHERE r <= 100 UNION ALL SELECT node_id, 0.0::DOUBLE, score FROM k0) GROUP BY node_id),
scored AS (SELECT n.*, 0.7 * semantic + 0.3 * (exact / (SELECT max(exact) FROM c0)) AS relevance, exp(-0.693 * (1706745600 - created) / 3600.0::DOUBLE) AS recency, [0.7, 0.8, 0.9, 1.0][level + 1]::DOUBLE AS boost FROM c0 JOIN n USING (node_id)),
ranked AS (SELECT *, 0.6 * relevance + 0.3 * recency + 0.1 * boost AS combined, [50, 200, 500, 1000][level + 1] AS cost FROM scored)"""


@query(_E_SQL + f" SELECT {_OUT} FROM ranked ORDER BY ranked.combined DESC, node_id LIMIT {K}")
def hybrid_e(spark, sf):
    return _shown(_index(spark, sf).search(query_vector(spark, sf), ranking.SearchOptions(query=_QT, k=K), AS_OF, E))


@query(_E_SQL + f""", cut AS (SELECT * FROM ranked ORDER BY combined DESC, node_id LIMIT {K}), b AS (SELECT *, sum(cost) OVER (ORDER BY combined DESC, node_id ROWS UNBOUNDED PRECEDING) AS used FROM cut)
SELECT node_id, used::BIGINT AS used FROM b WHERE used <= 2500""")
def budget_levels(spark, sf):
    found = _index(spark, sf).search(query_vector(spark, sf), ranking.SearchOptions(query=_QT, k=K, max_tokens=2500), AS_OF, E)
    return found.select("node_id", F.col("tokens_used").cast("long").alias("used"))


@query(f"WITH {_N}, {_V}, d AS (SELECT node_id, {_DIST} AS distance FROM v, q WHERE level = 2 ORDER BY distance, node_id LIMIT 8) SELECT n.node_id, round(greatest(0, 1 - distance), 6) AS semantic FROM d JOIN n USING (node_id)")
def semantic_only(spark, sf):
    return _index(spark, sf).semantic(query_vector(spark, sf), 8, "message").select("node_id", F.round("semantic", 6).alias("semantic"))


@query(P + sql.bm25(_QT) + " SELECT node_id, round(score, 6) AS score FROM scores ORDER BY score DESC, node_id LIMIT 8")
def exact_only(spark, sf):
    return _index(spark, sf).keyword(_QT, 8, normalise=False).select("node_id", F.round("score", 6).alias("score"))


def _hybrid_many_sql(k: int) -> str:
    """Vectors 0 to 4 with a text each, as one table of queries."""
    texts = "\nUNION ALL\n".join(f"SELECT {i} AS query_id, node_id, score / max(score) OVER () AS exact FROM (WITH {sql.bm25(t, 'sc')} SELECT * FROM sc)" for i, t in enumerate(_MANY))
    return f"""WITH {sql.POSTINGS}, {_N}, v AS (SELECT vec_id AS node_id, (vec_id % 4)::INT AS level, embedding::DOUBLE[] AS e FROM embeddings), qv AS (SELECT node_id AS query_id, e AS qe FROM v WHERE node_id < {len(_MANY)}),
d0 AS (SELECT query_id, node_id, list_distance(e, qe) AS distance, row_number() OVER (PARTITION BY query_id, level ORDER BY list_distance(e, qe), node_id) AS r FROM v, qv),
d AS (SELECT query_id, node_id, greatest(0, 1 - distance) AS semantic, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS r2 FROM d0 WHERE r <= {2 * k}),
k0 AS ({texts}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, node_id) AS r FROM k0),
c AS (SELECT query_id, node_id, coalesce(semantic, 0) AS semantic, coalesce(exact, 0) AS exact FROM (SELECT * FROM d WHERE r2 <= {2 * k}) FULL OUTER JOIN (SELECT * FROM k WHERE r <= {2 * k}) USING (query_id, node_id)),
scored AS (SELECT query_id, node_id, CASE WHEN semantic > 0 AND exact > 0 THEN 0.7 * semantic + 0.3 * exact WHEN semantic > 0 THEN semantic ELSE exact END AS relevance, 1 / (1 + (1706745600 - created) / 86400.0::DOUBLE) AS recency, [1.0, 0.6, 0.3, 0.0][level + 1]::DOUBLE AS boost FROM c JOIN n USING (node_id)),
ranked AS (SELECT query_id, node_id, 0.6 * relevance + 0.3 * recency + 0.1 * boost AS combined FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, node_id) AS rank FROM ranked)
SELECT query_id, node_id, round(combined, 6) AS combined, rank FROM placed WHERE rank <= {k}"""


@query(_hybrid_many_sql(5))
def hybrid_many_queries(spark, sf):
    v, (p, lengths) = vecs(spark, sf), index_of(spark, sf)
    vectors_ = v.filter("node_id < 5").select(F.col("node_id").cast("int").alias("query_id"), "embedding")
    queries = asked(spark, *_MANY).join(vectors_, "query_id")
    return ranking.hybrid_many(docs(spark, sf), p, lengths, v, queries, 5, AS_OF, profile=H).select("query_id", "node_id", F.round("combined_score", 6).alias("combined"), "rank")


CANDIDATES = [(i, i % 4, 0.9 - 0.1 * i, 0.2 * i, datetime(2024, 1, 31 - i), "x" * (10 * i)) for i in range(6)]


@query("""WITH c AS (SELECT i AS node_id, i % 4 AS level, 0.9::DOUBLE - 0.1::DOUBLE * i AS s, 0.2::DOUBLE * i AS x, (1 + i) * 86400 AS age FROM range(6) t(i)),
r AS (SELECT *, CASE WHEN s > 0 AND x > 0 THEN 0.7 * s + 0.3 * x WHEN s > 0 THEN s ELSE x END AS rel_h, 0.7 * s + 0.3 * x AS rel_e FROM c)
SELECT node_id, round(0.6 * rel_h + 0.3 / (1 + age / 86400.0::DOUBLE) + 0.1 * [1.0, 0.6, 0.3, 0.0][level + 1]::DOUBLE, 6) AS h, round(0.6 * rel_e + 0.3 * exp(-0.693 * age / 3600.0::DOUBLE) + 0.1 * [0.7, 0.8, 0.9, 1.0][level + 1]::DOUBLE, 6) AS e FROM r""")
def score_profiles(spark, sf):
    rows = spark.createDataFrame(CANDIDATES, "node_id long, level int, semantic double, exact double, created_at timestamp, content string")
    as_of = F.lit(AS_OF).cast("timestamp")
    h = ranking.score(rows, as_of, H).select("node_id", F.round("combined_score", 6).alias("h"))
    return h.join(ranking.score(rows, as_of, E).select("node_id", F.round("combined_score", 6).alias("e")), "node_id")
