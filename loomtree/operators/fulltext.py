"""Inverted index: postings (token, node_id, tf), lengths (node_id, doc_len) and corpus totals, all derived and additive.

Only tf and lengths are stored; document frequencies and averages come from them at query time, so appending documents never rewrites
old rows. Queries come as a table (query_id, query), so one job answers many. Every side that is small by construction (query tokens,
totals) is broadcast; postings are filtered by token first and shuffle their matches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens_h, is_index_token_h, raw_index_tokens_h
from ..profile import H, Profile

Tokenizer = Callable[[Column], Column]


def build_postings(docs: DataFrame, tokenizer: Tokenizer = index_tokens_h, key: str = "node_id", content: str = "content") -> DataFrame:
    """token, node_id, tf, first_pos (among all words, stop words too). Documents without tokens have no rows."""
    plain = tokenizer is index_tokens_h
    found = (raw_index_tokens_h if plain else tokenizer)(F.col(content))
    tokens = docs.select(F.col(key).alias("node_id"), F.posexplode(found).alias("pos", "token"))
    if plain:
        tokens = tokens.filter(is_index_token_h(F.col("token")))
    return tokens.groupBy("token", "node_id").agg(F.count("*").cast("int").alias("tf"), F.min("pos").alias("first_pos"))


def doc_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("node_id").agg(F.sum("tf").alias("doc_len"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def index_stats(postings: DataFrame) -> DataFrame:
    words = postings.agg(F.countDistinct("token").alias("unique_tokens"))
    return words.crossJoin(corpus_stats(doc_stats(postings)).withColumnsRenamed({"n_docs": "indexed_nodes", "avg_len": "avg_doc_length"}))


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def replace_documents(postings: DataFrame, docs: DataFrame, tokenizer: Tokenizer = index_tokens_h, profile: str = "H") -> DataFrame:
    """Postings after adding docs. H: a known document is replaced, but one without tokens leaves its old entry. E: known ones are errors."""
    new = build_postings(docs, tokenizer)
    if profile == "E" and not new.join(postings, "node_id", "left_semi").isEmpty():
        raise ValueError("a document exists already")
    return postings.join(new.select("node_id").distinct(), "node_id", "left_anti").unionByName(new)


def remove_documents(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return postings.join(ids.select("node_id"), "node_id", "left_anti")


def query_tokens(queries: DataFrame, tokenizer: Tokenizer = index_tokens_h) -> DataFrame:
    """query_id, token, times: how often a query has the token."""
    return queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def _asked_only(postings: DataFrame, asked: DataFrame, most: int = 1000) -> DataFrame:
    """postings of the queries' tokens. Few tokens are a filter that reaches the scan, where a stored index skips what has none of them."""
    tokens = [r["token"] for r in asked.select("token").distinct().limit(most + 1).collect()]
    return postings.filter(F.col("token").isin(tokens)) if len(tokens) <= most else postings


def _hint(asked: DataFrame, rows: int = 100_000):
    """broadcast, if the queries' tokens are that few; what has a row per token or query is then no larger. Else nothing, and the
    optimizer joins as sizes are."""
    return F.broadcast if asked.limit(rows + 1).count() <= rows else lambda df: df


def search_and(postings: DataFrame, queries: DataFrame, tokenizer: Tokenizer = index_tokens_h) -> DataFrame:
    """query_id, node_id: documents with every token of the query."""
    asked = query_tokens(queries, tokenizer)
    postings, hint = _asked_only(postings, asked), _hint(asked)
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = postings.join(hint(asked), "token").groupBy("query_id", "node_id").agg(F.count("*").alias("found"))
    return hits.join(hint(need), "query_id").filter("found = need").select("query_id", "node_id")


def search_or(postings: DataFrame, queries: DataFrame, tokenizer: Tokenizer = index_tokens_h) -> DataFrame:
    asked = query_tokens(queries, tokenizer)
    return _asked_only(postings, asked).join(_hint(asked)(asked), "token").select("query_id", "node_id").distinct()


def contains_any(postings: DataFrame, queries: DataFrame, tokenizer: Tokenizer = index_tokens_h) -> DataFrame:
    """query_id, found: whether any document has all tokens."""
    hits = search_and(postings, queries, tokenizer).select("query_id").distinct().withColumn("found", F.lit(True))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("found"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(tf: Column, length: Column, average: Column, idf_: Column, k1: float = H.k1, b: float = H.b) -> Column:
    return idf_ * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * length / average))


def bm25_scores(postings: DataFrame, stats: DataFrame, queries: DataFrame, tokenizer: Tokenizer = index_tokens_h, profile: Profile = H, all_tokens: bool = False) -> DataFrame:
    """query_id, node_id, score: sums over query tokens, a repeated one counting repeatedly. all_tokens: only documents with all of them."""
    asked = query_tokens(queries, tokenizer)
    postings, hint = _asked_only(postings, asked), _hint(asked)
    matched = postings.join(hint(asked), "token")
    # A token's frequency counts all its documents, whatever is filtered later.
    frequency = postings.join(hint(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    scored = matched.join(hint(frequency), "token").join(stats, "node_id").crossJoin(F.broadcast(corpus_stats(stats)))
    part = F.col("times") * bm25(F.col("tf"), F.col("doc_len"), F.col("avg_len"), idf(F.col("n_docs"), F.col("df")), profile.k1, profile.b)
    out = scored.groupBy("query_id", "node_id").agg(F.sum(part).alias("score"), F.count("*").alias("found"))
    if all_tokens:
        need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
        out = out.join(hint(need), "query_id").filter("found = need")
    return out.select("query_id", "node_id", "score")


def top(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query, ties by node_id; a group limit cuts each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "node_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def bm25_top(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int, normalise: bool = True, **more) -> DataFrame:
    """query_id, node_id, score, rank. normalise: over the query's best score, taken before the cut."""
    scores = bm25_scores(postings, stats, queries, **more)
    if normalise:
        best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
        scores = scores.join(_hint(queries)(best), "query_id").select("query_id", "node_id", (F.col("score") / F.col("best")).alias("score"))
    return top(scores, k)
