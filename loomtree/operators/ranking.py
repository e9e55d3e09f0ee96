"""Hybrid search: vector and keyword candidates joined, filtered, scored, cut, and fitted to a token budget.

Candidates are cut before the filters (prefilter=False), as a filter never moves below a limit; prefilter=True filters first, which
finds the k best that pass. Time is always the argument as_of, ties always go by node_id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..profile import SESSION, STATEMENT, H, Profile, level_code
from . import fulltext, knn


@dataclass(frozen=True)
class SearchOptions:
    """top_level is the coarser end (larger number), bottom_level the finer one; None: session and statement."""

    query: str = ""
    k: int = 10
    top_level: int | str | None = None
    bottom_level: int | str | None = None
    session_id: str | None = None
    agent_id: str | None = None
    after: datetime | None = None
    before: datetime | None = None
    max_tokens: int = 0
    prefilter: bool = False
    zero_range_is_all: bool = False  # levels 0 and 0 mean every level

    def resolved(self, profile: Profile = H) -> SearchOptions:
        k = self.k if self.k > 0 else profile.default_k
        k = min(k, profile.most_k) if profile.most_k else k
        top, bottom = level_code(self.top_level), level_code(self.bottom_level)
        if self.zero_range_is_all and top == 0 and bottom == 0:
            top = bottom = None
        return replace(self, k=k, top_level=SESSION if top is None else top, bottom_level=STATEMENT if bottom is None else bottom)


def boost(level: Column, profile: Profile) -> Column:
    out = F.lit(profile.boosts[-1])
    for i, x in enumerate(profile.boosts[:-1]):
        out = F.when(level == i, x).otherwise(out)
    return out


def recency(created: Column, as_of: Column, profile: Profile) -> Column:
    """H: 1 / (1 + age in days). E: exp(-0.693 age in hours), 1 for the future."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(created)) / 1e6
    if profile.name == "H":
        return 1.0 / (1.0 + seconds / 86400.0)
    return F.when(seconds <= 0, 1.0).otherwise(F.exp(-0.693 * seconds / 3600.0))


def relevance(semantic: Column, exact: Column, profile: Profile) -> Column:
    both = profile.semantic * semantic + profile.keyword * exact
    if profile.name == "E":
        return both
    return F.when((semantic > 0) & (exact > 0), both).when(semantic > 0, semantic).otherwise(exact)


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def score(candidates: DataFrame, as_of: Column, profile: Profile = H) -> DataFrame:
    """candidates (level, created_at, semantic, exact, content) with relevance_score, recency_score, level_boost, combined_score, token_count."""
    rows = candidates.withColumn("relevance_score", relevance(F.col("semantic"), F.col("exact"), profile))
    rows = rows.withColumn("recency_score", recency(F.col("created_at"), as_of, profile)).withColumn("level_boost", boost(F.col("level"), profile))
    combined = profile.relevance * F.col("relevance_score") + profile.recency * F.col("recency_score") + profile.level * F.col("level_boost")
    return rows.withColumn("combined_score", finite(combined)).withColumn("token_count", token_estimate(F.col("content")))


def merge_max(*candidates: DataFrame) -> DataFrame:
    """node_id with the larger semantic and exact score over all inputs."""
    out = candidates[0]
    for c in candidates[1:]:
        out = out.unionByName(c)
    return out.groupBy("node_id").agg(F.max("semantic").alias("semantic"), F.max("exact").alias("exact"))


def fuse(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Full outer join of (node_id, semantic) and (node_id, exact), missing sides 0."""
    return vector.join(keyword, "node_id", "full_outer").select("node_id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("exact", F.lit(0.0)).alias("exact"))


def passes(options: SearchOptions) -> Column:
    """The post-filters; times are inclusive."""
    ok = F.col("level").between(options.bottom_level, options.top_level)
    for name in ("session_id", "agent_id"):
        if (value := getattr(options, name)) is not None:
            ok = ok & (F.col(name) == value)
    if options.after is not None:
        ok = ok & (F.col("created_at") >= F.lit(options.after))
    if options.before is not None:
        ok = ok & (F.col("created_at") <= F.lit(options.before))
    return ok


def within_budget(ranked: DataFrame, budget: int, cost: Column | None = None, order: str = "combined_score", partition: tuple[str, ...] = ()) -> DataFrame:
    """The longest prefix of the ranking whose costs sum to the budget at most. ranked is a result cut to k rows, so one task is enough."""
    cost = F.col("token_count") if cost is None else cost
    upto = Window.partitionBy(*partition).orderBy(F.desc(order), "node_id").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens_used", F.sum(cost).over(upto)).filter(F.col("tokens_used") <= budget)


def level_cost(level: Column, profile: Profile) -> Column:
    out = F.lit(profile.costs[-1])
    for i, x in enumerate(profile.costs[:-1]):
        out = F.when(level == i, x).otherwise(out)
    return out


class HybridIndex:
    """Nodes with their postings, lengths and vectors; everything a search reads."""

    def __init__(self, nodes: DataFrame, postings: DataFrame, embeddings: DataFrame, stats: DataFrame | None = None):
        self.nodes, self.postings, self.embeddings = nodes, postings, embeddings
        self.stats = fulltext.doc_stats(postings) if stats is None else stats

    def _query(self, text: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(0, text)], "query_id int, query string")

    def _part(self, table: DataFrame, options: SearchOptions) -> DataFrame:
        """prefilter: what of a table belongs to nodes that pass."""
        return table.join(self.nodes.filter(passes(options)).select("node_id"), "node_id", "left_semi") if options.prefilter else table

    def candidates(self, vector, options: SearchOptions, n: int, profile: Profile = H) -> DataFrame:
        """node_id, semantic, exact."""
        low, high = options.bottom_level, options.top_level
        if profile.name == "H":
            near = knn.knn_levels(self._part(self.embeddings, options), vector, n, low, high)
            near = near.select("node_id", knn.similarity_h(F.col("distance")).alias("semantic"))
            keyed = fulltext.bm25_top(self._part(self.postings, options), self.stats, self._query(options.query), n)
            return fuse(near, keyed.select("node_id", F.col("score").alias("exact")))
        rows = self._part(self.embeddings, options).filter(F.col("level").between(low, high))
        from ..functions.vectors import dot, literal

        rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("semantic"), "node_id"))
        near = rows.select("node_id", "level", dot(F.col("embedding"), literal(vector)).alias("semantic")).withColumn("r", rank).filter(F.col("r") <= n)
        near = near.select("node_id", "semantic", F.lit(0.0).alias("exact"))
        keyed = fulltext.bm25_top(self._part(self.postings, options), self.stats, self._query(options.query), n, normalise=False)
        keyed = keyed.join(self.nodes.filter(F.col("level").between(low, high)).select("node_id"), "node_id", "left_semi")
        merged = merge_max(near, keyed.select("node_id", F.lit(0.0).alias("semantic"), F.col("score").alias("exact")))
        best = merged.agg(F.max("exact").alias("best"))
        return merged.crossJoin(F.broadcast(best)).select("node_id", "semantic", F.when(F.col("best") > 0, F.col("exact") / F.col("best")).otherwise(0.0).alias("exact"))

    def search(self, vector, options: SearchOptions, as_of: datetime, profile: Profile = H, candidates: int | None = None) -> DataFrame:
        """The k best: columns of nodes and scores, best first."""
        options = options.resolved(profile)
        n = candidates or (2 * options.k if profile.name == "H" else 100)
        found = self.candidates(vector, options, n, profile)
        rows = self.nodes.join(F.broadcast(found), "node_id").filter(passes(options))
        ranked = score(rows, F.lit(as_of).cast("timestamp"), profile).orderBy(F.desc("combined_score"), "node_id").limit(options.k)
        if options.max_tokens > 0:
            cost = level_cost(F.col("level"), profile) if profile.costs else None
            ranked = within_budget(ranked, options.max_tokens, cost)
        return ranked.orderBy(F.desc("combined_score"), "node_id")

    def search_with_response(self, vector, options: SearchOptions, as_of: datetime, profile: Profile = H) -> tuple[DataFrame, DataFrame]:
        """(results, summary): a search for 2k, cut to k and the budget; summary has total, returned, truncated, tokens_used. k of 0 means the default."""
        options = options.resolved(profile)
        wide = self.search(vector, replace(options, k=2 * options.k, max_tokens=0), as_of, profile)
        results = wide.limit(options.k)
        if options.max_tokens > 0:
            results = within_budget(results, options.max_tokens)
        total = wide.agg(F.count("*").alias("total"))
        got = results.agg(F.count("*").alias("returned"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens_used"))
        summary = total.crossJoin(got).withColumn("truncated", F.col("returned") < F.col("total"))
        return results, summary

    def semantic(self, vector, k: int, level: int | str) -> DataFrame:
        near = knn.knn(self.embeddings, vector, k, level_code(level))
        return self.nodes.join(F.broadcast(near.select("node_id", "distance")), "node_id").withColumn("semantic", knn.similarity_h(F.col("distance"))).orderBy("distance", "node_id")

    def keyword(self, query: str, k: int, normalise: bool = True) -> DataFrame:
        hits = fulltext.bm25_top(self.postings, self.stats, self._query(query), k, normalise)
        return self.nodes.join(F.broadcast(hits.select("node_id", "score")), "node_id").orderBy(F.desc("score"), "node_id")


def hybrid_many(nodes: DataFrame, postings: DataFrame, stats: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int, as_of: datetime, low: int = STATEMENT, high: int = SESSION, profile: Profile = H) -> DataFrame:
    """Search for a table of queries (query_id, query, embedding) in one job: query_id, node_id, combined_score, rank."""
    near = knn.knn_many(embeddings.filter(F.col("level").between(low, high)), queries, 2 * k, per_level=True)
    order = Window.partitionBy("query_id").orderBy("distance", "node_id")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * k).select("query_id", "node_id", knn.similarity_h(F.col("distance")).alias("semantic"))
    keyed = fulltext.bm25_top(postings, stats, queries, 2 * k).select("query_id", "node_id", F.col("score").alias("exact"))
    both = near.join(keyed, ["query_id", "node_id"], "full_outer").select("query_id", "node_id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("exact", F.lit(0.0)).alias("exact"))
    rows = both.join(nodes, "node_id").filter(F.col("level").between(low, high))
    return fulltext.top(score(rows, F.lit(as_of).cast("timestamp"), profile), k, "combined_score")
