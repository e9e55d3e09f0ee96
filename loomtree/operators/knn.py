"""Exact nearest neighbours, pooling and vector statistics on embeddings (node_id, level, embedding).

Exact search has recall 1. Candidates go through numpy in Arrow batches: the queries' matrix (checked to be small) is in every task, each
task keeps its k best per query and level, so the shuffle holds k rows a task, query and level whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import l2, literal, normalize
from ..profile import BLOCK, MESSAGE, SESSION

MOST_QUERIES = 10_000

#: Distances that a task holds at a time.
CELLS = 4_000_000


def knn(embeddings: DataFrame, vector, k: int, level: int | None = None) -> DataFrame:
    """node_id, level, distance of the k nearest to one vector: scan, distance, top-k in the JVM."""
    rows = embeddings if level is None else embeddings.filter(F.col("level") == level)
    return rows.select("node_id", "level", l2(F.col("embedding"), literal(vector)).alias("distance")).orderBy("distance", "node_id").limit(k)


def knn_levels(embeddings: DataFrame, vector, k: int, low: int, high: int) -> DataFrame:
    """The k nearest over a range of levels: k per level, then k of all."""
    rows = embeddings.filter(F.col("level").between(low, high)).select("node_id", "level", l2(F.col("embedding"), literal(vector)).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("distance", "node_id"))
    return rows.withColumn("r", rank).filter(F.col("r") <= k).drop("r").orderBy("distance", "node_id").limit(k)


def knn_many(embeddings: DataFrame, queries: DataFrame, k: int, metric: str = "l2", per_level: bool = False) -> DataFrame:
    """query_id, node_id, level, distance: the k nearest of every query (per level if asked).

    queries: query_id, embedding; more than MOST_QUERIES rows are answered in slices. metric: l2, or inner (1 - dot). Vectors of another
    length than the query's are 1e10 away.
    """
    asked = queries.select("query_id", "embedding").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        parts = -(-queries.count() // MOST_QUERIES) * 2
        sliced = queries.withColumn("_slice", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        out = None
        for i in range(parts):
            part = knn_many(embeddings, sliced.filter(F.col("_slice") == i).drop("_slice"), k, metric, per_level)
            out = part if out is None else out.unionByName(part)
        return out
    ids = [r["query_id"] for r in asked]
    wide = max((len(r["embedding"]) for r in asked), default=0)
    same = all(len(r["embedding"]) == wide for r in asked)
    matrix = np.array([r["embedding"] for r in asked], np.float64) if same and asked else None
    if asked and not same:
        raise ValueError("query vectors must have one length")
    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    kind, key_kind = dict(queries.dtypes)["query_id"], dict(embeddings.dtypes)["node_id"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """So many rows at a time that a block of distances has CELLS numbers at most, and a row each at least."""
        rows = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, len(batch), rows):
                yield batch.slice(lo, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            vectors = batch.column("embedding")
            n = np.asarray(vectors.value_lengths())
            fit = np.flatnonzero(n == wide)
            x = np.asarray(vectors.take(pa.array(fit)).flatten(), dtype=np.float64).reshape(len(fit), wide)
            if metric == "inner":
                distance = 1 - matrix @ x.T
            else:
                distance = np.sqrt(np.maximum(((matrix**2).sum(1)[:, None] + (x**2).sum(1)) - 2 * matrix @ x.T, 0))
                close = distance < 1e-3  # the expansion loses digits there
                for q, j in zip(*np.nonzero(close), strict=True):
                    distance[q, j] = np.sqrt(((matrix[q] - x[j]) ** 2).sum())
            full = np.full((len(ids), len(batch)), 1e10)
            full[:, fit] = distance
            nodes, levels = np.asarray(batch.column("node_id")), np.asarray(batch.column("level"))
            for level in np.unique(levels) if per_level else [None]:
                own = np.arange(len(batch)) if level is None else np.flatnonzero(levels == level)
                for q in range(len(ids)):
                    d = full[q, own]
                    near = own
                    if len(own) > 4 * k:
                        near = own[d <= np.partition(d, k - 1)[k - 1]]  # ties at the k-th place stay
                    best = near[np.lexsort((nodes[near], full[q, near]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(best), id_type), pa.array(nodes[best]), pa.array(levels[best]), pa.array(full[q, best])], ["query_id", "node_id", "level", "distance"])

    rows = embeddings.select("node_id", F.col("level").cast("int").alias("level"), "embedding").filter("embedding IS NOT NULL")
    found = rows.mapInArrow(run, f"query_id {kind}, node_id {key_kind}, level int, distance double")
    order = Window.partitionBy("query_id", *["level"] * per_level).orderBy("distance", "node_id")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def pool(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """key, embedding: mean by position over all vectors of a key (of one length), then unit length. Sums are combined on the map side."""
    wide = vectors.select(key, F.posexplode(embedding).alias("i", "x"))
    means = wide.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m")).select(key, F.struct("i", "m").alias("e"))
    pooled = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["m"]).alias("v"))
    return pooled.select(key, F.transform(normalize(F.col("v")), lambda x: x.cast("float")).alias("embedding"))


def pool_children(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """node_id, embedding of every node with embedded children."""
    up = nodes.select("node_id", "parent_id").join(embeddings.select("node_id", "embedding"), "node_id").filter("parent_id IS NOT NULL")
    return pool(up.select(F.col("parent_id").alias("parent"), "embedding"), "parent").withColumnRenamed("parent", "node_id")


def pool_sessions(nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """From statement vectors up: blocks, messages and sessions, each the pooled children. node_id, level, embedding of all levels."""
    level = statements.select("node_id", F.lit(0).alias("level"), "embedding")
    out = level
    for code in (BLOCK, MESSAGE, SESSION):
        level = pool_children(nodes, level).withColumn("level", F.lit(code)).select("node_id", "level", "embedding")
        out = out.unionByName(level)
    return out


def put(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """By (level, node_id); new rows replace old ones."""
    return embeddings.join(new.select("node_id", "level"), ["node_id", "level"], "left_anti").unionByName(new)


def remove(embeddings: DataFrame, gone: DataFrame) -> DataFrame:
    return embeddings.join(gone.select("node_id"), "node_id", "left_anti")


def index_stats(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("level").agg(F.count("*").alias("n"))


def contains(embeddings: DataFrame, node_id: int) -> bool:
    return not embeddings.filter(F.col("node_id") == node_id).isEmpty()


def similarity_h(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - distance)
