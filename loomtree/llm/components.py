"""Connected components by randomised contraction; used on links, never on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (one of its nodes) for every node of the undirected edges.

    In each round every node joins the neighbour (or itself) that comes first in an order drawn anew for the round; edges are then
    rewritten to what their ends joined. The number of nodes with edges falls by a constant factor a round, on chains and stars alike.
    Minima are combined on the map side, so a hub costs no more than its edges. Loops, repeated edges and edges with a null end are
    ignored (a node with a loop only is its own component).
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    label = nodes.select("node", F.col("node").alias("component"))
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    label = materialize(label, "labels")
    round_, n, n_nodes = 0, edges.count(), label.count()
    while n:
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        joined = both.groupBy("a").agg(F.least(order("a"), F.min(order("b"))).getField("id").alias("to"))
        joined = materialize(joined.select(F.col("a").alias("node"), "to"), "joined", min(2 * n, n_nodes))
        left = joined.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = joined.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        old = edges, label, joined
        edges = materialize(edges.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct(), "edges", n)
        moved = joined.select(F.col("node").alias("component"), "to")
        label = materialize(label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels", n_nodes)
        discard(*old)
        round_, n = round_ + 1, edges.count()
    discard(edges)
    return label
