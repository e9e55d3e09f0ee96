"""The hierarchy: lookups, scans and walks on the nodes table (node_id, level, parent_id, ...). Depth is bounded, so walks are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ascii, cut
from ..profile import AGENT, level_code

DEPTH = 4  # edges from a statement to an agent


class HierarchyError(ValueError):
    """A node that doesn't fit the tree."""


def get_node(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id)


def children(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("parent_id") == node_id).orderBy("node_id")


def by_session(nodes: DataFrame, session_id: str, limit: int = 0) -> DataFrame:
    found = nodes.filter(F.col("session_id") == session_id).orderBy("node_id")
    return found.limit(limit) if limit > 0 else found


def by_level(nodes: DataFrame, level: int | str) -> DataFrame:
    return nodes.filter(F.col("level") == level_code(level)).orderBy("node_id")


def first_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    return nodes.orderBy("node_id").limit(limit)


def find_by_content(nodes: DataFrame, part: str, level: int | str | None = None, limit: int = 0) -> DataFrame:
    found = nodes.filter(contains_ascii(F.col("content"), part))
    if level is not None and level_code(level) != 255:
        found = found.filter(F.col("level") == level_code(level))
    found = found.orderBy("node_id")
    return found.limit(limit) if limit > 0 else found


def parents(nodes: DataFrame) -> DataFrame:
    """node_id, parent_id and the parent's level, for all nodes that have one."""
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("level").alias("parent_level"))
    return nodes.select("node_id", "parent_id").join(up, "parent_id").select("node_id", "parent_id", "parent_level")


def siblings(nodes: DataFrame, with_self: bool = True) -> DataFrame:
    """node_id, sibling_id for all nodes. With self (profile H) a root is its own sibling; without, roots have none."""
    a = nodes.select("node_id", "parent_id")
    b = nodes.select(F.col("node_id").alias("sibling_id"), "parent_id")
    pairs = a.join(b, "parent_id").select("node_id", "sibling_id")
    if not with_self:
        return pairs.filter("node_id <> sibling_id")
    return pairs.unionByName(nodes.filter("parent_id IS NULL").select("node_id", F.col("node_id").alias("sibling_id")))


def siblings_of(nodes: DataFrame, node_id: int, with_self: bool = True) -> DataFrame:
    """The nodes themselves, for one node: two selective scans."""
    parent = get_node(nodes, node_id).select(F.col("parent_id").alias("p"))
    found = nodes.join(parent, nodes["parent_id"] == F.col("p"), "left_semi")
    if with_self:
        return found.unionByName(get_node(nodes, node_id).filter("parent_id IS NULL")).orderBy("node_id")
    return found.filter(F.col("node_id") != node_id).orderBy("node_id")


def paths(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, distance (0: the node itself) for all nodes. Each join is on the parent's id and drops finished rows."""
    edges = nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("up")).filter("up IS NOT NULL")
    out = step = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    for d in range(1, DEPTH + 1):
        step = step.join(edges, F.col("ancestor_id") == F.col("child")).select("node_id", F.col("up").alias("ancestor_id"), F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out


def ancestors(nodes: DataFrame, node_id: int, inclusive: bool = True) -> DataFrame:
    """Profile H: from the root to the node. Profile E (inclusive=False): from the parent to the root. Columns of nodes and distance.
    Starts from one node, so every join has one row on its left."""
    step = get_node(nodes, node_id).withColumn("distance", F.lit(0))
    found = [step] if inclusive else []
    for d in range(1, DEPTH + 1):
        up = step.select(F.col("parent_id").alias("p")).filter("p IS NOT NULL")
        step = nodes.join(F.broadcast(up), nodes["node_id"] == F.col("p")).drop("p").withColumn("distance", F.lit(d))
        found.append(step)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.orderBy(F.desc("distance") if inclusive else F.asc("distance"))


def descendants(nodes: DataFrame, node_id: int, with_root: bool = False) -> DataFrame:
    """In preorder: by the path of ids from the node down. Columns of nodes and depth."""
    step = get_node(nodes, node_id).withColumn("path", F.array("node_id")).withColumn("depth", F.lit(0))
    found = [step]
    for d in range(1, DEPTH + 1):
        up = step.select(F.col("node_id").alias("p"), F.col("path").alias("upper"))
        step = nodes.join(up, nodes["parent_id"] == F.col("p")).withColumn("path", F.concat("upper", F.array("node_id"))).withColumn("depth", F.lit(d)).drop("p", "upper")
        found.append(step)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    if not with_root:
        out = out.filter("depth > 0")
    return out.orderBy("path").drop("path")


def count_descendants(nodes: DataFrame) -> DataFrame:
    """node_id, n for all nodes."""
    counts = paths(nodes).filter("distance > 0").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))


def links(nodes: DataFrame) -> DataFrame:
    """node_id, parent_id, first_child_id, next_sibling_id."""
    first = nodes.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("first_child_id"))
    following = F.when(F.col("parent_id").isNotNull(), F.lead("node_id").over(Window.partitionBy("parent_id").orderBy("node_id")))
    rows = nodes.filter("parent_id IS NOT NULL").select("node_id", "parent_id", following.alias("next_sibling_id"))
    rows = rows.unionByName(nodes.filter("parent_id IS NULL").select("node_id", "parent_id", F.lit(None).cast("long").alias("next_sibling_id")))
    return rows.join(first, "node_id", "left").select("node_id", "parent_id", "first_child_id", "next_sibling_id")


def child_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children_count"))


def drill_down(nodes: DataFrame, node_id: int, part: str | None = None, most: int = 0) -> DataFrame:
    """Children, filtered by substring before the limit, with their true number of children and whether they have any."""
    found = nodes.filter(F.col("parent_id") == node_id)
    if part:
        found = found.filter(contains_ascii(F.col("content"), part))
    found = found.orderBy("node_id")
    if most > 0:
        found = found.limit(most)
    counts = child_counts(nodes)
    out = found.join(counts, found["node_id"] == counts["id"], "left").drop("id")
    return out.withColumn("children_count", F.coalesce("children_count", F.lit(0))).withColumn("has_children", F.col("children_count") > 0).orderBy("node_id")


def zoom_out(nodes: DataFrame, node_id: int, profile: str = "H", siblings_shown: int = 20) -> DataFrame:
    """H: root to node. E: the node, its ancestors upwards and siblings with a preview; column relation tells which."""
    if profile == "H":
        return ancestors(nodes, node_id)
    own = get_node(nodes, node_id).withColumn("distance", F.lit(0)).withColumn("relation", F.lit("node"))
    up = ancestors(nodes, node_id, inclusive=False).withColumn("relation", F.lit("ancestor"))
    beside = siblings_of(nodes, node_id, with_self=False).limit(siblings_shown).withColumn("content", cut(F.col("content"), 100)).withColumn("distance", F.lit(0)).withColumn("relation", F.lit("sibling"))
    return own.unionByName(up).unionByName(beside).withColumn("content", cut(F.col("content"), 500))


def get_context(nodes: DataFrame, node_id: int, parent: bool = True, siblings: bool = True, children_: bool = True, max_depth: int = 1) -> DataFrame:
    """The node and its surroundings, column relation telling which. max_depth is how many levels of descendants children_ means."""
    own = get_node(nodes, node_id)
    out = own.withColumn("relation", F.lit("node"))
    if parent:
        out = out.unionByName(ancestors(nodes, node_id, inclusive=False).filter("distance = 1").drop("distance").withColumn("relation", F.lit("parent")))
    if siblings:
        out = out.unionByName(siblings_of(nodes, node_id, with_self=False).withColumn("relation", F.lit("sibling")))
    if children_:
        out = out.unionByName(descendants(nodes, node_id).filter(F.col("depth") <= max_depth).drop("depth").withColumn("relation", F.lit("child")))
    return out


def similarity_to_parent_level(nodes: DataFrame, embeddings: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity for pairs of node ids; 0 where levels differ or a vector is missing."""
    from ..functions.vectors import cosine

    side = lambda n: nodes.select("node_id", "level").join(embeddings.select("node_id", "embedding"), "node_id", "left").select(F.col("node_id").alias(n), F.col("level").alias("level_" + n), F.col("embedding").alias("v_" + n))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    ok = (F.col("level_a") == F.col("level_b")) & F.col("v_a").isNotNull() & F.col("v_b").isNotNull()
    return both.select("a", "b", F.when(ok, cosine(F.col("v_a"), F.col("v_b"))).otherwise(0.0).alias("similarity"))


def upsert(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest row per node by sequence_num; a change must keep its node's parent."""
    moved = changes.select("node_id", F.col("parent_id").alias("new")).join(nodes.select("node_id", "parent_id"), "node_id").filter(~F.col("new").eqNullSafe(F.col("parent_id")))
    if not moved.isEmpty():
        raise HierarchyError("a node's parent can't change")
    return latest(nodes.unionByName(changes), "node_id")


def latest(rows: DataFrame, key: str, order: str = "sequence_num") -> DataFrame:
    """The row with the largest order value of each key; combined on the map side."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def delete_nodes(nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    return nodes.join(tombstones.select("node_id"), "node_id", "left_anti")


def delete_subtree(nodes: DataFrame, node_id: int) -> DataFrame:
    gone = descendants(nodes, node_id, with_root=True).select("node_id")
    return nodes.join(gone, "node_id", "left_anti")


def add_children(nodes: DataFrame, new: DataFrame, profile: str = "H") -> DataFrame:
    """Rows (parent_id, level, content, created_at, role) as nodes: ids go on, session and agent come from the parent.

    H: a level at or over the parent's becomes the one under it. E: it must be exactly that. A statement has no children.
    """
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("level").alias("up"), "session_id", "agent_id")
    joined = new.join(up, "parent_id", "left")
    wrong = F.col("up").isNull() | (F.col("up") == 0) | (F.col("level") < 0) | (F.col("level") > AGENT)
    if profile == "E":
        wrong = wrong | (F.col("level") != F.col("up") - 1)
    if not joined.filter(wrong).isEmpty():
        raise HierarchyError("no such parent, or no such level under it")
    top = nodes.agg(F.max("node_id").alias("id"), F.max("sequence_num").alias("seq")).first()
    n = F.row_number().over(Window.orderBy("parent_id", "created_at", "content"))
    level = F.when(F.col("level") >= F.col("up"), F.col("up") - 1).otherwise(F.col("level")).cast("tinyint")
    made = joined.withColumn("level", level).withColumn("node_id", n + F.lit(top["id"] or 0)).withColumn("sequence_num", n + F.lit(top["seq"] or 0)).drop("up")
    return nodes.unionByName(made, allowMissingColumns=True)


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes"), F.count("parent_id").alias("n_edges"), F.countDistinct("parent_id").alias("n_parents"))


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count("*").alias("n"))


def outline(nodes: DataFrame, node_id: int, depth: int, width: int = 60) -> DataFrame:
    """Text lines of the subtree to a depth, indented, in preorder."""
    from ..functions.text import level_name, preview

    rows = descendants(nodes, node_id, with_root=True).filter(F.col("depth") <= depth)
    line: Column = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("["), level_name(F.col("level")), F.lit(" "), F.col("node_id"), F.lit("] "), preview(F.col("content"), width))
    return rows.select("node_id", "depth", line.alias("line"))
