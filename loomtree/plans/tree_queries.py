"""Queries on the hierarchy of the fixture's conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..sources import storage
from . import sql
from .ingest import build_nodes, conversations, with_ordinals
from .registry import query, table

W = f"WITH {sql.NODES} "
R = f"WITH RECURSIVE {sql.NODES}, "


def nodes_of(spark, sf):
    return build_nodes(conversations(table(spark, sf, "conversations")))


def some(nodes, level, nth=3):
    """Id of the nth node of a level."""
    return nodes.filter(F.col("level") == level).orderBy("node_id").limit(nth).agg(F.max("node_id")).first()[0]


_MESSAGE = "(SELECT max(node_id) FROM (SELECT node_id FROM nodes WHERE level = 2 ORDER BY node_id LIMIT 3))"
_STATEMENT = "(SELECT max(node_id) FROM (SELECT node_id FROM nodes WHERE level = 0 ORDER BY node_id LIMIT 3))"


@query(W + "SELECT node_id, level::INT AS level, parent_id, session_id, agent_id, role, content, block_type, stmt_type, created FROM nodes")
def build_tree(spark, sf):
    n = nodes_of(spark, sf)
    return n.select("node_id", F.col("level").cast("int").alias("level"), "parent_id", "session_id", "agent_id", "role", "content", "block_type", "stmt_type", F.unix_seconds("created_at").alias("created"))


@query(W + "SELECT level::INT AS level, count(*) AS n FROM nodes GROUP BY ALL")
def level_counts(spark, sf):
    return tree.level_counts(nodes_of(spark, sf)).select(F.col("level").cast("int").alias("level"), "n")


@query(W + f"SELECT node_id, content FROM nodes WHERE parent_id = {_MESSAGE}")
def children(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.children(n, some(n, 2)).select("node_id", "content")


@query(W + "SELECT a.node_id, b.node_id AS sibling_id FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id UNION ALL SELECT node_id, node_id FROM nodes WHERE parent_id IS NULL")
def siblings(spark, sf):
    return tree.siblings(nodes_of(spark, sf))


@query(W + "SELECT a.node_id, b.node_id AS sibling_id FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id")
def siblings_without_self(spark, sf):
    return tree.siblings(nodes_of(spark, sf), with_self=False)


@query(W + "SELECT c.node_id, c.parent_id, p.level::INT AS parent_level FROM nodes c JOIN nodes p ON c.parent_id = p.node_id")
def parent(spark, sf):
    return tree.parents(nodes_of(spark, sf)).withColumn("parent_level", F.col("parent_level").cast("int"))


_UP = "up AS (SELECT node_id, node_id AS ancestor_id, 0 AS distance FROM nodes UNION ALL SELECT up.node_id, n.parent_id, distance + 1 FROM up JOIN nodes n ON n.node_id = up.ancestor_id WHERE n.parent_id IS NOT NULL) "


@query(R + _UP + "SELECT * FROM up")
def ancestors(spark, sf):
    return tree.paths(nodes_of(spark, sf))


@query(R + _UP + f"SELECT n.node_id, n.level::INT AS level, distance FROM up JOIN nodes n ON n.node_id = up.ancestor_id WHERE up.node_id = {_STATEMENT}")
def zoom_out(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.zoom_out(n, some(n, 0)).select("node_id", F.col("level").cast("int").alias("level"), "distance")


@query(R + _UP + f"SELECT 'node' AS relation, node_id FROM nodes WHERE node_id = {_STATEMENT} UNION ALL SELECT 'ancestor', ancestor_id FROM up WHERE node_id = {_STATEMENT} AND distance > 0 UNION ALL (SELECT 'sibling', b.node_id FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id WHERE a.node_id = {_STATEMENT} ORDER BY b.node_id LIMIT 20)")
def zoom_out_e(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.zoom_out(n, some(n, 0), "E").select("relation", "node_id")


@query(R + _UP + f"SELECT node_id, distance AS depth FROM up WHERE ancestor_id = (SELECT max(node_id) FROM (SELECT node_id FROM nodes WHERE level = 3 ORDER BY node_id LIMIT 2)) AND distance > 0")
def descendants(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.descendants(n, some(n, 3, 2)).select("node_id", "depth")


@query(R + _UP + "SELECT n.node_id, count(up.node_id) AS n FROM nodes n LEFT JOIN up ON up.ancestor_id = n.node_id AND distance > 0 GROUP BY n.node_id")
def count_descendants(spark, sf):
    return tree.count_descendants(nodes_of(spark, sf))


@query(W + "SELECT node_id, parent_id, (SELECT min(node_id) FROM nodes c WHERE c.parent_id = n.node_id) AS first_child_id, CASE WHEN parent_id IS NOT NULL THEN lead(node_id) OVER (PARTITION BY parent_id ORDER BY node_id) END AS next_sibling_id FROM nodes n")
def first_child_next_sibling(spark, sf):
    return tree.links(nodes_of(spark, sf))


@query(W + "SELECT node_id, CASE WHEN parent_id IS NOT NULL THEN row_number() OVER (PARTITION BY parent_id ORDER BY node_id) - 1 END AS ordinal FROM nodes")
def ordinals(spark, sf):
    return with_ordinals(nodes_of(spark, sf)).select("node_id", F.col("ordinal").cast("long").alias("ordinal"))


@query(W + f"SELECT node_id, (SELECT count(*) FROM nodes c WHERE c.parent_id = n.node_id) AS children_count, EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.node_id) AS has_children FROM nodes n WHERE parent_id = {_MESSAGE} AND contains(lower(content), 'a') ORDER BY node_id LIMIT 5")
def drill_down_filter(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.drill_down(n, some(n, 2), "A", 5).select("node_id", "children_count", "has_children")


_CTX = _MESSAGE


@query(W + f"""SELECT 'node' AS relation, node_id FROM nodes WHERE node_id = {_CTX}
UNION ALL SELECT 'parent', parent_id FROM nodes WHERE node_id = {_CTX}
UNION ALL SELECT 'sibling', b.node_id FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id WHERE a.node_id = {_CTX}
UNION ALL SELECT 'child', node_id FROM nodes WHERE parent_id = {_CTX}""")
def get_context(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.get_context(n, some(n, 2)).select("relation", "node_id")


@query(W + "SELECT node_id, content FROM nodes WHERE level = 0 AND contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') ORDER BY node_id LIMIT 20")
def find_by_content(spark, sf):
    return tree.find_by_content(nodes_of(spark, sf), "The", "statement", 20).select("node_id", "content")


@query(W + "SELECT node_id FROM nodes WHERE session_id = 'conv-1' ORDER BY node_id LIMIT 10")
def nodes_by_session(spark, sf):
    return tree.by_session(nodes_of(spark, sf), "conv-1", 10).select("node_id")


@query(W + "SELECT node_id FROM nodes WHERE level = 1")
def nodes_by_level(spark, sf):
    return tree.by_level(nodes_of(spark, sf), "block").select("node_id")


@query(W + "SELECT node_id FROM nodes ORDER BY node_id LIMIT 7")
def list_nodes(spark, sf):
    return tree.first_nodes(nodes_of(spark, sf), 7).select("node_id")


@query(W + "SELECT node_id, content FROM nodes WHERE node_id = 5")
def point_lookup(spark, sf):
    return tree.get_node(nodes_of(spark, sf), 5).select("node_id", "content")


@query(R + _UP + f"SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM up WHERE ancestor_id = {_MESSAGE})")
def delete_subtree(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.delete_subtree(n, some(n, 2)).select("node_id")


@query(W + "SELECT count(*) AS n_nodes, count(parent_id) AS n_edges, count(DISTINCT parent_id) AS n_parents FROM nodes")
def relation_stats(spark, sf):
    return tree.stats(nodes_of(spark, sf))


@query(W + "SELECT n.node_id, n.node_id + r.before - CASE WHEN n.level = 3 THEN 1 ELSE 0 END AS sequence FROM nodes n JOIN (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS before FROM m) r USING (conv_id, turn)")
def sequence_numbers(spark, sf):
    return nodes_of(spark, sf).select("node_id", F.col("sequence_num").alias("sequence"))


@query("""SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def latest_wins(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return storage.latest_wins(rows, "o_custkey", "o_orderkey")


@query(W + "SELECT node_id, CASE level WHEN 3 THEN 'session' WHEN 2 THEN 'message' WHEN 1 THEN 'block' ELSE 'statement' END AS level_name FROM nodes")
def level_names(spark, sf):
    return nodes_of(spark, sf).select("node_id", "level_name")


@query(R + _UP + r""", line AS (SELECT up.node_id, distance AS depth, trim(regexp_replace(replace(n.content, chr(10), ' '), ' +', ' ', 'g'), ' ') AS c, CASE n.level WHEN 3 THEN 'session' WHEN 2 THEN 'message' WHEN 1 THEN 'block' ELSE 'statement' END AS name
  FROM up JOIN nodes n USING (node_id) WHERE ancestor_id = (SELECT min(node_id) FROM nodes WHERE level = 3) AND distance <= 2)
SELECT node_id, depth, repeat('  ', depth) || '[' || name || ' ' || node_id || '] ' || CASE WHEN length(c) > 60 THEN left(c, 57) || '...' ELSE c END AS line FROM line""")
def outline_tree(spark, sf):
    n = nodes_of(spark, sf).cache()
    return tree.outline(n, some(n, 3, 1), 2)
