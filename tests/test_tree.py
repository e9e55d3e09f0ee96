from __future__ import annotations

from datetime import datetime

import pytest
from loomtree.functions.text import level_name
from loomtree.operators import tree
from loomtree.plans.ingest import build_nodes, with_ordinals

NOW = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def nodes(spark):
    """Session 1; message 2 with blocks 3, 6, 9 of two statements each; message 12 with one block of three."""
    said = "One here. Two here.\n\nThree now. Four now.\n\nFive yes. Six yes."
    rows = [(1, 0, "s1", "a1", "user", said, NOW), (1, 1, "s1", "a1", "user", "X one. Y two. Z three", NOW), (2, 0, "s2", "a2", "user", "Other", NOW)]
    return build_nodes(spark.createDataFrame(rows, "session_seq long, turn long, session_id string, agent_id string, role string, content string, created_at timestamp")).cache()


def ids(df, column="node_id"):
    return [r[column] for r in df.collect()]


def test_ids_are_preorder(nodes):
    assert ids(nodes.orderBy("node_id")) == list(range(1, 21))
    assert [(r.level, r.parent_id) for r in nodes.orderBy("node_id").limit(6).collect()] == [(3, None), (2, 1), (1, 2), (0, 3), (0, 3), (1, 2)]


def test_sequence_numbers(nodes):
    seq = {r.node_id: r.sequence_num for r in nodes.collect()}
    # A new session takes two numbers, the message follows; the second message is preceded by one for the session.
    assert [seq[1], seq[2], seq[3], seq[11]] == [1, 3, 4, 12]
    assert seq[12] == 14


def test_walks(nodes):
    assert ids(tree.children(nodes, 2)) == [3, 6, 9]
    assert ids(tree.siblings_of(nodes, 6, with_self=False)) == [3, 9]
    assert ids(tree.siblings_of(nodes, 6)) == [3, 6, 9]
    assert ids(tree.siblings_of(nodes, 1)) == [1]
    assert ids(tree.ancestors(nodes, 4)) == [1, 2, 3, 4]
    assert ids(tree.ancestors(nodes, 4, inclusive=False)) == [3, 2, 1]
    assert ids(tree.descendants(nodes, 2)) == list(range(3, 12))
    assert {r.node_id: r.n for r in tree.count_descendants(nodes).collect()}[1] == 15
    links = {r.node_id: (r.first_child_id, r.next_sibling_id) for r in tree.links(nodes).collect()}
    assert links[3] == (4, 6) and links[6] == (7, 9) and links[9] == (10, None)
    assert {r.node_id: r.ordinal for r in with_ordinals(nodes).collect()}[9] == 2


def test_path_lengths_add_up(nodes):
    n = {}
    for r in tree.paths(nodes).collect():
        n[r.node_id] = n.get(r.node_id, 0) + 1
    for r in nodes.filter("parent_id IS NOT NULL").collect():
        assert n[r.node_id] == n[r.parent_id] + 1


def test_drill_and_context(nodes):
    assert ids(tree.drill_down(nodes, 2, "NOW", 5)) == [6]
    assert [r.children_count for r in tree.drill_down(nodes, 2).collect()] == [2, 2, 2]
    context = {(r.relation, r.node_id) for r in tree.get_context(nodes, 6).collect()}
    assert context == {("node", 6), ("parent", 2), ("sibling", 3), ("sibling", 9), ("child", 7), ("child", 8)}
    deep = tree.get_context(nodes, 1, max_depth=2).filter("relation = 'child'")
    assert deep.count() == 2 + 4
    assert tree.drill_down(nodes, 999).count() == 0 and tree.zoom_out(nodes, 999).count() == 0


def test_find_scan_delete(nodes):
    assert ids(tree.find_by_content(nodes, "two", "statement")) == [5, 15]
    assert ids(tree.by_session(nodes, "s2", 2)) == [17, 18]
    assert tree.delete_subtree(nodes, 2).count() == 20 - 10
    stats = tree.stats(nodes).first()
    assert (stats.n_nodes, stats.n_edges) == (20, 18)


def test_add_children(spark, nodes):
    new = spark.createDataFrame([(3, 0, "new one", NOW), (2, 2, "clamped", NOW)], "parent_id long, level tinyint, content string, created_at timestamp")
    made = {r.content: r for r in tree.add_children(nodes, new).filter("node_id > 20").collect()}
    assert made["clamped"].level == 1 and made["new one"].session_id == "s1"
    with pytest.raises(tree.HierarchyError):
        tree.add_children(nodes, new, "E")
    with pytest.raises(tree.HierarchyError):
        tree.add_children(nodes, spark.createDataFrame([(4, 0, "x", NOW)], new.schema))


def test_upsert_keeps_parents(spark, nodes):
    change = nodes.filter("node_id = 4").selectExpr("*").withColumn("content", level_name(nodes["level"])).withColumn("sequence_num", nodes["sequence_num"] + 1000)
    assert tree.get_node(tree.upsert(nodes, change), 4).first().content == "statement"
    with pytest.raises(tree.HierarchyError):
        tree.upsert(nodes, change.withColumn("parent_id", nodes["parent_id"] + 1))


def test_outline(nodes):
    lines = ids(tree.outline(nodes, 2, 1), "line")
    assert lines[0].startswith("[message 2]") and lines[1].startswith("  [block 3]") and len(lines) == 4


def test_ranges_do_not_change_ids(spark):
    rows = [(s, t, f"s{s}", "a", "user", "A b. C d.\n\nE", NOW) for s in range(40) for t in range(3)]
    m = spark.createDataFrame(rows, "session_seq long, turn long, session_id string, agent_id string, role string, content string, created_at timestamp")
    one, many = (sorted((r.node_id, r.parent_id, r.content) for r in build_nodes(m, n).collect()) for n in (1, 17))
    assert one == many and [x[0] for x in one] == list(range(1, len(one) + 1))
