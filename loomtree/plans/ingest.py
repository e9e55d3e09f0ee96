"""Ingest: messages to the tables nodes, embeddings, postings and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import level_name
from ..operators.parsing import parse_h
from ..profile import BLOCK, MESSAGE, SESSION, STATEMENT

MESSAGE_COLUMNS = ("session_seq", "turn", "session_id", "agent_id", "role", "content", "created_at")


def conversations(raw: DataFrame, blank_lines: bool = True) -> DataFrame:
    """The fixture's conversations as messages; with blank_lines every line is a paragraph."""
    text = F.coalesce("text", F.lit(""))
    content = F.replace(text, F.lit("\n"), F.lit("\n\n")) if blank_lines else text
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return raw.select(
        F.col("conv_id").alias("session_seq"),
        "turn",
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("session_id"),
        F.concat(F.lit("agent-"), F.col("conv_id") % 5).alias("agent_id"),
        "role",
        content.alias("content"),
        created.alias("created_at"),
    )


_NODE = "struct<node_id:long,level:tinyint,parent_id:long,role:string,content:string,block_type:string,lang:string,stmt_type:string,sequence_num:long>"


def _node(offset: Column, level: int, parent: Column, content: Column, kind: Column | None = None, lang: Column | None = None, stmt: Column | None = None) -> Column:
    """A node so many places after its message."""
    void = F.lit(None)
    fields = (F.col("message_id") + offset, F.lit(level), parent, F.col("role"), content, kind, lang, stmt, F.col("message_seq") + offset)
    return F.struct(*(void if f is None else f for f in fields)).cast(_NODE)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most key, in two steps of about the square root of their number each."""
    wide = max(1, int(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    block = F.size(F.filter(longs(cuts[::wide]), lambda x: x <= key))
    fine = F.array(longs([]), *[longs(cuts[i + 1 : i + wide]) for i in range(0, len(cuts), wide)])
    # The first cut of a block counts for itself, and the blocks before it for all of theirs.
    return F.when(block == 0, 0).otherwise((block - 1) * wide + 1 + F.size(F.filter(F.element_at(fine, block + 1), lambda x: x <= key)))


def build_nodes(messages: DataFrame, ranges: int | None = None) -> DataFrame:
    """The tree in the order of ingest (session_seq, turn): for a new session its root, then message, block, statements, block, ...

    node_id counts from 1 in that order. sequence_num shares one counter with the sessions' own records: a new session takes two
    numbers, a message in a known one takes one more than its nodes. Empty statements are not stored.

    Ids are prefix sums over all messages. Sessions are dealt to ranges of session_seq; a task sums inside a range, and the ranges'
    totals, one row each, are added to that. So messages are shuffled once, and each gives all its nodes in one step. There is a range for
    about every 100,000 messages, 64 at least and 10,000 at most.
    """
    if ranges is None:
        ranges = min(10_000, max(64, messages.count() // 100_000))
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = sorted({int(x) for x in (messages.agg(F.percentile_approx("session_seq", probabilities, 10 * max(1000, ranges))).first()[0] or [])})
    kept = F.transform("blocks", lambda b: F.filter(b["statements"], lambda s: s["content"] != ""))
    parsed = messages.withColumn("range", _range_of(F.col("session_seq"), cuts)).withColumn("blocks", parse_h(F.col("content")))
    parsed = parsed.withColumn("kept", kept).withColumn("inner", F.aggregate("kept", F.lit(0).cast("long"), lambda n, x: n + F.size(x) + 1))
    totals = parsed.groupBy("range").agg(F.sum("inner").alias("inner"), F.count("*").alias("n"), F.countDistinct("session_seq").alias("sessions"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select("range", earlier(F.col("inner") + F.col("n") + F.col("sessions")).alias("ids0"), earlier(F.col("inner") + 2 * F.col("n") + F.col("sessions")).alias("seqs0"))
    session = Window.partitionBy("range", "session_seq")
    inside = Window.partitionBy("range").orderBy("session_seq", "turn").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    rows = parsed.repartition("range").withColumn("is_first", (F.col("turn") == F.min("turn").over(session)).cast("long"))
    rows = rows.withColumn("ids", running(F.col("inner") + 1 + F.col("is_first"))).withColumn("seqs", running(F.col("inner") + 2 + F.col("is_first")))
    rows = rows.join(F.broadcast(totals), "range").withColumn("ids", F.col("ids") + F.col("ids0")).withColumn("seqs", F.col("seqs") + F.col("seqs0"))
    rows = rows.withColumn("root_id", F.min(F.col("ids") + 1).over(session))
    rows = rows.withColumn("message_id", F.col("ids") + F.col("is_first") + 1).withColumn("message_seq", F.col("seqs") + F.col("is_first") + 2)
    # How many nodes of the message come before each block.
    rows = rows.withColumn("starts", F.transform("kept", lambda _, i: F.aggregate(F.slice("kept", 1, i), F.lit(1), lambda n, x: n + F.size(x) + 1)))
    root = F.struct(F.col("root_id"), F.lit(SESSION), F.lit(None), F.lit(None), F.lit(""), F.lit(None), F.lit(None), F.lit(None), F.col("seqs") + 1).cast(_NODE)

    def block(z: Column, i: Column) -> Column:
        start = F.get("starts", i)
        own = _node(start, BLOCK, F.col("message_id"), z["content"], z["type"], z["lang"])
        return F.concat(F.array(own), F.transform(F.get("kept", i), lambda s, k: _node(start + k + 1, STATEMENT, F.col("message_id") + start, s["content"], stmt=s["type"])))

    head = _node(F.lit(0), MESSAGE, F.col("root_id"), F.col("content"))
    none = F.array().cast(f"array<{_NODE}>")
    nodes = F.concat(F.when(F.col("is_first") == 1, F.array(root)).otherwise(none), F.array(head), F.flatten(F.transform("blocks", block)))
    out = rows.select("agent_id", "session_id", "created_at", F.explode(nodes).alias("n")).select("n.*", "agent_id", "session_id", "created_at")
    return out.withColumn("level_name", level_name(F.col("level")))


def with_ordinals(nodes: DataFrame) -> DataFrame:
    """Position among siblings (0 first); roots have null."""
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("node_id")) - 1
    children = nodes.filter("parent_id IS NOT NULL").withColumn("ordinal", place)
    return children.unionByName(nodes.filter("parent_id IS NULL").withColumn("ordinal", F.lit(None).cast("int")))
