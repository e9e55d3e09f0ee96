"""The engine's methods, their JSON-RPC form, counters, and text formatters. Methods return DataFrames; rpc() is the only one that collects,
and collects results cut to k rows."""

from __future__ import annotations

import json
import time
from dataclasses import fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedders
from ..functions.text import level_name
from ..operators import fulltext, ranking, sessions, tree
from ..operators.parsing import parse_h
from ..operators.ranking import HybridIndex, SearchOptions
from ..profile import DIM, LEVEL_NAMES, MESSAGE, PROFILES, SESSION, level_code
from . import ingest

PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR, NOT_FOUND = -32700, -32600, -32601, -32602, -32603, -32000
QUERY_CONTENT, ZOOM_CONTENT = 1000, 500


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class ConversationEngine:
    """A store of messages and what is derived from it. The messages given at the start are parsed, embedded and indexed once; a stored
    message adds its own nodes, vectors and postings to these and touches nothing else. Ids are given in the order of storing and stay.

    What has been stored since is held as local rows, up to `PENDING` of them; then they are folded into the cached tables.
    """

    PENDING = 5000

    def __init__(self, spark: SparkSession, messages: DataFrame | None = None, profile: str = "H", provider="stub_h", dim: int = DIM, as_of: datetime | None = None):
        self.spark, self.profile, self.provider, self.dim, self.as_of = spark, PROFILES[profile], provider, dim, as_of
        empty = "session_seq long, turn long, session_id string, agent_id string, role string, content string, created_at timestamp"
        messages = messages if messages is not None else spark.createDataFrame([], empty)
        self.counters = {"requests": 0, "errors": 0, "latency_us": 0}
        self.timings = {"plan_us": 0, "run_us": 0}  # of the last request that was answered
        self.started = time.time()
        nodes = ingest.build_nodes(messages).cache()
        vectors, postings = self._indexed(nodes)
        lengths = fulltext.doc_stats(postings.cache())
        self.base = {"messages": messages, "nodes": nodes, "vectors": vectors.cache(), "postings": postings, "lengths": lengths.cache()}
        self.pending: dict[str, list] = {name: [] for name in self.base}
        self._join_up()

    def _indexed(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Vectors and postings of nodes."""
        texts = nodes.filter("content <> ''")
        return texts.select("node_id", "level", embedders.embed(F.col("content"), self.provider, self.dim).alias("embedding")), fulltext.build_postings(texts)

    def _join_up(self) -> None:
        """The tables as they are now: what is cached and what is pending."""
        if sum(map(len, self.pending.values())) > self.PENDING:
            for name, rows in self.pending.items():
                if rows:
                    self.base[name] = self.base[name].unionByName(self.spark.createDataFrame(rows, self.base[name].schema)).cache()
                    rows.clear()
        whole = {n: df.unionByName(self.spark.createDataFrame(self.pending[n], df.schema)) if self.pending[n] else df for n, df in self.base.items()}
        self.messages, self.nodes = whole["messages"], whole["nodes"]
        self.index = HybridIndex(self.nodes, whole["postings"], whole["vectors"], whole["lengths"])
        self._sessions: DataFrame | None = None

    def _add(self, nodes: DataFrame) -> DataFrame:
        """Adds a few new nodes, with what is derived from them."""
        columns = self.base["nodes"].columns
        rows = nodes.select(*(F.col(c) if c in nodes.columns else F.lit(None).alias(c) for c in columns)).collect()
        local = self.spark.createDataFrame(rows, self.base["nodes"].schema)
        vectors, postings = self._indexed(local)
        found = postings.select(*self.base["postings"].columns).collect()
        lengths: dict[int, int] = {}
        for r in found:
            lengths[r["node_id"]] = lengths.get(r["node_id"], 0) + r["tf"]
        for name, new in (("nodes", rows), ("vectors", vectors.collect()), ("postings", found), ("lengths", list(lengths.items()))):
            self.pending[name] += new
        self._join_up()
        return local

    @property
    def sessions(self) -> DataFrame:
        """Made when asked for after a change."""
        if self._sessions is None:
            self._sessions = sessions.build_sessions(self.nodes, self.messages).cache()
        return self._sessions

    def _now(self) -> datetime:
        return self.as_of or datetime.now(UTC).replace(tzinfo=None)

    # The nine methods.

    def store(self, agent_id: str, session_id: str, content: str, role: str = "user", created_at: datetime | None = None) -> DataFrame:
        """Adds a message and gives its nodes."""
        if not content or not session_id:
            raise RpcError(INVALID_PARAMS, "session_id and content are required")
        known = self.messages.filter(F.col("session_id") == session_id).agg(F.max("session_seq").alias("s"), F.max("turn").alias("t")).first()
        fresh = known["s"] is None
        seq, turn = ((self.messages.agg(F.max("session_seq")).first()[0] or 0) + 1, 0) if fresh else (known["s"], known["t"] + 1)
        row = (seq, turn, session_id, agent_id, role, content, created_at or self._now())
        made = ingest.build_nodes(self.spark.createDataFrame([row], self.base["messages"].schema), 2)
        top = self.nodes.agg(F.max("node_id").alias("id"), F.max("sequence_num").alias("seq")).first()
        ids, numbers = top["id"] or 0, top["seq"] or 0
        parent = F.col("parent_id") + F.lit(ids)
        if not fresh:
            # The session has its root; the message takes the place that a new root had.
            root = self.nodes.filter((F.col("session_id") == session_id) & (F.col("level") == SESSION)).agg(F.min("node_id")).first()[0]
            made, ids, numbers = made.filter(F.col("level") != SESSION), ids - 1, numbers - 1
            parent = F.when(F.col("level") == MESSAGE, F.lit(root)).otherwise(F.col("parent_id") + F.lit(ids))
        made = made.withColumn("parent_id", parent).withColumn("node_id", F.col("node_id") + F.lit(ids)).withColumn("sequence_num", F.col("sequence_num") + F.lit(numbers))
        self.pending["messages"].append(row)
        local = self._add(made)
        return tree.descendants(local, local.filter(F.col("level") == MESSAGE).first()["node_id"], with_root=True)

    def _store_under(self, parent_id: int, level: int, content: str) -> DataFrame:
        if tree.get_node(self.nodes, parent_id).isEmpty():
            raise RpcError(NOT_FOUND, f"node {parent_id} not found")
        new = self.spark.createDataFrame([(parent_id, level, content, self._now())], "parent_id long, level tinyint, content string, created_at timestamp")
        before = self.nodes.agg(F.max("node_id")).first()[0]
        return self._add(tree.add_children(self.nodes, new, self.profile.name).filter(F.col("node_id") > before).withColumn("level_name", level_name(F.col("level"))))

    def store_block(self, message_id: int, content: str) -> DataFrame:
        return self._store_under(message_id, 1, content)

    def store_statement(self, block_id: int, content: str) -> DataFrame:
        return self._store_under(block_id, 0, content)

    def query(self, query: str, **options) -> DataFrame:
        known = {f.name for f in fields(SearchOptions)}
        if unknown := set(options) - known:
            raise RpcError(INVALID_PARAMS, f"unknown parameters: {sorted(unknown)}")
        vector = embedders.stub_h(query, self.dim) if self.provider == "stub_h" else embedders.stub_e(query, self.dim) if self.provider == "stub_e" else self.provider([query])[0]
        found = self.index.search(vector, SearchOptions(query=query, **options), self._now(), self.profile)
        return found.withColumn("content", F.left("content", F.lit(QUERY_CONTENT)))

    def drill_down(self, node_id: int, filter: str | None = None, max_results: int = 0) -> DataFrame:
        if self.profile.name == "E":
            self._must_exist(node_id)
            max_results = min(max_results or 100, 100)
        return tree.drill_down(self.nodes, node_id, filter, max_results)

    def zoom_out(self, node_id: int) -> DataFrame:
        if self.profile.name == "E":
            self._must_exist(node_id)
        return tree.zoom_out(self.nodes, node_id, self.profile.name)

    def get_context(self, node_id: int, include_parent: bool = True, include_siblings: bool = True, include_children: bool = True, max_depth: int = 1) -> DataFrame:
        self._must_exist(node_id)
        return tree.get_context(self.nodes, node_id, include_parent, include_siblings, include_children, max_depth)

    def list_sessions(self, agent_id: str | None = None, since: datetime | None = None, keyword: str | None = None, limit: int = 0) -> DataFrame:
        return sessions.list_sessions(self.sessions, agent_id, since, keyword, limit)

    def get_session(self, session_id: str) -> DataFrame:
        found = sessions.get_session(self.sessions, session_id)
        if found.isEmpty():
            raise RpcError(NOT_FOUND, f"session {session_id} not found")
        return found

    def get_node(self, node_id: int) -> DataFrame:
        return tree.get_node(self.nodes, node_id)

    def _must_exist(self, node_id: int) -> None:
        if tree.get_node(self.nodes, node_id).isEmpty():
            raise RpcError(NOT_FOUND, f"node {node_id} not found")

    # JSON-RPC.

    METHODS = ("store", "store_block", "store_statement", "query", "drill_down", "zoom_out", "get_context", "list_sessions", "get_session")

    def rpc(self, raw: str) -> str:
        """One request to one response; errors are envelopes, never exceptions."""
        began = time.perf_counter()
        self.counters["requests"] += 1
        id_ = None
        try:
            request = parse_request(raw)
            id_ = request.get("id")
            if request["method"] not in self.METHODS:
                raise RpcError(METHOD_NOT_FOUND, f"method not found: {request['method']}")
            params = dict(request.get("params") or {})
            if request["method"] == "get_context" and "id" in params:
                params["node_id"] = params.pop("id")
            if request["method"] in ("drill_down", "zoom_out") and "id" in params:
                params["node_id"] = params.pop("id")
            if request["method"] == "query":
                if "level" in params:
                    params["top_level"] = params["bottom_level"] = params.pop("level")
                params = {{"max_results": "k"}.get(k, k): v for k, v in params.items()}
                for name in ("top_level", "bottom_level"):
                    params[name] = level_code(params.get(name))
            try:
                found = getattr(self, request["method"])(**params)
            except (TypeError, ValueError) as e:
                raise RpcError(INVALID_PARAMS, str(e)) from e
            planned = time.perf_counter()
            rows = [json.loads(x) for x in found.toJSON().collect()]
            self.timings = {"plan_us": int((planned - began) * 1e6), "run_us": int((time.perf_counter() - planned) * 1e6)}
            for r in rows:
                if "level" in r:
                    r["level_name"] = LEVEL_NAMES[r["level"]]
            out = {"jsonrpc": "2.0", "result": rows, "id": id_}
        except RpcError as e:
            self.counters["errors"] += 1
            out = {"jsonrpc": "2.0", "error": {"code": e.code, "message": str(e)}, "id": id_}
        except Exception as e:  # the envelope's own code for anything else
            self.counters["errors"] += 1
            out = {"jsonrpc": "2.0", "error": {"code": INTERNAL_ERROR, "message": str(e)[:500]}, "id": id_}
        self.counters["latency_us"] += int((time.perf_counter() - began) * 1e6)
        return json.dumps(out)

    def health(self) -> dict:
        return {"status": "ok", "uptime_s": int(time.time() - self.started)} | self.counters

    def metrics(self) -> str:
        """Prometheus text."""
        values = self.counters | {"nodes": self.nodes.count(), "sessions": self.sessions.count(), "uptime_seconds": int(time.time() - self.started)}
        return "".join(f"# TYPE loomtree_{k} gauge\nloomtree_{k} {v}\n" for k, v in values.items())


def parse_request(raw: str) -> dict:
    try:
        request = json.loads(raw)
    except ValueError as e:
        raise RpcError(PARSE_ERROR, "parse error") from e
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not request.get("method") or not isinstance(request["method"], str):
        raise RpcError(INVALID_REQUEST, "invalid request")
    return request


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests (raw): method, id, code: the same checks on a table; code is null for good requests."""
    parsed = requests.select("raw", F.try_parse_json("raw").alias("v"))
    field = lambda n: F.try_variant_get("v", f"$.{n}", "string")
    rows = parsed.select("raw", "v", field("jsonrpc").alias("version"), field("method").alias("method"), field("id").alias("id"))
    bad = F.col("version").isNull() | (F.col("version") != "2.0") | F.col("method").isNull() | (F.col("method") == "")
    code = F.when(F.col("v").isNull(), PARSE_ERROR).when(bad, INVALID_REQUEST).when(~F.col("method").isin(*ConversationEngine.METHODS), METHOD_NOT_FOUND)
    return rows.select("raw", "method", "id", code.alias("code"))


# Formatters for agent tools and the inspector.


def result_lines(results: DataFrame, width: int = 200) -> DataFrame:
    from ..functions.text import level_name, preview

    line = F.format_string("[%s #%d] (%.3f) %s", level_name(F.col("level")), F.col("node_id"), F.col("combined_score"), preview(F.col("content"), width))
    return results.select("node_id", line.alias("line"))


def session_lines(rows: DataFrame) -> DataFrame:
    shown = F.array_join(F.slice("keywords", 1, 5), ", ")
    line = F.format_string("%s (agent %s): %d messages [%s]", F.col("session_id"), F.col("agent_id"), F.col("message_count"), shown)
    return rows.select("session_id", line.alias("line"))


def node_lines(rows: DataFrame, width: int = 200) -> DataFrame:
    from ..functions.text import level_name, preview

    return rows.select("node_id", F.format_string("[%s #%d] %s", level_name(F.col("level")), F.col("node_id"), preview(F.col("content"), width)).alias("line"))


TOOLS = {
    "memory_query": ("query", "search memory; query, level, max_results"),
    "memory_store": ("store", "store a message; agent_id, session_id, content, role"),
    "memory_drill_down": ("drill_down", "children of a node; id, filter"),
    "memory_zoom_out": ("zoom_out", "ancestors of a node; id"),
    "memory_list_sessions": ("list_sessions", "sessions; agent_id, keyword, limit"),
    "memory_get_session": ("get_session", "one session; session_id"),
    "memory_get_context": ("get_context", "a node and its surroundings; id"),
    "memory_get_node": ("get_node", "one node; node_id"),
}


def call_tool(engine: ConversationEngine, name: str, arguments: dict) -> str:
    """Text for an agent."""
    method, _ = TOOLS[name]
    args = dict(arguments)
    if "id" in args and method != "get_node":
        args["node_id"] = args.pop("id")
    if method == "query":
        if "level" in args:
            args["top_level"] = args["bottom_level"] = level_code(args.pop("level"))
        if "max_results" in args:
            args["k"] = args.pop("max_results")
    found = getattr(engine, method)(**args)
    lines = result_lines(found) if method == "query" else session_lines(found) if "session" in method else node_lines(found)
    return "\n".join(r["line"] for r in lines.collect()) or "no results"


__all__ = ["ConversationEngine", "RpcError", "call_tool", "parse_h", "parse_request", "ranking", "validate_requests"]
