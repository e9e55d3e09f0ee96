"""The methods by verb and path, for a server to mount; and a small command line over a folder of tables."""

from __future__ import annotations

import argparse
import json
import re
import sys

from .api import METHOD_NOT_FOUND, ConversationEngine

#: verb, path pattern, method; named groups are parameters.
ROUTES = (
    ("POST", r"/store", "store"),
    ("POST", r"/blocks", "store_block"),
    ("POST", r"/statements", "store_statement"),
    ("POST", r"/query", "query"),
    ("POST", r"/drill_down", "drill_down"),
    ("POST", r"/zoom_out", "zoom_out"),
    ("POST", r"/context", "get_context"),
    ("GET", r"/sessions", "list_sessions"),
    ("GET", r"/sessions/(?P<session_id>[^/]+)", "get_session"),
)
NODE = re.compile(r"/nodes/(\d+)")


def handle(engine: ConversationEngine, verb: str, path: str, body: str = "") -> tuple[int, str]:
    """Status and body of one request."""
    if verb == "POST" and path == "/rpc":
        return 200, engine.rpc(body)
    if verb == "GET" and path == "/health":
        return 200, json.dumps(engine.health())
    if verb == "GET" and path == "/metrics":
        return 200, engine.metrics()
    if verb == "GET" and (m := NODE.fullmatch(path)):
        rows = [json.loads(x) for x in engine.get_node(int(m[1])).toJSON().collect()]
        return (200, json.dumps(rows[0])) if rows else (404, json.dumps({"error": f"node {m[1]} not found"}))
    for v, pattern, method in ROUTES:
        if v == verb and (m := re.fullmatch(pattern, path)):
            try:
                params = json.loads(body) if body else {}
            except ValueError:
                return 400, json.dumps({"error": "parse error"})
            out = json.loads(engine.rpc(json.dumps({"jsonrpc": "2.0", "id": 0, "method": method, "params": params | m.groupdict()})))
            if "error" in out:
                return 404 if out["error"]["code"] == -32000 else 400, json.dumps({"error": out["error"]["message"]})
            return 200, json.dumps(out["result"])
    return 404, json.dumps({"error": "not found", "code": METHOD_NOT_FOUND})


def main(argv: list[str] | None = None) -> int:
    """python -m loomtree.plans.rest TABLES sessions | tree SESSION | node ID | query TEXT"""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ..operators import tree
    from .api import node_lines, result_lines, session_lines
    from .ingest import conversations

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("tables", help="folder with conversations.parquet")
    parser.add_argument("what", choices=("sessions", "tree", "node", "query"))
    parser.add_argument("value", nargs="?", default="")
    parser.add_argument("-k", type=int, default=20)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loomtree").getOrCreate()
    engine = ConversationEngine(spark, conversations(spark.read.parquet(f"{args.tables}/conversations.parquet")), dim=64)
    if args.what == "sessions":
        lines = session_lines(engine.list_sessions(limit=args.k))
    elif args.what == "tree":
        root = engine.nodes.filter((F.col("session_id") == args.value) & (F.col("level") == 3)).agg(F.min("node_id")).first()[0]
        lines = tree.outline(engine.nodes, root if root is not None else -1, 3)
    elif args.what == "node":
        lines = node_lines(engine.get_context(int(args.value)))
    else:
        lines = result_lines(engine.query(args.value, k=args.k))
    for r in lines.collect():
        print(r["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
