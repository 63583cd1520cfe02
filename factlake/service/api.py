"""The text store behind HTTP, a command line and JSON-RPC over standard input."""

from __future__ import annotations

import argparse
import json
import os
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from ..plans.store import DIM, Store
from ..sources import ingest

PORT, K = 7700, 5


def bounds(asked: dict) -> dict:
    """Options of a query; a category that isn't a whole number of at least 0 is no filter."""
    category = asked.get("category")
    whole = isinstance(category, int) and not isinstance(category, bool) and category >= 0
    return {"category": category % 256 if whole else None, "at_least": asked.get("min_amount"), "at_most": asked.get("max_amount")}


def matches(rows: DataFrame) -> list[dict]:
    return [r.asDict() for r in rows.collect()]


def load(store: Store, body: str) -> dict:
    done = store.load(ingest.from_body(store.spark, body))
    return {"loaded": done.given, "new": done.new, "indexed": store.indexed()}


def query(store: Store, asked: dict) -> dict:
    if not isinstance(asked.get("text"), str):
        raise ValueError("a query needs a text")
    return {"matches": matches(store.query(asked["text"], int(asked.get("k", K)), **bounds(asked)))}


def respond(store: Store, method: str, path: str, body: str) -> tuple[int, dict]:
    """Status and answer of a request; a query string is no part of the path."""
    path = path.partition("?")[0]
    try:
        if (method, path) == ("GET", "/health"):
            return (200 if store.is_healthy() else 500), {"status": "ok" if store.is_healthy() else "failed", "indexed": store.indexed()}
        if (method, path) == ("GET", "/stats"):
            return 200, {"indexed": store.indexed(), "dim": store.dim}
        if (method, path) == ("POST", "/grains"):
            return 200, load(store, body)
        if (method, path) == ("POST", "/query"):
            return 200, query(store, json.loads(body))
        return 404, {"error": "not found"}
    except (ValueError, KeyError, TypeError) as error:
        return 400, {"error": str(error)}
    except Exception as error:  # the service goes on
        return 500, {"error": str(error)[:500]}


def serve(store: Store, port: int | None = None) -> ThreadingHTTPServer:
    """A server on the port (FACTLAKE_PORT, else 7700); the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, out = respond(store, self.command, self.path, body)
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", int(os.environ.get("FACTLAKE_PORT", PORT)) if port is None else port), Handler)


def arguments(required: list[str], **kinds: str | dict) -> dict:
    """JSON schema of a tool's arguments."""
    described = {n: {"type": k} if isinstance(k, str) else k for n, k in kinds.items()}
    return {"type": "object", "properties": described} | ({"required": required} if required else {})


FACT = arguments(["sid", "text"], sid="integer", text="string", category="integer", amount="integer")

#: Tool -> what it does, its arguments.
TOOLS = {
    "grain_load": ("Load text facts; a sid that is there already stays as it is", arguments(["grains"], grains={"type": "array", "items": FACT})),
    "grain_query": (
        "Find the facts nearest to a text, of a category and between amounts if given",
        arguments(["text"], text="string", category="integer", min_amount="integer", max_amount="integer", k="integer"),
    ),
    "grain_stats": ("Count the facts that a query can find", arguments([])),
}


def use(store: Store, tool: str, given: dict) -> dict:
    """A tool's result; one that can't be had is told as such, not as an error of the protocol."""
    try:
        if tool == "grain_load" and not isinstance(given.get("grains"), list):
            raise ValueError("'grains' must be an array")
        done = load(store, json.dumps(given)) if tool == "grain_load" else query(store, given) if tool == "grain_query" else {"indexed": store.indexed()}
    except Exception as error:
        return {"content": [{"type": "text", "text": str(error)[:500]}], "isError": True}
    return {"content": [{"type": "text", "text": json.dumps(done)}]}


def rpc(store: Store, line: str) -> dict | None:
    """Answer to one JSON-RPC line: initialize, ping, tools/list, tools/call; None for a notice."""
    try:
        asked = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if "id" not in asked:
        return None
    method, params = asked.get("method"), asked.get("params") or {}
    answer: dict = {"jsonrpc": "2.0", "id": asked["id"]}
    try:
        if method == "initialize":
            result: dict = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "factlake", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": a} for n, (d, a) in TOOLS.items()]}
        elif method == "tools/call" and params.get("name") in TOOLS:
            result = use(store, params["name"], params.get("arguments") or {})
        else:
            return answer | {"error": {"code": -32601, "message": "method not found"}}
    except (ValueError, KeyError, TypeError) as error:
        return answer | {"error": {"code": -32602, "message": str(error)}}
    return answer | {"result": result}


def table(found: list[dict]) -> str:
    """Matches as aligned text."""
    rows = [("sid", "category", "amount", "distance", "text")]
    rows += [(str(m["sid"]), str(m["category"]), str(m["amount"]), f"{m['distance']:.4f}", m["text"].replace("\n", " ")[:60]) for m in found]
    widths = [max(len(r[i]) for r in rows) for i in range(5)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def main(args: list[str] | None = None) -> int:
    """The command line: serve and rpc run the store; stats, health, load FILE, query TEXT and repl
    ask a running server. FACTLAKE_PATH, FACTLAKE_DIM and FACTLAKE_PORT stand for flags not given."""
    parser = argparse.ArgumentParser(prog="factlake")
    parser.add_argument("--server", default=f"http://127.0.0.1:{PORT}")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("stats", "health", "repl"):
        sub.add_parser(name)
    sub.add_parser("load").add_argument("file")
    asked = sub.add_parser("query")
    asked.add_argument("text")
    for flag, kind in (("--category", int), ("--min", int), ("--max", int)):
        asked.add_argument(*(["-c"] if flag == "--category" else []), flag, type=kind)
    asked.add_argument("-k", type=int, default=K)
    for name in ("serve", "rpc"):
        own = sub.add_parser(name)
        own.add_argument("--path", default=os.environ.get("FACTLAKE_PATH"))
        own.add_argument("--dim", type=int, default=int(os.environ.get("FACTLAKE_DIM", DIM)))
        own.add_argument("--port", type=int)
    given = parser.parse_args(args)
    if given.command in ("serve", "rpc"):
        if not given.path:
            parser.error("--path or FACTLAKE_PATH must say where the store is")
        store = Store(SparkSession.builder.appName("factlake").getOrCreate(), given.path, given.dim)
        if given.command == "serve":
            serve(store, given.port).serve_forever()
        for line in sys.stdin:
            if (answer := rpc(store, line)) is not None:
                print(json.dumps(answer), flush=True)
        return 0

    def call(path: str, body: bytes | None = None) -> dict:
        with urlopen(Request(given.server + path, data=body)) as got:
            return json.loads(got.read())

    def ask(text: str, **more) -> None:
        body = {"text": text} | {k: v for k, v in more.items() if v is not None}
        print(table(call("/query", json.dumps(body).encode())["matches"]))

    if given.command in ("stats", "health"):
        print(json.dumps(call(f"/{given.command}")))
    elif given.command == "load":
        with open(given.file, "rb") as file:
            print(json.dumps(call("/grains", file.read())))
    elif given.command == "query":
        ask(given.text, category=given.category, min_amount=given.min, max_amount=given.max, k=given.k)
    else:
        for line in sys.stdin:
            if line.strip():
                ask(line.strip())
    return 0
