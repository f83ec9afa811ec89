"""A small HTTP API over an index."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from findery.plans.index import SearchIndex, Trace
from findery.plans.model import DocumentInput, SearchMode
from findery.sources.documents import from_inputs


def openapi() -> dict:
    ref = lambda n: {"content": {"application/json": {"schema": {"$ref": f"#/components/schemas/{n}"}}}}
    text, texts = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    post = lambda body, out: {"post": {"tags": ["search"], "requestBody": ref(body), "responses": {"200": {"description": "done"} | ref(out), "500": {"description": "failed"} | ref("StatusResponse")}}}
    return {
        "openapi": "3.1.0", "info": {"title": "findery", "version": "1"},
        "paths": {"/health": {"get": {"tags": ["search"], "responses": {"200": {"description": "up"} | ref("StatusResponse")}}}, "/search": post("SearchRequest", "SearchResponse"), "/documents": post("DocumentInput", "StatusResponse"), "/documents/update": post("DocumentInput", "StatusResponse"), "/documents/delete": post("DeleteRequest", "StatusResponse")},
        "components": {"schemas": {
            "SearchModeRequest": {"type": "string", "enum": [m.value for m in SearchMode]},
            "SearchRequest": {"type": "object", "required": ["query"], "properties": {"query": text, "mode": {"$ref": "#/components/schemas/SearchModeRequest"}, "top_k": {"type": "integer", "minimum": 0}}},
            "SearchResponse": {"type": "object", "properties": {"results": {"type": "array", "items": {"type": "object"}}, "plan": {"type": "object"}}},
            "DocumentInput": {"type": "object", "required": ["bundle_path", "file_path", "body"], "properties": {"bundle_path": text, "file_path": text, "frontmatter": {"type": "object"}, "body": text}},
            "DeleteRequest": {"type": "object", "properties": {"doc_ids": texts, "logical_keys": texts}},
            "StatusResponse": {"type": "object", "properties": {"status": text}},
        }},
    }


def handle(index: SearchIndex, lock: threading.Lock, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and JSON of a request. Bad requests give 400 or 422, failures 500, with the message as status."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    if (method, path) == ("GET", "/openapi.json"):
        return 200, openapi()
    if method != "POST" or path not in ("/search", "/documents", "/documents/update", "/documents/delete"):
        return 404, {"status": "not found"}
    try:
        data = json.loads(body)
    except ValueError as e:
        return 400, {"status": str(e)}
    try:
        if path == "/search":
            query, mode, k = data["query"], SearchMode(data.get("mode") or "hybrid"), int(data["top_k"] if data.get("top_k") is not None else 10)
        elif path == "/documents/delete":
            keys, ids = list(data.get("logical_keys") or []), list(data.get("doc_ids") or [])
        else:
            docs = [DocumentInput(d["bundle_path"], d["file_path"], d.get("frontmatter") or {}, d["body"]) for d in (data if isinstance(data, list) else [data])]
    except (KeyError, TypeError, ValueError) as e:
        return 422, {"status": str(e)}
    try:
        with lock:
            if path == "/search":
                return 200, {"results": [r.asDict() for r in index.search(query, mode, k).collect()], "plan": index.trace(query, mode)}
            if path == "/documents/delete":
                if keys:
                    index.delete_logical_keys(keys)
                if ids:
                    index.delete_doc_ids(ids)
                return 200, {"status": "deleted"}
            rows = from_inputs(index.spark, docs)
            index.update(rows) if path.endswith("update") else index.add(rows)
            return 200, {"status": "updated" if path.endswith("update") else "indexed"}
    except Exception as e:  # the API answers every failure
        return 500, {"status": str(e)}


def json_parts(out: dict) -> Iterator[str]:
    """The JSON of an answer in pieces; a trace is not gathered first."""
    for i, (k, v) in enumerate(out.items()):
        yield ("{" if not i else ", ") + json.dumps(k) + ": "
        if isinstance(v, Trace):
            yield from v.parts()
        else:
            yield json.dumps(v, ensure_ascii=False)
    yield "}"


def server(index: SearchIndex, bind: str) -> ThreadingHTTPServer:
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self) -> None:
            status, out = handle(index, lock, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            held: list[str] = []
            for part in json_parts(out):
                held.append(part)
                if len(held) == 1000:
                    self.chunk("".join(held).encode())
                    held = []
            self.chunk("".join(held).encode())
            self.wfile.write(b"0\r\n\r\n")

        def chunk(self, data: bytes) -> None:
            if data:
                self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")

        do_GET = do_POST = answer

        def log_message(self, *args) -> None:
            pass

    host, _, port = bind.rpartition(":")
    return ThreadingHTTPServer((host, int(port)), Handler)
