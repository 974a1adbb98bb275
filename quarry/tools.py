"""The tool server: functions that give JSON, and their transport over standard input and output.

The transport is JSON-RPC 2.0, one message per line, with the methods of the Model
Context Protocol that a server of tools needs.
"""

from __future__ import annotations

import json
import sys
from typing import TextIO

from quarry.workspace import Workspace

#: Revision of the protocol, and JSON-RPC's error numbers (fixed values).
PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602


def _json(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def workspace_info(workspace: Workspace) -> str:
    return json.dumps(_json(workspace.info())[0] | {"root": workspace.root}, indent=2)


def workspace_sync(workspace: Workspace) -> str:
    upserted, removed, embedded = workspace.sync_and_embed()
    return json.dumps({"upserted": upserted, "removed": removed, "embedded": embedded})


def workspace_rebuild(workspace: Workspace) -> str:
    upserted, removed = workspace.rebuild()
    return json.dumps({"upserted": upserted, "removed": removed})


def search(workspace: Workspace, query: str, limit: int = 10) -> str:
    """At most ``limit`` files, best first."""
    return json.dumps(_json(workspace.search(query, limit)), indent=2, ensure_ascii=False)


TOOLS = {"workspace_info": workspace_info, "workspace_sync": workspace_sync, "workspace_rebuild": workspace_rebuild, "search": search}

_NOTHING = {"type": "object", "properties": {}}
_SEARCH = {
    "type": "object",
    "properties": {"query": {"type": "string", "description": "words, phrases, AND, OR, NOT"}, "limit": {"type": "integer", "minimum": 0, "default": 10}},
    "required": ["query"],
}
DESCRIBED = [
    {"name": "workspace_info", "description": "Root, store, version and counts of the workspace.", "inputSchema": _NOTHING},
    {"name": "workspace_sync", "description": "Bring the index up to date with the files; counts of written, removed and embedded rows.", "inputSchema": _NOTHING},
    {"name": "workspace_rebuild", "description": "Forget the index and build it again.", "inputSchema": _NOTHING},
    {"name": "search", "description": "Files that match, best first, with the matching line ranges; by text and, if configured, by meaning.", "inputSchema": _SEARCH},
]
INSTRUCTIONS = "Searches the text files of a workspace. workspace_sync follows changed files; search does so by itself."


class _Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _call(workspace: Workspace, params: dict) -> dict:
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        raise _Refused(INVALID_PARAMS, f"unknown tool: {name}")
    known = _SEARCH["properties"] if name == "search" else {}
    told = {k: v for k, v in given.items() if k in known and v is not None} if isinstance(given, dict) else {}
    if name == "search" and not (isinstance(told.get("query"), str) and type(told.get("limit", 10)) is int and told.get("limit", 10) >= 0):
        raise _Refused(INVALID_PARAMS, "search needs a query (text) and takes a limit (a number, 0 or more)")
    try:
        return {"content": [{"type": "text", "text": TOOLS[name](workspace, **told)}], "isError": False}
    except Exception as e:  # noqa: BLE001 - the caller is told, the server goes on
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}


def answer(workspace: Workspace, message: object) -> dict | None:
    """The answer to one message; None for a notification."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "not a request"}}
    if "id" not in message:
        return None
    params = message.get("params")
    try:
        match message["method"]:
            case "initialize":
                about = {"name": "quarry", "version": "0"}
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": about, "instructions": INSTRUCTIONS}
            case "ping":
                result = {}
            case "tools/list":
                result = {"tools": DESCRIBED}
            case "tools/call":
                result = _call(workspace, params if isinstance(params, dict) else {})
            case other:
                raise _Refused(UNKNOWN_METHOD, f"unknown method: {other}")
    except _Refused as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(workspace: Workspace, source: TextIO | None = None, sink: TextIO | None = None) -> None:
    """Answer messages line by line until the input ends."""
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if not line.strip():
            continue
        try:
            given = json.loads(line)
        except ValueError:
            said: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}}
        else:
            said = answer(workspace, given)
        if said is not None:
            sink.write(json.dumps(said, ensure_ascii=False) + "\n")
            sink.flush()
