"""The five service calls as named tools: a description and a schema for each, checked arguments, plain results."""

from __future__ import annotations

import inspect
import json
import typing
from collections.abc import Callable
from dataclasses import dataclass
from types import NoneType, UnionType

from .session import Session

_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object", NoneType: "null"}

#: What each call is for, as a client is told.
CALLS = {
    "ingest_artifact": "Store a source file, parse it by its type, and fold what it shows into the graph.",
    "query_graph": "Nodes of a type that pass filters (field, op, value; op is eq, contains, gt, lt or exists), and how many there are in all.",
    "get_node_provenance": "Where a node comes from: its hash, derivation and source file. The key is as query_graph returns it.",
    "commit_finding": "Record a claim. All cited nodes must exist; the confidence is lowered to what they support.",
    "list_evidence": "All stored sources, and the size of the graph.",
}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    schema: dict
    run: Callable[..., dict]


def schema_of(call: Callable) -> dict:
    """The JSON schema of a call's arguments, from its annotations."""
    hints = typing.get_type_hints(call)
    properties, required = {}, []
    for name, p in inspect.signature(call).parameters.items():
        hint = hints.get(name, str)
        members = typing.get_args(hint) if isinstance(hint, UnionType) or typing.get_origin(hint) is typing.Union else (hint,)
        kinds = [_KINDS[typing.get_origin(m) or m] for m in members]
        properties[name] = {"type": kinds[0] if len(kinds) == 1 else kinds}
        if p.default is inspect.Parameter.empty:
            required.append(name)
        else:
            properties[name]["default"] = p.default
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


def fits(value: object, kind: str | list[str]) -> bool:
    kinds = [kind] if isinstance(kind, str) else kind
    return any(isinstance(value, t) and not (isinstance(value, bool) and k in ("integer", "number")) for t, k in _KINDS.items() if k in kinds)


class Service:
    """The calls of one session. Problems with a name or with arguments are results, not exceptions."""

    def __init__(self, session: Session) -> None:
        self.session = session
        self.tools = {name: Tool(name, text, schema_of(getattr(session, name)), getattr(session, name)) for name, text in CALLS.items()}

    def listing(self) -> list[dict]:
        return [{"name": t.name, "description": t.description, "inputSchema": t.schema} for t in self.tools.values()]

    def call(self, name: str, arguments: dict | None = None) -> dict:
        tool, arguments = self.tools.get(name), dict(arguments or {})
        if tool is None:
            return {"status": "error", "error": "unknown_tool", "message": f"no tool {name!r}; there are {sorted(self.tools)}"}
        known = tool.schema["properties"]
        bad = [f"{a} is missing" for a in tool.schema["required"] if a not in arguments]
        bad += [f"{a} is unknown" if a not in known else f"{a} must be {known[a]['type']}" for a, v in arguments.items() if a not in known or not fits(v, known[a]["type"])]
        if bad:
            return {"status": "error", "error": "bad_arguments", "message": "; ".join(bad)}
        return json.loads(json.dumps(tool.run(**arguments), default=str))


def build_server(session: Session, server: object | None = None) -> object:
    """The session's calls on a tool server: any object with a FastMCP-like `tool(name, description)` decorator, or a Service where none is given."""
    if server is None:
        return Service(session)
    for t in Service(session).tools.values():
        server.tool(name=t.name, description=t.description)(t.run)
    return server
