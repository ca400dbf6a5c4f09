"""The tools over JSON-RPC lines: one request a line on standard input, one response a line on standard output.

Requests are read strictly: UTF-8 within a size, no repeated keys, no NaN, bounded nesting, version 2.0, ids that are strings,
whole numbers or null.  A request without an id is a notification and gets no response."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any

from symloom.schema import RequestError

# Limits and error codes of the protocol.
MAX_REQUEST_BYTES, MAX_DEPTH = 128 << 20, 64
PARSE, INVALID, NO_METHOD, BAD_PARAMS, FAILED = -32700, -32600, -32601, -32602, -32000


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is given twice")
    return out


def _constant(name: str) -> Any:
    raise ValueError(f"{name} isn't JSON")


def loads(text: str) -> Any:
    try:
        value = json.loads(text, parse_constant=_constant, object_pairs_hook=_unique)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(MAX_DEPTH + 1):
        level = [c for v in level if isinstance(v, (list, dict)) for c in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError(f"nested deeper than {MAX_DEPTH}")


def _id(request: Any) -> Any:
    value = request.get("id") if isinstance(request, dict) else None
    return value if value is None or (isinstance(value, (str, int)) and not isinstance(value, bool)) else None


def error(request_id: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": request_id, "error": {"code": code, "message": message}}


class Gateway:
    """``methods``: initialize, tools/list and tools/call; the tools by their own names too."""

    def __init__(self, tools: dict[str, Callable]):
        self.tools = tools

    def line(self, text: str) -> str | None:
        """The response to a line, or nothing for a blank line or a notification."""
        if not text.strip():
            return None
        if len(text.encode("utf-8", "replace")) > MAX_REQUEST_BYTES:
            return json.dumps(error(None, INVALID, f"a request of over {MAX_REQUEST_BYTES} bytes"))
        try:
            request = loads(text)
        except ValueError as e:
            return json.dumps(error(None, PARSE, f"invalid JSON: {e}"), ensure_ascii=False)
        response = self.handle(request)
        silent = isinstance(request, dict) and request.get("jsonrpc") == "2.0" and "id" not in request and isinstance(request.get("method"), str) and request["method"]
        if silent:
            return None
        try:
            return json.dumps(response, ensure_ascii=False, allow_nan=False, default=_plain)
        except (TypeError, ValueError) as e:
            return json.dumps(error(_id(request), FAILED, f"the result is no JSON: {e}"), ensure_ascii=False)

    def handle(self, request: Any) -> dict:
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str) or not request["method"]:
            return error(_id(request), INVALID, "a request is an object with jsonrpc 2.0 and a method")
        if "id" in request and _id(request) != request["id"]:
            return error(None, INVALID, "an id is a string, a whole number or null")
        method, params = request["method"], request.get("params", {})
        if not isinstance(params, dict):
            return error(_id(request), BAD_PARAMS, "params must be an object")
        if method == "initialize":
            return self._result(request, {"serverInfo": {"name": "symloom"}, "capabilities": {"tools": {}}})
        if method == "tools/list":
            return self._result(request, {"tools": [{"name": n} for n in sorted(self.tools)]})
        if method == "tools/call":
            method, params = params.get("name"), params.get("arguments", {})
            if not isinstance(params, dict):
                return error(_id(request), BAD_PARAMS, "arguments must be an object")
        if method not in self.tools:
            return error(_id(request), NO_METHOD, f"no method {method!r}")
        try:
            return self._result(request, self.tools[method](**params))
        except (RequestError, TypeError, KeyError) as e:
            return error(_id(request), BAD_PARAMS, str(e))
        except Exception as e:  # noqa: BLE001
            return error(_id(request), FAILED, str(e).split("\n")[0])

    @staticmethod
    def _result(request: dict, value: Any) -> dict:
        return {"jsonrpc": "2.0", "id": _id(request), "result": value}

    def serve(self, lines=None, out=None) -> None:
        lines, out = lines or sys.stdin, out or sys.stdout
        for text in lines:
            if (response := self.line(text)) is not None:
                try:
                    out.write(response + "\n")
                    out.flush()
                except BrokenPipeError:
                    return


def _plain(value: Any) -> Any:
    if isinstance(value, (set, frozenset, tuple)):
        return sorted(value) if isinstance(value, (set, frozenset)) else list(value)
    raise TypeError(type(value).__name__)


def main() -> None:
    """``python -m symloom.gateway /path/to/workspace``"""
    from pyspark.sql import SparkSession

    from symloom.api import Engine

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    Gateway(Engine(spark, root=sys.argv[1] if len(sys.argv) > 1 else ".").tools()).serve()


if __name__ == "__main__":
    main()
