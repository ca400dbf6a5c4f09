"""JSON-RPC lines: what is refused, what is answered, and what stays silent."""

import io
import json

import pytest

from symloom.gateway import MAX_DEPTH, Gateway
from symloom.schema import RequestError


def refuse(x=0):
    raise RequestError("no")


def fail():
    raise OSError("gone\nmore")


GATEWAY = Gateway({"add": lambda a, b=1: {"sum": a + b}, "refuse": refuse, "fail": fail, "nan": lambda: float("nan")})


def ask(text):
    out = GATEWAY.line(text if isinstance(text, str) else json.dumps(text))
    return None if out is None else json.loads(out)


@pytest.mark.parametrize(
    "request_, code",
    [
        ("{", -32700), ('{"a": 1, "a": 2}', -32700), ('{"x": NaN}', -32700), ("[" * (MAX_DEPTH + 2) + "]" * (MAX_DEPTH + 2), -32700), ("[]", -32600), ('{"jsonrpc": "1.0", "id": 1, "method": "add"}', -32600),
        ('{"jsonrpc": "2.0", "id": true, "method": "add"}', -32600), ('{"jsonrpc": "2.0", "id": 1.5, "method": "add"}', -32600), ('{"jsonrpc": "2.0", "id": 1, "method": "none"}', -32601),
        ('{"jsonrpc": "2.0", "id": 1, "method": "add", "params": []}', -32602), ('{"jsonrpc": "2.0", "id": 1, "method": "add", "params": {"c": 1}}', -32602), ('{"jsonrpc": "2.0", "id": 1, "method": "refuse"}', -32602),
        ('{"jsonrpc": "2.0", "id": 1, "method": "fail"}', -32000), ('{"jsonrpc": "2.0", "id": 1, "method": "nan"}', -32000), ('{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "add", "arguments": 3}}', -32602),
    ],
)
def test_refused(request_, code):
    assert ask(request_)["error"]["code"] == code


def test_answered():
    assert ask({"jsonrpc": "2.0", "id": "x", "method": "add", "params": {"a": 2}}) == {"jsonrpc": "2.0", "id": "x", "result": {"sum": 3}}
    assert ask({"jsonrpc": "2.0", "id": None, "method": "tools/call", "params": {"name": "add", "arguments": {"a": 2, "b": 2}}})["result"] == {"sum": 4}
    assert [t["name"] for t in ask({"jsonrpc": "2.0", "id": 1, "method": "tools/list"})["result"]["tools"]] == ["add", "fail", "nan", "refuse"]
    assert ask({"jsonrpc": "2.0", "method": "add", "params": {"a": 1}}) is None and ask("  ") is None


def test_served():
    out = io.StringIO()
    GATEWAY.serve(['{"jsonrpc": "2.0", "id": 1, "method": "add", "params": {"a": 1}}\n', "\n", "x\n"], out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [1, None]
