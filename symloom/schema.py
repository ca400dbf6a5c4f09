"""Table schemas and the limits that requests are checked against before a job is planned."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
_LIST = T.ArrayType(_S)

FACT = T.StructType().add("spelling", _S).add("call_arities", T.ArrayType(T.IntegerType())).add("details", T.MapType(_S, _S))

#: A call with the paths that it may mean, nearest first, and the type around it.
CALL = T.StructType().add("name", _S).add("arity", T.IntegerType()).add("kind", _S).add("paths", _LIST).add("within", _S)

#: One declaration, before references are resolved.
RAW_SYMBOLS = (
    T.StructType()
    .add("symbol_id", _S).add("semantic_path", _S).add("scope_path", _S).add("file_path", _S).add("node_kind", _S)
    .add("start_byte", _L).add("end_byte", _L).add("signature", _S).add("parameters", _LIST).add("return_type", _S)
    .add("docstring", _S).add("extension_receiver", _S).add("reference_names", _LIST)
    .add("reference_call_arities", T.MapType(_S, T.ArrayType(T.IntegerType()))).add("reference_facts", T.ArrayType(FACT))
    .add("is_overload", T.BooleanType()).add("calls", T.ArrayType(CALL)).add("bases", T.ArrayType(_LIST)).add("interfaces", T.ArrayType(_LIST))
)

FILES = T.StructType().add("file_path", _S).add("language", _S).add("source", _S).add("size_bytes", _L)
EDGES = T.StructType().add("src", _S).add("dst", _S)
FILE_STATE = T.StructType().add("file_path", _S).add("fingerprint", _S)

# Limits of requests.
MAX_LIMIT, MAX_DEPTH, MAX_NODES, MAX_TIMEOUT_MS = 10_000, 64, 10_000, 300_000
DEFAULT_FILES, MAX_FILES, MAX_FILE_BYTES = 20_000, 200_000, 64 << 20
MAX_CAPTURES, DEFAULT_CAPTURES, MAX_MATCHES, MAX_PATTERN_BYTES = 100_000, 10_000, 32_768, 64 << 10
MAX_REPLACEMENT, MAX_REASON, MAX_EDITS, MAX_PREVIEW_FILES, MAX_BATCH, MAX_WATCH = 4 << 20, 4 << 10, 10_000, 32, 32, 256
DEFAULT_LIST, DEFAULT_SEARCH, DEFAULT_DEPTH, DEFAULT_NODES, SKELETON_DEPTH = 100, 20, 2, 64, 2


class RequestError(ValueError):
    """A request that is refused before any job runs."""


def within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise RequestError(f"{name} must be from {low} to {high}, not {value}")
    return value


def nonblank(name: str, value: str) -> str:
    value = value.strip()
    if not value:
        raise RequestError(f"{name} must not be blank")
    return value
