"""Replacements of Python definitions: dedented, put at the target's place, with the file's unit of indentation."""

from __future__ import annotations

import io
import tokenize
from functools import reduce
from math import gcd


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip(" \t"))]


def _inside_strings(text: str) -> set[int]:
    """Rows, from 0, that begin inside a string: their spaces are text."""
    rows: set[int] = set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in (tokenize.STRING, getattr(tokenize, "FSTRING_MIDDLE", -1)):
                rows.update(range(t.start[0], t.end[0]))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return rows


def unit_of(text: str) -> str:
    """A tab, or as many spaces as all indentations have in common; empty where nothing is indented."""
    inside = _inside_strings(text)
    indents = [_indent(x) for k, x in enumerate(text.split("\n")) if x.strip() and k not in inside]
    if any(i.startswith("\t") for i in indents):
        return "\t"
    width = reduce(gcd, (len(i) for i in indents), 0)
    return " " * width


def dedented(text: str) -> str:
    """Without the indentation that all lines share."""
    lines = text.split("\n")
    least = min((len(_indent(x)) for x in lines if x.strip()), default=0)
    return "\n".join(x[min(least, len(_indent(x))) :] for x in lines)


def decorated(text: str) -> bool:
    return next((x.lstrip().startswith("@") for x in text.split("\n") if x.strip()), False)


def normalized(source: str, start: int, end: int, new_code: str) -> str:
    """new_code as it stands in place of the bytes from start to end: the first line has the target's indentation before it
    already, the others get it, in the file's unit; lines inside strings stay as they are."""
    raw = source.encode()
    line = raw[:start].rpartition(b"\n")[2].decode()
    ambient = line if not line.strip() else _indent(line)
    ending = "\r\n" if "\r\n" in source else "\n"
    code = new_code.replace("\r\n", "\n").strip("\n")
    first, _, rest = code.partition("\n")
    if ambient and rest and not _indent(first) and decorated(code) and all(x.startswith(ambient) or not x.strip() for x in rest.split("\n")):
        # written with its first line at the margin and the others in place
        code = first + "\n" + "\n".join(x[len(ambient) :] if x.startswith(ambient) else x for x in rest.split("\n"))
    code = dedented(code)
    mine, own = unit_of(code), unit_of(dedented(ambient + raw[start:end].decode())) or unit_of(source)
    inside = _inside_strings(code)
    out = []
    for k, x in enumerate(code.split("\n")):
        if k == 0 or not x.strip() or k in inside:
            out.append(x)
            continue
        indent, text = _indent(x), x.lstrip(" \t")
        if mine and own and mine != own and len(indent) % len(mine) == 0 and set(indent) <= set(mine):
            indent = own * (len(indent) // len(mine))
        out.append(ambient + indent + text)
    return ending.join(out)


def indentation_issues(source: str) -> list[dict]:
    """As ``operators.patch.indentation_issues``, for one text: lines that should be deeper than the block header before them."""
    waits, out, at = None, [], 0
    for row, line in enumerate(source.split("\n")):
        text = line.rstrip("\r")
        if text.strip() and not text.strip().startswith("#"):
            indent = len(_indent(text))
            bad = waits is not None and indent <= waits[0]
            if bad:
                out.append({"kind": "indentation", "row": row, "column_no": 0, "message": f"expected an indented block after line {waits[1] + 1}", "start_byte": at})
            waits = (indent, row) if text.strip().endswith(":") else waits if bad else None
        at += len(line.encode()) + 1
    return out


def decorator_issues(source: str) -> list[dict]:
    """Decorators that don't stand in the column of their definition."""
    out, wait = [], None
    for row, line in enumerate(source.split("\n")):
        text = line.strip()
        if text.startswith("@"):
            wait = wait or (len(_indent(line)), row)
        elif text.startswith(("def ", "class ", "async def ")) and wait:
            if len(_indent(line)) != wait[0]:
                out.append({"kind": "indentation", "row": wait[1], "column_no": wait[0], "message": f"the definition after the decorator on line {wait[1] + 1} must have its indentation"})
            wait = None
        elif text and not text.startswith("#") and wait and len(_indent(line)) <= wait[0] and not text.startswith((")", "]", "}")):
            wait = None
    return out
