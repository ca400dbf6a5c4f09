"""Tree queries: S-expression patterns over rows of syntax trees, as joins of children with their parents.

``(kind field: (kind) @name (_) @any "text" (#eq? @name "x") (#match? @name "re"))``: a node of the kind with such children, in
any order, and captures.  ``_`` is any kind, ``[(a) (b)]`` either of several, and predicates are eq?, not-eq?, match?,
not-match? and any-of?.  Quantifiers, anchors and negated fields are refused."""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.schema import MAX_PATTERN_BYTES, RequestError, nonblank

_TOKEN = re.compile(r"""\s+|;[^\n]*|(?P<string>"(?:\\.|[^"\\])*")|(?P<sign>[()\[\]])|(?P<field>[A-Za-z_]\w*:)|(?P<predicate>\#[\w-]+\?)|(?P<capture>@[\w.-]+)|(?P<name>[A-Za-z_][\w.-]*)|(?P<bad>.)""")


@dataclasses.dataclass
class Pattern:
    kinds: list[str]
    field: str | None = None
    literal: str | None = None
    captures: list[str] = dataclasses.field(default_factory=list)
    children: list[Pattern] = dataclasses.field(default_factory=list)
    predicates: list[tuple] = dataclasses.field(default_factory=list)


def parse(text: str) -> list[Pattern]:
    """The patterns of a query; anything beyond the grammar above is an error."""
    if len(nonblank("query", text).encode()) > MAX_PATTERN_BYTES:
        raise RequestError("the query is too long")
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text) if m.lastgroup]
    at = 0

    def need(sort: str) -> str:
        nonlocal at
        if at >= len(tokens) or tokens[at][0] != sort:
            raise RequestError(f"the query has {tokens[at][1] if at < len(tokens) else 'an end'!r} where a {sort} should be")
        at += 1
        return tokens[at - 1][1]

    def one(label: str | None) -> Pattern:
        nonlocal at
        sort, word = tokens[at] if at < len(tokens) else ("end", "")
        if sort == "string":
            at += 1
            out = Pattern(["_"], label, re.sub(r"\\(.)", r"\1", word[1:-1]))
        elif word == "[":
            at += 1
            options = []
            while at < len(tokens) and tokens[at][1] != "]":
                options.append(one(None))
            at += 1
            if not options or any(o.children or o.predicates or o.captures or o.literal is not None for o in options):
                raise RequestError("an alternation holds plain kinds only")
            out = Pattern([k for o in options for k in o.kinds], label)
        elif word == "(":
            at += 1
            out = Pattern([need("name")], label)
            while at < len(tokens) and tokens[at][1] != ")":
                sort, word = tokens[at]
                if sort == "field":
                    at += 1
                    out.children.append(one(word[:-1]))
                elif word == "(" and at + 1 < len(tokens) and tokens[at + 1][0] == "predicate":
                    at += 1
                    name = need("predicate")[1:]
                    args = []
                    while at < len(tokens) and tokens[at][1] != ")":
                        args.append(tokens[at])
                        at += 1
                    at += 1
                    out.predicates.append((name, args))
                else:
                    out.children.append(one(None))
            if at >= len(tokens):
                raise RequestError("the query isn't closed")
            at += 1
        else:
            raise RequestError(f"the query has {word!r} where a node should be")
        while at < len(tokens) and tokens[at][0] == "capture":
            out.captures.append(tokens[at][1][1:])
            at += 1
        return out

    if any(sort == "bad" for sort, _ in tokens):
        raise RequestError(f"the query has {next(w for s, w in tokens if s == 'bad')!r}, which isn't supported")
    out = []
    while at < len(tokens):
        if tokens[at][1] == "(" and at + 1 < len(tokens) and tokens[at + 1][0] == "predicate" and out:
            at += 1
            name, args = need("predicate")[1:], []
            while at < len(tokens) and tokens[at][1] != ")":
                args.append(tokens[at])
                at += 1
            at += 1
            out[-1].predicates.append((name, args))
        else:
            out.append(one(None))
    return out


def _collected(p: Pattern) -> list[tuple]:
    return [*p.predicates, *(x for c in p.children for x in _collected(c))]


def match(nodes: DataFrame, query: str) -> DataFrame:
    """nodes: (file_path, node_id, parent_id, field, kind, start_byte, end_byte, text).  One row per capture of each match:
    file_path, capture, kind, start_byte, end_byte, text, node_id."""
    parts = [_matched(nodes, p) for p in parse(query)]
    return reduce(DataFrame.unionByName, parts).distinct()


def _matched(nodes: DataFrame, pattern: Pattern) -> DataFrame:
    used: dict[str, int] = {}
    count = 0

    def rows(p: Pattern, n: int) -> DataFrame:
        kept = nodes
        if p.kinds != ["_"]:
            kept = kept.filter(F.col("kind").isin(*p.kinds))
        if p.literal is not None:
            kept = kept.filter(F.col("text") == p.literal)
        if p.field:
            kept = kept.filter(F.col("field") == p.field)
        named = F.struct("kind", "start_byte", "end_byte", "text", "node_id").alias(f"n{n}")
        return kept.select(F.col("file_path").alias("file"), F.col("node_id").alias(f"id{n}"), F.col("parent_id").alias(f"up{n}"), named)

    def grow(p: Pattern) -> tuple[DataFrame, int]:
        nonlocal count
        n = count
        count += 1
        out = rows(p, n)
        for c in p.captures:
            used[c] = n
        for child in p.children:
            below, k = grow(child)
            out = out.join(below.withColumnRenamed(f"up{k}", "above"), (out["file"] == below["file"]) & (F.col(f"id{n}") == F.col("above"))).drop(below["file"]).drop("above")
        return out, n

    found, _ = grow(pattern)
    for name, args in _collected(pattern):
        if not args or args[0][0] != "capture" or args[0][1][1:] not in used:
            raise RequestError(f"#{name} needs a capture of its pattern")
        text = F.col(f"n{used[args[0][1][1:]]}.text")
        other = [F.col(f"n{used[w[1:]]}.text") if s == "capture" and w[1:] in used else F.lit(re.sub(r"\\(.)", r"\1", w[1:-1]) if s == "string" else w) for s, w in args[1:]]
        raw = [w[1:-1].replace('\\"', '"').replace("\\\\", "\\") if s == "string" else w for s, w in args[1:]]
        if name in ("eq?", "not-eq?") and len(other) == 1:
            test = text == other[0]
        elif name in ("match?", "not-match?") and len(raw) == 1:
            test = text.rlike(raw[0])
        elif name == "any-of?" and raw:
            test = text.isin(*raw)
        else:
            raise RequestError(f"#{name} isn't a predicate with such arguments")
        found = found.filter(~test if name.startswith("not-") else test)
    if not used:
        return found.select(F.col("file").alias("file_path"), F.lit("").alias("capture"), "n0.*").limit(0)
    caps = F.explode(F.array(*[F.struct(F.lit(c).alias("capture"), F.col(f"n{n}").alias("n")) for c, n in used.items()])).alias("c")
    return found.select(F.col("file").alias("file_path"), caps).select("file_path", "c.capture", "c.n.*").distinct()
