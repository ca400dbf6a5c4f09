"""The tools as Python methods: one engine over a workspace, an index or rows of files, with session buffers.

Every query tool works on the same two relations, symbols and edges; where they come from - a live scan, a stored index,
either with unsaved buffers or one overlaid source - is decided in ``Engine.catalog``.  Results are small by the limits
of the request and returned as plain dictionaries.
"""

from __future__ import annotations

import os
import re
import threading
from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import schema as S
from symloom.extract import lexical, nodes, python_ast, replacement
from symloom.functions import expr as E
from symloom.operators import graph, identity, index, query, tree
from symloom.operators.patch import SARIF_RULES, SARIF_SCHEMA, SCOPES
from symloom.sources import workspace as W
from symloom.sources.scratch import alive, forget, materialize

SUMMARY = ("symbol_id", "semantic_path", "scope_path", "file_path", "node_kind", "start_byte", "end_byte", "signature", "return_type", "docstring")
# Names that patch validation takes for granted in Python.
PYTHON_BUILTINS = (
    "ArithmeticError", "AssertionError", "AttributeError", "BaseException", "Exception", "ImportError", "IndexError", "KeyError", "LookupError", "NameError", "OSError", "RuntimeError",
    "StopIteration", "SyntaxError", "TypeError", "ValueError", "ZeroDivisionError", "abs", "all", "any", "bool", "dict", "enumerate", "filter", "float", "int", "len", "list", "map", "max", "min",
    "object", "open", "print", "range", "repr", "reversed", "set", "sorted", "str", "sum", "tuple", "zip",
)
#: Catalogues that an engine keeps: the workspace's own and the overlays of an edit under way.
KEPT = 4


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Buffer:
    def __init__(self, disk: str, source: str, version: int = 0):
        self.disk, self.source, self.version, self.pending = disk, source, version, False

    @property
    def dirty(self) -> bool:
        return self.source != self.disk


class Engine:
    def __init__(self, spark: SparkSession, files: dict[str, str] | None = None, root: str | None = None):
        self.spark, self.root, self.rows = spark, root, dict(files or {})
        self.buffers: dict[str, Buffer] = {}
        self.indexes: dict[str, str] = {}
        self._kept: dict[tuple, tuple] = {}

    # ---- catalogue

    def files(self, root: str | None = None) -> DataFrame:
        root = root or self.root
        return W.scan(self.spark, root) if root else W.from_rows(self.spark, self.rows)

    def catalog(self, index_path: str | None = None, file_path: str | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """files, symbols, edges.  An overlay or a dirty buffer replaces its file before ids and edges are made.

        Catalogues are written once and kept by the fingerprint of their files; another one takes the symbols of equal files from
        those that are kept, so that only files that differ are extracted again."""
        if (file_path is None) != (source is None):
            raise S.RequestError("file_path and source go together")
        if file_path is not None:
            self._overlay(file_path, source)
        over = {p: b.source for p, b in self.buffers.items() if b.dirty} | ({file_path: source} if file_path else {})
        files = self.files()
        if over:
            files = index.overlaid(files, W.from_rows(self.spark, over)).withColumn("language", E.language("file_path"))
        state = W.fingerprints(files)
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("file_path", "fingerprint").cast("decimal(38,0)")).alias("sum")).first()
        key = (index_path, mark["n"], mark["sum"])
        if key in self._kept and all(map(alive, self._kept[key][1:3])):
            self._kept[key] = self._kept.pop(key)  # the newest last
            return self._kept[key][:3]
        if index_path and not over:
            stored = index.Store(self.spark, index_path).read()
            bad = index.freshness(state, stored["file_state"]).filter("status <> 'fresh'").limit(1).collect()
            if bad:
                raise index.IndexError_(f"the index is stale: {bad[0]['file_path']} is {bad[0]['status']}")
            broken = [r["rule"] for r in _rows(index.violations(stored["symbols"], files)) if r["n"]]
            ids = stored["symbols"].select("symbol_id")
            loose = stored["edges"].select(F.explode(F.array("src", "dst")).alias("symbol_id")).join(ids, "symbol_id", "left_anti").limit(1).collect()
            if broken or loose:
                raise index.IndexError_(f"the index is damaged: {broken or loose[0]['symbol_id']}")
            made = (files, stored["symbols"], stored["edges"], None)
        else:
            files, state = materialize(files, "files"), materialize(state, "state")
            known = next((k for k in reversed(self._kept.values()) if k[3] is not None and alive(k[1]) and alive(k[3])), None)
            raw = W.refreshed(known[1], known[3], files) if known else W.raw_symbols(files)
            symbols = materialize(identity.assigned(materialize(raw, "raw")), "symbols")
            made = (files, symbols, materialize(W.edges(files, symbols), "edges"), state)
        while len(self._kept) >= KEPT:
            forget(*self._kept.pop(next(iter(self._kept))))
        self._kept[key] = made
        return made[:3]

    def _overlay(self, file_path: str, source: str) -> None:
        """An overlay must be a file of a known language inside the workspace, in no skipped folder, of a bounded size."""
        if file_path.rpartition(".")[2].lower() not in E.EXTENSION_LANGUAGE:
            raise S.RequestError(f"no language for {file_path!r}")
        if len(source.encode()) > S.MAX_FILE_BYTES:
            raise S.RequestError("the source is too long")
        if self.root:
            root = os.path.realpath(self.root.removeprefix("file://"))
            at = os.path.realpath(file_path)
            if not at.startswith(root + os.sep) or any(p.lower() in E.SKIP_DIRECTORIES for p in at[len(root) + 1 :].split(os.sep)[:-1]):
                raise S.RequestError(f"{file_path!r} isn't a file of the workspace")

    @contextmanager
    def deadline(self, timeout_ms: int | None):
        """Jobs started inside are cancelled after the time; nothing partial is returned."""
        if timeout_ms is None:
            yield
            return
        S.within("timeout_ms", timeout_ms, 1, S.MAX_TIMEOUT_MS)
        tag = f"deadline-{id(object())}"
        timer = threading.Timer(timeout_ms / 1000, lambda: self.spark.sparkContext.cancelJobsWithTag(tag))
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    # ---- search, list, selection

    def search_symbols(self, query_: str, limit: int = S.DEFAULT_SEARCH, file_path_contains: str | None = None, node_kind: str | None = None, **backend) -> dict:
        files, symbols, _ = self.catalog(**backend)
        rows, head = self._page(query.search(symbols, query_, limit, file_path_contains, node_kind), ("score", "matched_fields"))
        out = {"query": query_.strip(), "indexed_files": self._indexed(files), "total_matches": head["total"], "truncated": head["truncated"]}
        out["matches"] = [{k: r[k] for k in SUMMARY} for r in rows]
        return out | {"match_details": [{k: r[k] for k in ("symbol_id", "score", "matched_fields")} for r in rows]}

    def list_symbols(self, limit: int = S.DEFAULT_LIST, file_path_contains: str | None = None, node_kind: str | None = None, **backend) -> dict:
        files, symbols, _ = self.catalog(**backend)
        rows, head = self._page(query.list_symbols(symbols, limit, file_path_contains, node_kind), ())
        return {"indexed_files": self._indexed(files), "total_symbols": head["total"], "truncated": head["truncated"], "symbols": rows}

    @staticmethod
    def _indexed(files: DataFrame) -> int:
        return files.filter("language IS NOT NULL").count()

    def _page(self, df: DataFrame, more: tuple[str, ...]) -> tuple[list[dict], dict]:
        rows = _rows(df.select(*SUMMARY, *more, "total_matches", "truncated"))
        head = {"total": rows[0]["total_matches"] if rows else 0, "truncated": rows[0]["truncated"] if rows else False}
        return [{k: v for k, v in r.items() if k not in ("total_matches", "truncated")} for r in rows], head

    def _select(self, symbols: DataFrame, symbol_path: str) -> dict:
        got = _rows(query.select(symbols, self.spark.createDataFrame([(S.nonblank("symbol_path", symbol_path),)], "selector string")))
        if not got:
            raise S.RequestError(f"no symbol {symbol_path!r}")
        if got[0]["family"] == "python":
            names = {r["symbol_id"] for r in symbols.filter((F.col("semantic_path") == symbol_path) & (F.col("family") == "python")).select("symbol_id").limit(50).collect()}
            if len(names) > 1:
                raise S.RequestError(f"{symbol_path!r} is ambiguous: {sorted(names)}")
        return got[0]

    def _at(self, files: DataFrame, symbols: DataFrame, file_path: str, row: int, column: int) -> dict:
        point = files.filter(F.col("file_path") == file_path).select(F.lit(1).alias("point_id"), F.col("file_path").alias("point_file"), E.point_offset(F.col("source"), F.lit(row), F.lit(column)).cast("long").alias("offset"))
        got = _rows(query.at_positions(symbols, point.filter("offset IS NOT NULL")))
        if not got:
            raise S.RequestError(f"no symbol at {file_path}:{row}:{column}")
        return got[0]

    # ---- reads and contexts

    def _read(self, files: DataFrame, symbols: DataFrame, ids: list[str]) -> dict[str, dict]:
        wanted = symbols.filter(F.col("symbol_id").isin(ids))
        return {r["symbol_id"]: r for r in _rows(query.read(wanted.select(*SUMMARY), files))}

    def _traces(self, symbols: DataFrame, edges: DataFrame, roots: DataFrame, direction: str) -> dict[str, dict]:
        got: dict[str, list[dict]] = {}
        for r in _rows(graph.trace(symbols, edges, roots)):
            r["evidence_key"] = "|".join([r["symbol_id"], r["file_path"], r["node_kind"], r["role"], f"{r['start_byte']}..{r['end_byte']}", r["signature"] or ""])
            got.setdefault(r["root_id"], []).append(r)
        for root, rows in got.items():
            if len({r["evidence_key"] for r in rows}) < len(rows):
                raise S.RequestError(f"the trace of {root!r} has an evidence key twice")
        out = {}
        for root, rows in got.items():
            side = lambda role, on: sorted(({k: r[k] for k in (*SUMMARY, "evidence_key")} for r in rows if r["role"] == role), key=lambda r: r["symbol_id"]) if direction in (on, "both") else []  # noqa: E731, B023
            out[root] = {"root": next(r for r in rows if r["role"] == "trace_root"), "callers": side("caller", "callers"), "callees": side("callee", "callees")}
        return out

    def _trace(self, symbols: DataFrame, edges: DataFrame, root: str, direction: str) -> dict:
        return self._traces(symbols, edges, self.spark.createDataFrame([(root,)], "root_id string"), direction)[root]

    def _arounds(self, symbols: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "both", max_depth: int = S.DEFAULT_DEPTH, max_nodes: int = S.DEFAULT_NODES) -> dict[str, dict]:
        nodes_, links = graph.neighborhood(symbols, edges, roots, direction, max_depth, max_nodes)
        out: dict[str, dict] = {}
        for r in sorted(_rows(nodes_), key=lambda r: r["ordinal"]):
            one = out.setdefault(r["root_id"], {"neighborhood": {"nodes": [], "edges": [], "truncated": r["truncated"]}})["neighborhood"]
            one["nodes"].append({k: r[k] for k in ("id", "ordinal", "depth")})
        for r in sorted(_rows(links), key=str):
            out[r["root_id"]]["neighborhood"]["edges"].append({"src": r["src"], "dst": r["dst"]})
        return out

    def _around(self, symbols: DataFrame, edges: DataFrame, root: str, direction: str, max_depth: int, max_nodes: int) -> dict:
        return self._arounds(symbols, edges, self.spark.createDataFrame([(root,)], "root_id string"), direction, max_depth, max_nodes)[root]["neighborhood"]

    def _context(self, kind: str, catalog, root: str, direction: str = "both", max_depth: int = S.DEFAULT_DEPTH, max_nodes: int = S.DEFAULT_NODES) -> dict:
        files, symbols, edges = catalog
        out = {}
        if kind in ("read", "context", "discovery"):
            out["read"] = self._read(files, symbols, [root])[root]
        if kind in ("trace", "context", "discovery"):
            out["trace"] = self._trace(symbols, edges, root, direction)
        if kind in ("around", "neighborhood", "discovery"):
            out["neighborhood"] = self._around(symbols, edges, root, direction, max_depth, max_nodes)
        if kind in ("neighborhood", "discovery"):
            out["reads"] = self._read(files, symbols, [n["id"] for n in out["neighborhood"]["nodes"]])
        return out

    def _single(self, kind: str, symbol_path: str | None, position: tuple[str, int, int] | None, graph_args: dict, backend: dict) -> dict:
        files, symbols, edges = catalog = self.catalog(**backend)
        root = self._select(symbols, symbol_path) if position is None else self._at(files, symbols, *position)
        return self._context(kind, catalog, root["symbol_id"], **graph_args)

    def _each(self, kind: str, page: dict, graph_args: dict, backend: dict) -> dict:
        """The contexts of all matches, each relation asked once for all of them."""
        files, symbols, edges = self.catalog(**backend)
        ids = [m["symbol_id"] for m in page.get("matches", page.get("symbols"))]
        page = {"search" if "matches" in page else "list": page}
        if not ids:
            return page | ({"reads": []} if kind == "context" else {"contexts": []})
        texts = self._read(files, symbols, ids)
        if kind == "context":
            return page | {"reads": [texts.get(i) for i in ids]}
        roots = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "root_id string")
        around = self._arounds(symbols, edges, roots, **graph_args)
        reads = self._read(files, symbols, sorted({n["id"] for a in around.values() for n in a["neighborhood"]["nodes"]} if kind in ("neighborhood", "discovery") else set(ids)))
        traces = self._traces(symbols, edges, roots, graph_args["direction"]) if kind == "discovery" else {}
        out = []
        for i in ids:
            one = dict(around[i])
            one["reads"] = {n["id"]: reads[n["id"]] for n in one["neighborhood"]["nodes"] if n["id"] in reads}
            if kind == "discovery":
                one |= {"read": texts[i], "trace": traces[i]}
            out.append(one)
        return page | {"contexts": out}

    # ---- source tools

    def _source(self, file_path: str, source: str | None) -> str:
        if source is not None:
            return source
        if file_path in self.buffers:
            return self.buffers[file_path].source
        got = self.files().filter(F.col("file_path") == file_path).select("source").collect()
        if not got:
            raise S.RequestError(f"no file {file_path!r}")
        return got[0]["source"]

    @staticmethod
    def _declared(file_path: str, source: str) -> list[dict]:
        lang = E.EXTENSION_LANGUAGE.get(file_path.rpartition(".")[2].lower())
        if lang is None:
            raise S.RequestError(f"no language for {file_path!r}")
        return python_ast.declarations(source) if lang == "python" else lexical.declarations(source, lang)

    def get_semantic_skeleton(self, file_path: str, depth_limit: int = S.SKELETON_DEPTH, source: str | None = None, expand_nodes: tuple[str, ...] = ()) -> dict:
        """Headers within the depth; expanded symbols in full, which hides what is inside them."""
        S.within("depth_limit", depth_limit, 0, S.MAX_DEPTH)
        text = self._source(file_path, source)
        raw, parts, hidden, around = text.encode(), [], -1, []
        declared = self._declared(file_path, text)
        for node in expand_nodes:
            if sum(d["semantic_path"] == node for d in declared) > 1:
                raise S.RequestError(f"{node!r} is ambiguous")
        for d in declared:
            around = [end for end in around if end > d["start_byte"]] + [d["end_byte"]]
            if d["start_byte"] < hidden:
                continue
            if d["semantic_path"] in expand_nodes:
                parts.append(raw[d["start_byte"] : d["end_byte"]].decode())
                hidden = d["end_byte"]
            elif len(around) <= depth_limit:
                parts.append(f"{d['signature']} ...")
        return {"file_path": file_path, "skeleton": "\n\n".join(parts)}

    def execute_tree_query(self, file_path: str, query: str, source: str | None = None, max_captures: int = S.DEFAULT_CAPTURES) -> list[dict]:
        """The captures of an S-expression pattern, in source order, with their owners.  More than max_captures is an error."""
        S.within("max_captures", max_captures, 1, S.MAX_CAPTURES)
        tree.parse(query)
        text = self._source(file_path, source)
        lang = E.EXTENSION_LANGUAGE.get(file_path.rpartition(".")[2].lower())
        if lang is None:
            raise S.RequestError(f"no language for {file_path!r}")
        schema = "file_path string, node_id int, parent_id int, field string, kind string, start_byte int, end_byte int, text string"
        frame = self.spark.createDataFrame([(file_path, *n) for n in nodes.nodes(text, lang)], schema)
        got = sorted(_rows(tree.match(frame, query).limit(max_captures + 1)), key=lambda r: (r["start_byte"], -r["end_byte"], r["capture"]))
        if len(got) > max_captures:
            raise S.RequestError(f"over {max_captures} captures")
        declared, raw = self._declared(file_path, text), text.encode()
        point = lambda at: {"row": raw.count(b"\n", 0, at), "column": at - (raw.rfind(b"\n", 0, at) + 1)}
        out = []
        for r in got:
            around = [d for d in declared if d["start_byte"] <= r["start_byte"] and r["end_byte"] <= d["end_byte"]]
            owner = min(around, key=lambda d: (d["end_byte"] - d["start_byte"], d["start_byte"]), default=None) if lang in ("python", "c", "cpp") else None
            out.append({
                "capture": r["capture"], "node_kind": r["kind"], "text": r["text"], "start_byte": r["start_byte"], "end_byte": r["end_byte"], "start_point": point(r["start_byte"]), "end_point": point(r["end_byte"]),
                "owner": owner and owner["semantic_path"], "owner_scope": owner and owner["scope_path"],
            })
        return out

    # ---- patches

    def _target(self, file_path: str, text: str, selector: str) -> dict:
        """The declaration of a file that a symbol id, a path with the file before it, or a path alone names; several are an error."""
        rows = self._declared(file_path, text)
        ids = local_ids(file_path, rows)
        local = selector.removeprefix(f"{file_path}::")
        named = [d for i, d in zip(ids, rows, strict=True) if i == selector]
        named = named or [d for d in rows if d["semantic_path"] == local] or [d for d in rows if d["semantic_path"] == re.sub(r"(\(.*|#.*)$", "", local)]
        if len(named) != 1:
            found = [i for i, d in zip(ids, rows, strict=True) if d in named]
            raise S.RequestError(f"{selector!r} names {len(named)} declarations: {found}")
        return named[0]

    def _patched(self, file_path: str, semantic_path: str, new_code: str, source: str | None) -> tuple[str, str, dict, list[dict]]:
        if len(new_code.encode()) > S.MAX_REPLACEMENT:
            raise S.RequestError("the replacement is too long")
        text = self._source(file_path, source)
        d = self._target(file_path, text, semantic_path)
        raw, guard = text.encode(), []
        if file_path.endswith((".py", ".pyi")):
            if raw[d["start_byte"] : d["start_byte"] + 1] == b"@" and not replacement.decorated(new_code):
                row = raw.count(b"\n", 0, d["start_byte"])
                guard = [{"kind": "decorator_guard", "row": row, "column_no": 0, "message": "the replacement would drop decorators; give them, or a bypass reason"}]
            new_code = replacement.normalized(text, d["start_byte"], d["end_byte"], new_code)
        return text, (raw[: d["start_byte"]] + new_code.encode() + raw[d["end_byte"] :]).decode(), d, guard

    def preview_patch(self, file_path: str, semantic_path: str, new_code: str, source: str | None = None, bypass_reason: str | None = None) -> dict:
        """Syntax issues, binding decisions, gate and diff of a replacement; nothing is written."""
        before, after, target, guard = self._patched(file_path, semantic_path, new_code, source)
        lang = E.EXTENSION_LANGUAGE[file_path.rpartition(".")[2].lower()]
        issues = python_ast.issues(after) + replacement.indentation_issues(after) + replacement.decorator_issues(after) + guard if lang == "python" else lexical.issues(after)
        decided = []
        if not issues:
            declared = {d["semantic_path"]: d for d in self._declared(file_path, after)}
            decided = self._bound(file_path, after, lang, declared.get(target["semantic_path"], {"reference_names": [], "calls": []}))
        for d in decided:
            d["invariant"] = "blocked" if d["status"] in ("ambiguous", "unresolved") else "passed" if d["status"] == "resolved" and len(d["candidates"]) == 1 and d["selected"] else "failed"
        reason = "syntax" if issues else next((s for s in ("ambiguous", "unresolved") if any(d["status"] == s for d in decided)), "invariant" if any(d["invariant"] == "failed" for d in decided) else None)
        if bypass_reason is not None and len(bypass_reason.encode()) > S.MAX_REASON:
            raise S.RequestError("bypass_reason is too long")
        gate = "allowed" if reason is None else "allowed_with_bypass" if bypass_reason and bypass_reason.strip() else "rejected"
        return {"file_path": file_path, "syntax_issues": issues, "decisions": decided, "gate": gate, "reason": reason, "diff": unified_diff(file_path, before, after), "updated_source": after}

    def _bound(self, file_path: str, after: str, lang: str, target: dict) -> list[dict]:
        """What each reference of a patched symbol may mean: in Python and C any symbol of the name, the file's own before others;
        elsewhere the targets of its calls by the scopes of the language."""
        _, symbols, edges = self.catalog(file_path=file_path, source=after)
        key = lambda r, origin: "|".join([r["symbol_id"], r["file_path"], r["node_kind"], origin, f"{r['start_byte']}..{r['end_byte']}", r["signature"] or ""])
        wanted = SUMMARY + ("base_name",)
        names = [n for n in target["reference_names"] if lang != "python" or n not in PYTHON_BUILTINS]
        if lang not in ("python", "c"):
            bound = {c["name"] for c in target["calls"] if c["kind"] == "value" and not c["paths"]}
            names = [n for n in names if n not in bound]
        bases = {n: n.replace("::", ".").rpartition(".")[2] for n in names}
        if not bases:
            return []
        known: dict[str, list[dict]] = {}
        for r in _rows(symbols.filter(F.col("base_name").isin(sorted(set(bases.values())))).select(*wanted)):
            known.setdefault(r["base_name"], []).append(r)
        reached = None
        if lang not in ("python", "c"):
            at = [r["symbol_id"] for r in _rows(symbols.filter((F.col("file_path") == file_path) & (F.col("semantic_path") == target.get("semantic_path"))).select("symbol_id"))]
            reached = {r["dst"] for r in _rows(edges.filter(F.col("src").isin(at)).select("dst"))} | set(at)
        out = []
        for n in names:
            found = known.get(bases[n], [])
            if reached is not None:
                found = [r for r in found if r["symbol_id"] in reached] or ([] if len(found) < 2 else found)
            own = [r for r in found if r["file_path"] == file_path] or found
            candidates = [{"symbol_id": r["symbol_id"], "evidence_key": key(r, "module_scope" if r["file_path"] == file_path else "workspace")} for r in sorted(own, key=lambda r: r["symbol_id"])]
            status = "unresolved" if not candidates else "resolved" if len(candidates) == 1 else "ambiguous"
            why = {"unresolved": "no candidate", "ambiguous": f"{len(candidates)} candidates", "resolved": "one candidate"}[status]
            out.append({"name": n, "candidates": candidates, "status": status, "reason": why, "selected": candidates[0] if status == "resolved" else None})
        return out

    def apply_patch(self, file_path: str, semantic_path: str, new_code: str, bypass_reason: str | None = None) -> dict:
        """As the preview; if the gate lets it through, the buffer of the file takes the new source."""
        out = self.preview_patch(file_path, semantic_path, new_code, None, bypass_reason)
        if out["gate"] != "rejected":
            b = self.buffers.get(file_path) or self._open(file_path)
            b.source, b.version = out["updated_source"], b.version + 1
        return out

    def validate_patch(self, file_path: str, semantic_path: str, new_code: str, source: str | None = None, bypass_reason: str | None = None, direction: str = "both", kind: str = "trace", **graph_args) -> dict:
        """The preview, and with an open gate what the edit does to the graph around its target."""
        out = {"patch": self.preview_patch(file_path, semantic_path, new_code, source, bypass_reason)}
        if out["patch"]["gate"] == "rejected":
            return out | {"decision": "rejected_by_patch_gate", "trace_error": f"gate: {out['patch']['reason']}"}
        before = self.catalog(**({"file_path": file_path, "source": source} if source is not None else {}))
        root = self._select(before[1], semantic_path)["symbol_id"]
        old = self._trace(before[1], before[2], root, direction)
        after = self.catalog(file_path=file_path, source=out["patch"]["updated_source"])
        new = self._trace(after[1], after[2], root, direction)
        verdict = self.validate_patch_commit(out["patch"], new)
        impact = {}
        for role in ("callers", "callees"):
            a, b = ({r["symbol_id"] for r in t[role]} for t in (old, new))
            impact |= {f"added_{role}": sorted(b - a), f"removed_{role}": sorted(a - b)}
        impact["affected"] = len(set().union(*impact.values()))
        return out | {"decision": verdict["decision"], "replay": verdict["replay"], "impact": impact, "context": self._context(kind, after, root, direction, **graph_args)}

    def preview_workspace_position_edits(self, files: list[dict]) -> list[dict]:
        """files: file_path, edits of (start_row, start_col, end_row, end_col, new_text) each, all or nothing."""
        S.within("files", len(files), 1, S.MAX_PREVIEW_FILES)
        if len({f["file_path"] for f in files}) != len(files):
            raise S.RequestError("a file is given twice")
        out = []
        for f in files:
            before = self._source(f["file_path"], f.get("source"))
            after = _positioned(before, f["edits"])
            out.append({"file_path": f["file_path"], "source": after, "diff": unified_diff(f["file_path"], before, after)})
        return out

    # ---- buffers

    def _open(self, file_path: str, source: str | None = None) -> Buffer:
        got = self.files().filter(F.col("file_path") == file_path).select("source").collect()
        disk = got[0]["source"] if got else ""
        self.buffers[file_path] = b = Buffer(disk, disk if source is None else source)
        return b

    def _snapshot(self, file_path: str) -> dict:
        b = self.buffers[file_path]
        return {"file_path": file_path, "source": b.source, "version": b.version, "dirty": b.dirty, "index_sync_pending": b.pending}

    def did_open(self, file_path: str, source: str | None = None) -> dict:
        self._open(file_path, source)
        return self._snapshot(file_path)

    def did_change(self, file_path: str, edits: list) -> dict:
        """Edits by position, each on the result of the one before; a bad one leaves the buffer as it was."""
        S.within("edits", len(edits), 0, S.MAX_EDITS)
        b = self.buffers.get(file_path) or self._open(file_path)
        b.source, b.version = _positioned(b.source, edits), b.version + 1
        return self._snapshot(file_path)

    def apply_buffer_edit(self, file_path: str, start_byte: int, old_end_byte: int, new_text: str) -> dict:
        b = self.buffers.get(file_path) or self._open(file_path)
        raw = b.source.encode()
        S.within("start_byte", start_byte, 0, old_end_byte)
        S.within("old_end_byte", old_end_byte, start_byte, len(raw))
        b.source, b.version = (raw[:start_byte] + new_text.encode() + raw[old_end_byte:]).decode(), b.version + 1
        return self._snapshot(file_path)

    def read_virtual_file(self, file_path: str) -> dict:
        b = self.buffers.get(file_path)
        if b is None or not b.dirty:  # clean buffers follow the disk
            version = b.version if b else 0
            self._open(file_path).version = version
        return self._snapshot(file_path)

    def list_virtual_files(self, dirty_only: bool = False) -> list[dict]:
        return [{k: v for k, v in self._snapshot(p).items() if k != "source"} for p in sorted(self.buffers) if self.buffers[p].dirty or not dirty_only]

    def discard_virtual_file(self, file_path: str) -> dict:
        b = self.buffers[file_path]
        b.source, b.version = b.disk, b.version + 1
        return self._snapshot(file_path)

    def commit_virtual_file(self, file_path: str) -> dict:
        """Writes the buffer; indexes are refreshed after it, and stay marked as pending if that fails."""
        b = self.buffers[file_path]
        if self.root:
            from symloom.sources.atomic import write_text

            write_text(file_path, b.source)
        else:
            self.rows[file_path] = b.source
        b.disk, b.pending = b.source, bool(self.indexes)
        for root, path in self.indexes.items():
            if not self.root or _inside(file_path, root):
                self.refresh_symbol_index_for_file(root if self.root else None, path, file_path)
        b.pending = False
        return self._snapshot(file_path)

    def did_close(self, file_path: str, persist: bool = False) -> dict:
        out = self.commit_virtual_file(file_path) if persist else self._snapshot(file_path)
        del self.buffers[file_path]
        return out

    # ---- indexes

    def rebuild_symbol_index(self, workspace_root: str | None, db_path: str) -> dict:
        files = materialize(self.files(workspace_root), "files")
        store = index.Store(self.spark, db_path)
        state = W.fingerprints(files)
        plan = store.plan()
        if plan == "manual":
            raise index.IndexError_("this index has to be looked at by hand")
        if plan == "none":
            old = store.read()
            raw = W.refreshed(old["symbols"], old["file_state"], files)
            stats = _rows(index.refresh_stats(state, old["file_state"]))[0]
        else:
            raw, stats = W.raw_symbols(files), {"indexed": files.count(), "reused": 0}
        symbols = materialize(identity.assigned(materialize(raw, "raw")), "symbols")
        said = materialize(W.facts(files), "facts")
        store.write(symbols=symbols, edges=W.edges(files, symbols, said), file_state=state, facts=said)
        return stats | {"rebuilt": stats["indexed"] - stats["reused"]}

    refresh_symbol_index = rebuild_symbol_index

    def refresh_symbol_index_for_file(self, workspace_root: str | None, db_path: str, file_path: str) -> dict:
        """One file is read again: its rows are replaced, ids are assigned over the whole, and the references of callers that the
        change can touch are resolved anew; all other edges stay.  A file that is gone loses its rows.  The result is
        that of a rebuild."""
        store = index.Store(self.spark, db_path)
        if store.plan() != "none" or "facts" not in store.read():
            return self.rebuild_symbol_index(workspace_root, db_path) | {"file_path": file_path}
        old = store.read()
        files = materialize(self.files(workspace_root), "files")
        one = files.filter(F.col("file_path") == file_path)
        fresh = materialize(W.raw_symbols(one), "raw")
        kept = old["symbols"].filter(F.col("file_path") != file_path)
        symbols = materialize(identity.assigned(kept.select(*fresh.columns).unionByName(fresh)), "symbols")
        said = materialize(old["facts"].filter(F.col("file_path") != file_path).unionByName(W.facts(one)), "facts")
        callers = materialize(W.touched(old, symbols, said, files, file_path), "touched")
        again = W.edges(files, symbols, said, callers)
        stay = old["edges"].join(callers.select(F.col("symbol_id").alias("src")), "src", "left_anti").join(symbols.select(F.col("symbol_id").alias("src")).distinct(), "src", "left_semi").join(symbols.select(F.col("symbol_id").alias("dst")).distinct(), "dst", "left_semi")
        state = index.replaced(old["file_state"], self.spark.createDataFrame([(file_path,)], "file_path string"), W.fingerprints(one))
        store.write(symbols=symbols, edges=stay.select("src", "dst").unionByName(again).distinct(), file_state=state, facts=said)
        return {"file_path": file_path, "symbols": fresh.count(), "callers": callers.count()}

    def inspect_symbol_index(self, db_path: str) -> dict:
        store = index.Store(self.spark, db_path)
        plan = store.plan()
        if plan != "none":
            return {"exists": store.manifest() is not None, "ok": False, "action": plan}
        got = store.read()
        return {"exists": True} | _rows(index.health(W.fingerprints(self.files()), got["file_state"]))[0] | {"symbols": got["symbols"].count()}

    def migrate_symbol_index(self, db_path: str, workspace_root: str | None = None) -> dict:
        """An older schema is brought to the current one in place; then, and for an index that can't be used, it is rebuilt."""
        store = index.Store(self.spark, db_path)
        plan = store.plan()
        if plan == "manual":
            raise index.IndexError_("this index has to be looked at by hand")
        if plan == "migrate":
            store.migrate()
        if plan != "none":
            self.rebuild_symbol_index(workspace_root, db_path)
        return {"migrated_from": plan} | self.inspect_symbol_index(db_path)

    def register_symbol_index(self, workspace_root: str, db_path: str) -> dict:
        self.rebuild_symbol_index(workspace_root if self.root else None, db_path)
        self.indexes[workspace_root] = db_path
        return {"workspace_root": workspace_root, "db_path": db_path}

    def unregister_symbol_index(self, workspace_root: str) -> bool:
        return self.indexes.pop(workspace_root, None) is not None

    def list_symbol_indexes(self) -> list[dict]:
        return [{"workspace_root": k, "db_path": self.indexes[k]} for k in sorted(self.indexes)]

    def refresh_registered_symbol_indexes(self) -> list[dict]:
        return [self.rebuild_symbol_index(k if self.root else None, self.indexes[k]) for k in sorted(self.indexes)]

    # ---- evidence

    def replay_patch_evidence(self, patch: dict, trace: dict) -> dict:
        """Where the evidence of a patch's decisions is found in a trace: items with their scope and status, the worst status, and
        whether all of them are matched or blocked."""
        exact: dict[str, str] = {}
        for role, rows in (("callee", trace["callees"]), ("caller", trace["callers"]), ("trace_root", [trace["root"]])):
            for r in rows:
                exact.setdefault(r["evidence_key"], SCOPES[role])
        loose: dict[str, str] = {}
        for k, scope in exact.items():
            if _bare(k):
                loose.setdefault(_bare(k), scope)
        items = []
        for d in patch["decisions"]:
            key = d["selected"]["evidence_key"] if d["selected"] else None
            own = key is not None and key.split("|")[3:4] in (["local_scope"], ["module_scope"])
            scope = "none" if key is None else exact.get(key) or loose.get(_bare(key)) or ("patch_scope" if own else "none")
            status = ("matched" if scope != "none" else "missing") if d["invariant"] == "passed" else "blocked" if d["invariant"] == "blocked" else "failed"
            items.append({"name": d["name"], "status": status, "selected_evidence_key": key, "matched_in_trace": scope != "none", "trace_match_scope": scope})
        worst = next((s for s in ("failed", "missing", "blocked") if any(i["status"] == s for i in items)), "matched")
        count = lambda s: sum(i["status"] == s for i in items)
        return {"items": items, "status": worst, "matched_items": count("matched"), "blocked_items": count("blocked"), "consistent": worst in ("matched", "blocked")}

    def validate_patch_commit(self, patch: dict, trace: dict) -> dict:
        """Whether a patch may be written: its gate first, then what the trace says of its evidence."""
        replay = self.replay_patch_evidence(patch, trace)
        lost = replay["status"] in ("missing", "failed") or (replay["status"] == "blocked" and patch["gate"] != "allowed_with_bypass")
        decision = "rejected_by_patch_gate" if patch["gate"] == "rejected" else "rejected_by_trace_replay" if lost else patch["gate"]
        return {"allowed": decision == patch["gate"], "decision": decision, "patch_gate_status": patch["gate"], "replay_status": replay["status"], "replay": replay}

    def export_patch_diagnostics_sarif(self, patch: dict) -> dict:
        uri = _uri(patch["file_path"])
        results = []
        for i in patch["syntax_issues"]:
            region = {"startLine": i["row"] + 1, "startColumn": i["column_no"] + 1, "endLine": i["row"] + 1, "endColumn": i["column_no"] + 1}
            place = {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": region}}
            results.append({"ruleId": f"symloom.syntax.{i['kind']}", "level": "error", "message": {"text": i["message"]}, "locations": [place]})
        level = {"unresolved": "error", "ambiguous": "warning"}
        results += [{"ruleId": f"symloom.binding.{d['status']}", "level": level[d["status"]], "message": {"text": f"{d['name']}: {d['reason']}"}} for d in patch["decisions"] if d["status"] in level]
        if patch["gate"] != "allowed":
            results.append({"ruleId": "symloom.patch-gate", "level": "error" if patch["gate"] == "rejected" else "warning", "message": {"text": patch["reason"]}})
        told = lambda r: SARIF_RULES[r.split(".")[1]]
        rules = [{"id": r, "name": told(r)[0], "shortDescription": {"text": told(r)[1]}} for r in sorted({x["ruleId"] for x in results})]
        return {"version": "2.1.0", "$schema": SARIF_SCHEMA, "runs": [{"tool": {"driver": {"name": "symloom", "rules": rules}}, "columnKind": "utf8CodeUnits", "results": results}]}

    def batch(self, calls: list[tuple[str, dict]], timeout_ms: int | None = None) -> list:
        """Up to 32 reading tools in order under one deadline, all or nothing."""
        S.within("calls", len(calls), 1, S.MAX_BATCH)
        tools = self.tools()
        for name, _ in calls:
            if name not in tools or not name.startswith(("search_", "list_", "read_", "get_", "trace_", "inspect_", "execute_")):
                raise S.RequestError(f"{name!r} isn't a reading tool")
        with self.deadline(timeout_ms):
            return [tools[name](**args) for name, args in calls]

    def tools(self) -> dict:
        """Every tool by name.  ``_at_position`` forms take position=(file_path, row, column) for symbol_path."""

        def single(kind):
            return lambda symbol_path=None, position=None, index_path=None, file_path=None, source=None, **g: self._single(kind, symbol_path, position, g, {"index_path": index_path, "file_path": file_path, "source": source})

        def each(kind, page):
            def run(index_path=None, file_path=None, source=None, direction="both", max_depth=S.DEFAULT_DEPTH, max_nodes=S.DEFAULT_NODES, **args):
                backend = {"index_path": index_path, "file_path": file_path, "source": source}
                if "query" in args:
                    args["query_"] = args.pop("query")
                return self._each(kind, page(**args, **backend), {"direction": direction, "max_depth": max_depth, "max_nodes": max_nodes}, backend)

            return run

        def at(tool):
            def run(position, **args):
                file_path, row, column = position
                files, symbols, _ = self.catalog()
                return tool(file_path=file_path, semantic_path=self._at(files, symbols, file_path, row, column)["symbol_id"], **args)

            return run

        out = {}
        for name, kind in (("trace_symbol_graph", "trace"), ("trace_symbol_neighborhood", "around"), ("read_symbol", "read"), ("read_symbol_context", "context"), ("read_symbol_neighborhood_context", "neighborhood"), ("read_symbol_discovery_context", "discovery")):
            out[name] = out[f"{name}_at_position"] = single(kind)
        out["search_symbols"] = lambda query, **a: self.search_symbols(query, **a)
        out["list_symbols"] = self.list_symbols
        for kind in ("context", "neighborhood_context", "discovery_context"):
            out[f"search_symbols_{kind}"] = each(kind.split("_")[0], self.search_symbols)
            out[f"list_symbols_{kind}"] = each(kind.split("_")[0], self.list_symbols)
        for name, tool in (("preview_patch_ast_node", self.preview_patch), ("patch_ast_node", self.apply_patch), ("patch_virtual_ast_node", self.apply_patch)):
            out[name], out[f"{name}_at_position"] = tool, at(tool)
        for name, kind in (("trace", "trace"), ("graph", "around"), ("neighborhood", "neighborhood"), ("discovery", "discovery")):
            tool = lambda kind=kind, **a: self.validate_patch(kind=kind, **a)
            out[f"validate_patch_with_{name}_context"], out[f"validate_patch_with_{name}_context_at_position"] = tool, at(tool)
        out["replay_patch_evidence_against_trace"], out["validate_patch_commit_with_trace"] = self.replay_patch_evidence, self.validate_patch_commit
        for name in OWN_TOOLS:
            out[name] = getattr(self, name)
        return out


# Tools that are methods of the same name.
OWN_TOOLS = (
    "batch",
    "get_semantic_skeleton",
    "execute_tree_query",
    "export_patch_diagnostics_sarif",
    "preview_workspace_position_edits",
    "did_open",
    "did_change",
    "did_close",
    "list_virtual_files",
    "read_virtual_file",
    "apply_buffer_edit",
    "commit_virtual_file",
    "discard_virtual_file",
    "rebuild_symbol_index",
    "refresh_symbol_index",
    "refresh_symbol_index_for_file",
    "inspect_symbol_index",
    "migrate_symbol_index",
    "register_symbol_index",
    "unregister_symbol_index",
    "list_symbol_indexes",
    "refresh_registered_symbol_indexes",
)


def local_ids(file_path: str, rows: list[dict]) -> list[str]:
    """Ids of a file's declarations among themselves: the path, numbered with the file before it where it repeats."""
    python = file_path.endswith((".py", ".pyi"))
    group: dict[str, list[dict]] = {}
    for d in rows:
        group.setdefault(d["semantic_path"], []).append(d)
    out = []
    for d in rows:
        own = group[d["semantic_path"]]
        if len(own) == 1:
            out.append(d["semantic_path"])
            continue
        if python:
            same = [o for o in own if o["is_overload"] == d["is_overload"]]
            word = "overload" if d["is_overload"] else "implementation" if any(o["is_overload"] for o in own) else "definition"
            number = "" if word == "implementation" and len(same) == 1 else f"[{same.index(d) + 1}]"
        else:
            word = "overload" if all(o["node_kind"] in identity.CALLABLES for o in own) else "definition"
            number = f"[{own.index(d) + 1}]"
        out.append(f"{file_path}::{d['semantic_path']}#{word}{number}")
    return out


def _bare(key: str) -> str | None:
    parts = key.split("|", 5)
    return "|".join(parts[:3] + parts[4:]) if len(parts) == 6 else None


def _inside(path: str, root: str) -> bool:
    return os.path.realpath(path).startswith(os.path.realpath(root.removeprefix("file://")) + os.sep)


def _uri(path: str) -> str:
    path = path.replace("\\", "/")
    path = quote(path if path.startswith("/") else f"/{path}", safe="/:~")
    return ("file:" if path.startswith("//") else "file://") + path


def unified_diff(path: str, before: str, after: str) -> str:
    """As ``operators.patch.unified_diff``, for two texts."""
    if before == after:
        return ""

    def lines(text: str) -> list[str]:
        parts = text.split("\n")
        ended = parts[-1] == ""
        parts = parts[:-1] if ended else parts
        return [p[:-1] if p.endswith("\r") and (ended or k < len(parts) - 1) else p for k, p in enumerate(parts)]

    a, b = lines(before), lines(after)
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    room = min(len(a), len(b)) - head
    tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y or k == room), room)
    old, new, name = a[head : len(a) - tail], b[head : len(b) - tail], path.lstrip("/")
    top = [f"--- a/{name}", f"+++ b/{name}", f"@@ -{head + 1},{len(old)} +{head + 1},{len(new)} @@"]
    return "\n".join([*top, *(f"-{x}" for x in old), *(f"+{x}" for x in new), ""])


def _positioned(text: str, edits: list) -> str:
    for r, c, r2, c2, new in edits:
        lines, ends = text.split("\n"), []
        for row, column in ((r, c), (r2, c2)):
            if not 0 <= row < len(lines) or not 0 <= column <= len(lines[row].encode()):
                raise S.RequestError(f"{row}:{column} is out of bounds")
            ends.append(sum(len(x.encode()) + 1 for x in lines[:row]) + column)
        raw = text.encode()
        if ends[0] > ends[1]:
            raise S.RequestError("an edit ends before it starts")
        text = (raw[: ends[0]] + new.encode() + raw[ends[1] :]).decode()
    return text
