"""The engine over small source trees, and graph operators against plain Python models."""

import random

import pytest

from symloom.api import Engine
from symloom.extract import lexical, python_ast
from symloom.operators import graph, index
from symloom.schema import RequestError
from symloom.sources import workspace as W

FILES = {
    "/ws/a.py": 'from b import helper\n\ndef orchestrate():\n    """Doc é."""\n    return helper(1)\n\ndef entrypoint():\n    return orchestrate()\n',
    "/ws/b.py": "def helper(x):\n    return leaf()\n\ndef leaf():\n    return 1\n\nclass Greeter:\n    def greet(self):\n        return leaf()\n",
    "/ws/over.py": "from typing import overload\n\n@overload\ndef get(x: int): ...\n@overload\ndef get(x: str): ...\ndef get(x): return x\n",
    "/ws/m.ts": 'import {q} from "./n";\nexport function run(a, b) { return q(a); }\n',
    "/ws/n.ts": "export function q(x) { return x; }\n",
    "/ws/x.go": "package x\nfunc (s *T) M(a int) int { return F(a) }\nfunc F(a int) int { return a }\n",
    "/ws/bad.py": "def x(:\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, FILES)


def test_edges_and_trace(engine):
    t = engine.tools()
    got = t["trace_symbol_graph"](symbol_path="orchestrate")["trace"]
    assert [c["symbol_id"] for c in got["callers"]] == ["entrypoint"] and [c["symbol_id"] for c in got["callees"]] == ["helper"]
    got = t["trace_symbol_neighborhood"](symbol_path="leaf", direction="callers", max_depth=3)["neighborhood"]
    assert {n["id"]: n["depth"] for n in got["nodes"]} == {"leaf": 0, "helper": 1, "Greeter": 1, "Greeter.greet": 1, "orchestrate": 2, "entrypoint": 3}


def test_search_list_read(engine):
    t = engine.tools()
    found = t["search_symbols"](query="helper", limit=2)
    assert found["matches"][0]["symbol_id"] == "helper" and found["match_details"][0] == {"symbol_id": "helper", "score": 1000, "matched_fields": ["base_name", "symbol_id", "semantic_path", "signature"]}
    assert (found["query"], found["indexed_files"]) == ("helper", 7)
    assert t["list_symbols"](limit=3)["truncated"] and len(t["list_symbols"](limit=3)["symbols"]) == 3
    assert t["list_symbols"](limit=0) == {"indexed_files": 7, "total_symbols": 0, "truncated": False, "symbols": []}
    assert t["read_symbol"](symbol_path="leaf")["read"]["text"] == "def leaf():\n    return 1"
    assert t["read_symbol_at_position"](position=("/ws/b.py", 7, 9))["read"]["symbol_id"] == "Greeter.greet"
    assert t["search_symbols_context"](query="leaf")["reads"][0]["start_row"] == 3
    assert t["read_symbol_discovery_context"](symbol_path="run")["reads"]["q"]["text"].startswith("function q")
    with pytest.raises(RequestError):
        t["search_symbols"](query="  ")
    with pytest.raises(RequestError, match="ambiguous"):
        t["read_symbol"](symbol_path="get")


def test_overload_ids(engine):
    _, symbols, _ = engine.catalog()
    ids = [r.symbol_id for r in symbols.filter("semantic_path = 'get'").orderBy("start_byte").collect()]
    assert ids == ["/ws/over.py::get#overload[1]", "/ws/over.py::get#overload[2]", "/ws/over.py::get#implementation"]


def test_overlay_and_patch(engine):
    t = engine.tools()
    got = t["trace_symbol_graph"](symbol_path="leaf", file_path="/ws/b.py", source="def leaf(): return 2\n")["trace"]
    assert got["callers"] == []
    ok = t["preview_patch_ast_node"](file_path="/ws/b.py", semantic_path="Greeter.greet", new_code="def greet(self):\n    return helper(2)")
    assert ok["gate"] == "allowed" and "        return helper(2)" in ok["updated_source"]
    assert t["preview_patch_ast_node"](file_path="/ws/b.py", semantic_path="leaf", new_code="def leaf(:")["reason"] == "syntax"
    lost = t["preview_patch_ast_node"](file_path="/ws/b.py", semantic_path="leaf", new_code="def leaf():\n    return nowhere()", bypass_reason="later")
    assert (lost["reason"], lost["gate"]) == ("unresolved", "allowed_with_bypass")
    assert t["export_patch_diagnostics_sarif"](patch=lost)["runs"][0]["results"][0]["ruleId"] == "symloom.binding.unresolved"
    full = t["validate_patch_with_trace_context"](file_path="/ws/b.py", semantic_path="helper", new_code="def helper(x):\n    return 3")
    assert full["impact"]["removed_callees"] == ["leaf"] and full["impact"]["affected"] == 1


def test_targets_and_replacements(spark):
    source = "class A:\n\t@deco\n\tdef f(self):\n\t\treturn 1\n\n@overload\ndef g(x): ...\ndef g(x):\n    return x\n"
    e = Engine(spark, {"/w/t.py": "from typing import overload\n" + source})
    text = e.rows["/w/t.py"]
    _, after, _, guard = e._patched("/w/t.py", "A.f", 'def f(self):\n    if x:\n        return """a\n  b"""', None)
    assert guard[0]["kind"] == "decorator_guard" and '\tdef f(self):\n\t\tif x:\n\t\t\treturn """a\n  b"""\n' in after
    _, after, _, guard = e._patched("/w/t.py", "/w/t.py::A.f", "@deco\ndef f(self):\n  return 2", None)
    assert not guard and "\t@deco\n\tdef f(self):\n\t\treturn 2\n" in after
    assert e._target("/w/t.py", text, "/w/t.py::g#implementation")["start_byte"] > e._target("/w/t.py", text, "/w/t.py::g#overload[1]")["start_byte"]
    for bad in ("g", "nothing"):
        with pytest.raises(RequestError):
            e._target("/w/t.py", text, bad)
    kinds = [i["kind"] for i in e.preview_patch("/w/t.py", "A.f", "@deco\ndef f(self):\nreturn 2")["syntax_issues"]]
    assert kinds[:2] == ["error", "indentation"] and set(kinds[1:]) == {"indentation"}


def test_write_is_atomic(spark, tmp_path):
    from symloom.sources.atomic import write_text

    at = tmp_path / "a.py"
    at.write_text("old")
    write_text(str(at), "new é")
    assert at.read_text() == "new é" and [p.name for p in tmp_path.iterdir()] == ["a.py"]


def test_buffers(spark):
    e = Engine(spark, FILES)
    e.did_open("/ws/n.ts")
    e.did_change("/ws/n.ts", [(0, 0, 0, 0, "// é\n"), (0, 5, 0, 5, "!")])
    with pytest.raises(RequestError):
        e.did_change("/ws/n.ts", [(0, 0, 0, 0, "x"), (99, 0, 99, 0, "y")])
    assert e.read_virtual_file("/ws/n.ts")["source"].startswith("// é!\n") and e.list_virtual_files(True)[0]["version"] == 1
    assert e.commit_virtual_file("/ws/n.ts")["dirty"] is False and e.rows["/ws/n.ts"].startswith("// é!")
    assert e.did_close("/ws/n.ts")["dirty"] is False and e.list_virtual_files() == []


def test_index_lifecycle(spark, tmp_path):
    e = Engine(spark, FILES)
    db = f"file://{tmp_path}/db"
    assert e.inspect_symbol_index(db) == {"exists": False, "ok": False, "action": "rebuild"}
    assert e.rebuild_symbol_index(None, db) == {"indexed": 7, "reused": 0, "rebuilt": 7}
    assert e.inspect_symbol_index(db)["ok"]
    e.rows["/ws/b.py"] += "\ndef more():\n    return leaf()\n"
    with pytest.raises(index.IndexError_, match="stale"):
        e.catalog(index_path=db)
    assert e.rebuild_symbol_index(None, db) == {"indexed": 7, "reused": 6, "rebuilt": 1}
    _, symbols, edges = e.catalog(index_path=db)
    _, live, live_edges = Engine(spark, e.rows).catalog()
    assert {tuple(r) for r in edges.collect()} == {tuple(r) for r in live_edges.collect()}
    assert {r.symbol_id for r in symbols.collect()} == {r.symbol_id for r in live.collect()}


def test_scan(spark, tmp_path):
    for name, text in (("a.py", "def f(): pass\n"), ("node_modules/b.py", "def g(): pass\n"), ("c.txt", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = W.scan(spark, str(tmp_path)).collect()
    assert [r.file_path for r in got] == [f"{tmp_path}/a.py"] and got[0].language == "python"
    (tmp_path / "d.py").write_text("x")
    with pytest.raises(RequestError):
        W.scan(spark, str(tmp_path), max_files=1)
    (tmp_path / "out").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "out" / "e.py").write_text("x")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out")
    (tmp_path / "in" / "g.py").symlink_to(tmp_path / "d.py")
    (tmp_path / "in" / "f.py").write_text("x")
    assert [r.file_path for r in W.scan(spark, str(tmp_path / "in")).collect()] == [f"{tmp_path}/in/f.py"]
    with pytest.raises(RequestError, match="ms"):
        W.scan(spark, str(tmp_path), timeout_ms=1)
    with pytest.raises(RequestError):
        Engine(spark, root=str(tmp_path / "in")).catalog(file_path=f"{tmp_path}/out/e.py", source="x")


def test_skeleton_and_tree_query(engine):
    assert engine.get_semantic_skeleton("/ws/b.py", 1)["skeleton"] == "def helper(x) ...\n\ndef leaf() ...\n\nclass Greeter ..."
    full = engine.get_semantic_skeleton("/ws/b.py", 1, expand_nodes=("Greeter",))["skeleton"]
    assert full.endswith("        return leaf()")
    assert [c["owner"] for c in engine.execute_tree_query("/ws/b.py", '(function_definition name: (identifier) @n (#eq? @n "greet"))')] == ["Greeter.greet"]
    with pytest.raises(RequestError):
        engine.execute_tree_query("/ws/b.py", "function_definition", max_captures=1)


def test_every_tool_is_there(engine):
    assert len(engine.tools()) == 58
    assert len(engine.batch([("list_symbols", {"limit": 1}), ("get_semantic_skeleton", {"file_path": "/ws/a.py"})], 60_000)) == 2


def walk(adjacent, root, direction, max_depth, max_nodes):
    """The queue walk that the level-wise joins must equal."""
    ids, depth, truncated, k = [root], {root: 0}, False, 0
    while k < len(ids):
        at = ids[k]
        k += 1
        if depth[at] == max_depth:
            continue
        up, down = (sorted(adjacent[at][d]) for d in ("callers", "callees"))
        for n in (up if direction != "callees" else []) + (down if direction != "callers" else []):
            if n in depth:
                continue
            if len(ids) == max_nodes:
                truncated = True
                continue
            depth[n] = depth[at] + 1
            ids.append(n)
    return [(i, depth[i]) for i in ids], truncated


@pytest.mark.parametrize("seed", range(3))
def test_neighborhood_equals_queue_walk(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(14)]
    pairs = {(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(30)) if a != b}
    adjacent = {n: {"callers": {a for a, b in pairs if b == n and a != b}, "callees": {b for a, b in pairs if a == n and a != b}} for n in nodes}
    symbols, edges = spark.createDataFrame([(n,) for n in nodes], "symbol_id string"), spark.createDataFrame(sorted(pairs), "src string, dst string")
    direction, depth, budget = rng.choice(["callers", "callees", "both"]), rng.randint(1, 3), rng.randint(1, 9)
    got, _ = graph.neighborhood(symbols, edges, spark.createDataFrame([(n,) for n in nodes[:4]], "root_id string"), direction, depth, budget)
    rows = got.orderBy("root_id", "ordinal").collect()
    for root in nodes[:4]:
        want, truncated = walk(adjacent, root, direction, depth, budget)
        own = [r for r in rows if r.root_id == root]
        assert [(r.id, r.depth) for r in own] == want and own[0].truncated == truncated


def test_neighborhood_refuses_loops(spark):
    symbols, edges = spark.createDataFrame([("a",), ("b",)], "symbol_id string"), spark.createDataFrame([("a", "b"), ("b", "b")], "src string, dst string")
    with pytest.raises(Exception, match="own neighbour"):
        graph.neighborhood(symbols, edges, spark.createDataFrame([("a",)], "root_id string"))


def test_python_extraction():
    rows = {r["semantic_path"]: r for r in python_ast.declarations("import m\nfrom p.q import z as y\n\ndef f(a, b=1, *c) -> int:\n    x = T()\n    a()\n    g(1, 2)\n    x.run()\n    return [k for k in m.w(y)]\n")}
    assert rows["f"]["reference_names"] == ["T", "T.run", "g", "m.w", "p.q.z"] and rows["f"]["reference_call_arities"]["g"] == [2]
    assert rows["f"]["parameters"] == ["a", "b=1", "*c"] and rows["f"]["return_type"] == "int"
    assert python_ast.declarations("def (") == [] and python_ast.issues("def (")[0]["kind"] == "error"


def test_overload_names_follow_the_source():
    def marked(source):
        return [r["is_overload"] for r in python_ast.declarations(source)]

    assert marked("from typing import overload as o\n@o\ndef f(): ...\no = None\n@o\ndef f(): ...\n") == [True, False]
    assert marked("import typing as t\nv = t.overload\n@v\ndef f(): ...\n@t.overload\ndef f(): ...\ndef t(): ...\n@t.overload\ndef f(): ...\n") == [True, True, False, False]
    assert marked("from typing_extensions import overload\nclass A:\n    @overload\n    def m(self): ...\n    overload = 1\n    @overload\n    def m(self): ...\n@overload\ndef g(): ...\n") == [False, True, False, True]
    assert marked("try:\n    from typing import overload\nexcept ImportError:\n    overload = None\n@overload\ndef f(): ...\n") == [False]


def test_lexical_extraction():
    java = lexical.declarations('class A {\n  /* } */ String s = "}";\n  int go(int x) { return run(x, f(1)); }\n}\n', "java")
    assert [(r["semantic_path"], r["reference_call_arities"]) for r in java] == [("A", {}), ("A::go", {"f": [1], "run": [2]})]
    assert lexical.issues("f(a { )")[0]["kind"] == "error" and lexical.issues("f(a)") == []
