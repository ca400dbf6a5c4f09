"""Calls of every language resolved by its scopes, over small sources of our own, and an index kept fresh file by file."""

import pytest

from symloom.api import Engine
from symloom.operators import index
from symloom.schema import RequestError
from symloom.sources import workspace as W

FILES = {
    "/w/a.cpp": '#include "a.h"\nnamespace app { namespace inner { int leaf(int x) { return x; } int leaf(int x, int y = 2, int z = 3) { return x; } }\nint go(int v) { return inner::leaf(v, 1); }\nint amb(int v) { return inner::leaf(v); }\nclass Box : public Base { public: int get() const { return run(1); } int put(int q) { return this->get(); } };\nint use(Box b) { return b.get(); } }\nusing namespace app;\nint main2() { return go(1); }\nint shade(int go) { return go(1); }\n',
    "/w/q.cpp": "class Q { public: Q(int a) : v(a) { init(); } int at() { return 1; } int at() const { return 2; } int mine() { return at(); } int fixed() const { return this->at(); } void init() { } int v; };\nint far(Q q) { return q.at(); }\n",
    "/w/a.h": "struct Base { int run(int a) { return a; } };\n",
    "/w/x/A.java": "package com.x;\nimport com.y.B;\nimport static com.y.B.stat;\npublic class A extends B {\n  public A(int v) { }\n  int own(int a) { return twice(a) + stat(1); }\n  int twice(int a) { return a; }\n  int twice(int a, int b) { return a; }\n  int inh() { return up(3); }\n  int sup() { return super.up(4); }\n  int rec(B b) { return b.up(1); }\n  int wrong() { return up(); }\n  static int far() { return B.stat(2) + Peer.hi(); }\n}\n",
    "/w/x/Made.java": "package com.x;\nclass Made extends Base1 { Made(int a, int b) { super(a); } Made(int a) { this(a, 1); } }\nclass Base1 { Base1(int a) { } }\n",
    "/w/c/Made.cs": "namespace M { class B1 { public B1(int a) { } } class D1 : B1 { public D1(int a, int b) : base(a) { } public D1(int a) : this(a, 1) { } } }\n",
    "/w/x/Peer.java": "package com.x;\nclass Peer { static int hi() { return 1; } int two(int a) { return a; } int two(String a) { return 1; } int both() { return two(1); } }\n",
    "/w/x/I.java": "package com.x;\ninterface I extends J { default int dft(int a) { return a; } }\ninterface J { default int low() { return 1; } default int two() { return 1; } }\ninterface K { default int two() { return 2; } }\nclass Impl implements I, K { int a() { return dft(1) + this.low(); } int b() { return two(); } }\n",
    "/w/y/B.java": "package com.y;\npublic class B {\n  int up(int a) { return a; }\n  public static int stat(int a) { return a; }\n}\n",
    "/w/c/C.cs": "global using static N.Util;\nglobal using Lib;\nnamespace N { public static class Util { public static int Twice(int v) => v; } public class P { protected int Up(int a) { return a; } } public class Q : P { int M() { return Up(1) + this.Own(2) + base.Up(3) + Twice(3) + Other.Far(1) + Helper.Do(); } int Own(int v) { return v; } } class Other { public static int Far(int a) => a; } }\n",
    "/w/c/L.cs": "namespace Lib;\npublic static class Helper { public static int Do() { return 1; } }\n",
    "/w/k/a.kt": "package p.q\nimport r.far\nfun near(x: Int): Int = x\nclass K { fun m(): Int { return near(1) + far(2) + own() }\n fun own(): Int = 3 }\nfun t(k: K): Int = k.own()\n",
    "/w/k/b.kt": "package r\nfun far(x: Int): Int { return x }\n",
    "/w/go.mod": "module ex.com/m\n",
    "/w/g/a.go": 'package g\nimport ( h "ex.com/m/util" )\nfunc F(a int) int { return h.Up(a) + G(a) }\ntype T struct { }\nfunc (t *T) M() int { return t.N() + F(1) }\nfunc (t *T) N() int { return 1 }\nfunc Mk() int { x := &T{}\n return x.M() }\nfunc Lit() int { return T{}.N() }\n',
    "/w/g/b.go": "package g\nfunc G(a int) int { return a }\n",
    "/w/g/b_test.go": "package g\nfunc G(a int) int { return a }\n",
    "/w/util/u.go": "package utilx\nfunc Up(a int) int { return a }\n",
    "/w/r/main.rs": "mod net;\nmod two;\nuse crate::net::dial as d;\nfn main() { d(); net::http::get(); local(); T::mk(); two::gone(); }\nfn local() {}\nstruct T {}\nimpl T { fn mk() -> i32 { local(); Self::both() } fn both() -> i32 { 1 } }\nmod inl { fn a() { super::local(); b(); } fn b() {} }\n",
    "/w/r/two.rs": "pub fn gone() {}\n",
    "/w/r/two/mod.rs": "pub fn gone() {}\n",
    "/w/r/net/mod.rs": "pub mod http;\npub fn dial() { super::local(); self::http::get(); }\n",
    "/w/r/net/http.rs": "pub fn get() { super::dial(); crate::local(); }\n",
    "/w/j/a.js": 'import { q as z, k } from "./idx";\nimport dflt, * as ns from "./b.js";\nconst { w } = require("./b");\nexport function run(a) { return z(a) + k() + dflt() + w() + loc(); }\nexport function spaces() { return ns.q(1) + new ns.C(1); }\nfunction loc() { return 1; }\nfunction shadow(loc) { return loc(); }\n',
    "/w/j/idx.ts": 'export * from "./b";\nexport * from "./c";\nexport { q } from "./b";\n',
    "/w/j/b.js": "export function q(x) { return x; }\nexport default function entry() { return 1; }\nexport function k() { return 1; }\nexport const w = (x) => { return x; };\nexport class C { constructor(a) { } }\n",
    "/w/j/c.ts": "export function k() { return 2; }\n",
    "/w/s.c": '#include "h.h"\nstatic int priv(int a) { return a; }\nint pub(int a) { return priv(a) + shared(a); }\n',
    "/w/h.h": "int shared(int a) { return a; }\n",
    "/w/o.c": "int shared(int a) { return 2; }\nint lone(int a) { return priv(a); }\n",
    "/w/p.py": "from p2 import helper\n\ndef first():\n    return helper() + len([])\n",
    "/w/p2.py": "def helper():\n    return other()\n\ndef other():\n    return 1\n",
}

WANT = {
    "cpp": {("app::go(int)", "app::inner::leaf(int,int,int)"), ("app::Box::get() const", "Base::run"), ("app::Box::put(int)", "app::Box::get() const"), ("app::use(Box)", "app::Box::get() const"), ("main2()", "app::go(int)"), ("Q::Q(int)", "Q::init()"), ("Q::mine()", "Q::at()"), ("Q::fixed() const", "Q::at() const"), ("far(Q)", "Q::at()")},
    "java": {("own", "twice#overload[1]"), ("own", "stat"), ("inh", "up"), ("sup", "up"), ("rec", "up"), ("far", "stat"), ("far", "hi"), ("a", "dft"), ("a", "low"), ("Made#overload[1]", "Base1"), ("Made#overload[2]", "Made#overload[1]")},
    "csharp": {("M", x) for x in ("Up", "Own", "Twice", "Far", "Do")} | {("D1#overload[1]", "B1"), ("D1#overload[2]", "D1#overload[1]")},
    "kotlin": {("m", "near"), ("m", "far"), ("m", "own"), ("t", "own")},
    "go": {("g.F", "utilx.Up"), ("g.F", "g.G"), ("g.T::M", "g.T::N"), ("g.T::M", "g.F"), ("g.Mk", "g.T::M"), ("g.Lit", "g.T::N")},
    "rust": {("main", "dial"), ("main", "get"), ("main", "local"), ("main", "T::mk"), ("T::mk", "local"), ("T::mk", "T::both"), ("inl::a", "local"), ("inl::a", "inl::b"), ("dial", "local"), ("dial", "get"), ("get", "dial"), ("get", "local")},
    "javascript": {("run", "q"), ("run", "entry"), ("run", "w"), ("run", "loc"), ("spaces", "q"), ("spaces", "C")},
    "c": {("/w/s.c::pub", "/w/s.c::priv"), ("/w/s.c::pub", "/w/h.h::shared")},
    "python": {("first", "helper"), ("helper", "other")},
}
LAST = ("java", "csharp", "kotlin")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, FILES)


@pytest.fixture(scope="module")
def found(engine):
    _, symbols, edges = engine.catalog()
    where = {r.symbol_id: r.file_path for r in symbols.select("symbol_id", "file_path").collect()}
    return {(r.src, r.dst): where[r.src].rpartition(".")[2] for r in edges.collect()}


@pytest.mark.parametrize("language", sorted(WANT))
def test_calls_go_by_the_scopes_of_the_language(found, language):
    ends = {"cpp": ("cpp",), "java": ("java",), "csharp": ("cs",), "kotlin": ("kt",), "go": ("go",), "rust": ("rs",), "javascript": ("js", "ts"), "c": ("c",), "python": ("py",)}[language]
    short = (lambda x: x.rpartition("::")[2]) if language in LAST else lambda x: x
    assert {(short(a), short(b)) for (a, b), e in found.items() if e in ends} == WANT[language]


def test_a_repeated_call_extracts_nothing(engine, monkeypatch):
    before = engine.catalog()
    monkeypatch.setattr(W, "raw_symbols", lambda files: pytest.fail("extracted again"))
    assert engine.catalog() is before or engine.catalog() == before


def test_one_file_is_refreshed_like_a_rebuild(spark, tmp_path):
    files = {p: s for p, s in FILES.items() if p.endswith((".py", ".java", "s.c", "h.h", "o.c"))}
    e = Engine(spark, dict(files))
    a, b = (f"file://{tmp_path}/{k}" for k in "ab")
    e.rebuild_symbol_index(None, a)
    steps = [("/w/p2.py", "def helper():\n    return 2\n\ndef first():\n    return helper()\n"), ("/w/y/B.java", None), ("/w/h.h", "int other(int a) { return a; }\n")]
    for path, text in steps:
        if text is None:
            del e.rows[path]
        else:
            e.rows[path] = text
        e.refresh_symbol_index_for_file(None, a, path)
    e.rebuild_symbol_index(None, b)
    one, two = (index.Store(spark, x).read() for x in (a, b))
    for name, key in (("symbols", ["symbol_id", "file_path", "start_byte"]), ("edges", ["src", "dst"]), ("file_state", ["file_path", "fingerprint"])):
        rows = [sorted(tuple(r) for r in t[name].select(*key).collect()) for t in (one, two)]
        assert rows[0] == rows[1], name
    assert e.inspect_symbol_index(a)["ok"]


def test_older_schemas_are_migrated(spark, tmp_path):
    root = f"file://{tmp_path}/old"
    e = Engine(spark, {"/w/p2.py": FILES["/w/p2.py"]})
    e.rebuild_symbol_index(None, root)
    store = index.Store(spark, root)
    rows = spark.createDataFrame([("", "m.f", "/w/p2.py", "function_definition", 0, 5)], "symbol_id string, semantic_path string, file_path string, node_kind string, start_byte long, end_byte long")
    index.SCHEMA_VERSION, current = 4, index.SCHEMA_VERSION
    try:
        store.write(symbols=rows, edges=spark.createDataFrame([], "src string, dst string"), file_state=spark.createDataFrame([("/w/p2.py", "x")], "file_path string, fingerprint string"))
    finally:
        index.SCHEMA_VERSION = current
    assert store.plan() == "migrate"
    store.migrate()
    got = store.read()
    row = got["symbols"].first()
    assert store.plan() == "none" and row.symbol_id == "m.f" and row.parameters == [] and row.reference_call_arities == {} and got["file_state"].count() == 0
    assert e.migrate_symbol_index(root)["migrated_from"] == "none"


def test_tree_queries(engine):
    t = engine.tools()["execute_tree_query"]
    got = t(file_path="/w/p.py", query='(function_definition name: (identifier) @n) (call function: (identifier) @c (#eq? @c "helper"))')
    assert [(r["capture"], r["text"], r["owner"], r["start_point"]) for r in got] == [("n", "first", "first", {"row": 2, "column": 4}), ("c", "helper", "first", {"row": 3, "column": 11})]
    got = t(file_path="/w/k/a.kt", query='(call_expression function: (_) @c (#match? @c "^(near|own)$"))')
    assert [r["text"] for r in got] == ["near", "own"] and got[0]["owner"] is None
    for bad in ("(", "(a", "(a)*", "a", "(a (#eq? @b \"x\"))", "  "):
        with pytest.raises(RequestError):
            t(file_path="/w/p.py", query=bad)
    with pytest.raises(RequestError, match="captures"):
        t(file_path="/w/p2.py", query="(identifier) @i", max_captures=1)


def test_commit_is_validated_against_a_trace(engine):
    t = engine.tools()
    trace = t["trace_symbol_graph"](symbol_path="first")["trace"]
    patch = t["preview_patch_ast_node"](file_path="/w/p.py", semantic_path="first", new_code="def first():\n    return helper() + 2\n")
    assert patch["gate"] == "allowed" and patch["diff"].startswith("--- a/w/p.py\n+++ b/w/p.py\n@@ -4,1 +4,1 @@\n")
    got = t["validate_patch_commit_with_trace"](patch, trace)
    assert got["decision"] == "allowed" and got["replay"]["items"][0]["trace_match_scope"] == "callees"
    lost = t["preview_patch_ast_node"](file_path="/w/p.py", semantic_path="first", new_code="def first():\n    return other()\n")
    assert t["validate_patch_commit_with_trace"](lost, trace)["decision"] == "rejected_by_trace_replay"
    broken = t["preview_patch_ast_node"](file_path="/w/p.py", semantic_path="first", new_code="def first(:\n", bypass_reason="known")
    assert broken["gate"] == "allowed_with_bypass" and broken["reason"] == "syntax"
    sarif = t["export_patch_diagnostics_sarif"](broken)
    assert [r["level"] for r in sarif["runs"][0]["results"]] == ["error", "warning"] and sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "file:///w/p.py"
    unknown = t["preview_patch_ast_node"](file_path="/w/p.py", semantic_path="first", new_code="def first():\n    return nowhere()\n")
    assert unknown["gate"] == "rejected" and t["validate_patch_commit_with_trace"](unknown, trace)["decision"] == "rejected_by_patch_gate"
