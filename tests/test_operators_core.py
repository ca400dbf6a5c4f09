"""Rules and operators on small inputs of their own."""

import pytest
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.operators import index, patch, query, resolve
from symloom.streaming import buffers, reconcile


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("path, want", [("a<b<c>>::d", "a::d"), ("a", None), ("f(x<y>)", "fx<y>"), ("a<b", None), ("a>b<", None), ("v<int>", "v"), ("api::Box<detail::Tag>", "api::Box"), ("api::Box<(1 > 0)>", "api::Box"), ("a<b > c>", "a"), ("a<b> c", None), ("a(b", None)])
def test_template_base(spark, path, want):
    assert one(spark, E.template_base(F.lit(path))) == want


@pytest.mark.parametrize("path, base, parent", [("a::b.c", "c", "a"), ("a.b", "b", "a"), ("x", "x", None), ("p::q::r", "r", "p::q")])
def test_names(spark, path, base, parent):
    assert one(spark, E.base_name(F.lit(path))) == base and one(spark, E.parent_path(F.lit(path))) == parent


@pytest.mark.parametrize("parameters, takes", [(["int value", "int radix = 10"], {1, 2}), (["int first", "..."], {1, 2, 3, 4}), (["void"], {0}), ([], {0}), (["Args... values"], {1}), (["int a", "Args..."], {2}), (["F f = g(1, 2)"], {0, 1}), (["int a[b = 1]"], {1}), (["T t{x = 1}", "int b=2"], {1, 2})])
def test_arity(spark, parameters, takes):
    p = F.array(*[F.lit(x) for x in parameters]).cast("array<string>")
    assert {n for n in range(5) if one(spark, E.accepts_arity(p, F.lit(n)))} == takes


def test_positions_count_bytes(spark):
    text = F.lit("é\nab\n")
    assert [one(spark, f(text, F.lit(4))) for f in (E.offset_row, E.offset_column)] == [1, 1]
    assert one(spark, E.point_offset(text, F.lit(1), F.lit(1))) == 4
    assert one(spark, E.point_offset(text, F.lit(2), F.lit(0))) == 6
    assert one(spark, E.point_offset(text, F.lit(3), F.lit(0))) is None
    assert one(spark, E.byte_slice(text, F.lit(0), F.lit(2))) == "é"


@pytest.mark.parametrize("text, read", [('["a", ""]', E.json_list), ('["a", null]', E.json_list), ('{"a": 1}', E.json_list), ("[", E.json_list), ('{"a": [1], "a": [2]}', E.json_map), ("[1]", E.json_map), ('{"a": "x"}', E.json_map)])
def test_stored_json_is_read_strictly(spark, text, read):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, read(F.lit(text)))


def test_stored_json(spark):
    assert one(spark, E.json_list(F.lit('["a", "b"]'))) == ["a", "b"] and one(spark, E.json_map(F.lit('{"a": [1, 2]}'))) == {"a": [1, 2]}
    assert one(spark, E.json_list(F.lit(None).cast("string"))) is None


def test_paths(spark):
    assert one(spark, E.normalized_path(F.lit("/a/./b/../c\\d"))) == "/a/c/d"
    assert one(spark, E.path_uri(F.lit("/a b/é"))) == "file:///a%20b/%C3%A9"
    assert one(spark, E.language(F.lit("/x/Y.HPP"))) == "cpp" and one(spark, E.language(F.lit("/x/y"))) is None
    assert one(spark, E.key_without_origin(F.lit("a|b|c|d|e|f|g"))) == "a|b|c|e|f|g"
    assert one(spark, E.key_without_origin(F.lit("a|b|c|d|e"))) is None
    assert [one(spark, E.path_uri(F.lit(p))) for p in ("/c:/a", "c:\\w s", "//host/x", "\\\\host\\x")] == ["file:///c:/a", "file:///c:/w%20s", "file://host/x", "file://host/x"]
    assert [one(spark, E.inside(F.lit(p), "/w")) for p in ("/w/a", "/w/../x", "/wx/a", "/w/a/../../y")] == [True, False, False, False]
    assert {d: one(spark, E.in_skipped_directory(F.lit(f"a/{d}/f.py"))) for d in (".ruff_cache", ".tox", ".hg", ".svn", "Build")} == {".ruff_cache": True, ".tox": True, ".hg": False, ".svn": False, "Build": True}


# Ranks of kinds.
RANKS = {"function_definition": 3, "function_signature_item": 3, "function_item": 3, "class_definition": 3, "class_specifier": 2, "struct_specifier": 2, "union_specifier": 2, "alias_declaration": 2, "using_declaration": 2, "template_instantiation": 2, "concept_definition": 2, "declaration": 1, "field_declaration": 1, "function_declaration": 0, "method_definition": 0}


def test_kind_ranks(spark):
    rows = spark.createDataFrame(list(RANKS.items()), "kind string, want int").withColumn("got", E.kind_rank("kind"))
    assert {r.kind: r.got for r in rows.collect()} == RANKS


def test_scope_counts_for_cpp_callers_only(spark):
    from symloom.operators import query

    rows = spark.createDataFrame([("/a.cpp", "s", 1), ("/a.c", "s", 2), ("/a.py", "s", 3), ("/a.HPP", "s", 4), ("/a.cpp", None, 5), ("/a.cpp", "t", 6)], "ctx string, scope string, k int")
    rows = rows.selectExpr("*", "'/b.cpp' file_path", "'s' scope_path", "'x' semantic_path", "'declaration' node_kind")
    no = F.lit(False)
    got = {r.k: r.v for r in rows.select("k", query.resolver_rank(F.col("ctx"), no, no, F.col("scope")).alias("v")).collect()}
    assert got == {1: 501, 2: 1, 3: 1, 4: 501, 5: 1, 6: 1}


@pytest.mark.parametrize("module, first, last, n", [("./x", "/w/x.js", "/w/x/index.tsx", 16), ("../y.mjs", "/y.mjs", "/y.mjs", 1), (".", "/w.js", "/w/index.tsx", 16), ("pkg", None, None, 0)])
def test_script_candidates(spark, module, first, last, n):
    got = [r.candidate for r in resolve.javascript_candidates(spark.createDataFrame([("i", "/w/f.ts", module)], "import_id string, file_path string, module string")).orderBy("ordinal").collect()]
    assert len(got) == n and (got[:1], got[-1:]) == ([first] * bool(n), [last] * bool(n))
    assert not n == 16 or [g.rpartition(".")[2] for g in got[:8]] == ["js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx"]


def test_unified_diff(spark):
    diff = lambda a, b: one(spark, patch.unified_diff(F.lit("/w/f.py"), F.lit(a), F.lit(b)))
    top = "--- a/w/f.py\n+++ b/w/f.py\n"
    assert diff("a\nb\nc", "a\nx\nc") == top + "@@ -2,1 +2,1 @@\n-b\n+x\n"
    assert diff("a\nc", "a\nb\nc") == top + "@@ -2,0 +2,1 @@\n+b\n"
    assert diff("a\r\nb\r\n", "a\nb\r") == top + "@@ -2,1 +2,1 @@\n-b\n+b\r\n"
    assert diff("a", "a\n") == top + "@@ -2,0 +2,0 @@\n" and diff("", "x") == top + "@@ -1,0 +1,1 @@\n+x\n"
    assert diff("a", "a") == "" and diff("x\nx\nx", "x\nx") == top + "@@ -3,1 +3,0 @@\n-x\n"


def test_indentation(spark):
    text = "if a:\n# no\n\nx\ny\n  z\nw\nfor b:\nelse:\n\tq:  \n\t r\n"
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text.split("\n"))], "file_path string, row long, line string")
    got = sorted((r.row, r.indent, r.header) for r in patch.indentation_issues(lines).collect())
    assert got == [(3, 0, 0), (4, 0, 0), (8, 0, 0)]


def test_replay_and_commit(spark):
    k = lambda s, o="o": f"{s}|f|k|{o}|1..2|sig"
    trace = spark.createDataFrame([(1, "callee", k("a")), (1, "caller", k("a")), (1, "caller", k("b")), (1, "trace_root", k("r"))], "patch_id int, role string, evidence_key string")
    asked = [("1", k("a"), "passed"), ("2", k("b", "x"), "passed"), ("3", k("r", "y"), "passed"), ("4", k("z", "module_scope"), "passed"), ("5", k("z"), "passed"), ("6", None, "blocked"), ("7", k("a"), "failed"), ("8", "a|b|c|local_scope", "passed")]
    got = {r.name: (r.scope, r.status) for r in patch.replay(spark.createDataFrame([(1, *x) for x in asked], "patch_id int, name string, evidence_key string, invariant string"), trace).collect()}
    assert got == {"1": ("callees", "matched"), "2": ("callers", "matched"), "3": ("symbol", "matched"), "4": ("patch_scope", "matched"), "5": ("none", "missing"), "6": ("none", "blocked"), "7": ("callees", "failed"), "8": ("patch_scope", "matched")}
    rows = [(1, "allowed", "matched"), (2, "allowed", "blocked"), (3, "allowed_with_bypass", "blocked"), (4, "allowed_with_bypass", "missing"), (5, "rejected", "matched"), (6, "allowed_with_bypass", "matched"), (7, "allowed", "failed")]
    both = spark.createDataFrame(rows, "patch_id int, gate string, status string")
    got = {r.patch_id: r.decision for r in patch.commit_decision(both.select("patch_id", "gate"), both.select("patch_id", "status")).collect()}
    no = "rejected_by_trace_replay"
    assert got == {1: "allowed", 2: no, 3: "allowed_with_bypass", 4: no, 5: "rejected_by_patch_gate", 6: "allowed_with_bypass", 7: no}


def test_decisions_and_gate(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "patch_id int, name string")
    cands = spark.createDataFrame([(1, "a", "x", 3, False), (1, "a", "y", 1, False), (1, "b", "x", 2, False), (1, "b", "y", 2, False), (2, "a", "x", 1, False), (2, "a", "p", 5, True), (3, "a", "z", 1, False)], "patch_id int, name string, candidate string, rank int, suppressing boolean")
    got = {(r.patch_id, r.name): (r.status, r.selected) for r in patch.decisions(refs, cands).collect()}
    assert got == {(1, "a"): ("resolved", "x"), (1, "b"): ("ambiguous", None), (2, "a"): ("unresolved", None), (3, "a"): ("resolved", "z")}
    patches = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 0, False), (4, 1, True)], "patch_id int, syntax_errors int, bypass boolean")
    gates = {r.patch_id: (r.gate, r.reason) for r in patch.gates(patches, patch.decisions(refs, cands)).collect()}
    assert gates == {1: ("allowed_with_bypass", "ambiguous"), 2: ("rejected", "unresolved"), 3: ("allowed", None), 4: ("allowed_with_bypass", "syntax")}


def test_ambiguous_references_make_no_edge(spark):
    symbols = spark.createDataFrame([("a", "/x", None, "a", "function_definition", 0, "a", "c"), ("b", "/y", None, "b", "function_definition", 0, "b", "c"), ("b2", "/z", None, "b", "function_definition", 0, "b", "c"), ("c", "/y", None, "c", "function_definition", 9, "c", "c"), ("c9", "/y", None, "c", "function_definition", 9, "c", "go")], "symbol_id string, file_path string, scope_path string, semantic_path string, node_kind string, start_byte long, base_name string, family string")
    refs = spark.createDataFrame([("a", "/x", "c", "b"), ("a", "/x", "c", "c"), ("a", "/x", "c", "a"), ("c", "/y", "c", "b")], "src string, src_file string, family string, name string")
    assert {tuple(r) for r in resolve.edges(refs, symbols).collect()} == {("a", "c"), ("c", "b")}
    imports = spark.createDataFrame([("/x", "/z")], "importer string, imported string")
    assert ("a", "b2") in {tuple(r) for r in resolve.edges(refs, symbols, imports).collect()}


def test_store_and_reconcile(spark, tmp_path):
    files = spark.createDataFrame([("/a", "1"), ("/b", "2")], "file_path string, fingerprint string")
    store = index.Store(spark, f"file://{tmp_path}/i")
    assert store.plan() == "rebuild"
    empty = spark.createDataFrame([], "symbol_id string")
    first = store.write(symbols=empty, edges=empty, file_state=files)
    second = store.write(symbols=empty, edges=empty, file_state=files.limit(1))
    third = store.write(symbols=empty, edges=empty, file_state=files.limit(1))
    assert len(list((tmp_path / "i").glob("MANIFEST.*.json"))) == 2 and not (tmp_path / "i" / first["version"]).exists() and third["version"] == store.manifest()["version"]
    assert first["version"] != second["version"] and store.plan() == "none" and store.read()["file_state"].count() == 1
    seen = []
    assert reconcile.cycle(files, files, seen.append)["event"] == "healthy" and not seen
    assert reconcile.cycle(files, files.limit(1), seen.append, dry_run=True)["event"] == "would_refresh" and not seen
    assert reconcile.cycle(files, files.limit(1), lambda df: seen.append(df.count()))["event"] == "refreshed" and seen == [1]


def test_watch_stream(spark, tmp_path):
    spark.createDataFrame([("/a.py", "python", "x", 1)], "file_path string, language string, source string, size_bytes long").write.parquet(f"{tmp_path}/in/1")
    got = []
    run = reconcile.watch(spark, f"file://{tmp_path}/in/*", lambda df, _: got.extend(r.file_path for r in df.collect()), f"file://{tmp_path}/ck")
    run.awaitTermination()
    assert got == ["/a.py"]


def test_hot_names_make_no_product(spark):
    """A name that 200 files declare and use: no edge from other files, own file's declaration wins, plan without that product."""
    n = 200
    symbols = spark.createDataFrame([(f"f{i}::get", f"/f{i}", None, "get", "function_definition", 0, "get", "c") for i in range(n)] + [(f"f{i}::use", f"/f{i}", None, "use", "function_definition", 9, "use", "c") for i in range(n)] + [("g", "/g", None, "g", "function_definition", 0, "g", "c")], "symbol_id string, file_path string, scope_path string, semantic_path string, node_kind string, start_byte long, base_name string, family string")
    refs = spark.createDataFrame([(f"f{i}::use", f"/f{i}", "c", "get") for i in range(n)] + [("g", "/g", "c", "get")], "src string, src_file string, family string, name string")
    got = {tuple(r) for r in resolve.edges(refs, symbols).collect()}
    assert got == {(f"f{i}::use", f"f{i}::get") for i in range(n)}
    # the reference itself declares the name with one other
    two = symbols.filter("symbol_id IN ('f0::get', 'f1::get')")
    more = refs.limit(0).union(spark.createDataFrame([("f0::get", "/f0", "c", "get"), ("f1::get", "/f9", "c", "x::get<int>")], "src string, src_file string, family string, name string"))
    assert {tuple(r) for r in resolve.edges(more, two).collect()} == {("f0::get", "f1::get"), ("f1::get", "f0::get")}


def test_buffers(spark):
    log = spark.createDataFrame([("p", 1, 0, 0, "ab"), ("p", 2, 1, 2, "é"), ("q", 1, 0, 0, "")], "path string, version int, start int, end int, new_text string")
    got = {r.path: (r.source, r.version, r.dirty) for r in buffers.folded(log, F.lit("")).collect()}
    assert got == {"p": ("aé", 2, True), "q": ("", 1, False)}
    assert [r.path for r in buffers.status(buffers.folded(log, F.lit("")), True).collect()] == ["p"]


def broadcasts(df):
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def nested_symbols(spark):
    d = spark.range(2000).selectExpr("concat('s', id) symbol_id", "'f' file_path", "id * 10 start_byte", "id * 10 + 9 end_byte")
    return d.unionAll(spark.range(1).selectExpr("'all'", "'f'", "0L", "10000000000L"))


def test_owners_send_no_spans_to_the_driver(spark):
    spans = spark.range(3000).selectExpr("id point_id", "'f' point_file", "id * 10 from_byte", "id * 10 + 3 to_byte")
    got = query.containing(nested_symbols(spark), spans).select("point_id", "symbol_id")
    assert not broadcasts(got)
    assert dict(got.collect()) == {i: f"s{i}" if i < 2000 else "all" for i in range(3000)}


def test_positions_send_no_points_to_the_driver(spark):
    points = spark.range(3000).selectExpr("id point_id", "'f' point_file", "id * 10 + id % 12 offset")
    got = query.at_positions(nested_symbols(spark), points).select("point_id", "symbol_id")
    assert not broadcasts(got)
    at = {i: (i * 10 + i % 12) // 10 for i in range(3000)}
    assert dict(got.collect()) == {i: f"s{k}" if k < 2000 else "all" for i, k in at.items()}


def test_locate_makes_no_product(spark):
    """Three thousand symbols share file and path, and as many are wanted by it: by range, else the first of the best kind."""
    import re

    kinds = "CASE WHEN id % 1000 = 999 THEN 'struct_item' WHEN id % 7 = 0 THEN 'other' ELSE 'declaration' END node_kind"
    symbols = spark.range(3000).selectExpr("concat('p#definition[', id, ']') symbol_id", "'p' semantic_path", "'f' file_path", "id * 10 start_byte", "id * 10 + 9 end_byte", kinds)
    symbols = symbols.unionAll(spark.createDataFrame([("p", "q", "f", 10, 19, "declaration"), ("p", "p", "g", 0, 9, "struct_item")], symbols.schema))
    wanted = spark.range(3000).selectExpr("id want_id", "'f' want_file", "id * 10 + id % 2 want_start", "id * 10 + 9 want_end", "CASE WHEN id % 5 = 0 THEN concat('p#definition[', id, ']') WHEN id = 3 THEN 'none' ELSE 'p' END want_symbol")
    got = query.locate(symbols, wanted).select("want_id", "symbol_id")
    rows = dict(got.collect())
    want = {i: f"p#definition[{i}]" if i % 5 == 0 or i % 2 == 0 else "p#definition[999]" for i in range(3000) if i != 3}
    assert rows == want and not broadcasts(got)
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and all(re.search(r"_name", line) for line in joins)


def test_neighbourhoods_write_no_far_edges(spark, monkeypatch):
    """Of a long ring only what is near the roots is written; hubs with more neighbours than a root may have are cut as before."""
    from symloom.operators import graph

    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, tag: written.append(keep(df, tag)) or written[-1])
    n = 5000
    ring = spark.range(n).selectExpr("concat('n', id) src", f"concat('n', (id + 1) % {n}) dst")
    hub = spark.range(300).selectExpr("concat('n', id + 2000) src", "'hub' dst").unionAll(spark.range(300).selectExpr("'hub'", "concat('n', id + 2000)"))
    symbols = spark.range(n).selectExpr("concat('n', id) symbol_id").unionAll(spark.range(1).selectExpr("'hub'"))
    roots = spark.createDataFrame([("n10",), ("hub",), ("n2003",)], "root_id string")
    nodes, links = graph.neighborhood(symbols, ring.unionAll(hub), roots, "both", 2, 20)
    assert sum(t.count() for t in written) < 500
    found = {}
    for r in nodes.orderBy("root_id", "ordinal").collect():
        found.setdefault(r["root_id"], []).append((r["id"], r["depth"], r["truncated"]))
    assert found["n10"] == [("n10", 0, False), ("n9", 1, False), ("n11", 1, False), ("n8", 2, False), ("n12", 2, False)]
    assert found["hub"] == [("hub", 0, True)] + [(f"n{2000 + i}", 1, True) for i in range(19)]
    first = ["n2003", "hub", "n2002", "n2004"]
    assert [i for i, _, _ in found["n2003"]] == first + [f"n{2000 + i}" for i in range(300) if i not in (2, 3, 4)][:16]
    assert links.filter("root_id = 'n10'").count() == 4


def made(plan, kind):
    """Rows that nodes of a kind made in a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
        return made(plan.executedPlan() if name[0] == "A" else plan.plan(), kind)
    own = plan.metrics().apply("numOutputRows").value() if name == kind else 0
    return own + sum(made(plan.children().apply(i), kind) for i in range(plan.children().size()))


def test_positions_are_looked_up_only_at_levels_that_have_symbols(spark):
    points = spark.range(3000).selectExpr("id point_id", "'f' point_file", "id * 10 + id % 12 offset")
    got = query.at_positions(nested_symbols(spark), points).select("point_id", "symbol_id")
    assert len(got.collect()) == 3000
    assert 2 * 3000 < made(got._jdf.queryExecution().executedPlan(), "GenerateExec") < 4 * 3000  # two levels, and the symbols' blocks
    none = query.at_positions(nested_symbols(spark).filter("false"), points)
    assert none.collect() == []
