"""Registered queries over all rows, against brute force in plain Python."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def unique(found):
    return {(m, x, min(d)) for (m, x), d in found.items() if len(d) == 1}


def spread(direct, named, star):
    """Rounds until nothing is new."""
    own = {(m, x) for m, x, _ in direct} | {(m, x) for m, x, _, _ in named}
    found = {}
    for m, x, d in direct:
        found.setdefault((m, x), set()).add(d)
    while True:
        new = {(m, x, d) for m, x, to, y in named for d in found.get((to, y), ())}
        new |= {(m, x, d) for m, to in star for (at, x), ds in found.items() if at == to and x != "default" and (m, x) not in own for d in ds}
        new = {(m, x, d) for m, x, d in new if d not in found.get((m, x), ())}
        if not new:
            return unique(found)
        for m, x, d in new:
            found.setdefault((m, x), set()).add(d)


def test_re_exports_of_all_orders(spark):
    rows = [(r["o_orderkey"], f"m{r['o_custkey']}", f"x{r['o_orderkey'] % 25}") for r in table(spark, "orders")]
    direct = {(m, x, f"{m}.{x}") for i, m, x in rows if i % 2 == 0}
    want = spread(direct, {(m, x, f"m{i * 7 % 1499}", x) for i, m, x in rows if i % 2}, {(m, f"m{i * 11 % 1499}") for i, m, x in rows if i % 40 == 1})
    assert {tuple(r) for r in entry.queries()["re_export_closure"](spark, SF).select("module", "name", "definer").collect()} == want and want


def test_import_chains_of_all_orders(spark):
    rows = [(r["o_orderkey"], f"m{r['o_custkey'] % 60}", f"x{r['o_orderkey'] % 20}") for r in table(spark, "orders")]
    direct = {(m, x, f"{m}.{x}") for i, m, x in rows if i % 2 == 0}
    want = spread(direct, {(m, f"y{i % 9}", f"m{i % 61}", x) for i, m, x in rows if i % 2}, set())
    assert {tuple(r) for r in entry.queries()["import_chains"](spark, SF).select("module", "name", "definer").collect()} == want and want


def test_path_union_has_every_path(spark):
    """More than 300 paths."""
    sf = SF.replace("0.001", "0.01")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang").collect()
    paths = {r["doc_id"]: f"/ws/{r['source']}/{r['lang']}/{r['doc_id']}.txt" for r in d}
    want = sorted({*paths.values(), *(p + ".new" for i, p in paths.items() if i % 50 == 0)})
    assert sorted(r[0] for r in entry.queries()["path_union_sorted"](spark, sf).collect()) == want and len(want) > 300


def test_every_patch_has_a_report(spark):
    got = [r["patch_id"] for r in entry.queries()["patch_sarif"](spark, SF).collect()]
    assert sorted(got) == sorted(r["o_orderkey"] for r in table(spark, "orders"))


def test_long_chains_end_where_they_end(spark):
    from symloom.operators import graph

    n = 70
    calls = spark.createDataFrame([(1, 0, "f"), (2, 1000, "f"), (3, 2000, "f")], "call_id long, node long, name string")
    cycle = [(1000, 1001), (1001, 1002), (1002, 1003), (1003, 1001), (2000, 2000)]
    parents = spark.createDataFrame([(i, i + 1) for i in range(n)] + cycle, "node long, parent long")
    got = graph.inherited(calls, parents, spark.createDataFrame([(n, "f", "s")], "node long, name string, symbol_id string"))
    assert [tuple(r) for r in got.select("call_id", "symbol_id", "hops").collect()] == [(1, "s", n)]


def test_re_exports_reach_far(spark):
    from symloom.operators import graph

    n = 66
    direct = spark.createDataFrame([("m0", "x", "d")], "module string, name string, definer string")
    named = spark.createDataFrame([(f"m{i + 1}", "x", f"m{i}", "x") for i in range(n)], "module string, name string, target string, target_name string")
    star = spark.createDataFrame([], "module string, target string")
    assert graph.re_exports(direct, named, star).count() == n + 1
