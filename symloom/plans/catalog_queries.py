"""Registered queries over the test catalogue, each with the SQL of its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.operators import graph, identity, index, patch, query, resolve
from symloom.sources import testcat as C

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# SQL fragments
KIND = """CASE WHEN {k} IN ('function_definition', 'function_item', 'function_signature_item', 'class_definition') THEN 3
 WHEN {k} IN ('alias_declaration', 'class_specifier', 'concept_definition', 'enum_specifier', 'enumerator', 'namespace_alias_definition', 'struct_specifier', 'template_instantiation', 'type_definition', 'union_specifier',
   'using_declaration', 'const_item', 'enum_item', 'mod_item', 'static_item', 'struct_item', 'trait_item', 'type_item') THEN 2
 WHEN {k} IN ('declaration', 'field_declaration') THEN 1 ELSE 0 END"""
RANK = KIND.format(k="node_kind")
KEY = "symbol_id || '|' || file_path || '|' || node_kind || '|' || {o} || '|' || start_byte || '..' || end_byte || '|' || coalesce(signature, '')"


def registered(sql: str | None = None, catalog: bool = True):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = C.sql(sql) if catalog else sql
        return f

    return put


def n(c: str = "n"):
    return F.count(F.lit(1)).alias(c)


# ---- search, list, selection ------------------------------------------------------------------------------------

SCORED = """scored AS (SELECT *, lower(base_name) AS lb, lower(symbol_id) AS li, lower(semantic_path) AS lp,
  contains(lower(base_name), q) AS h1, contains(lower(symbol_id), q) AS h2, contains(lower(semantic_path), q) AS h3, coalesce(contains(lower(scope_path), q), false) AS h4, contains(lower(file_path), q) AS h5,
  contains(lower(node_kind), q) AS h6, coalesce(contains(lower(signature), q), false) AS h7, coalesce(contains(lower(parameter), q), false) AS h8, coalesce(contains(lower(return_type), q), false) AS h9
  FROM symbols, ({qs}) AS qq(q)),
hits AS (SELECT *, CASE WHEN semantic_path = q OR symbol_id = q OR base_name = q THEN 1000 WHEN lb = q THEN 950 WHEN li = q THEN 925 WHEN lp = q THEN 900 WHEN starts_with(lb, q) THEN 850
   WHEN starts_with(lp, q) THEN 825 WHEN starts_with(li, q) THEN 800 WHEN h5 THEN 300 WHEN h7 OR h8 OR h9 THEN 200 ELSE 400 END AS score,
   array_to_string(list_filter([CASE WHEN h1 THEN 'base_name' END, CASE WHEN h2 THEN 'symbol_id' END, CASE WHEN h3 THEN 'semantic_path' END, CASE WHEN h4 THEN 'scope_path' END, CASE WHEN h5 THEN 'file_path' END,
     CASE WHEN h6 THEN 'node_kind' END, CASE WHEN h7 THEN 'signature' END, CASE WHEN h8 THEN 'parameters' END, CASE WHEN h9 THEN 'return_type' END], lambda x: x IS NOT NULL), ',') AS fields
  FROM scored WHERE h1 OR h2 OR h3 OR h4 OR h5 OR h6 OR h7 OR h8 OR h9)"""


def _search_sql(q: str, limit: int, where: str = "true") -> str:
    body = SCORED.replace("{qs}", f"VALUES ('{q}')")
    return f"""{body}
SELECT symbol_id, file_path, score, fields, (SELECT count(*) FROM hits WHERE {where}) AS total_matches, (SELECT count(*) FROM hits WHERE {where}) > {limit} AS truncated
FROM hits WHERE {where} ORDER BY score DESC, semantic_path, file_path, start_byte, end_byte, symbol_id LIMIT {limit}"""


def _found(df):
    return df.select("symbol_id", "file_path", "score", F.array_join("matched_fields", ",").alias("fields"), "total_matches", "truncated")


@registered(_search_sql("widget", 20))
def search_basic(spark, sf):
    return _found(query.search(C.symbols(spark, sf), "widget", 20))


@registered(_search_sql("customer", 50, "contains(lower(file_path), 'nation_1') AND lower(node_kind) = 'function_definition'"))
def search_filtered(spark, sf):
    return _found(query.search(C.symbols(spark, sf), "customer", 50, "nation_1", "Function_Definition"))


@registered(
    SCORED.replace("{qs}", "VALUES ('brand#1'), ('economy'), ('nation_1'), ('building'), ('cold widget'), ('mod'), ('declaration')")
    + "\nSELECT q AS query, score, count(*) AS n FROM hits GROUP BY ALL"
)
def search_score_bands(spark, sf):
    s = C.symbols(spark, sf)
    out = None
    for q in ("brand#1", "economy", "nation_1", "building", "cold widget", "mod", "declaration"):
        got = query.scored(s, q).groupBy("score").agg(n()).select(F.lit(q).alias("query"), "score", "n")
        out = got if out is None else out.unionAll(got)
    return out


def _list_sql(where: str, limit: int) -> str:
    return f"""SELECT file_path, semantic_path, start_byte, symbol_id, (SELECT count(*) FROM symbols WHERE {where}) AS total_matches, (SELECT count(*) FROM symbols WHERE {where}) > {limit} AS truncated
FROM symbols WHERE {where} ORDER BY file_path, semantic_path, start_byte, end_byte, symbol_id LIMIT {limit}"""


@registered(_list_sql("true", 100))
def list_sorted(spark, sf):
    return query.list_symbols(C.symbols(spark, sf), 100).select("file_path", "semantic_path", "start_byte", "symbol_id", "total_matches", "truncated")


@registered(_list_sql("contains(lower(file_path), 'parts/brand#2') AND lower(node_kind) = 'declaration'", 60))
def list_filtered(spark, sf):
    return query.list_symbols(C.symbols(spark, sf), 60, "parts/Brand#2", "declaration").select("file_path", "semantic_path", "start_byte", "symbol_id", "total_matches", "truncated")


def _selectors(spark, sf):
    s = C.symbols(spark, sf)
    return s.filter("start_byte % 70 = 0").select(F.col("symbol_id").alias("selector")).union(s.filter("start_byte % 110 = 0").select("semantic_path")).distinct()


SELECTORS = """selectors AS (SELECT symbol_id AS selector FROM symbols WHERE start_byte % 70 = 0 UNION SELECT semantic_path FROM symbols WHERE start_byte % 110 = 0),
met AS (SELECT selector, s.*, 0 AS priority FROM selectors JOIN symbols s ON selector = symbol_id UNION ALL SELECT selector, s.*, 1 FROM selectors JOIN symbols s ON selector = semantic_path),
kept AS (SELECT * FROM met QUALIFY priority = min(priority) OVER (PARTITION BY selector)),
chosen AS (SELECT *, count(*) OVER (PARTITION BY selector) AS candidates, row_number() OVER (PARTITION BY selector ORDER BY """ + RANK + """ DESC, file_path, start_byte, end_byte, symbol_id) AS nth FROM kept)
"""


@registered(SELECTORS + "SELECT selector, symbol_id, candidates, priority FROM chosen WHERE nth = 1")
def select_symbol(spark, sf):
    return query.select(C.symbols(spark, sf), _selectors(spark, sf)).select("selector", "symbol_id", "candidates", "priority")


@registered(SELECTORS + "SELECT selector, max(candidates) AS candidates FROM chosen WHERE candidates > 1 GROUP BY selector")
def select_ambiguous(spark, sf):
    return query.select(C.symbols(spark, sf), _selectors(spark, sf)).filter("candidates > 1").select("selector", "candidates")


@registered(f"SELECT scope_path, symbol_id, {RANK} AS rank FROM symbols QUALIFY row_number() OVER (PARTITION BY scope_path ORDER BY {RANK} DESC, file_path, start_byte, end_byte, symbol_id) = 1")
def kind_rank_best(spark, sf):
    return query.best_of(C.symbols(spark, sf), ["scope_path"], E.kind_rank("node_kind")).select("scope_path", "symbol_id", "rank")


KINDS = (
    "function_definition class_definition function_item function_signature_item alias_declaration class_specifier concept_definition enum_specifier enumerator namespace_alias_definition struct_specifier "
    "template_instantiation type_definition union_specifier using_declaration const_item enum_item mod_item static_item struct_item trait_item type_item declaration field_declaration function_declaration method_definition other"
).split()
BY_KIND = f"""kinds AS (SELECT p_name AS name, p_partkey AS start_byte, [{", ".join(f"'{k}'" for k in KINDS)}][p_partkey % {len(KINDS)} + 1] AS node_kind FROM part)"""


@registered(BY_KIND + f" SELECT name, node_kind, {RANK} AS rank, start_byte FROM kinds QUALIFY row_number() OVER (PARTITION BY name ORDER BY {RANK} DESC, start_byte) = 1")
def kind_ranks(spark, sf):
    """The best of every name where candidates have all kinds, those that tools confuse included."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    c = C.read(spark, sf, "part").select(F.col("p_name").alias("name"), kind.alias("node_kind"), F.lit("f").alias("file_path"), F.col("p_partkey").alias("start_byte"), F.lit(0).alias("end_byte"), F.lit("s").alias("symbol_id"))
    return query.best_of(c, ["name"], E.kind_rank("node_kind")).select("name", "node_kind", "rank", "start_byte")


# The callers whose key is divisible by 20, as a query set against all symbols.
CONTEXT = f"""ctx AS (SELECT p.symbol_id AS caller, p.file_path AS ctx_file, p.scope_path AS ctx_scope, s.*, s.start_byte % 30 = 0 AS included, s.start_byte % 70 = 0 AS companion
  FROM symbols p JOIN symbols s ON s.base_name = p.base_name WHERE p.node_kind IN ('declaration', 'function_item') AND p.start_byte % 200 = 0),
ranked AS (SELECT *, CASE WHEN file_path <> ctx_file AND contains(semantic_path, '::') THEN greatest({RANK} - 100, 0) ELSE {RANK} END + CASE WHEN file_path = ctx_file THEN 1000 ELSE 0 END
  + CASE WHEN included THEN 200 ELSE 0 END + CASE WHEN companion THEN 300 ELSE 0 END AS r, CASE WHEN scope_path = ctx_scope AND ctx_file LIKE '%.cpp' THEN 500 ELSE 0 END AS same FROM ctx)
"""


def _contexts(spark, sf):
    """The callers whose key is divisible by 20, each with all symbols of its base name."""
    s = C.symbols(spark, sf)
    p = s.filter("node_kind IN ('declaration', 'function_item') AND start_byte % 200 = 0").select(F.col("symbol_id").alias("caller"), F.col("file_path").alias("ctx_file"), F.col("scope_path").alias("ctx_scope"), "base_name")
    met = p.join(s, "base_name")
    return met.withColumns({"included": F.col("start_byte") % 30 == 0, "companion": F.col("start_byte") % 70 == 0})


@registered(CONTEXT + "SELECT caller, symbol_id, r AS rank FROM ranked QUALIFY row_number() OVER (PARTITION BY caller ORDER BY r DESC, file_path, start_byte, end_byte, symbol_id) = 1")
def context_rank_best(spark, sf):
    rank = query.context_rank(F.col("ctx_file"), F.col("included"), F.col("companion"))
    return query.best_of(_contexts(spark, sf), ["caller"], rank).select("caller", "symbol_id", "rank")


@registered(CONTEXT + "SELECT caller, symbol_id, r + same AS rank FROM ranked QUALIFY row_number() OVER (PARTITION BY caller ORDER BY r + same DESC, file_path, start_byte, end_byte, symbol_id) = 1")
def resolver_rank_best(spark, sf):
    """A shared scope counts for C++ callers; the other callers here are of Python files."""
    rank = query.resolver_rank(F.col("ctx_file"), F.col("included"), F.col("companion"), F.col("ctx_scope"))
    return query.best_of(_contexts(spark, sf), ["caller"], rank).select("caller", "symbol_id", "rank")


@registered(CONTEXT + ", t AS (SELECT *, max(r) OVER (PARTITION BY caller) AS m FROM ranked) SELECT caller, count(*) AS candidate_count, min(symbol_id) AS first_candidate FROM t WHERE r = m GROUP BY caller")
def all_at_best_rank(spark, sf):
    rank = query.context_rank(F.col("ctx_file"), F.col("included"), F.col("companion"))
    return query.all_best(_contexts(spark, sf), ["caller"], rank).groupBy("caller").agg(F.max("candidate_count").alias("candidate_count"), F.min("symbol_id").alias("first_candidate"))


# ---- identity ---------------------------------------------------------------------------------------------------

FAM = """fam AS (SELECT '{f}' AS family, p_name AS semantic_path, '/ws/' || p_brand || '.src' AS file_path, p_partkey * 10 AS start_byte, p_partkey * 10 + 9 AS end_byte, p_size % 3 = 0 AS is_overload,
   CASE WHEN p_size % 2 = 0 THEN 'method_declaration' ELSE 'class_declaration' END AS node_kind FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY semantic_path) AS a, count(*) OVER (PARTITION BY file_path, semantic_path) AS h, row_number() OVER (PARTITION BY file_path, semantic_path ORDER BY start_byte, end_byte) AS nth,
   row_number() OVER (PARTITION BY file_path, semantic_path, is_overload ORDER BY start_byte, end_byte) AS onth, count(*) OVER (PARTITION BY file_path, semantic_path, is_overload) AS oc,
   bool_or(is_overload) OVER (PARTITION BY file_path, semantic_path) AS any_over, bool_and(node_kind = 'method_declaration') OVER (PARTITION BY file_path, semantic_path) AS callables FROM fam)
SELECT file_path, start_byte, CASE WHEN a = 1 THEN semantic_path WHEN h = 1 THEN file_path || '::' || semantic_path ELSE file_path || '::' || semantic_path || '#' || {tag} END AS symbol_id FROM c"""


def _family(spark, sf, family):
    p = C.read(spark, sf, "part")
    return p.select(
        F.lit(family).alias("family"), F.col("p_name").alias("semantic_path"), F.concat(F.lit("/ws/"), "p_brand", F.lit(".src")).alias("file_path"), (F.col("p_partkey") * 10).alias("start_byte"),
        (F.col("p_partkey") * 10 + 9).alias("end_byte"), (F.col("p_size") % 3 == 0).alias("is_overload"), F.when(F.col("p_size") % 2 == 0, "method_declaration").otherwise("class_declaration").alias("node_kind"),
    )


@registered(FAM.replace("{f}", "python").replace("{tag}", "CASE WHEN is_overload THEN 'overload' WHEN any_over THEN 'implementation' ELSE 'definition' END || CASE WHEN NOT is_overload AND any_over AND oc = 1 THEN '' ELSE '[' || onth || ']' END"))
def symbol_ids_python(spark, sf):
    return identity.assigned(_family(spark, sf, "python")).select("file_path", "start_byte", "symbol_id")


@registered(FAM.replace("{f}", "javascript").replace("{tag}", "'definition[' || nth || ']'"))
def symbol_ids_js(spark, sf):
    return identity.assigned(_family(spark, sf, "javascript")).select("file_path", "start_byte", "symbol_id")


@registered(FAM.replace("{f}", "java").replace("{tag}", "CASE WHEN callables THEN 'overload[' ELSE 'definition[' END || nth || ']'"))
def symbol_ids_java(spark, sf):
    return identity.assigned(_family(spark, sf, "java")).select("file_path", "start_byte", "symbol_id")


@registered("""old AS (SELECT *, semantic_path || '#' || row_number() OVER (PARTITION BY semantic_path ORDER BY file_path, start_byte) AS sid FROM symbols),
new AS (SELECT *, semantic_path || '#' || row_number() OVER (PARTITION BY semantic_path ORDER BY file_path, start_byte) AS sid FROM symbols WHERE start_byte % 90 <> 0)
SELECT o.file_path, o.start_byte, o.sid AS old_id, n.sid AS new_id FROM old o JOIN new n USING (file_path, semantic_path, node_kind, start_byte, end_byte) WHERE o.sid <> n.sid""")
def id_drift(spark, sf):
    def numbered(df):
        w = Window.partitionBy("semantic_path").orderBy("file_path", "start_byte")
        return df.withColumn("symbol_id", F.concat("semantic_path", F.lit("#"), F.row_number().over(w).cast("string")))

    s = C.raw_symbols(spark, sf)
    return identity.drifted(numbered(s), numbered(s.filter("start_byte % 90 <> 0"))).select("file_path", "start_byte", "old_id", "new_id")


# ---- graph ------------------------------------------------------------------------------------------------------


@registered("SELECT dst AS symbol_id, array_to_string(list_sort(list(DISTINCT src)), ',') AS refs, count(DISTINCT src) AS n FROM edges GROUP BY dst")
def edges_invert(spark, sf):
    return graph.inverted(C.edges(spark, sf)).select("symbol_id", F.array_join("references", ",").alias("refs"), F.size("references").cast("long").alias("n"))


@registered("SELECT src AS symbol_id, md5(array_to_string(list_sort(list(DISTINCT dst)), ',')) AS deps, count(DISTINCT dst) AS n FROM edges GROUP BY src")
def dependency_union(spark, sf):
    return graph.dependencies(C.edges(spark, sf)).select("symbol_id", F.md5(F.array_join("dependencies", ",")).alias("deps"), F.size("dependencies").cast("long").alias("n"))


@registered("""down AS (SELECT DISTINCT src, dst FROM edges WHERE hash_bucket(src) <> 0), up AS (SELECT DISTINCT src, dst FROM edges WHERE hash_bucket(dst) <> 1)
SELECT 'missing_reference' AS kind, src, dst FROM (SELECT * FROM down EXCEPT SELECT * FROM up) UNION ALL SELECT 'missing_dependency', src, dst FROM (SELECT * FROM up EXCEPT SELECT * FROM down)""".replace("hash_bucket(src)", "length(src) % 7").replace("hash_bucket(dst)", "length(dst) % 7"))
def edge_reciprocity(spark, sf):
    s, e = C.symbols(spark, sf).select("symbol_id"), C.edges(spark, sf)
    empty = F.array().cast("array<string>")
    down, up = graph.dependencies(e.filter("length(src) % 7 <> 0")), graph.inverted(e.filter("length(dst) % 7 <> 1"))
    broken = s.join(down, "symbol_id", "left").join(up, "symbol_id", "left").withColumns({c: F.coalesce(c, empty) for c in ("dependencies", "references")})
    return graph.reciprocity(broken).select("kind", "src", "dst")


ROOTS = "roots AS (SELECT symbol_id AS root_id FROM symbols WHERE node_kind IN ('class_definition', 'function_definition') AND start_byte % 200 = 0)"


def _roots(spark, sf):
    """The query set of traces and neighbourhoods: classes and functions whose key is divisible by 20.  Each root is answered from all
    symbols and edges."""
    return C.symbols(spark, sf).filter("node_kind IN ('class_definition', 'function_definition') AND start_byte % 200 = 0").select(F.col("symbol_id").alias("root_id"))


def _trace_sql(roles: str) -> str:
    return ROOTS + f""", t AS (SELECT root_id, 'caller' AS role, src AS symbol_id FROM roots JOIN edges ON dst = root_id UNION SELECT root_id, 'callee', dst FROM roots JOIN edges ON src = root_id UNION SELECT root_id, 'trace_root', root_id FROM roots)
SELECT root_id, role, symbol_id, file_path, node_kind FROM t JOIN symbols USING (symbol_id) WHERE role IN ({roles})"""


def _traced(spark, sf, roles):
    return graph.trace(C.symbols(spark, sf), C.edges(spark, sf), _roots(spark, sf)).filter(F.col("role").isin(*roles)).select("root_id", "role", "symbol_id", "file_path", "node_kind")


@registered(_trace_sql("'caller'"))
def trace_callers(spark, sf):
    return _traced(spark, sf, ["caller"])


@registered(_trace_sql("'callee'"))
def trace_callees(spark, sf):
    return _traced(spark, sf, ["callee"])


@registered(_trace_sql("'caller', 'callee', 'trace_root'"))
def trace_both(spark, sf):
    return _traced(spark, sf, ["caller", "callee", "trace_root"])


@registered(ROOTS + """, walk(root_id, id, depth) AS (SELECT root_id, root_id, 0 FROM roots UNION SELECT root_id, dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < 3)
SELECT root_id, id, min(depth) AS depth FROM walk GROUP BY ALL""")
def neighborhood_callees(spark, sf):
    nodes, _ = graph.neighborhood(C.symbols(spark, sf), C.edges(spark, sf), _roots(spark, sf), "callees", 3, 10_000)
    return nodes.select("root_id", "id", "depth")


@registered(ROOTS + """, st AS (SELECT dst AS at_, src AS to_, 0 AS side FROM edges UNION SELECT src, dst, 1 FROM edges),
l1 AS (SELECT root_id, to_, min(side) AS side FROM roots JOIN st ON at_ = root_id GROUP BY ALL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY side, to_) AS ordinal FROM l1),
a1 AS (SELECT root_id, root_id AS id, 0 AS ordinal, 0 AS depth FROM roots UNION ALL SELECT root_id, to_, ordinal, 1 FROM r1 WHERE ordinal < 40),
l2 AS (SELECT a.root_id, s.to_, min({'o': a.ordinal, 's': s.side}) AS way FROM a1 a JOIN st s ON s.at_ = a.id WHERE a.depth = 1 AND NOT EXISTS (SELECT 1 FROM a1 x WHERE x.root_id = a.root_id AND x.id = s.to_) GROUP BY ALL),
r2 AS (SELECT l2.root_id, to_, (SELECT count(*) FROM a1 WHERE a1.root_id = l2.root_id) + row_number() OVER (PARTITION BY l2.root_id ORDER BY way.o, way.s, to_) - 1 AS ordinal FROM l2),
every AS (SELECT * FROM a1 UNION ALL SELECT root_id, to_, ordinal, 2 FROM r2 WHERE ordinal < 40),
cut AS (SELECT root_id FROM r1 WHERE ordinal >= 40 UNION SELECT root_id FROM r2 WHERE ordinal >= 40)
SELECT root_id, id, ordinal::BIGINT AS ordinal, depth, root_id IN (SELECT root_id FROM cut) AS truncated FROM every""")
def neighborhood_truncated(spark, sf):
    nodes, _ = graph.neighborhood(C.symbols(spark, sf), C.edges(spark, sf), _roots(spark, sf), "both", 2, 40)
    return nodes.select("root_id", "id", "ordinal", "depth", "truncated")


@registered(_trace_sql("'caller', 'callee', 'trace_root'").replace("SELECT root_id, role, symbol_id, file_path, node_kind FROM", f"SELECT root_id, role, {KEY.format(o='role')} AS evidence_key FROM"))
def evidence_keys(spark, sf):
    t = graph.trace(C.symbols(spark, sf), C.edges(spark, sf), _roots(spark, sf))
    return t.select("root_id", "role", E.evidence_key("symbol_id", "file_path", "node_kind", "role", "start_byte", "end_byte", "signature").alias("evidence_key"))


IMPACT = """b AS (SELECT DISTINCT 'callee' AS role, dst AS symbol_id FROM edges WHERE length(src) % 3 = 0 UNION SELECT 'caller', src FROM edges WHERE length(dst) % 3 = 0),
a AS (SELECT DISTINCT 'callee' AS role, dst AS symbol_id FROM edges WHERE length(src) % 3 = 1 UNION SELECT 'caller', src FROM edges WHERE length(dst) % 3 = 1),
diff AS (SELECT 'removed' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'added', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
"""


def _impact(spark, sf):
    e = C.edges(spark, sf)
    side = lambda k: e.filter(f"length(src) % 3 = {k}").select(F.lit("callee").alias("role"), F.col("dst").alias("symbol_id")).union(e.filter(f"length(dst) % 3 = {k}").select(F.lit("caller"), "src")).distinct()
    return graph.impact(side(0), side(1))


@registered(IMPACT + "SELECT * FROM diff")
def impact_diff(spark, sf):
    return _impact(spark, sf)


@registered(IMPACT + "SELECT change, count(*) AS n, count(DISTINCT symbol_id) AS symbols FROM diff GROUP BY change")
def impact_counts(spark, sf):
    return _impact(spark, sf).groupBy("change").agg(n(), F.count_distinct("symbol_id").alias("symbols"))


@registered("""walk(root, node) AS (SELECT file_path, file_path FROM files WHERE doc_id % 25 = 0 UNION SELECT root, importer FROM walk JOIN file_deps ON imported = node)
SELECT root, node FROM walk""")
def dependents_closure(spark, sf):
    starts = C.files(spark, sf).filter("doc_id % 25 = 0").select(F.col("file_path").alias("root"), F.col("file_path").alias("node"))
    return graph.closure(starts, C.file_deps(spark, sf).select(F.col("imported").alias("src"), F.col("importer").alias("dst")))


@registered("""walk(root, node) AS (SELECT file_path, file_path FROM files WHERE doc_id % 10 = 1 UNION SELECT root, imported FROM walk JOIN file_deps ON importer = node)
SELECT root, node FROM walk""")
def include_closure(spark, sf):
    starts = C.files(spark, sf).filter("doc_id % 10 = 1").select(F.col("file_path").alias("root"), F.col("file_path").alias("node"))
    return graph.closure(starts, C.file_deps(spark, sf).select(F.col("importer").alias("src"), F.col("imported").alias("dst")))


@registered("""m AS (SELECT o_orderkey AS id, 'm' || o_custkey AS module, 'x' || (o_orderkey % 25) AS name FROM orders),
direct AS (SELECT DISTINCT module, name, module || '.' || name AS definer FROM m WHERE id % 2 = 0),
named AS (SELECT DISTINCT module, name, 'm' || (id * 7 % 1499) AS target, name AS target_name FROM m WHERE id % 2 = 1),
star AS (SELECT DISTINCT module, 'm' || (id * 11 % 1499) AS target FROM m WHERE id % 40 = 1),
own AS (SELECT module, name FROM direct UNION SELECT module, name FROM named),
walk(module, name, definer) AS (SELECT * FROM direct UNION
  (SELECT x.module, x.name, w.definer FROM walk w JOIN (SELECT module, name, target, target_name FROM named UNION ALL
     SELECT s.module, a.name, s.target, a.name FROM star s, (SELECT DISTINCT name FROM own) a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.module = s.module AND o.name = a.name)) x ON x.target = w.module AND x.target_name = w.name))
SELECT module, name, min(definer) AS definer FROM walk GROUP BY ALL HAVING count(DISTINCT definer) = 1""")
def re_export_closure(spark, sf):
    m = C.read(spark, sf, "orders").selectExpr("o_orderkey AS id", "concat('m', o_custkey) AS module", "concat('x', o_orderkey % 25) AS name")
    direct = m.filter("id % 2 = 0").selectExpr("module", "name", "concat(module, '.', name) AS definer").distinct()
    named = m.filter("id % 2 = 1").selectExpr("module", "name", "concat('m', id * 7 % 1499) AS target", "name AS target_name").distinct()
    star = m.filter("id % 40 = 1").selectExpr("module", "concat('m', id * 11 % 1499) AS target").distinct()
    return graph.re_exports(direct, named, star)


# ---- resolution -------------------------------------------------------------------------------------------------

REFS = """refs AS (SELECT s.symbol_id AS src, s.file_path AS src_file, 'x' AS family, p_name AS name FROM symbols s JOIN part ON p_partkey = (s.start_byte // 10) WHERE s.node_kind = 'declaration'),
met AS (SELECT r.*, d.symbol_id AS dst, d.file_path AS dst_file, """ + KIND.format(k="d.node_kind") + """ + CASE WHEN d.file_path = r.src_file THEN 1000 ELSE 0 END AS r FROM refs r JOIN symbols d ON d.base_name = r.name WHERE d.symbol_id <> r.src),
top AS (SELECT * FROM met QUALIFY r = max(r) OVER (PARTITION BY src, name))
"""


def _refs(spark, sf):
    s = C.symbols(spark, sf)
    p = C.read(spark, sf, "part")
    return s.filter("node_kind = 'declaration'").join(p, F.col("p_partkey") == F.expr("start_byte div 10")).select(F.col("symbol_id").alias("src"), F.col("file_path").alias("src_file"), F.lit("x").alias("family"), F.col("p_name").alias("name"))


@registered(REFS + "SELECT DISTINCT src, min(dst) AS dst FROM top GROUP BY src, name HAVING count(DISTINCT dst) = 1")
def resolve_edges(spark, sf):
    return resolve.edges(_refs(spark, sf), C.symbols(spark, sf).withColumn("family", F.lit("x")))


IMPORTED = REFS.replace("ELSE 0 END AS r FROM refs r JOIN symbols d ON d.base_name = r.name", "WHEN i.a IS NOT NULL THEN 200 ELSE 0 END AS r FROM refs r JOIN symbols d ON d.base_name = r.name LEFT JOIN inc i ON i.a = r.src_file AND i.b = d.file_path").replace(
    "refs AS", "inc AS (SELECT DISTINCT '/ws/parts/' || p_brand || '.cpp' AS a, '/ws/parts/Brand#' || (p_size % 5 + 1) || (p_size % 3 + 1) || '.cpp' AS b FROM part WHERE p_size % 7 = 0),\nrefs AS", 1
)


@registered(IMPORTED + "SELECT DISTINCT src, min(dst) AS dst FROM top GROUP BY src, name HAVING count(DISTINCT dst) = 1")
def resolve_imported(spark, sf):
    """Own file first, then imported files, then the rest."""
    imports = C.read(spark, sf, "part").filter("p_size % 7 = 0").selectExpr("concat('/ws/parts/', p_brand, '.cpp') AS importer", "concat('/ws/parts/Brand#', p_size % 5 + 1, p_size % 3 + 1, '.cpp') AS imported")
    return resolve.edges(_refs(spark, sf), C.symbols(spark, sf).withColumn("family", F.lit("x")), imports)


@registered("""names AS (SELECT p_name AS name, min(p_partkey) AS ref_id FROM part GROUP BY p_name UNION ALL SELECT 'no ' || r_name, -r_regionkey - 1 FROM region UNION ALL SELECT n_name, -100 - n_nationkey FROM nation),
met AS (SELECT ref_id, symbol_id, """ + RANK + """ AS r FROM names LEFT JOIN symbols ON base_name = name), best AS (SELECT * FROM met QUALIFY symbol_id IS NULL OR r = max(r) OVER (PARTITION BY ref_id))
SELECT ref_id, count(symbol_id) AS candidates, CASE WHEN count(symbol_id) = 0 THEN 'unresolved' WHEN count(symbol_id) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM best GROUP BY ref_id""")
def reference_diagnostics(spark, sf):
    names = C.read(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ref_id"))
    names = names.unionAll(C.read(spark, sf, "region").selectExpr("concat('no ', r_name)", "cast(-r_regionkey - 1 AS bigint)")).unionAll(C.read(spark, sf, "nation").selectExpr("n_name", "cast(-100 - n_nationkey AS bigint)"))
    return query.unresolved(names, C.symbols(spark, sf))


@registered("""refs AS (SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '::' || p_name ELSE p_brand || '::' || p_name || '<' || p_type || '<int>>' END AS name FROM part),
exact AS (SELECT ref_id, symbol_id, 'exact' AS step FROM refs JOIN symbols ON semantic_path = name)
SELECT * FROM exact UNION ALL SELECT ref_id, symbol_id, 'template' FROM refs JOIN symbols ON semantic_path = regexp_replace(name, '<.*>$', '') WHERE contains(name, '<') AND ref_id NOT IN (SELECT ref_id FROM exact)""")
def template_fallback(spark, sf):
    refs = C.read(spark, sf, "part").selectExpr("p_partkey AS ref_id", "CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, '::', p_name) ELSE concat(p_brand, '::', p_name, '<', p_type, '<int>>') END AS name")
    return resolve.by_path(refs, C.symbols(spark, sf)).select("ref_id", F.col("dst").alias("symbol_id"), "step")


@registered("""cand AS (SELECT a.symbol_id AS src, a.file_path AS src_file, a.start_byte AS at_byte, b.symbol_id AS dst, b.file_path AS dst_file, b.start_byte FROM symbols a JOIN symbols b USING (base_name) WHERE a.node_kind = 'declaration' AND a.start_byte % 200 = 0 AND a.symbol_id <> b.symbol_id),
inc AS (SELECT DISTINCT '/ws/parts/' || p_brand || '.cpp' AS src_file, '/ws/parts/Brand#' || (p_size % 5 + 1) || (p_size % 3 + 1) || '.cpp' AS dst_file FROM part)
SELECT src, dst, i.src_file IS NOT NULL AS included FROM cand c LEFT JOIN inc i USING (src_file, dst_file) WHERE (c.src_file = c.dst_file AND start_byte < at_byte) OR i.src_file IS NOT NULL""")
def visible_before(spark, sf):
    """The callers whose key is divisible by 20, against all symbols and includes."""
    s = C.symbols(spark, sf)
    a = s.filter("node_kind = 'declaration' AND start_byte % 200 = 0").select(F.col("symbol_id").alias("src"), F.col("file_path").alias("src_file"), F.col("start_byte").alias("at_byte"), "base_name")
    cand = a.join(s.select("base_name", F.col("symbol_id").alias("dst"), F.col("file_path").alias("dst_file"), "start_byte"), "base_name").filter("src <> dst")
    inc = C.read(spark, sf, "part").selectExpr("concat('/ws/parts/', p_brand, '.cpp') AS root", "concat('/ws/parts/Brand#', p_size % 5 + 1, p_size % 3 + 1, '.cpp') AS node")
    return resolve.visible_before(cand, inc).select("src", "dst", "included")


@registered("""i AS (SELECT 'f' || (o_custkey % 200) AS file_path, 'n' || (o_orderkey % 60) AS local_name, o_orderpriority AS target FROM orders)
SELECT file_path, local_name, target FROM i QUALIFY count(*) OVER (PARTITION BY file_path, local_name) = 1""", True)
def import_unique(spark, sf):
    i = C.read(spark, sf, "orders").selectExpr("concat('f', o_custkey % 200) AS file_path", "concat('n', o_orderkey % 60) AS local_name", "o_orderpriority AS target")
    return resolve.unique_imports(i)


@registered("SELECT p_name || '/' || p_size AS directory, min(p_brand) AS package FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1", False)
def unique_package(spark, sf):
    return resolve.package_names(C.read(spark, sf, "part").select(F.concat("p_name", F.lit("/"), F.col("p_size").cast("string")).alias("directory"), F.col("p_brand").alias("package")))


@registered("""c AS (SELECT p_partkey AS id, p_size % 4 AS n, p_partkey % 8 AS k FROM part)
SELECT id, CASE k WHEN 0 THEN n = 0 WHEN 1 THEN n BETWEEN 1 AND 2 WHEN 2 THEN n >= 1 WHEN 3 THEN n = 3 WHEN 4 THEN n = 1 WHEN 5 THEN n = 1 WHEN 6 THEN n <= 1 ELSE n = 0 END AS accepts FROM c""")
def arity_accepts(spark, sf):
    """A pack is one parameter, ``=`` inside brackets is no default, and one after closed brackets is."""
    lists = [["void"], ["int a", "int b = 1"], ["int a", "..."], ["int a", "int b", "int c"], ["Args... values"], ["int a[sizeof(b = 1)]"], ["F f = g(1, [x = 2]{})"], []]
    k = F.col("p_partkey") % 8
    ps = F.array().cast("array<string>")
    for key, v in enumerate(lists):
        ps = F.when(k == key, F.array(*[F.lit(x) for x in v]).cast("array<string>")).otherwise(ps)
    return C.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), E.accepts_arity(ps, F.col("p_size") % 4).alias("accepts"))


@registered("""SELECT DISTINCT p_brand || '<' || p_type || '>::' || p_name AS path, p_brand || '::' || p_name AS base, p_name AS name, p_brand || '<' || p_type || '>' AS parent FROM part
UNION ALL SELECT n_name || '<(1 > 0)>', n_name, n_name, NULL FROM nation UNION ALL SELECT n_name || '(a<b)', n_name || 'a<b', n_name || 'a<b', NULL FROM nation
UNION ALL SELECT n_name || '<a > b>', NULL, n_name || '<a > b>', NULL FROM nation WHERE n_nationkey < 0 UNION ALL SELECT n_name || '<x', NULL, n_name || '<x', NULL FROM nation UNION ALL SELECT n_name, NULL, n_name, NULL FROM nation""", False)
def template_base(spark, sf):
    """Angle brackets inside others stay, other brackets go, and what is left open has no base."""
    path = F.concat("p_brand", F.lit("<"), "p_type", F.lit(">::"), "p_name")
    p = C.read(spark, sf, "part").select(path.alias("path")).distinct()
    n = C.read(spark, sf, "nation")
    for end in ("<(1 > 0)>", "(a<b)", "<x", ""):
        p = p.unionAll(n.select(F.concat("n_name", F.lit(end))))
    return p.select("path", E.template_base("path").alias("base"), E.reference_base("path").alias("name"), E.parent_path("path").alias("parent"))


@registered("""refs AS (SELECT c_custkey AS ref_id, r_name || '::' || n_name || '::' || c_name AS scope, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS name FROM customer JOIN people ON c_nationkey = n_nationkey),
paths AS (SELECT ref_id, unnest([name, string_split(scope, '::')[1] || '::' || name, string_split(scope, '::')[1] || '::' || string_split(scope, '::')[2] || '::' || name, scope || '::' || name]) AS path, unnest([0, 1, 2, 3]) AS depth FROM refs),
met AS (SELECT ref_id, symbol_id FROM paths JOIN symbols ON semantic_path = path QUALIFY depth = max(depth) OVER (PARTITION BY ref_id))
SELECT ref_id, CASE WHEN count(DISTINCT symbol_id) = 1 THEN min(symbol_id) END AS symbol_id FROM met GROUP BY ref_id""")
def lexical_scopes(spark, sf):
    c = C.read(spark, sf, "customer").join(F.broadcast(C._people(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey"))
    refs = c.selectExpr("c_custkey AS ref_id", "concat(r_name, '::', n_name, '::', c_name) AS scope", "CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS name")
    return resolve.lexical(refs, C.symbols(spark, sf)).select("ref_id", "symbol_id")


@registered("""callers AS (SELECT DISTINCT '/s/' || p_brand || '.c' AS file_path FROM part),
h AS (SELECT '/s/' || p_brand || '.c' AS file_path, '/i/' || CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_type END || '.h' AS header, p_partkey AS position, p_size % 3 = 0 AS included FROM part),
r AS (SELECT *, CASE WHEN regexp_extract(header, '([^/]*)\\.h$', 1) = regexp_extract(file_path, '([^/]*)\\.c$', 1) THEN 1000 ELSE 0 END + CASE WHEN included THEN 500 ELSE 0 END AS rank FROM h JOIN callers USING (file_path))
SELECT file_path, header, rank FROM r WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY rank DESC, position DESC) = 1""")
def header_family(spark, sf):
    p = C.read(spark, sf, "part")
    h = p.selectExpr("concat('/s/', p_brand, '.c') AS included_by", "concat('/i/', CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_type END, '.h') AS header", "p_partkey AS position", "p_size % 3 = 0 AS included")
    return resolve.header_family(h.select(F.col("included_by").alias("file_path")).distinct(), h)


# ---- files, positions, reads ------------------------------------------------------------------------------------


SPANS = "spans AS (SELECT doc_id, source, (doc_id * 7) % greatest(length(source) - 30, 1) AS a, least((doc_id * 7) % greatest(length(source) - 30, 1) + 25, length(source)) AS b FROM files)"


def _spans(spark, sf):
    """Byte ranges that begin and end on characters: the bytes before character a and b."""
    f = C.files(spark, sf)
    a = F.expr("(doc_id * 7) % greatest(length(source) - 30, 1)")
    f = f.withColumn("a", a).withColumn("b", F.least(F.col("a") + 25, F.length("source")))
    at = lambda c: F.octet_length(F.substr("source", F.lit(1), F.col(c).cast("int")))
    return f.withColumns({"start_byte": at("a").cast("long"), "end_byte": at("b").cast("long"), "symbol_id": F.col("doc_id").cast("string")})


@registered(SPANS + """ SELECT doc_id, strlen(source[1:a]) AS start_byte, strlen(source[1:b]) AS end_byte, source[a + 1:b] AS text, length(source[1:a]) - length(replace(source[1:a], chr(10), '')) AS start_row,
  strlen(string_split(source[1:a], chr(10))[-1]) AS start_column FROM spans""")
def read_slice(spark, sf):
    s = _spans(spark, sf)
    got = query.read(s.select("doc_id", "file_path", "symbol_id", "start_byte", "end_byte"), s.select("file_path", "source"))
    return got.select("doc_id", "start_byte", "end_byte", "text", F.col("start_row").cast("long").alias("start_row"), F.col("start_column").cast("long").alias("start_column"))


@registered(SPANS + """, p AS (SELECT doc_id, source, a, length(source[1:a]) - length(replace(source[1:a], chr(10), '')) AS r, strlen(string_split(source[1:a], chr(10))[-1]) AS c FROM spans)
SELECT doc_id, r AS row_no, c AS column_no, strlen(source[1:a]) AS back FROM p""")
def point_round_trip(spark, sf):
    s = _spans(spark, sf).withColumns({"r": E.offset_row(F.col("source"), F.col("start_byte")), "c": E.offset_column(F.col("source"), F.col("start_byte"))})
    back = E.point_offset(F.col("source"), F.col("r"), F.col("c"))
    return s.select("doc_id", F.col("r").cast("long").alias("row_no"), F.col("c").cast("long").alias("column_no"), back.cast("long").alias("back"))


POINTS = """points AS (SELECT p_partkey AS point_id, '/ws/parts/' || p_brand || '.cpp' AS point_file, p_partkey * 10 + p_size % 12 AS at_byte FROM part),
wide AS (SELECT symbol_id, file_path, start_byte, end_byte FROM symbols WHERE node_kind = 'declaration' UNION ALL SELECT file_path || '::block' || (start_byte // 1000), file_path, (start_byte // 1000) * 1000, (start_byte // 1000) * 1000 + 999 FROM symbols WHERE node_kind = 'declaration' GROUP BY ALL
  UNION ALL SELECT file_path || '::all', file_path, 0, 10000000000 FROM symbols WHERE node_kind = 'declaration' GROUP BY ALL)"""


def _nested(spark, sf):
    d = C.symbols(spark, sf).filter("node_kind = 'declaration'").select("symbol_id", "file_path", "start_byte", "end_byte")
    blocks = d.selectExpr("file_path", "start_byte div 1000 AS k").distinct().selectExpr("concat(file_path, '::block', k)", "file_path", "k * 1000", "k * 1000 + 999")
    whole = d.select("file_path").distinct().selectExpr("concat(file_path, '::all')", "file_path", "0L", "10000000000L")
    return d.unionAll(blocks).unionAll(whole)


def _points(spark, sf):
    return C.read(spark, sf, "part").selectExpr("p_partkey AS point_id", "concat('/ws/parts/', p_brand, '.cpp') AS point_file", "p_partkey * 10 + p_size % 12 AS offset")


@registered(POINTS + " SELECT point_id, symbol_id FROM points JOIN wide ON point_file = file_path AND start_byte <= at_byte AND end_byte >= at_byte QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY end_byte - start_byte, start_byte, symbol_id) = 1")
def position_symbol(spark, sf):
    return query.at_positions(_nested(spark, sf), _points(spark, sf)).select("point_id", "symbol_id")


@registered(POINTS + " SELECT point_id, symbol_id FROM points JOIN wide ON point_file = file_path AND start_byte <= at_byte AND end_byte >= at_byte + 3 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY end_byte - start_byte, start_byte, symbol_id) = 1")
def owner_of_node(spark, sf):
    p = _points(spark, sf).withColumns({"from_byte": F.col("offset"), "to_byte": F.col("offset") + 3}).drop("offset")
    return query.containing(_nested(spark, sf), p).select("point_id", "symbol_id")


@registered(f"""wanted AS (SELECT p_partkey AS want_id, '/ws/parts/' || p_brand || '.cpp' AS want_file, p_partkey * 10 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS want_start, p_partkey * 10 + 9 AS want_end, p_brand || '::' || p_name AS want_symbol FROM part),
m AS (SELECT *, CASE WHEN want_start = start_byte AND want_end = end_byte THEN 10 ELSE 0 END + {RANK} AS r FROM wanted JOIN symbols ON want_file = file_path AND (want_symbol = symbol_id OR want_symbol = semantic_path))
SELECT want_id, symbol_id FROM m QUALIFY row_number() OVER (PARTITION BY want_id ORDER BY r DESC, file_path, start_byte, end_byte, symbol_id) = 1""")
def locate_rows(spark, sf):
    w = C.read(spark, sf, "part").selectExpr("p_partkey AS want_id", "concat('/ws/parts/', p_brand, '.cpp') AS want_file", "p_partkey * 10 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS want_start", "p_partkey * 10 + 9 AS want_end", "concat(p_brand, '::', p_name) AS want_symbol")
    return query.locate(C.symbols(spark, sf), w).select("want_id", "symbol_id")


PATHS = """paths AS (SELECT page_id AS id, '/ws/' || CASE page_id % 10 WHEN 0 THEN 'src' WHEN 1 THEN 'Node_Modules/a' WHEN 2 THEN 'a/.git' WHEN 3 THEN 'b/target' WHEN 4 THEN 'a/.ruff_cache' WHEN 5 THEN '.tox' WHEN 6 THEN '.hg' WHEN 7 THEN '.svn/b' WHEN 8 THEN 'lib' ELSE '../out' END || '/f' || page_id || CASE page_id % 9 WHEN 0 THEN '.PY' WHEN 1 THEN '.cpp' WHEN 2 THEN '_test.go' WHEN 3 THEN '.tsx' WHEN 4 THEN '.H' WHEN 5 THEN '.txt' WHEN 6 THEN '.go' WHEN 7 THEN '.kts' ELSE '' END AS path FROM pages)"""


def _paths(spark, sf):
    mid = "CASE page_id % 10 WHEN 0 THEN 'src' WHEN 1 THEN 'Node_Modules/a' WHEN 2 THEN 'a/.git' WHEN 3 THEN 'b/target' WHEN 4 THEN 'a/.ruff_cache' WHEN 5 THEN '.tox' WHEN 6 THEN '.hg' WHEN 7 THEN '.svn/b' WHEN 8 THEN 'lib' ELSE '../out' END"
    end = "CASE page_id % 9 WHEN 0 THEN '.PY' WHEN 1 THEN '.cpp' WHEN 2 THEN '_test.go' WHEN 3 THEN '.tsx' WHEN 4 THEN '.H' WHEN 5 THEN '.txt' WHEN 6 THEN '.go' WHEN 7 THEN '.kts' ELSE '' END"
    return C.read(spark, sf, "pages").selectExpr("page_id AS id", f"concat('/ws/', {mid}, '/f', page_id, {end}) AS path")


@registered(PATHS + """ SELECT id, CASE id % 9 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'go' WHEN 3 THEN 'tsx' WHEN 4 THEN 'c' WHEN 6 THEN 'go' WHEN 7 THEN 'kotlin' END AS language, id % 10 IN (1, 2, 3, 4, 5) AS skipped,
  id % 9 = 4 AS header, id % 9 = 6 AS production_go, id % 10 <> 9 AS inside, CASE WHEN id % 10 = 9 THEN replace(path, '/ws/..', '') ELSE path END AS normal FROM paths""")
def scan_predicates(spark, sf):
    p = _paths(spark, sf)
    relative = F.substr("path", F.lit(5))
    return p.select(
        "id", E.language("path").alias("language"), E.in_skipped_directory(relative).alias("skipped"), E.extension("path").isin(*E.HEADER_EXTENSIONS).alias("header"),
        (F.col("path").endswith(".go") & ~F.col("path").rlike(r"_test\.go$")).alias("production_go"), E.inside(E.normalized_path("path"), "/ws").alias("inside"), E.normalized_path("path").alias("normal"),
    )


@registered("SELECT file_path FROM files UNION SELECT file_path || '.new' FROM overlay ORDER BY file_path")
def path_union_sorted(spark, sf):
    return C.files(spark, sf).select("file_path").union(C.overlay(spark, sf).select(F.concat("file_path", F.lit(".new")))).distinct().orderBy("file_path")


@registered("""i AS (SELECT doc_id AS import_id, '/ws/' || source || '/' || lang || '/' || doc_id || '.py' AS file_path, CASE doc_id % 3 WHEN 0 THEN '.m' || (doc_id % 7) WHEN 1 THEN '..pkg' ELSE 'm' || (doc_id % 5) END AS module, source, lang FROM documents),
have AS (SELECT DISTINCT '/ws/' || source || '/' || lang || '/m' || (doc_id % 7) || '.py' AS p FROM documents WHERE doc_id % 4 = 0 UNION SELECT '/ws/' || source || '/pkg/__init__.py' FROM documents WHERE doc_id % 9 = 0 UNION SELECT '/ws/m' || (doc_id % 3) || '.pyi' FROM documents),
c AS (SELECT import_id, CASE WHEN starts_with(module, '..') THEN '/ws/' || source || '/pkg' WHEN starts_with(module, '.') THEN '/ws/' || source || '/' || lang || '/' || module[2:] END AS base, 0 AS up FROM i WHERE starts_with(module, '.')
  UNION ALL SELECT import_id, unnest(['/ws/' || source || '/' || lang || '/', '/ws/' || source || '/', '/ws/', '/']) || module, unnest([0, 1, 2, 3]) FROM i WHERE NOT starts_with(module, '.')),
e AS (SELECT import_id, base || x.ext AS p, up * 4 + x.k AS ord FROM c, (VALUES ('.py', 0), ('.pyi', 1), ('/__init__.py', 2), ('/__init__.pyi', 3)) x(ext, k))
SELECT import_id, arg_min(p, ord) AS resolved FROM e JOIN have USING (p) GROUP BY import_id""")
def python_modules(spark, sf):
    d = C.read(spark, sf, "documents")
    i = d.selectExpr("doc_id AS import_id", "concat('/ws/', source, '/', lang, '/', doc_id, '.py') AS file_path", "CASE doc_id % 3 WHEN 0 THEN concat('.m', doc_id % 7) WHEN 1 THEN '..pkg' ELSE concat('m', doc_id % 5) END AS module")
    have = d.filter("doc_id % 4 = 0").selectExpr("concat('/ws/', source, '/', lang, '/m', doc_id % 7, '.py') AS file_path").union(d.filter("doc_id % 9 = 0").selectExpr("concat('/ws/', source, '/pkg/__init__.py')")).union(d.selectExpr("concat('/ws/m', doc_id % 3, '.pyi')")).distinct()
    return resolve.first_existing(resolve.python_candidates(i), have)


# ---- index ------------------------------------------------------------------------------------------------------

FRESH = "now AS (SELECT file_path, CASE WHEN doc_id % 33 <> 0 THEN fingerprint END AS fingerprint FROM files), fresh AS (SELECT coalesce(f.file_path, s.file_path) AS file_path, CASE WHEN f.file_path IS NULL THEN 'missing' WHEN f.fingerprint IS NULL THEN 'unreadable' WHEN s.file_path IS NULL THEN 'unindexed' WHEN f.fingerprint = s.fingerprint THEN 'fresh' ELSE 'stale' END AS status FROM now f FULL JOIN file_state s ON f.file_path = s.file_path)"


@registered(FRESH + " SELECT * FROM fresh")
def file_freshness(spark, sf):
    return index.freshness(_now(spark, sf), C.file_state(spark, sf))


def _now(spark, sf):
    """Some files can't be read."""
    return C.files(spark, sf).withColumn("fingerprint", F.when(F.col("doc_id") % 33 != 0, F.col("fingerprint")))


@registered(FRESH + """, c AS (SELECT count(*) FILTER (WHERE status = 'fresh') AS fresh, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'unreadable') AS unreadable, count(*) FILTER (WHERE status = 'unindexed') AS unindexed FROM fresh)
SELECT *, stale + missing + unreadable + unindexed = 0 AS ok, CASE WHEN stale + missing + unreadable + unindexed = 0 THEN 'none' ELSE 'refresh' END AS action FROM c""")
def file_health(spark, sf):
    return index.health(_now(spark, sf), C.file_state(spark, sf))


@registered("SELECT file_path FROM files WHERE file_path NOT IN (SELECT file_path FROM file_state) AND file_path NOT IN (SELECT file_path FROM overlay)")
def unindexed_files(spark, sf):
    return index.unindexed(C.files(spark, sf), C.file_state(spark, sf), C.overlay(spark, sf))


@registered("SELECT f.file_path, coalesce(f.fingerprint = s.fingerprint, false) AS reused FROM files f LEFT JOIN file_state s USING (file_path)")
def fingerprint_reuse(spark, sf):
    return index.reuse(C.files(spark, sf), C.file_state(spark, sf))


@registered("r AS (SELECT coalesce(f.fingerprint = s.fingerprint, false) AS reused FROM files f LEFT JOIN file_state s USING (file_path)) SELECT count(*) AS indexed, count(*) FILTER (WHERE reused) AS reused, count(*) FILTER (WHERE NOT reused) AS rebuilt FROM r")
def refresh_stats(spark, sf):
    return index.refresh_stats(C.files(spark, sf), C.file_state(spark, sf))


@registered("SELECT file_path, md5(source) AS digest FROM files WHERE file_path NOT IN (SELECT file_path FROM overlay) UNION ALL SELECT file_path, md5(source) FROM overlay")
def overlay_apply(spark, sf):
    return index.overlaid(C.files(spark, sf), C.overlay(spark, sf)).select("file_path", F.md5("source").alias("digest"))


@registered("""changed AS (SELECT symbol_id, base_name FROM symbols WHERE start_byte % 230 = 0), refs AS (SELECT DISTINCT src, split_part(dst, '::', 2) AS name FROM edges WHERE starts_with(dst, 'Brand'))
SELECT symbol_id FROM changed UNION SELECT src FROM refs WHERE name IN (SELECT base_name FROM changed) UNION SELECT src FROM edges WHERE dst IN (SELECT symbol_id FROM changed) UNION SELECT dst FROM edges WHERE src IN (SELECT symbol_id FROM changed)""")
def impacted_ids(spark, sf):
    s, e = C.symbols(spark, sf), C.edges(spark, sf)
    refs = e.filter("startswith(dst, 'Brand')").select("src", F.split_part("dst", F.lit("::"), F.lit(2)).alias("name")).distinct()
    return index.impacted(s.filter("start_byte % 230 = 0").select("symbol_id"), refs, s, e)


@registered("""changed AS (SELECT DISTINCT file_path FROM symbols WHERE contains(file_path, 'Brand#1')), rows_ AS (SELECT symbol_id || '!' AS symbol_id, file_path, start_byte FROM symbols WHERE contains(file_path, 'Brand#1') AND start_byte % 20 = 0)
SELECT symbol_id, file_path, start_byte FROM symbols WHERE file_path NOT IN (SELECT file_path FROM changed) UNION ALL SELECT * FROM rows_""")
def incremental_replace(spark, sf):
    s = C.symbols(spark, sf).select("symbol_id", "file_path", "start_byte")
    own = s.filter("contains(file_path, 'Brand#1')")
    return index.replaced(s, own.select("file_path"), own.filter("start_byte % 20 = 0").withColumn("symbol_id", F.concat("symbol_id", F.lit("!"))))


@registered("SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'new' FROM nation WHERE n_nationkey % 2 = 1", False)
def key_value_upsert(spark, sf):
    t = C.read(spark, sf, "nation")
    return index.upserted(t.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")), t.filter("n_nationkey % 2 = 1").select(F.col("n_name").alias("key"), F.lit("new").alias("value")))


@registered("SELECT 'symbols' AS name, count(*) AS n FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'file_state', count(*) FROM file_state")
def table_counts(spark, sf):
    one = lambda name, df: df.agg(n()).select(F.lit(name).alias("name"), "n")
    return one("symbols", C.symbols(spark, sf)).unionAll(one("edges", C.edges(spark, sf))).unionAll(one("file_state", C.file_state(spark, sf)))


@registered("""s AS (SELECT CASE WHEN start_byte % 170 = 0 THEN ' ' ELSE symbol_id END AS symbol_id, CASE WHEN start_byte % 190 = 0 THEN '' ELSE semantic_path END AS semantic_path, node_kind, start_byte, CASE WHEN start_byte % 110 = 0 THEN start_byte - 1 ELSE end_byte END AS end_byte, CASE WHEN start_byte % 130 = 0 AND signature IS NOT NULL THEN '' ELSE signature END AS signature FROM symbols)
SELECT 'blank_id' AS rule, count(*) FILTER (WHERE trim(symbol_id) = '') AS n FROM s UNION ALL SELECT 'blank_path', count(*) FILTER (WHERE trim(semantic_path) = '') FROM s UNION ALL SELECT 'blank_kind', count(*) FILTER (WHERE trim(node_kind) = '') FROM s
UNION ALL SELECT 'range', count(*) FILTER (WHERE start_byte > end_byte) FROM s UNION ALL SELECT 'blank_signature', count(*) FILTER (WHERE trim(signature) = '') FROM s""")
def record_violations(spark, sf):
    s = C.symbols(spark, sf)
    bad = s.withColumns({
        "symbol_id": F.when(F.col("start_byte") % 170 == 0, " ").otherwise(F.col("symbol_id")), "semantic_path": F.when(F.col("start_byte") % 190 == 0, "").otherwise(F.col("semantic_path")),
        "end_byte": F.when(F.col("start_byte") % 110 == 0, F.col("start_byte") - 1).otherwise(F.col("end_byte")), "signature": F.when((F.col("start_byte") % 130 == 0) & F.col("signature").isNotNull(), "").otherwise(F.col("signature")),
    })
    return index.violations(bad)


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_columns(spark, sf):
    return C.read(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT", {"mode": "FAILFAST"})["k"].alias("k"))


# ---- patches ----------------------------------------------------------------------------------------------------

PATCH = """pt AS (SELECT o_orderkey AS patch_id, CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS syntax_errors, o_orderkey % 4 = 0 AS bypass FROM orders),
rf AS (SELECT l_orderkey AS patch_id, 'n' || l_linenumber AS name FROM lineitem),
cand AS (SELECT l_orderkey AS patch_id, 'n' || (l_linenumber % 3 + 1) AS name, 's' || l_partkey AS candidate, CAST(floor(l_quantity / 10) AS BIGINT) AS rank, l_returnflag = 'R' AS suppressing FROM lineitem),
op AS (SELECT * FROM (SELECT *, max(CASE WHEN suppressing THEN rank END) OVER (PARTITION BY patch_id, name) AS shade FROM cand) WHERE NOT suppressing AND (shade IS NULL OR rank >= shade)),
best AS (SELECT * FROM op QUALIFY rank = max(rank) OVER (PARTITION BY patch_id, name)),
cn AS (SELECT patch_id, name, count(*) AS n, min(candidate) AS candidate FROM best GROUP BY ALL),
dec AS (SELECT rf.patch_id, rf.name, coalesce(n, 0) AS candidates, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN candidate END AS selected FROM rf LEFT JOIN cn USING (patch_id, name)),
gc AS (SELECT patch_id, count(*) FILTER (WHERE status = 'ambiguous') AS amb, count(*) FILTER (WHERE status = 'unresolved') AS unr FROM dec GROUP BY patch_id),
gate AS (SELECT patch_id, bypass, CASE WHEN syntax_errors > 0 THEN 'syntax' WHEN coalesce(amb, 0) > 0 THEN 'ambiguous' WHEN coalesce(unr, 0) > 0 THEN 'unresolved' END AS reason FROM pt LEFT JOIN gc USING (patch_id)),
gated AS (SELECT patch_id, bypass, CASE WHEN reason IS NULL THEN 'allowed' WHEN bypass THEN 'allowed_with_bypass' ELSE 'rejected' END AS gate, reason FROM gate)
"""


def _decided(spark, sf):
    li = C.read(spark, sf, "lineitem")
    refs = li.selectExpr("l_orderkey AS patch_id", "concat('n', l_linenumber) AS name")
    cand = li.selectExpr("l_orderkey AS patch_id", "concat('n', l_linenumber % 3 + 1) AS name", "concat('s', l_partkey) AS candidate", "cast(floor(l_quantity / 10) AS bigint) AS rank", "l_returnflag = 'R' AS suppressing")
    return patch.decisions(refs, cand)


def _gated(spark, sf):
    p = C.read(spark, sf, "orders").selectExpr("o_orderkey AS patch_id", "CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS syntax_errors", "o_orderkey % 4 = 0 AS bypass")
    return patch.gates(p, _decided(spark, sf))


@registered(PATCH + "SELECT * FROM dec")
def binding_decisions(spark, sf):
    return _decided(spark, sf)


@registered(PATCH + "SELECT status, CASE WHEN status = 'resolved' THEN 'passed' ELSE 'blocked' END AS invariant, count(*) AS n FROM dec GROUP BY ALL")
def evidence_invariants(spark, sf):
    return patch.invariants(_decided(spark, sf)).groupBy("status", "invariant").agg(n())


@registered(PATCH + "SELECT patch_id, bypass, gate, reason FROM gated")
def commit_gate(spark, sf):
    return _gated(spark, sf)


REPLAY = """st AS (SELECT l_orderkey AS patch_id, CASE WHEN l_shipdate IS NULL OR l_linenumber = 7 THEN 'failed' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'blocked' WHEN l_partkey % 50 = 0 THEN 'missing' ELSE 'matched' END AS status FROM lineitem),
rs AS (SELECT patch_id, CASE max(CASE status WHEN 'failed' THEN 3 WHEN 'missing' THEN 2 WHEN 'blocked' THEN 1 ELSE 0 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'missing' WHEN 1 THEN 'blocked' ELSE 'matched' END AS status, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'blocked') AS blocked, bool_and(status IN ('matched', 'blocked')) AS consistent FROM st GROUP BY patch_id)
"""


def _replayed(spark, sf):
    status = "CASE WHEN l_shipdate IS NULL OR l_linenumber = 7 THEN 'failed' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'blocked' WHEN l_partkey % 50 = 0 THEN 'missing' ELSE 'matched' END AS status"
    return patch.replay_status(C.read(spark, sf, "lineitem").selectExpr("l_orderkey AS patch_id", status))


@registered(REPLAY + "SELECT * FROM rs")
def replay_status(spark, sf):
    return _replayed(spark, sf)


@registered(PATCH.rstrip() + ", " + REPLAY + "SELECT g.patch_id, CASE WHEN gate = 'rejected' THEN 'rejected_by_patch_gate' WHEN status IN ('missing', 'failed') OR (status = 'blocked' AND gate <> 'allowed_with_bypass') THEN 'rejected_by_trace_replay' ELSE gate END AS decision FROM gated g LEFT JOIN rs USING (patch_id)")
def commit_decision(spark, sf):
    return patch.commit_decision(_gated(spark, sf), _replayed(spark, sf))


@registered(ROOTS + f""", tr AS (SELECT root_id AS patch_id, 'caller' AS role, src AS symbol_id FROM roots JOIN edges ON dst = root_id UNION SELECT root_id, 'callee', dst FROM roots JOIN edges ON src = root_id UNION SELECT root_id, 'trace_root', root_id FROM roots),
keyed AS (SELECT patch_id, symbol_id, CASE role WHEN 'callee' THEN 'callees' WHEN 'caller' THEN 'callers' ELSE 'symbol' END AS scope, {KEY.format(o='role')} AS k, {KEY.format(o="'moved'")} AS moved, {KEY.format(o="'local_scope'")} AS own, start_byte FROM tr JOIN symbols USING (symbol_id)),
ev AS (SELECT patch_id, symbol_id, CASE WHEN start_byte % 30 = 0 THEN moved WHEN start_byte % 70 = 0 THEN k || '?' WHEN start_byte % 110 = 0 THEN own || '?' WHEN start_byte % 130 = 0 THEN 'short|' || symbol_id WHEN start_byte % 170 = 0 THEN NULL ELSE k END AS evidence_key,
  CASE WHEN start_byte % 30 = 0 THEN scope WHEN start_byte % 70 = 0 THEN 'none' WHEN start_byte % 110 = 0 THEN 'patch_scope' WHEN start_byte % 130 = 0 OR start_byte % 170 = 0 THEN 'none' ELSE scope END AS scope,
  CASE WHEN length(symbol_id) % 5 = 0 THEN 'blocked' WHEN length(symbol_id) % 7 = 0 THEN 'failed' ELSE 'passed' END AS invariant FROM keyed)
SELECT patch_id, symbol_id AS name, evidence_key, scope, CASE invariant WHEN 'passed' THEN CASE WHEN scope = 'none' THEN 'missing' ELSE 'matched' END ELSE invariant END AS status FROM ev""")
def evidence_replay(spark, sf):
    t = graph.trace(C.symbols(spark, sf), C.edges(spark, sf), _roots(spark, sf)).withColumnRenamed("root_id", "patch_id")
    key = lambda o: E.evidence_key("symbol_id", "file_path", "node_kind", o, "start_byte", "end_byte", "signature")
    by = lambda k: F.col("start_byte") % k == 0
    k, lost = key(F.col("role")), F.lit("?")
    chosen = F.when(by(30), key(F.lit("moved"))).when(by(70), F.concat(k, lost)).when(by(110), F.concat(key(F.lit("local_scope")), lost)).when(by(130), F.concat(F.lit("short|"), "symbol_id")).when(~by(170), k)
    invariant = F.when(F.length("symbol_id") % 5 == 0, "blocked").when(F.length("symbol_id") % 7 == 0, "failed").otherwise("passed")
    return patch.replay(t.select("patch_id", F.col("symbol_id").alias("name"), chosen.alias("evidence_key"), invariant.alias("invariant")), t.select("patch_id", "role", k.alias("evidence_key")))


@registered(SPANS + " SELECT doc_id, md5(source[1:a] || '<new é>' || source[b + 1:]) AS digest FROM spans")
def splice_text(spark, sf):
    s = _spans(spark, sf)
    return s.select("doc_id", F.md5(patch.spliced(F.col("source"), F.col("start_byte"), F.col("end_byte"), F.lit("<new é>"))).alias("digest"))


@registered(SPANS + """ SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE md5('intro' || chr(10) || 'X' || source) END AS digest FROM spans""")
def position_edit_batch(spark, sf):
    s = C.files(spark, sf)
    edit = lambda r, c, r2, c2, text: F.struct(F.lit(r).alias("start_row"), F.lit(c).alias("start_col"), F.lit(r2).alias("end_row"), F.lit(c2).alias("end_col"), F.lit(text).alias("new_text"))
    good = F.array(edit(0, 0, 0, 0, "intro\n"), edit(1, 0, 1, 0, "X"))
    bad = F.array(edit(0, 0, 0, 0, "intro\n"), edit(99999, 0, 99999, 0, "X"))
    edits = F.when(F.col("doc_id") % 4 == 0, bad).otherwise(good)
    return s.select("doc_id", F.md5(patch.position_edits(F.col("source"), edits)).alias("digest"))


@registered("""l AS (SELECT doc_id, source, string_split(source, chr(10)) AS s0 FROM files),
v AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN source || chr(10) || 'tail' WHEN 2 THEN 'head' || chr(13) || chr(10) || source WHEN 3 THEN '' ELSE array_to_string(list_concat(s0[1:1], ['added'], s0[3:]), chr(10)) END AS after FROM l),
c AS (SELECT *, CASE WHEN source = '' OR source LIKE '%' || chr(10) THEN string_split(source, chr(10))[:-2] ELSE string_split(source, chr(10)) END AS a0, CASE WHEN after = '' OR after LIKE '%' || chr(10) THEN string_split(after, chr(10))[:-2] ELSE string_split(after, chr(10)) END AS b0 FROM v),
m AS (SELECT doc_id, source, after, list_transform(a0, lambda x, i: CASE WHEN x LIKE '%' || chr(13) AND (i < len(a0) OR source LIKE '%' || chr(10)) THEN x[:-2] ELSE x END) AS a, list_transform(b0, lambda x, i: CASE WHEN x LIKE '%' || chr(13) AND (i < len(b0) OR after LIKE '%' || chr(10)) THEN x[:-2] ELSE x END) AS b FROM c),
h AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS head FROM m),
t AS (SELECT *, least(coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[len(a) + 1 - i] <> b[len(b) + 1 - i])) - 1, least(len(a), len(b))), least(len(a), len(b)) - head) AS tail FROM h)
SELECT doc_id, CASE WHEN source = after THEN '' ELSE '--- a/ws/f' || doc_id || '.py' || chr(10) || '+++ b/ws/f' || doc_id || '.py' || chr(10) || '@@ -' || (head + 1) || ',' || (len(a) - head - tail) || ' +' || (head + 1) || ',' || (len(b) - head - tail) || ' @@' || chr(10)
  || coalesce(array_to_string(list_transform(a[head + 1:len(a) - tail], lambda x: '-' || x || chr(10)), ''), '') || coalesce(array_to_string(list_transform(b[head + 1:len(b) - tail], lambda x: '+' || x || chr(10)), ''), '') END AS diff FROM t""")
def unified_diff(spark, sf):
    """Lines added at the end and the start, a text made empty, a line replaced, and no change."""
    f, k = C.files(spark, sf).withColumn("a", F.split("source", "\n")), F.col("doc_id") % 5
    replaced = F.array_join(F.concat(F.slice("a", 1, 1), F.array(F.lit("added")), F.slice("a", F.lit(3), F.size("a"))), "\n")
    after = F.when(k == 0, F.col("source")).when(k == 1, F.concat("source", F.lit("\ntail"))).when(k == 2, F.concat(F.lit("head\r\n"), "source")).when(k == 3, "").otherwise(replaced)
    return f.select("doc_id", patch.unified_diff(F.concat(F.lit("/ws/f"), F.col("doc_id").cast("string"), F.lit(".py")), F.col("source"), after).alias("diff"))


@registered("""l AS (SELECT 'f' || c_nationkey AS file_path, c_custkey AS row, CASE c_custkey % 9 WHEN 0 THEN 'if x:  ' WHEN 1 THEN '# note' WHEN 2 THEN '' WHEN 3 THEN 'flat' WHEN 4 THEN '  for z:' WHEN 5 THEN '  w' WHEN 6 THEN '    deep' WHEN 7 THEN '  # y:' ELSE 'else:' END AS line FROM customer),
c AS (SELECT file_path, row, length(line) - length(ltrim(line)) AS indent, rtrim(line) LIKE '%:' AS opens, row_number() OVER (PARTITION BY file_path ORDER BY row) AS k FROM l WHERE trim(line) <> '' AND ltrim(line) NOT LIKE '#%'),
st(file_path, k, row, indent, header, waits) AS (SELECT file_path, k, row, indent, NULL::BIGINT, CASE WHEN opens THEN indent END FROM c WHERE k = 1
  UNION ALL SELECT c.file_path, c.k, c.row, c.indent, CASE WHEN c.indent <= st.waits THEN st.waits END, CASE WHEN c.opens THEN c.indent WHEN c.indent <= st.waits THEN st.waits END FROM st JOIN c ON c.file_path = st.file_path AND c.k = st.k + 1)
SELECT file_path, row, indent, header FROM st WHERE header IS NOT NULL""")
def indentation_issues(spark, sf):
    line = "CASE c_custkey % 9 WHEN 0 THEN 'if x:  ' WHEN 1 THEN '# note' WHEN 2 THEN '' WHEN 3 THEN 'flat' WHEN 4 THEN '  for z:' WHEN 5 THEN '  w' WHEN 6 THEN '    deep' WHEN 7 THEN '  # y:' ELSE 'else:' END AS line"
    out = patch.indentation_issues(C.read(spark, sf, "customer").selectExpr("concat('f', c_nationkey) AS file_path", "c_custkey AS row", line))
    return out.select("file_path", "row", F.col("indent").cast("long").alias("indent"), F.col("header").cast("long").alias("header"))


@registered("SELECT file_path, string_agg(semantic_path || ' ...', chr(10) || chr(10) ORDER BY start_byte, semantic_path) AS skeleton, count(*) AS n FROM symbols WHERE node_kind <> 'function_item' AND len(string_split(semantic_path, '::')) <= 2 GROUP BY file_path")
def skeleton_text(spark, sf):
    s = C.symbols(spark, sf).filter("node_kind <> 'function_item'").filter(F.size(F.split("semantic_path", "::")) <= 2)
    lines = F.array_sort(F.collect_list(F.struct("start_byte", F.concat("semantic_path", F.lit(" ...")).alias("t"))))
    return s.groupBy("file_path").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n\n").alias("skeleton"), n())


# ---- buffers and events -----------------------------------------------------------------------------------------


@registered("SELECT conv_id, max(turn) AS version, arg_max(md5(text), turn) AS digest, count(*) AS edits FROM conversations GROUP BY conv_id")
def buffer_latest(spark, sf):
    from symloom.streaming import buffers

    log = C.read(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("version"), F.col("text").alias("source"))
    return buffers.latest(log).select(F.col("path").alias("conv_id"), "version", F.md5("source").alias("digest"), "edits")


@registered("""w AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, md5(string_agg(text, '' ORDER BY turn DESC)) AS digest, count(*) AS version FROM w GROUP BY conv_id""")
def buffer_fold(spark, sf):
    from symloom.streaming import buffers

    log = C.read(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("version"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("text").alias("new_text"))
    return buffers.folded(log, F.lit("")).select(F.col("path").alias("conv_id"), F.md5("source").alias("digest"), "version")


@registered("""e AS (SELECT user_id, event_id, ts, value FROM events)
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM e GROUP BY ALL""")
def event_windows(spark, sf):
    """An extension: tumbling windows over the event table."""
    w = F.window("ts", "1 hour")
    return C.read(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(n()).select("user_id", F.col("w.start").alias("hour"), "n")
