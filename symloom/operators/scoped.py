"""Resolution of calls by the paths that their language allows, the nearest scope first.

A call comes with its candidate paths in order.  The first one that is declared decides: of its declarations those that take
the call's arguments count, and one alone makes an edge.  Paths that need other files - modules, packages, exports - are made
whole by joins first.  Calls that no scope knows climb the unique chain of base classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.operators import graph, resolve
from symloom.sources.scratch import materialize

SEP = "\x01"
CALLABLES = ("function_definition", "function_declaration", "method_declaration", "constructor_declaration", "variable_declarator", "method_definition", "function_item")
SCRIPTS, DOTTED = ("javascript", "typescript", "tsx"), ("java", "kotlin", "csharp")
LANGUAGES = ("cpp", *SCRIPTS, *DOTTED, "rust", "go")


def folder(path: str = "file_path") -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def keyed(space: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit(space) if isinstance(space, str) else space, F.lit(SEP), F.col(path) if isinstance(path, str) else path)


def rust_units(files: DataFrame, facts: DataFrame) -> DataFrame:
    """file_path, root, unit: the module of each file, from the root file of its tree.  A module that two files could be, or a
    file that two modules claim, has no unit of that tree and counts as a root."""
    stem = F.regexp_extract("file_path", r"([^/]*)\.rs$", 1)
    base = F.when(stem.isin("main", "lib", "mod"), folder()).otherwise(F.concat(folder(), F.lit("/"), stem))
    mods = facts.filter("kind = 'import' AND language = 'rust'").select("file_path", F.col("target").alias("name"), base.alias("base")).distinct()
    places = mods.select(F.col("file_path").alias("parent"), "name", F.explode(F.array(F.concat("base", F.lit("/"), "name", F.lit(".rs")), F.concat("base", F.lit("/"), "name", F.lit("/mod.rs")))).alias("file_path"))
    met = places.join(files.select("file_path"), "file_path", "left_semi")
    one = met.groupBy("parent", "name").agg(F.count_distinct("file_path").alias("n"), F.min("file_path").alias("file_path")).filter("n = 1")
    child = one.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"), F.min("name").alias("name")).filter("n = 1 AND parent <> file_path").drop("n")
    child = materialize(child, "rust-modules")
    level = files.filter("language = 'rust'").select("file_path").join(child, "file_path", "left_anti").select("file_path", F.col("file_path").alias("root"), F.lit("").alias("unit"))
    out = level = materialize(level, "rust-roots")
    while True:  # ends, as each file has one parent and cycles hang from no root
        level = child.join(level.select(F.col("file_path").alias("parent"), "root", "unit"), "parent").select("file_path", "root", F.concat("unit", "name", F.lit("::")).alias("unit"))
        level = materialize(level, "rust-level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def go_folders(files: DataFrame, facts: DataFrame) -> DataFrame:
    """file_path, import path, folder, package: packages below the nearest go.mod of the importing file."""
    modules = files.filter("file_path LIKE '%/go.mod'").select(folder().alias("at"), F.regexp_extract("source", r"(?m)^\s*module\s+(\S+)", 1).alias("module")).filter("module <> ''")
    asked = facts.filter("kind = 'import' AND language = 'go'").select("file_path", F.col("target").alias("imported")).distinct()
    parts = F.split(folder(), "/")
    above = asked.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("at", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    near = above.join(modules, "at").groupBy("file_path", "imported").agg(F.max_by(F.struct("at", "module"), "depth").alias("m"))
    below = near.filter("startswith(imported, concat(m.module, '/'))").withColumn("folder", F.concat("m.at", F.expr("substr(imported, length(m.module) + 1)")))
    production = facts.filter("kind = 'package' AND language = 'go' AND file_path NOT LIKE '%_test.go'").select(folder().alias("directory"), F.col("target").alias("package"))
    return below.join(resolve.package_names(production), F.col("folder") == F.col("directory")).select("file_path", "imported", "folder", "package")


def script_modules(files: DataFrame, facts: DataFrame) -> DataFrame:
    """file_path, module, resolved: relative module names of scripts."""
    asked = facts.filter(F.col("language").isin(*SCRIPTS) & F.col("kind").isin("import", "named", "star")).select("file_path", F.col("target").alias("module")).filter("module LIKE '.%'").distinct()
    asked = asked.withColumn("import_id", F.concat_ws(SEP, "file_path", "module"))
    return resolve.first_existing(resolve.javascript_candidates(asked), files).join(asked, "import_id").select("file_path", "module", "resolved")


def script_exports(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """module, name, definer: what each script module exports, through named and star re-exports; definer is a key."""
    own = facts.filter(F.col("language").isin(*SCRIPTS))
    direct = own.filter("kind = 'direct'").select(F.col("file_path").alias("module"), "name", keyed(F.col("file_path"), "target").alias("definer"))
    there = own.join(modules.select("file_path", F.col("module").alias("target"), "resolved"), ["file_path", "target"])
    named = there.filter("kind = 'named'").select(F.col("file_path").alias("module"), "name", F.col("resolved").alias("target"), F.col("target_name"))
    star = there.filter("kind = 'star'").select(F.col("file_path").alias("module"), F.col("resolved").alias("target"))
    return graph.re_exports(direct, named, star)


def takes(language: Column, parameters: Column, arity: Column) -> Column:
    """Whether a callable takes so many arguments, by the rule of its language; languages without one take any."""
    variadic = F.exists(parameters, lambda p: p.contains("...") | p.startswith("params ") | p.startswith("vararg "))
    exact = ~variadic & (F.size(parameters) == arity)
    return F.coalesce(F.when(language == "cpp", E.accepts_arity(parameters, arity)).when(language.isin(*DOTTED), exact), F.lit(True))


def nearest(asked: DataFrame, targets: DataFrame) -> DataFrame:
    """asked: (ref_id, src, ordinal, key, kind, language, arity); targets: (key, dst, node_kind, parameters).  ref_id, src, fit:
    of the first path of a call that is declared, the declarations that take its arguments."""
    met = asked.join(targets.select("key", "dst", "node_kind", "parameters"), "key")
    met = met.filter(F.col("node_kind").isin(*CALLABLES) | (F.col("kind") == "new"))
    fits = ~F.col("node_kind").isin(*CALLABLES) | F.col("arity").isNull() | takes(F.col("language"), F.col("parameters"), F.col("arity"))
    level = met.groupBy("ref_id", "src", "ordinal").agg(F.array_sort(F.collect_set(F.when(fits, F.col("dst")))).alias("fit"))
    return level.groupBy("ref_id", "src").agg(F.min_by("fit", "ordinal").alias("fit"))


def edges(symbols: DataFrame, files: DataFrame, facts: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """src, dst of the calls of all languages that have scopes of their own, or of the calls of some callers; symbols carry
    ``calls`` and ``bases``.  Headers count as C and may be what C++ calls."""
    every = symbols.withColumn("language", E.language("file_path"))
    own = every.filter(F.col("language").isin(*LANGUAGES))
    have = {r[0] for r in own.select("language").distinct().collect()}
    if not have:
        return symbols.select(F.col("symbol_id").alias("src"), F.col("symbol_id").alias("dst")).limit(0)
    units = rust_units(files, facts) if "rust" in have else None
    # where a symbol can be found: its path, with its file, folder or module before it as the language asks
    space = F.when(F.col("language").isin(*SCRIPTS), F.col("file_path")).when(F.col("language") == "go", folder()).otherwise(F.col("family"))
    place = every.filter(F.col("language").isin("c", *LANGUAGES)).withColumn("key", keyed(space, "semantic_path")).filter("language <> 'go' OR file_path NOT LIKE '%_test.go'")
    if units is not None:
        place = place.join(units, "file_path", "left").withColumn("key", F.when(F.col("language") == "rust", keyed(F.col("root"), F.concat("unit", "semantic_path"))).otherwise(F.col("key")))
    targets = materialize(place.select("key", "language", "family", "file_path", F.col("symbol_id").alias("dst"), "node_kind", "parameters", "base_name", "scope_path", "semantic_path", "signature", "bases", "interfaces"), "call-targets")
    if callers is not None:
        own = own.join(callers.select("symbol_id"), "symbol_id", "left_semi")
    calls = own.select(F.col("symbol_id").alias("src"), "file_path", "language", "family", F.posexplode("calls").alias("nth", "c"), "start_byte").select("src", "file_path", "language", "family", "start_byte", "nth", "c.*")
    calls = materialize(calls.withColumn("ref_id", F.concat_ws(SEP, "src", "file_path", F.col("start_byte").cast("string"), F.col("nth").cast("string"))), "calls")
    asked = calls.select("ref_id", "src", "file_path", "language", "family", "arity", "kind", F.posexplode("paths").alias("ordinal", "path"))
    rest = lambda mark: F.substr("path", F.lit(len(mark) + 1))
    ways = [asked.filter("NOT startswith(path, '@')").withColumn("key", keyed(F.col("family"), "path")), asked.filter("startswith(path, '@file::')").withColumn("key", keyed(F.col("file_path"), rest("@file::")))]
    ways.append(asked.filter("startswith(path, '@dir::')").withColumn("key", keyed(folder(), rest("@dir::"))))
    if units is not None:
        modules = asked.filter("startswith(path, '@self::') OR startswith(path, '@crate::') OR startswith(path, '@super::')").join(units, "file_path")
        up = F.size(F.split(F.regexp_extract("path", r"^@((?:super::)*)", 1), "::")) - 1
        tail = F.regexp_replace("path", r"^@(?:self::|crate::|(?:super::)+)", "")
        parts = F.filter(F.split("unit", "::"), lambda x: x != "")
        base = F.when(F.col("path").startswith("@crate::"), "").when(up > F.size(parts), None).otherwise(F.array_join(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), lambda x: F.concat(x, F.lit("::"))), ""))
        ways.append(modules.withColumn("key", keyed(F.col("root"), F.concat(base, tail))).drop("root", "unit"))
    if "go" in have:
        split = asked.filter("startswith(path, '@go:')").withColumns({"imported": F.regexp_extract("path", r"^@go:(.*)\|", 1), "tail": F.regexp_extract("path", r"\|([^|]*)$", 1)})
        met = split.join(go_folders(files, facts), ["file_path", "imported"]).withColumn("key", keyed(F.col("folder"), F.concat("package", F.lit("."), "tail")))
        ways.append(met.select(*ways[0].columns))
    if have & set(SCRIPTS):
        modules = materialize(script_modules(files, facts), "script-modules")
        exports = script_exports(facts, modules)
        split = asked.filter("startswith(path, '@js:')").withColumns({"module": F.regexp_extract("path", r"^@js:(.*)\|", 1), "name": F.regexp_extract("path", r"\|([^|:]*)", 1), "tail": F.regexp_extract("path", r"\|[^|:]*(.*)$", 1)})
        met = split.join(modules, ["file_path", "module"]).drop("module").withColumnRenamed("resolved", "module").join(exports, ["module", "name"])
        ways.append(met.withColumn("key", F.concat("definer", "tail")).select(*ways[0].columns))
    found = ways[0]
    for w in ways[1:]:
        found = found.unionByName(w.select(*found.columns))
    best = materialize(nearest(found, targets), "call-scopes")
    out = best.filter("size(fit) = 1").select("src", F.get("fit", F.lit(0)).alias("dst"))
    if "cpp" in have:
        out = out.unionByName(_qualified(best.filter("size(fit) > 1"), calls, targets))
    lost = calls.join(best, "ref_id", "left_anti")
    climbed = materialize(_inherited(lost, targets), "inherited")
    out = out.unionByName(climbed.select("src", "dst"))
    if "java" in have:
        out = out.unionByName(_defaults(lost.join(climbed, "ref_id", "left_anti"), targets))
    if "csharp" in have:
        out = out.unionByName(_open_to_all(lost, targets, facts))
    return out.filter("src <> dst").distinct()


def _qualified(many: DataFrame, calls: DataFrame, targets: DataFrame) -> DataFrame:
    """C++ members that differ in what stands behind their parameters.  Of a member's own scope, or for a receiver, those that are
    const like the caller (a receiver that isn't known to be const asks for the others) come first, then those for an
    lvalue."""
    tail = F.regexp_extract("signature", r"\)([^)]*)$", 1)
    ways = targets.filter("language = 'cpp'").select("dst", F.coalesce(tail.rlike(r"^\s*(?:volatile\s+)?const\b"), F.lit(False)).alias("const"), F.coalesce(tail.rlike(r"^\s*(?:(?:const|volatile)\b\s*)*&(?!&)"), F.lit(False)).alias("lvalue"), "scope_path")
    ways = ways.groupBy("dst").agg(F.max("const").alias("const"), F.max("lvalue").alias("lvalue"), F.max("scope_path").alias("scope"))
    asked = calls.filter("language = 'cpp'").select("ref_id", "kind").join(many, "ref_id").select("ref_id", "src", "kind", F.explode("fit").alias("dst"))
    met = asked.join(ways, "dst").join(ways.select(F.col("dst").alias("src"), F.col("const").alias("from_const"), F.col("scope").alias("from_scope")), "src")
    own = (F.col("kind") == "value") | F.col("scope").eqNullSafe(F.col("from_scope"))
    good = own & (F.col("const") == ((F.col("kind") != "value") & F.col("from_const")))
    row = F.struct("dst", good.alias("good"), (own & F.col("lvalue")).alias("lvalue"))
    first = lambda rows, name: F.when(F.exists(rows, lambda r: r[name]), F.filter(rows, lambda r: r[name])).otherwise(rows)
    left = met.groupBy("ref_id", "src").agg(F.collect_set(row).alias("rows")).withColumn("rows", first(F.col("rows"), "good")).withColumn("rows", first(F.col("rows"), "lvalue"))
    return left.filter("size(rows) = 1").select("src", F.col("rows")[0]["dst"].alias("dst"))


def _defaults(lost: DataFrame, targets: DataFrame) -> DataFrame:
    """Java calls inside a type that no class answers: the one default method of all its interfaces, if no other one of them
    declares the name."""
    types = targets.filter("language = 'java'").filter(F.col("node_kind").isin("class_declaration", "interface_declaration", "enum_declaration"))
    if types.filter("size(interfaces) > 0").isEmpty():
        return targets.select(F.col("dst").alias("src"), "dst").limit(0)
    asked = types.select(F.col("key").alias("node"), "family", F.posexplode("interfaces").alias("b", "paths")).select("node", "family", "b", F.posexplode("paths").alias("ordinal", "path"))
    met = asked.withColumn("key", keyed(F.col("family"), "path")).join(types.select("key"), "key").filter("node <> key")
    links = met.groupBy("node", "b").agg(F.min_by("key", "ordinal").alias("dst")).select(F.col("node").alias("src"), "dst")
    inside = lost.filter("language = 'java' AND kind IN ('bare', 'this') AND within <> ''").select("ref_id", "src", "arity", keyed(F.col("family"), "within").alias("node"), E.base_name("name").alias("name"))
    above = graph.closure(inside.select(F.col("node").alias("root"), "node").distinct(), links)
    methods = targets.filter("language = 'java' AND node_kind = 'method_declaration'").select(keyed(F.col("family"), "scope_path").alias("owner"), F.col("base_name").alias("name"), "dst", "parameters", F.col("signature").rlike(r"(^|\s)default\s").alias("has_body"))
    found = inside.join(above.filter("root <> node").select("root", F.col("node").alias("owner")), F.col("node") == F.col("root")).join(methods, ["owner", "name"])
    fits = F.col("has_body") & takes(F.lit("java"), F.col("parameters"), F.col("arity"))
    return found.groupBy("ref_id", "src").agg(F.count_distinct("owner").alias("owners"), F.collect_set(F.when(fits, F.col("dst"))).alias("fit")).filter("owners = 1 AND size(fit) = 1").select("src", F.get("fit", F.lit(0)).alias("dst"))


def _inherited(lost: DataFrame, targets: DataFrame) -> DataFrame:
    """ref_id, src, dst: calls on a type, or inside one, up the unique chain of base classes to the first that declares the name."""
    kinds = ("class_declaration", "class_specifier", "struct_specifier", "interface_declaration", "struct_declaration", "object_declaration")
    types = targets.filter(F.col("node_kind").isin(*kinds))
    based = types.filter("size(bases) > 0")
    if based.isEmpty():
        return targets.select(F.lit("").alias("ref_id"), F.col("dst").alias("src"), "dst").limit(0)
    names = types.select("key", F.col("key").alias("parent"))
    asked = based.select(F.col("key").alias("node"), "family", "file_path", F.posexplode("bases").alias("b", "paths")).select("node", "family", "file_path", "b", F.posexplode("paths").alias("ordinal", "path"))
    full = F.when(F.col("path").startswith("@file::"), keyed(F.col("file_path"), F.regexp_replace("path", "^@file::", ""))).otherwise(keyed(F.col("family"), "path"))
    met = asked.withColumn("key", full).join(names, "key").filter("node <> parent")
    parents = met.groupBy("node", "b").agg(F.min_by("parent", "ordinal").alias("parent")).select("node", "parent")
    space = F.when(F.col("language").isin(*SCRIPTS), F.col("file_path")).otherwise(F.col("family"))
    methods = targets.filter(F.col("node_kind").isin(*CALLABLES) & F.col("scope_path").isNotNull()).withColumn("node", keyed(space, "scope_path"))
    name = E.base_name("name")
    inside = lost.filter("kind IN ('bare', 'this') AND within <> '' AND (kind = 'this' OR NOT contains(name, '.'))").select("ref_id", "src", "arity", "language", keyed(space, "within").alias("node"), name.alias("name"))
    above = lost.filter("kind = 'super' AND within <> ''").select("ref_id", "src", "arity", "language", keyed(space, "within").alias("below"), name.alias("name"))
    # super(...) and base(...) mean the constructor of the parent, which has its name
    called = F.when(F.col("name").isin("super", "base"), F.regexp_extract("parent", rf"([^:{SEP}]*)$", 1)).otherwise(F.col("name"))
    above = above.join(graph.unique_parents(parents), F.col("below") == F.col("node")).select("ref_id", "src", "arity", "language", F.col("parent").alias("node"), called.alias("name"))
    on = lost.filter("kind IN ('value', 'path')").select("ref_id", "src", "arity", "language", "family", "file_path", name.alias("name"), F.posexplode("paths").alias("ordinal", "path"))
    on = on.withColumn("type", F.regexp_extract("path", r"^(.*)::[^:]*$", 1)).filter("type <> '' AND NOT startswith(type, '@js')")
    on = on.withColumn("key", F.when(F.col("type").startswith("@file::"), keyed(F.col("file_path"), F.regexp_replace("type", "^@file::", ""))).otherwise(keyed(F.col("family"), "type"))).join(types.select("key"), "key")
    on = on.groupBy("ref_id", "src", "arity", "language", "name").agg(F.min_by("key", "ordinal").alias("node")).select("ref_id", "src", "arity", "language", "node", "name")
    open_ = materialize(inside.unionByName(above).unionByName(on), "inherited-calls")
    if open_.isEmpty():
        return targets.select(F.lit("").alias("ref_id"), F.col("dst").alias("src"), "dst").limit(0)
    at = graph.inherited(open_.withColumnRenamed("ref_id", "call_id"), parents, methods.select("node", F.col("base_name").alias("name"), F.col("node").alias("symbol_id")))
    met = open_.drop("node").join(at.select(F.col("call_id").alias("ref_id"), F.col("symbol_id").alias("node")), "ref_id").join(methods.select("node", F.col("base_name").alias("name"), "dst", "parameters"), ["node", "name"])
    fit = met.filter(F.col("arity").isNull() | takes(F.col("language"), F.col("parameters"), F.col("arity")))
    return fit.groupBy("ref_id", "src").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("ref_id", "src", "dst")


def _open_to_all(lost: DataFrame, targets: DataFrame, facts: DataFrame) -> DataFrame:
    """C# names that any file opens to all of them: methods of types, and types of namespaces."""
    own = targets.filter("language = 'csharp'").filter(F.col("node_kind").isin(*CALLABLES))
    statics, spaces = (facts.filter(F.col("kind") == k).select(F.col("target").alias("open")).distinct() for k in ("global_static", "global_open"))
    bare = own.withColumn("open", F.col("scope_path")).join(statics, "open", "left_semi").select(F.col("base_name").alias("spelled"), "dst", "parameters")
    typed = own.withColumn("open", F.regexp_extract("scope_path", r"^(.*)::[^:]*$", 1)).join(spaces, "open", "left_semi")
    typed = typed.select(F.concat(E.base_name("scope_path"), F.lit("."), "base_name").alias("spelled"), "dst", "parameters")
    asked = lost.filter("language = 'csharp' AND kind IN ('bare', 'path')").select("ref_id", "src", "language", "arity", F.col("name").alias("spelled"))
    met = asked.join(bare.unionByName(typed).distinct(), "spelled").filter(F.col("arity").isNull() | takes(F.col("language"), F.col("parameters"), F.col("arity")))
    return met.groupBy("ref_id", "src").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("src", "dst")
