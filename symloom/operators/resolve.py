"""Reference resolution as joins: candidates by name or path, ranks, and no edge where the best isn't one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.operators.skew import salted_join
from symloom.sources.scratch import materialize


def by_path(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exact path first; a template's base path only for those that found none."""
    target = symbols.select(F.col("symbol_id").alias("dst"), F.col("semantic_path").alias("path"))
    exact = references.join(target, F.col("name") == F.col("path"))
    rest = references.join(exact.select("ref_id").distinct(), "ref_id", "left_anti")
    base = rest.withColumn("base", E.template_base("name")).join(target, F.col("base") == F.col("path")).drop("base")
    return exact.withColumn("step", F.lit("exact")).unionByName(base.withColumn("step", F.lit("template")))


def visible_before(candidates: DataFrame, includes: DataFrame) -> DataFrame:
    """Declared earlier in the same file, or in a file that the caller's file includes.  includes: (root, node), a closure."""
    seen = includes.select(F.col("root").alias("src_file"), F.col("node").alias("dst_file")).distinct().withColumn("included", F.lit(True))
    met = candidates.join(seen, ["src_file", "dst_file"], "left").withColumn("included", F.coalesce("included", F.lit(False)))
    return met.filter(((F.col("src_file") == F.col("dst_file")) & (F.col("start_byte") < F.col("at_byte"))) | F.col("included"))


def _levels(declared: DataFrame, keys: list[str]) -> DataFrame:
    """declared: (*keys, rank, dst), distinct.  One row per key: levels, from the best kind rank down, with the number of
    symbols, the least and the greatest; they are enough to tell whether one alone is left without a given symbol."""
    stats = declared.groupBy(*keys, "rank").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    level = F.struct((-F.col("rank")).alias("order"), "n", "lo", "hi")
    return stats.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("levels"))


def _answer(levels: Column, src: Column) -> Column:
    """(found, dst) of the best level that has a symbol besides src; dst is null where it has several."""
    besides = lambda v: v["n"] - F.when((v["lo"] == src) | (v["hi"] == src), 1).otherwise(0)
    best = F.get(F.filter(levels, lambda v: besides(v) > 0), F.lit(0))
    alone = F.when(besides(best) == 1, F.when(best["lo"] == src, best["hi"]).otherwise(best["lo"]))
    return F.struct(best.isNotNull().alias("found"), alone.alias("dst"))


def edges(references: DataFrame, symbols: DataFrame, imports: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """The generic rule: a reference (src, src_file, family, name) goes to the symbol with the best kind rank in its own file,
    else in the files that it imports, else anywhere; where several share that place there is no edge.  imports: (importer,
    imported), or several such tables, the nearer files first.

    References never meet the declarations of a name one by one: these are aggregated to a row per name first, by file and
    over all files, so a name that is declared and used everywhere costs one row there and no product.  Symbols whose
    ``file_local`` is true, if there is such a column, are known in their own file only."""
    local = F.col("file_local") if "file_local" in symbols.columns else F.lit(False)
    declared = symbols.select(F.col("family"), F.col("base_name").alias("base"), F.col("file_path").alias("file"), E.kind_rank("node_kind").alias("rank"), F.col("symbol_id").alias("dst"), local.alias("local")).distinct()
    asked = references.select("src", "src_file", "family", "name", E.reference_base("name").alias("base")).distinct()
    here = _levels(declared.drop("local"), ["family", "base", "file"]).withColumnRenamed("file", "src_file")
    met = asked.join(here, ["family", "base", "src_file"], "left")
    met = materialize(met.withColumn("a", _answer(F.col("levels"), F.col("src"))).drop("levels"), "own-file")
    own = met.filter("a.found").select("src", F.col("a.dst").alias("dst"))
    rest = met.filter("NOT a.found").drop("a")
    found, declared = own, declared.filter("NOT local").drop("local")
    for table in [] if imports is None else imports if isinstance(imports, list) else [imports]:
        seen = table.select(F.col("importer").alias("src_file"), F.col("imported").alias("file")).filter("src_file <> file").distinct()
        near = rest.join(seen, "src_file").join(declared, ["family", "base", "file"]).filter("src <> dst")
        near = near.select("src", "name", "rank", "dst").distinct()
        near = near.groupBy("src", "name", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
        near = near.groupBy("src", "name").agg(F.max_by(F.struct("n", "dst"), "rank").alias("best"))
        near = materialize(near.select("src", "name", F.when(F.col("best.n") == 1, F.col("best.dst")).alias("dst")), "imported")
        found = found.unionByName(near.select("src", "dst"))
        rest = rest.join(near.select("src", "name"), ["src", "name"], "left_anti")
    everywhere = _levels(declared.drop("file").distinct(), ["family", "base"])
    used = rest.groupBy("family", "base").agg(F.count(F.lit(1)).alias("uses"))
    facts = materialize(everywhere.join(used, ["family", "base"]), "names")
    last = salted_join(rest, facts, ["family", "base"], "uses", F.xxhash64("src"))
    last = last.withColumn("a", _answer(F.col("levels"), F.col("src"))).filter("a.found").select("src", F.col("a.dst").alias("dst"))
    return found.unionByName(last).filter("dst IS NOT NULL").distinct()


def unique_imports(imports: DataFrame) -> DataFrame:
    """imports: (file_path, local_name, target).  A local name bound twice in a file is ambiguous and goes."""
    w = Window.partitionBy("file_path", "local_name")
    return imports.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n = 1").drop("_n")


def package_names(files: DataFrame) -> DataFrame:
    """files: (directory, package).  The package of a directory, where all its files agree."""
    return files.groupBy("directory").agg(F.count_distinct("package").alias("n"), F.min("package").alias("package")).filter("n = 1").drop("n")


def by_arity(calls: DataFrame, callables: DataFrame) -> DataFrame:
    """calls: (call_id, name, n); callables: (symbol_id, base_name, parameters).  Those that take n arguments, if one alone does.
    Callables of a name are counted by how many arguments they take before calls meet them."""
    offers = callables.select("symbol_id", F.col("base_name").alias("name"), E.arity_range("parameters").alias("r")).distinct()
    offers = offers.groupBy("name", F.col("r.least").alias("least"), F.col("r.most").alias("most")).agg(F.count_distinct("symbol_id").alias("k"), F.min("symbol_id").alias("symbol_id"))
    met = calls.join(offers, "name").filter((F.col("n") >= F.col("least")) & (F.col("most").isNull() | (F.col("n") <= F.col("most"))))
    one = met.groupBy("call_id").agg(F.sum("k").alias("k"), F.min("symbol_id").alias("symbol_id"))
    return one.filter("k = 1").drop("k")


def lexical(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references: (ref_id, scope, name).  The innermost enclosing scope in which scope::name exists wins."""
    parts = F.split("scope", "::")
    scopes = references.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts))))
    prefix = F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "::")
    scopes = scopes.withColumn("path", F.when(F.col("depth") == 0, F.col("name")).otherwise(F.concat(prefix, F.lit("::"), F.col("name"))))
    met = scopes.join(symbols.select(F.col("semantic_path").alias("path"), "symbol_id"), "path")
    w = Window.partitionBy("ref_id")
    best = met.withColumn("_top", F.max("depth").over(w)).filter("depth = _top")
    one = best.groupBy("ref_id").agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    return one.withColumn("symbol_id", F.when(F.col("n") == 1, F.col("symbol_id")))


def header_family(callers: DataFrame, headers: DataFrame) -> DataFrame:
    """callers: (file_path), headers: (header, included_by, position).  Same stem 1000, included 500; above zero, the
    last of equals by position."""
    met = callers.join(headers.withColumnRenamed("included_by", "file_path"), "file_path", "left").filter("header IS NOT NULL")
    rank = F.when(E.stem("header") == E.stem("file_path"), 1000).otherwise(0) + F.when(F.col("included"), 500).otherwise(0)
    w = Window.partitionBy("file_path").orderBy(F.desc("rank"), F.desc("position"))
    return met.withColumn("rank", rank).filter("rank > 0").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("file_path", "header", "rank")


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates: (import_id, candidate, ordinal).  The first candidate path that is a file."""
    met = candidates.join(files.select(F.col("file_path").alias("candidate")), "candidate", "left_semi")
    return met.groupBy("import_id").agg(F.min_by("candidate", "ordinal").alias("resolved"))


def python_candidates(imports: DataFrame) -> DataFrame:
    """imports: (import_id, file_path, module).  Leading dots climb from the importing file; absolute names look in
    every directory above it, nearest first; module.py, module.pyi, then the package."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    name = F.replace(F.regexp_extract("module", r"^\.*(.*)$", 1), F.lit("."), F.lit("/"))
    folders = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    ups = F.when(dots > 0, F.array(dots - 1)).otherwise(F.sequence(F.lit(0), F.size("folders") - 1))
    rows = imports.withColumns({"folders": folders, "name": name}).withColumn("up", F.explode(ups))
    base = F.array_join(F.slice("folders", F.lit(1), F.greatest(F.size("folders") - F.col("up"), F.lit(0))), "/")
    rows = rows.withColumn("base", F.when(F.col("name") == "", base).otherwise(F.concat(base, F.lit("/"), "name")))
    ends = F.array(*[F.lit(e) for e in (".py", ".pyi", "/__init__.py", "/__init__.pyi")])
    rows = rows.select("import_id", "base", "up", F.posexplode(ends).alias("e", "end"))
    return rows.select("import_id", F.concat("base", "end").alias("candidate"), (F.col("up") * 4 + F.col("e")).alias("ordinal"))


# Extensions that a module name without one may stand for, in order.
SCRIPT_EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx")


def javascript_candidates(imports: DataFrame) -> DataFrame:
    """imports: (import_id, file_path, module).  Relative names only.  A name with an extension is that file; any other one is
    tried with each extension, then as a folder with an index file of each."""
    rows = imports.filter("module IN ('.', '..') OR module LIKE './%' OR module LIKE '../%'")
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    base = E.normalized_path(F.concat(folder, F.lit("/"), F.col("module")))
    named = F.regexp_extract(base, r"([^/]*)$", 1).rlike(r"^.+\.[^.]*$")
    ends = F.when(named, F.array(F.lit(""))).otherwise(F.array(*[F.lit(f"{at}.{e}") for at in ("", "/index") for e in SCRIPT_EXTENSIONS]))
    return rows.select("import_id", base.alias("base"), F.posexplode(ends).alias("ordinal", "end")).select("import_id", F.concat("base", "end").alias("candidate"), "ordinal")
