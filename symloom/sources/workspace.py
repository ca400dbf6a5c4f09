"""A workspace of source files as DataFrames: scan, extraction, ids and edges."""

from __future__ import annotations

import os
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.operators import graph, identity, index, resolve, scoped
from symloom.schema import DEFAULT_FILES, FILES, MAX_FILE_BYTES, MAX_FILES, MAX_TIMEOUT_MS, RAW_SYMBOLS, RequestError, within
from symloom.sources.scratch import materialize

FAMILY = {"typescript": "javascript", "tsx": "javascript", "cpp": "c"}


def scan(spark: SparkSession, root: str, max_files: int = DEFAULT_FILES, max_file_bytes: int = MAX_FILE_BYTES, timeout_ms: int | None = None) -> DataFrame:
    """Files of known languages below root, and go.mod files; skipped folders, folders that are links, and files that lead out of
    root are left out.  Too many or too large ones are an error, never cut short, and so is a scan that takes too long; texts
    that aren't UTF-8, or grew too large since, are an error when they are read."""
    within("max_files", max_files, 1, MAX_FILES)
    if timeout_ms is not None:
        within("timeout_ms", timeout_ms, 1, MAX_TIMEOUT_MS)
    began = time.monotonic()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].rstrip("/") if "://" in root else root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace("path", r"^file:/*", "/")
    rows = raw.select(path.alias("file_path"), "length", "content").withColumn("language", E.language("file_path"))
    rows = rows.filter((F.col("language").isNotNull() | F.col("file_path").endswith("/go.mod")) & ~E.in_skipped_directory(F.substr("file_path", F.lit(len(base) + 2))))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).first()
    if seen["n"] > max_files:
        raise RequestError(f"over {max_files} files")
    if (seen["most"] or 0) > max_file_bytes:
        raise RequestError(f"a file of over {max_file_bytes} bytes")
    if os.path.isdir(base):  # links can only be told on a local disk
        top = os.path.realpath(base)
        out = [r[0] for r in rows.select("file_path").collect() if not _at_home(r[0], base, top)]  # max_files at most
        if out:
            rows = rows.filter(~F.col("file_path").isin(out))
    if timeout_ms is not None and (time.monotonic() - began) * 1000 > timeout_ms:
        raise RequestError(f"the scan took over {timeout_ms} ms")
    text = F.when(F.octet_length("content") > max_file_bytes, F.raise_error(F.concat(F.lit("too large: "), "file_path")))
    text = text.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "file_path")))
    return rows.select("file_path", "language", text.alias("source"), F.col("length").alias("size_bytes"))


def _at_home(path: str, base: str, top: str) -> bool:
    """No folder between root and the file is a link, and the file itself stays below root."""
    folder = os.path.dirname(path)
    while len(folder) > len(base):
        if os.path.islink(folder):
            return False
        folder = os.path.dirname(folder)
    return os.path.realpath(path).startswith(top + os.sep)


def from_rows(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    rows = [(p, None, s, len(s.encode())) for p, s in files.items()]
    return spark.createDataFrame(rows, FILES).withColumn("language", E.language("file_path"))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.md5("source").alias("fingerprint"))


def _extract(frames):
    from symloom.extract import lexical, python_ast

    names = RAW_SYMBOLS.names
    for frame in frames:
        rows = []
        for path, lang, source in zip(frame["file_path"], frame["language"], frame["source"], strict=True):
            found = python_ast.declarations(source) if lang == "python" else lexical.declarations(source, lang)
            for r in found:
                r |= {"calls": r.get("calls", []), "bases": r.get("bases", []), "interfaces": r.get("interfaces", []), "file_path": path, "symbol_id": r["semantic_path"], "extension_receiver": None, "reference_facts": [{"spelling": n, "call_arities": r["reference_call_arities"].get(n, []), "details": {}} for n in r["reference_names"]]}
                rows.append([r[n] for n in names])
        yield pd.DataFrame(rows, columns=names)


def raw_symbols(files: DataFrame) -> DataFrame:
    known = files.filter(F.col("language").isNotNull()).select("file_path", "language", "source")
    out = known.mapInPandas(_extract, RAW_SYMBOLS)
    family = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    lang = E.language("file_path")
    return out.withColumns({"language": lang, "family": F.coalesce(F.try_element_at(family, lang), lang), "base_name": E.base_name("semantic_path")})


def symbols(files: DataFrame) -> DataFrame:
    return identity.assigned(raw_symbols(files))


FACTS = "file_path string, language string, kind string, name string, target string, target_name string"


def facts(files: DataFrame) -> DataFrame:
    """What each file says about other files: imports as written, and for some languages packages, exports and namespaces."""

    def run(frames):
        from symloom.extract import lexical, python_ast

        for frame in frames:
            rows = []
            for path, lang, source in zip(frame["file_path"], frame["language"], frame["source"], strict=True):
                found = [("import", "", m, "") for m in (python_ast.imported_modules(source) if lang == "python" else lexical.imported_modules(source, lang))]
                rows += [(path, lang, *f) for f in found + (lexical.facts(source, lang) if lang != "python" else [])]
            yield pd.DataFrame(rows, columns=["file_path", "language", "kind", "name", "target", "target_name"])

    return files.filter("language IS NOT NULL").select("file_path", "language", "source").mapInPandas(run, FACTS)


def imports(files: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """importer, imported: local files that each file imports, resolved by the rules of its language.  Names of packages lead to
    every file of the package."""
    said = facts(files) if said is None else said
    found = said.filter("kind = 'import'").select("file_path", "language", F.col("target").alias("module")).distinct()
    found = found.withColumn("import_id", F.concat_ws("\0", "file_path", "module"))
    python = resolve.python_candidates(found.filter("language = 'python'"))
    script = resolve.javascript_candidates(found.filter("language IN ('javascript', 'typescript', 'tsx')"))
    folder = scoped.folder()
    include = found.filter("language IN ('c', 'cpp')").select("import_id", E.normalized_path(F.concat(folder, F.lit("/"), "module")).alias("candidate"), F.lit(0).alias("ordinal"))
    stem = F.regexp_extract("file_path", r"([^/]*)\.rs$", 1)
    base = F.when(stem.isin("main", "lib", "mod"), folder).otherwise(F.concat(folder, F.lit("/"), stem))
    rust = found.filter("language = 'rust'").select("import_id", F.posexplode(F.array(F.concat(base, F.lit("/"), "module", F.lit(".rs")), F.concat(base, F.lit("/"), "module", F.lit("/mod.rs")))).alias("ordinal", "candidate")).select("import_id", "candidate", "ordinal")
    all_ = python.unionByName(script).unionByName(include).unionByName(rust)
    got = resolve.first_existing(all_, files).join(found, "import_id").select(F.col("file_path").alias("importer"), F.col("resolved").alias("imported"))
    # a name of a package, or a type or member below it, leads to the package's files
    packages = said.filter("kind = 'package' AND language <> 'go'").select(F.col("target").alias("package"), F.col("file_path").alias("imported"), F.col("language").alias("in_language")).distinct()
    named = found.filter("language IN ('java', 'kotlin', 'csharp')")
    parts = F.split("module", r"\.")
    above = named.withColumn("package", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    met = above.join(packages, "package").filter("language = in_language AND file_path <> imported")
    # the type's own file, where a file of the package is named after it
    own = F.expr("contains(concat('.', module, '.'), concat('.', regexp_extract(imported, '([^/]*)[.][^./]*$', 1), '.'))")
    met = met.withColumn("own", own.cast("int"))
    top = met.groupBy("import_id").agg(F.max("own").alias("top"))
    dotted = met.join(top, "import_id").filter("own = top").select(F.col("file_path").alias("importer"), "imported")
    go = scoped.go_folders(files, said).join(files.filter("language = 'go' AND file_path NOT LIKE '%_test.go'").select(F.col("file_path").alias("imported_file"), folder.alias("folder")), "folder")
    go = go.select(F.col("file_path").alias("importer"), F.col("imported_file").alias("imported"))
    return got.unionByName(dotted).unionByName(go).distinct()


def included(met: DataFrame) -> DataFrame:
    """importer, imported for C and C++: everything that a file includes, directly or not."""
    c = met.filter(E.language("importer").isin("c", "cpp"))
    starts = c.select(F.col("importer").alias("root"), F.col("imported").alias("node")).distinct()
    if starts.isEmpty():
        return c
    all_ = graph.closure(starts, c.select(F.col("importer").alias("src"), F.col("imported").alias("dst"))).select(F.col("root").alias("importer"), F.col("node").alias("imported"))
    return all_.filter("importer <> imported")


def companions(all_: DataFrame, files: DataFrame) -> DataFrame:
    """importer, imported: the C and C++ sources that have the folder and name of a header that the importer includes."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    sources = files.filter(F.col("language").isin("c", "cpp") & ~E.extension("file_path").isin(*E.HEADER_EXTENSIONS)).select(F.col("file_path").alias("source_file"), stem("file_path").alias("stem"))
    headers = all_.filter(E.extension("imported").isin(*E.HEADER_EXTENSIONS)).select("importer", stem("imported").alias("stem"))
    return headers.join(sources, "stem").filter("importer <> source_file").select("importer", F.col("source_file").alias("imported")).distinct()


def touched(old: dict[str, DataFrame], symbols_: DataFrame, said: DataFrame, files: DataFrame, file_path: str) -> DataFrame:
    """symbol_id of the callers whose edges a change of one file can touch: the file's own and those of the files that import it,
    directly or not; who refers to a name that the file declared or declares, or whose id the change moved; and for a language
    with scopes everyone of its family, as packages, base classes and exports reach beyond names."""
    own = E.language("file_path").isin("python", "c")
    before, after = (t.filter(F.col("file_path") == file_path).select("base_name", "family") for t in (old["symbols"], symbols_))
    moved = identity.drifted(old["symbols"], symbols_)
    renamed = moved.select(F.explode(F.array("old_id", "new_id")).alias("id")).select(E.base_name(F.regexp_replace("id", r"(#.*|\(.*)$", "")).alias("base_name"))
    names = before.select("base_name").unionByName(after.select("base_name")).unionByName(renamed).distinct()
    met = imports(files, said)
    start = files.sparkSession.createDataFrame([(file_path, file_path)], "root string, node string")
    near = graph.closure(start, met.select(F.col("imported").alias("src"), F.col("importer").alias("dst"))).select(F.col("node").alias("file_path"))
    asked = symbols_.filter(own).select("symbol_id", F.explode("reference_names").alias("name")).withColumn("base_name", E.reference_base("name"))
    out = symbols_.join(near, "file_path", "left_semi").select("symbol_id").unionByName(asked.join(names, "base_name", "left_semi").select("symbol_id"))
    out = out.unionByName(moved.select(F.col("new_id").alias("symbol_id"))).unionByName(moved.select(F.col("old_id").alias("symbol_id")))
    families = before.select("family").unionByName(after.select("family")).distinct()
    return out.unionByName(symbols_.filter(~own).join(families, "family", "left_semi").select("symbol_id")).distinct()


def edges(files: DataFrame, symbols_: DataFrame, said: DataFrame | None = None, callers: DataFrame | None = None) -> DataFrame:
    """Callers to callees.  A Python ``module.name`` must lie in the module's file, and C names are ranked by file and
    includes; both fall back on the base name.  The other languages go by the scopes of each call.  No edge where the best
    isn't one symbol.  callers: only the references of these symbols are resolved."""
    files = materialize(files.select("file_path", "language", "source"), "files")
    symbols_ = materialize(symbols_, "symbols")
    said = materialize(facts(files), "facts") if said is None else said
    only = (lambda t, c: t) if callers is None else (lambda t, c: t.join(callers.select(F.col("symbol_id").alias(c)), c, "left_semi"))
    met = materialize(imports(files, said), "imports")
    refs = symbols_.filter(E.language("file_path").isin("python", "c")).select(F.col("symbol_id").alias("src"), F.col("file_path").alias("src_file"), "family", F.explode("reference_names").alias("name"))
    refs = only(refs, "src")
    dotted = refs.filter("family = 'python' AND name LIKE '%.%'")
    module = F.regexp_extract("name", r"^(.*)\.[^.]+$", 1)
    module = F.when(F.col("name").rlike(r"^\.+[^.]+$"), F.regexp_extract("name", r"^(\.+)", 1)).otherwise(module)
    asked = dotted.select(F.concat_ws("\0", "src_file", "name").alias("import_id"), F.col("src_file").alias("file_path"), module.alias("module")).distinct()
    at = resolve.first_existing(resolve.python_candidates(asked), files)
    hinted = dotted.withColumn("import_id", F.concat_ws("\0", "src_file", "name")).join(at, "import_id")
    target = symbols_.filter("family = 'python'").select(F.col("symbol_id").alias("dst"), F.col("file_path").alias("resolved"), F.col("semantic_path").alias("top"))
    exact = hinted.withColumn("top", E.base_name("name")).join(target, ["resolved", "top"]).filter("src <> dst")
    one = exact.groupBy("src", "name").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("src", "dst")
    types = symbols_.filter("family = 'python'").select(F.col("symbol_id").alias("dst"), F.col("semantic_path").alias("name"))
    attrs = dotted.join(hinted.select("src", "name"), ["src", "name"], "left_anti").join(types, "name").filter("src <> dst")
    typed = attrs.groupBy("src", "name").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("src", "dst")
    plain = refs.join(dotted.select("src", "name"), ["src", "name"], "left_anti")
    near = materialize(included(met), "included")
    seen = [companions(near, files), met.filter(~E.language("importer").isin("c", "cpp")).unionByName(near)]
    known = symbols_.filter(E.language("file_path").isin("python", "c")).withColumn("file_local", (E.language("file_path") == "c") & F.coalesce(F.col("signature").startswith("static "), F.lit(False)))
    scopes = scoped.edges(symbols_, files, said, callers)
    return resolve.edges(plain, known, seen).unionByName(one).unionByName(typed).unionByName(scopes).distinct()


def refreshed(old_symbols: DataFrame, old_state: DataFrame, files: DataFrame) -> DataFrame:
    """Raw rows of all files: reused where the fingerprint is the old one, extracted anew for the rest.  Ids and edges
    are always assigned over the whole, since a new path elsewhere can rename a symbol."""
    again = index.reuse(files.select("file_path", F.md5("source").alias("fingerprint")), old_state)
    keep = old_symbols.join(again.filter("reused").select("file_path"), "file_path", "left_semi")
    fresh = raw_symbols(files.join(again.filter("NOT reused").select("file_path"), "file_path", "left_semi"))
    return keep.select(*fresh.columns).unionByName(fresh)
