"""Symbol ids: unique within a language family, stable under reordering of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.operators.skew import salted_join
from symloom.sources.scratch import materialize

# Kinds that count as callables in the families with overloads.
CALLABLES = ("method_declaration", "constructor_declaration", "function_declaration")
CPP_CALLABLES = ("function_definition", "declaration", "field_declaration")
ORDER = ("file_path", "start_byte", "end_byte")


def _repeated(symbols: DataFrame) -> DataFrame:
    """_all: rows with the path in the family; _here: with the path in the file.  Both are counted before they meet the rows, and
    the rows meet their counts by file and path, so a path that every file declares has no task of its own."""
    here = symbols.groupBy("family", "semantic_path", "file_path").agg(F.count(F.lit(1)).alias("_here"))
    every = here.groupBy("family", "semantic_path").agg(F.sum("_here").alias("_all"), F.count(F.lit(1)).alias("_files"))
    facts = materialize(every.filter("_all > 1"), "repeated-paths")
    known = salted_join(here, facts, ["family", "semantic_path"], "_files", F.xxhash64("file_path")).drop("_files")
    counts = ["family", "semantic_path", "file_path"]
    met = symbols.join(known, counts, "left")
    return met.withColumns({"_all": F.coalesce("_all", F.lit(1).cast("long")), "_here": F.coalesce("_here", F.lit(1).cast("long"))})


def _single(symbols) -> F.Column:
    """A path that is alone is the id; alone in its file but not in the family, the file goes before it."""
    filed = F.concat("file_path", F.lit("::"), "semantic_path")
    return F.when(F.col("_all") == 1, F.col("semantic_path")).when(F.col("_here") == 1, filed)


def python_ids(symbols: DataFrame) -> DataFrame:
    """Groups of one path in a file: overloads and implementations are numbered apart; a sole implementation after
    overloads has no number."""
    group = Window.partitionBy("family", "file_path", "semantic_path")
    same = Window.partitionBy("family", "file_path", "semantic_path", "is_overload")
    nth = F.row_number().over(same.orderBy("start_byte", "end_byte"))
    n, some = F.count(F.lit(1)).over(same), F.max("is_overload").over(group)
    filed = F.concat("file_path", F.lit("::"), "semantic_path")
    word = F.when(F.col("is_overload"), "overload").when(some, "implementation").otherwise("definition")
    number = F.when(~F.col("is_overload") & some & (n == 1), "").otherwise(F.concat(F.lit("["), nth.cast("string"), F.lit("]")))
    out = _repeated(symbols).withColumn("symbol_id", F.coalesce(_single(symbols), F.concat(filed, F.lit("#"), word, number)))
    return out.drop("_all", "_here")


def numbered_ids(symbols: DataFrame, overloads: bool) -> DataFrame:
    """#definition[n] in a file's group; with overloads, #overload[n] if all of the group are callables."""
    group = Window.partitionBy("family", "file_path", "semantic_path")
    nth = F.row_number().over(group.orderBy("start_byte", "end_byte"))
    callables = F.min(F.col("node_kind").isin(*CALLABLES)).over(group) if overloads else F.lit(False)
    filed = F.concat("file_path", F.lit("::"), "semantic_path")
    tag = F.concat(F.lit("#"), F.when(callables, "overload").otherwise("definition"), F.lit("["), nth.cast("string"), F.lit("]"))
    return _repeated(symbols).withColumn("symbol_id", F.coalesce(_single(symbols), F.concat(filed, tag))).drop("_all", "_here")


def parameter_type(parameter: F.Column) -> F.Column:
    """A C++ parameter without its default and name, spaces compacted: ``const T & x = 1`` is ``const T&``."""
    bare = F.trim(F.regexp_replace(parameter, r"\s*=.*$", ""))
    one = F.regexp_replace(bare, r"\s+", " ")
    # the last word is the name if a type stands before it
    named = F.regexp_extract(one, r"^(.*[\w>&*\]])\s*(?<=[\s&*])([A-Za-z_]\w*)((?:\[[^\]]*\])*)$", 1)
    array = F.regexp_extract(one, r"((?:\[[^\]]*\])*)$", 1)
    words = F.regexp_extract(one, r"([A-Za-z_]\w*)(?:\[[^\]]*\])*$", 1)
    builtin = words.isin("int", "char", "long", "short", "bool", "double", "float", "unsigned", "signed", "void", "auto", "const", "volatile")
    kept = F.when((named != "") & ~builtin, F.concat(F.trim(named), array)).otherwise(one)
    kept = F.regexp_replace(F.regexp_replace(kept, r"\s*([<>,&*()\[\]]|::)\s*", "$1"), r"\s+", " ")
    return F.when(bare == "void", "").otherwise(kept)


def member_qualifiers(signature: F.Column) -> F.Column:
    """const, volatile and reference qualifiers behind the parameter list, each after a space."""
    tail = F.regexp_extract(signature, r"\)([^)]*)$", 1)
    words = F.regexp_extract_all(tail, F.lit(r"\b(const|volatile)\b|(&&?)"), F.lit(0))
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w)), ""), F.lit(""))


def c_family_ids(symbols: DataFrame) -> DataFrame:
    """C and C++.  Callables of C++ are path(types) and qualifiers; a qualified path is the id; a bare name goes after its
    anchor: its header, for a source file the header with its stem in its folder, else the file itself - always the file for
    what is static there."""
    cpp = F.col("language") == "cpp"
    types = F.array_join(F.transform("parameters", parameter_type), ",")
    callable_ = F.concat("semantic_path", F.lit("("), types, F.lit(")"), member_qualifiers(F.col("signature")))
    header = E.extension("file_path").isin(*E.HEADER_EXTENSIONS)
    stem = F.regexp_replace("file_path", r"\.[^./]*$", "")
    headers = symbols.filter(header).select(stem.alias("_stem"), F.col("file_path").alias("_header")).groupBy("_stem").agg(F.min("_header").alias("_header"))
    met = symbols.withColumn("_stem", stem).join(headers, "_stem", "left")
    static = F.coalesce(F.col("signature").rlike(r"^static\b"), F.lit(False))
    anchor = F.when(header | static, F.col("file_path")).otherwise(F.coalesce("_header", "file_path"))
    ident = F.when(cpp & F.col("node_kind").isin(*CPP_CALLABLES), callable_).when(F.col("semantic_path").contains("::"), F.col("semantic_path")).otherwise(F.concat(anchor, F.lit("::"), "base_name"))
    return met.withColumn("symbol_id", ident).drop("_stem", "_header")


def assigned(symbols: DataFrame) -> DataFrame:
    """Ids by family.  Families that number nothing keep the path."""
    parts = [
        python_ids(symbols.filter("family = 'python'")),
        numbered_ids(symbols.filter("family = 'javascript'"), False),
        numbered_ids(symbols.filter("family IN ('java', 'kotlin', 'csharp')"), True),
        symbols.filter("family NOT IN ('python', 'javascript', 'java', 'kotlin', 'csharp', 'c')").withColumn("symbol_id", F.col("semantic_path")),
    ]
    if "language" in symbols.columns:
        parts.append(c_family_ids(symbols.filter("family = 'c'")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the same file, path, kind and range whose id changed: another file's edit renamed them."""
    keys = ["file_path", "semantic_path", "node_kind", "start_byte", "end_byte"]
    old = before.select(*keys, F.col("symbol_id").alias("old_id"))
    return old.join(after.select(*keys, F.col("symbol_id").alias("new_id")), keys).filter("old_id <> new_id")
