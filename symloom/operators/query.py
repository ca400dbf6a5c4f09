"""Search, list, selection, position and read queries over a symbol table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.schema import DEFAULT_LIST, DEFAULT_SEARCH, MAX_LIMIT, nonblank, within

RANGE = ("file_path", "start_byte", "end_byte", "symbol_id")


def filtered(symbols: DataFrame, file_path_contains: str | None = None, node_kind: str | None = None) -> DataFrame:
    """The optional filters of list and search: part of the path, and the whole kind, both ignoring case."""
    if file_path_contains is not None:
        symbols = symbols.filter(F.lower("file_path").contains(nonblank("file_path_contains", file_path_contains).lower()))
    if node_kind is not None:
        symbols = symbols.filter(F.lower("node_kind") == nonblank("node_kind", node_kind).lower())
    return symbols


def _text(symbols: DataFrame, name: str) -> Column:
    if name == "parameters":
        return F.array_join("parameters", " ") if "parameters" in symbols.columns else F.col("parameter")
    return F.col(name) if name in symbols.columns else F.lit(None).cast("string")


# Fields in the order in which they are reported.
FIELDS = ("base_name", "symbol_id", "semantic_path", "scope_path", "file_path", "node_kind", "signature", "parameters", "return_type", "docstring")


def scored(symbols: DataFrame, query: str) -> DataFrame:
    """Rows with a field that holds the query, with matched_fields and score."""
    q = nonblank("query", query)
    low = q.lower()
    hit = {f: F.coalesce(F.lower(_text(symbols, f)).contains(low), F.lit(False)) for f in FIELDS}
    base, ident, path = F.lower("base_name"), F.lower("symbol_id"), F.lower("semantic_path")
    score = (
        F.when((F.col("semantic_path") == q) | (F.col("symbol_id") == q) | (F.col("base_name") == q), 1000)
        .when(base == low, 950).when(ident == low, 925).when(path == low, 900)
        .when(base.startswith(low), 850).when(path.startswith(low), 825).when(ident.startswith(low), 800)
        .when(hit["file_path"], 300).when(hit["signature"] | hit["parameters"] | hit["return_type"], 200).when(hit["docstring"], 100)
        .otherwise(400)
    )
    names = F.array_compact(F.array(*[F.when(h, F.lit(f)) for f, h in hit.items()]))
    return symbols.filter(E.any_of(list(hit.values()))).withColumns({"score": score.cast("int"), "matched_fields": names})


def _paged(rows: DataFrame, limit: int, order: list) -> DataFrame:
    """The first rows in order, each with the total of all and whether some were left out.  The total is a
    scalar subquery, so ordering stays a top-k and no row is sent to a single task but the top ones."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).limit(limit).withColumns({"total_matches": total, "truncated": total > limit})


def search(symbols: DataFrame, query: str, limit: int = DEFAULT_SEARCH, file_path_contains: str | None = None, node_kind: str | None = None) -> DataFrame:
    within("limit", limit, 0, MAX_LIMIT)
    hits = scored(filtered(symbols, file_path_contains, node_kind), query)
    return _paged(hits, limit, [F.desc("score"), "semantic_path", *RANGE])


def list_symbols(symbols: DataFrame, limit: int = DEFAULT_LIST, file_path_contains: str | None = None, node_kind: str | None = None) -> DataFrame:
    within("limit", limit, 0, MAX_LIMIT)
    return _paged(filtered(symbols, file_path_contains, node_kind), limit, ["file_path", "semantic_path", "start_byte", "end_byte", "symbol_id"])


def best_of(candidates: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """One row per key: the highest rank, then file, range and id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_rank"), *RANGE)
    return candidates.withColumn("_rank", rank).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("_rank", "rank")


def context_rank(context: Column, included: Column, companion: Column) -> Column:
    """Kind rank, raised for the context's own file, its includes and companions, and lowered for a qualified path elsewhere."""
    kind = E.kind_rank("node_kind")
    elsewhere = context.isNotNull() & (F.col("file_path") != context) & F.col("semantic_path").contains("::")
    lowered = F.when(elsewhere, F.greatest(kind - 100, F.lit(0))).otherwise(kind)
    bonus = F.when(F.col("file_path") == context, 1000).otherwise(0) + F.when(included, 200).otherwise(0) + F.when(companion, 300).otherwise(0)
    return lowered + bonus


def resolver_rank(context: Column, included: Column, companion: Column, scope: Column) -> Column:
    """context_rank, and 500 more where a C++ caller and the candidate share a scope."""
    same = (E.language(context) == "cpp") & scope.isNotNull() & (scope == F.col("scope_path"))
    return context_rank(context, included, companion) + F.when(same, 500).otherwise(0)


def all_best(candidates: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Every candidate that has its key's highest rank, and how many they are: over one means ambiguous."""
    w = Window.partitionBy(*keys)
    top = candidates.withColumn("_rank", rank).withColumn("_top", F.max("_rank").over(w)).filter("_rank = _top")
    return top.drop("_top").withColumnRenamed("_rank", "rank").withColumn("candidate_count", F.count(F.lit(1)).over(w))


def select(symbols: DataFrame, selectors: DataFrame) -> DataFrame:
    """selectors: (selector).  A match by id beats a match by path; candidates counts those of the better sort, and the
    best is returned with them, so that a caller can refuse a selector with several."""
    by_id = selectors.join(symbols, F.col("selector") == F.col("symbol_id")).withColumn("priority", F.lit(0))
    by_path = selectors.join(symbols, F.col("selector") == F.col("semantic_path")).withColumn("priority", F.lit(1))
    both = by_id.unionByName(by_path)
    w = Window.partitionBy("selector")
    kept = both.withColumn("_p", F.min("priority").over(w)).filter("priority = _p").drop("_p").withColumn("candidates", F.count(F.lit(1)).over(w))
    return best_of(kept, ["selector"], E.kind_rank("node_kind"))


def at_positions(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """points: (point_id, point_file, offset).  The narrowest symbol around each offset, the first one of equals.

    Ranges are cut into blocks of bytes so that the join has an equi key; a symbol is in every block that it touches."""
    return containing(symbols, points.withColumns({"from_byte": F.col("offset"), "to_byte": F.col("offset")}))


def containing(symbols: DataFrame, spans: DataFrame, block: int = 1 << 12) -> DataFrame:
    """spans: (point_id, point_file, from_byte, to_byte).  The narrowest symbol that contains each span.  Levels of
    blocks grow by 16, and a symbol is filed once, at the level where it touches two blocks at most: a span looks
    in one block of each level that has symbols.  Neither side is broadcast, however small Spark takes it to be: the spans are up to eight times
    what they were."""
    levels = 8
    size = lambda k: block * 16**k
    width = F.col("end_byte") - F.col("start_byte")
    level = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        level = F.when(width <= size(k), k).otherwise(level)
    unit = F.element_at(F.array(*[F.lit(size(k)) for k in range(levels)]), F.col("level") + 1)
    filed = symbols.withColumn("level", level).withColumn("unit", unit)
    used = filed.select(F.collect_set("level")).scalar()
    filed = filed.withColumn("block", F.explode(F.sequence(F.expr("start_byte div unit"), F.expr("end_byte div unit")))).drop("unit")
    asked = spans.withColumn("level", F.explode(used)).withColumn("unit", unit)
    asked = asked.withColumn("block", F.expr("from_byte div unit")).drop("unit")
    near = asked.join(filed.hint("merge"), (F.col("point_file") == F.col("file_path")) & (asked["level"] == filed["level"]) & (asked["block"] == filed["block"]))
    inside = near.filter("start_byte <= from_byte AND end_byte >= to_byte").drop("level", "block")
    w = Window.partitionBy("point_id").orderBy(width, "start_byte", "symbol_id")
    return inside.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def locate(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (want_id, want_file, want_start, want_end, want_symbol).  The same range first, else the same file, by id or path.

    A symbol goes by its id and its path.  Of those that share file, name and range, and of those that share file and name, only the best
    one meets what is wanted: a path that is declared and wanted many times makes no product."""
    kind = E.kind_rank("node_kind")
    named = symbols.withColumn("_name", F.explode(F.array_distinct(F.array("symbol_id", "semantic_path"))))
    ranged, any_ = best_of(named, ["file_path", "_name", "start_byte", "end_byte"], kind + 10), best_of(named, ["file_path", "_name"], kind)
    here = (F.col("want_file") == F.col("file_path")) & (F.col("want_symbol") == F.col("_name"))
    there = here & (F.col("want_start") == F.col("start_byte")) & (F.col("want_end") == F.col("end_byte"))
    met = wanted.join(ranged.hint("merge"), there).unionByName(wanted.join(any_.hint("merge"), here)).drop("_name")
    return best_of(met.withColumnRenamed("rank", "_met"), ["want_id"], F.col("_met")).drop("rank", "_met")


def read(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Exact text of each symbol by its byte range, with start and end points.  A null text marks an invalid range."""
    s, a, b = F.col("source"), F.col("start_byte"), F.col("end_byte")
    valid = (a <= b) & (b <= F.octet_length(s)) & (F.length(E.byte_slice(s, a, b)) > 0)
    got = symbols.join(files.select("file_path", "source"), "file_path")
    return got.withColumns({
        "text": F.when(valid, E.byte_slice(s, a, b)), "start_row": E.offset_row(s, a), "start_column": E.offset_column(s, a),
        "end_row": E.offset_row(s, b), "end_column": E.offset_column(s, b),
    }).drop("source")


def unresolved(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references: (ref_id, name), one row per reference.  Diagnostics: no candidate, or several at the best kind rank.
    Declarations are counted by name first, so a name with many of them is one row in the join."""
    counted = symbols.groupBy("base_name", E.kind_rank("node_kind").alias("r")).agg(F.count("symbol_id").alias("n"))
    best = counted.groupBy(F.col("base_name").alias("name")).agg(F.max_by("n", "r").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    status = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    return references.join(best, "name", "left").select("ref_id", n.alias("candidates"), status.alias("status"))
