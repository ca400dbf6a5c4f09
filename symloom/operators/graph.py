"""Graph operators over edges (src, dst), caller to callee."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.operators.query import best_of, context_rank
from symloom.schema import MAX_DEPTH, MAX_NODES, RequestError, within
from symloom.sources.scratch import forget, materialize, release


def inverted(edges: DataFrame) -> DataFrame:
    """symbol_id, references: the distinct callers of each callee, sorted."""
    return edges.groupBy(F.col("dst").alias("symbol_id")).agg(F.array_sort(F.collect_set("src")).alias("references"))


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("symbol_id")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))


def adjacency(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with dependencies and references, empty where there are none."""
    empty = F.array().cast("array<string>")
    out = symbols.join(dependencies(edges), "symbol_id", "left").join(inverted(edges), "symbol_id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("dependencies", "references")})


def reciprocity(adjacent: DataFrame) -> DataFrame:
    """kind, src, dst of every listed edge that isn't listed at its other end: empty for a sound index."""
    down = adjacent.select(F.col("symbol_id").alias("src"), F.explode("dependencies").alias("dst")).distinct()
    up = adjacent.select(F.explode("references").alias("src"), F.col("symbol_id").alias("dst")).distinct()
    lost = down.join(up, ["src", "dst"], "left_anti").withColumn("kind", F.lit("missing_reference"))
    return lost.unionByName(up.join(down, ["src", "dst"], "left_anti").withColumn("kind", F.lit("missing_dependency")))


def trace(symbols: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """roots: (root_id).  Root, callers and callees with the row that stands for each id; callees prefer the root's file.  Edges
    and symbols are met once for both directions."""
    roots = roots.distinct()
    root = materialize(best_of(roots.join(symbols, F.col("root_id") == F.col("symbol_id")), ["root_id"], E.kind_rank("node_kind")), "roots")
    ways = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("at"), F.col("src").alias("id"), F.lit("caller").alias("role")), F.struct(F.col("src").alias("at"), F.col("dst").alias("id"), F.lit("callee").alias("role")))).alias("w")).select("w.*")
    near = ways.join(root.select(F.col("root_id"), F.col("file_path").alias("root_file")), F.col("at") == F.col("root_id")).drop("at").distinct()
    met = near.join(symbols, F.col("id") == F.col("symbol_id"))
    no = F.lit(False)
    ranked = F.when(F.col("role") == "callee", context_rank(F.col("root_file"), no, no)).otherwise(E.kind_rank("node_kind"))
    best = best_of(met, ["root_id", "role", "id"], ranked).drop("id", "root_file")
    return best.unionByName(root.withColumn("role", F.lit("trace_root")))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """src, dst, place: neighbours in the order of the adjacency list, callers before callees."""
    if direction not in ("callers", "callees", "both"):
        raise RequestError(f"direction {direction!r}")
    loop = F.raise_error(F.concat(F.lit("a symbol can't be its own neighbour: "), "src"))
    edges = edges.select(*[F.when(F.col("src") == F.col("dst"), loop).otherwise(F.col(c)).alias(c) for c in ("src", "dst")])
    views = []
    if direction in ("callers", "both"):
        views.append(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0).alias("side")))
    if direction in ("callees", "both"):
        views.append(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(1).alias("side")))
    return views[0] if len(views) == 1 else views[0].unionByName(views[1])


#: Bits of the filter for the neighbours of a frontier.
BITS = 1 << 22


def _around(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """The steps from ids and a few others: those whose hash has its bit set in a table of BITS bits, so that the rest aren't shuffled.  Of
    more ids than bits nearly all may pass; who asks joins ids exactly."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    one = ids.select(place("id").alias("p")).distinct().selectExpr("p div 64 AS w", "shiftleft(1L, cast(p % 64 AS int)) AS b")
    bits = [0] * (BITS // 64)
    for w, b in one.groupBy("w").agg(F.bit_or("b")).collect():  # BITS / 64 rows at most
        bits[w] = b
    row = steps.sparkSession.createDataFrame([(bits,)], "bits array<long>")
    held = steps.withColumn("_p", place("at"))
    return held.join(F.broadcast(row), F.expr("getbit(bits[cast(_p div 64 AS int)], cast(_p % 64 AS int)) = 1"), "left_semi").drop("_p")


def neighborhood(symbols: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "both", max_depth: int = 2, max_nodes: int = 64) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from each root at once.  Returns nodes (root_id, id, ordinal, depth, truncated) and edges (root_id,
    src, dst).  A level is one join of the frontier with the neighbour lists; within a level nodes are accepted in the
    order of (parent's ordinal, callers first, neighbour id) until max_nodes.  Per root at most max_nodes rows are kept, so
    the state is bounded by the number of roots.

    Only steps from the frontier are shuffled.  A root that has been cut is done.  Of a node's list the first 2 * max_nodes + 1 count: of those
    before the last node that matters to a root (one beyond max_nodes new ones at most), at most max_nodes are new and as many had been accepted."""
    within("max_depth", max_depth, 0, MAX_DEPTH)
    within("max_nodes", max_nodes, 1, MAX_NODES)
    known = symbols.select(F.col("symbol_id").alias("to")).distinct()
    steps = _steps(edges, direction)
    accepted = roots.join(known.withColumnRenamed("to", "root_id"), "root_id", "left_semi").distinct()
    accepted = materialize(accepted.select("root_id", F.col("root_id").alias("id"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("depth")), "accepted")
    cut = None
    for depth in range(max_depth):
        frontier = accepted.filter(F.col("depth") == depth)
        if cut is not None:
            frontier = materialize(frontier.join(cut.distinct(), "root_id", "left_anti"), "open")
        lists = _around(steps, frontier).groupBy("at", "to").agg(F.min("side").alias("side")).join(known, "to", "left_semi")
        nth = F.row_number().over(Window.partitionBy("at").orderBy("side", "to"))
        lists = lists.withColumn("_nth", nth).filter(F.col("_nth") <= 2 * max_nodes + 1).drop("_nth")
        # per node and root the first way to it; then the first max_nodes new nodes of a root
        reached = frontier.join(lists.hint("merge"), F.col("id") == F.col("at")).select("root_id", "to", F.struct("ordinal", "side", "to").alias("way"))
        fresh = reached.groupBy("root_id", "to").agg(F.min("way").alias("way"))
        fresh = fresh.join(accepted.select("root_id", F.col("id").alias("to")).hint("merge"), ["root_id", "to"], "left_anti")
        have = accepted.groupBy("root_id").agg(F.count(F.lit(1)).alias("have"))
        w = Window.partitionBy("root_id").orderBy("way")
        ranked = fresh.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_nodes + 1).join(have.hint("merge"), "root_id")
        ranked = ranked.withColumn("ordinal", F.col("have") + F.col("_n") - 1)
        ranked = materialize(ranked.select("root_id", F.col("to").alias("id"), "ordinal"), "frontier")
        release(ranked.sparkSession)
        over = ranked.filter(F.col("ordinal") >= max_nodes).select("root_id")
        cut = over if cut is None else cut.unionAll(over)
        new = ranked.filter(F.col("ordinal") < max_nodes).withColumn("depth", F.lit(depth + 1))
        if new.isEmpty():
            break
        accepted = materialize(accepted.unionByName(new), "accepted")
    nodes = accepted.withColumn("truncated", F.lit(False))
    if cut is not None:
        nodes = accepted.join(cut.distinct().withColumn("truncated", F.lit(True)), "root_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    ends = accepted.select("root_id", F.col("id").alias("to"))
    walked = accepted.filter(F.col("depth") < max_depth).join(steps, F.col("id") == F.col("at")).join(ends, ["root_id", "to"], "left_semi")
    src, dst = F.when(F.col("side") == 0, F.col("to")).otherwise(F.col("id")), F.when(F.col("side") == 0, F.col("id")).otherwise(F.col("to"))
    return nodes, walked.select("root_id", src.alias("src"), dst.alias("dst")).distinct()


def closure(starts: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """starts: (root, node), edges: (src, dst).  All (root, node) that edges lead to, cycles included, by rounds that
    only follow what the last round found."""
    edges = materialize(edges.select("src", "dst").distinct(), "closure-edges")
    reached = frontier = materialize(starts.distinct(), "closure-starts")
    for _ in range(max_rounds):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        last, frontier = frontier, materialize(step.join(reached, ["root", "node"], "left_anti"), "closure-step")
        if frontier.isEmpty():
            return reached
        before, reached = reached, materialize(reached.unionByName(frontier), "closure")
        forget(last, before)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """before and after: (role, symbol_id).  change, role, symbol_id of what came and what went."""
    gone = before.join(after, ["role", "symbol_id"], "left_anti").select(F.lit("removed").alias("change"), "role", "symbol_id")
    return gone.unionByName(after.join(before, ["role", "symbol_id"], "left_anti").select(F.lit("added").alias("change"), "role", "symbol_id"))


def re_exports(direct: DataFrame, named: DataFrame, star: DataFrame) -> DataFrame:
    """direct: (module, name, definer); named: (module, name, target, target_name); star: (module, target).  module, name,
    definer of every export with exactly one definer; a named export hides stars, ``default`` isn't passed by a star,
    cycles end in nothing."""
    direct, named, star = (materialize(t.distinct(), "exports") for t in (direct.select("module", "name", "definer"), named.select("module", "name", "target", "target_name"), star.select("module", "target")))
    own = direct.select("module", "name").unionByName(named.select("module", "name")).distinct()
    found = frontier = direct
    while True:  # ends, as what is found only grows
        f = frontier.select(F.col("module").alias("target"), F.col("name").alias("target_name"), "definer")
        by_name = named.join(f, ["target", "target_name"]).select("module", "name", "definer")
        by_star = star.join(f, "target").filter("target_name <> 'default'").select("module", F.col("target_name").alias("name"), "definer").join(own, ["module", "name"], "left_anti")
        last, frontier = frontier, materialize(by_name.unionByName(by_star).distinct().join(found, ["module", "name", "definer"], "left_anti"), "re-export-step")
        if frontier.isEmpty():
            break
        before, found = found, materialize(found.unionByName(frontier), "re-exports")
        forget(*(t for t in (last, before) if t is not direct))
    one = found.groupBy("module", "name").agg(F.count_distinct("definer").alias("n"), F.min("definer").alias("definer"))
    return one.filter("n = 1").drop("n")


def unique_parents(parents: DataFrame) -> DataFrame:
    """(node, parent) where a node has exactly one parent; with several, none is taken."""
    one = parents.groupBy("node").agg(F.count_distinct("parent").alias("n"), F.min("parent").alias("parent"))
    return one.filter("n = 1").drop("n")


def inherited(calls: DataFrame, parents: DataFrame, providers: DataFrame) -> DataFrame:
    """calls: (call_id, node, name); providers: (node, name, symbol_id).  Up the unique chain of parents, the first node that
    provides the name; nothing if it provides several, or if the chain comes back to where it was.  call_id, symbol_id, hops."""
    chain = materialize(unique_parents(parents), "parents")
    offer = materialize(providers.groupBy("node", "name").agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id")), "offers")
    open_, done, hops = calls.select("call_id", "node", "name", F.col("node").alias("mark")), None, 0
    while True:
        met = open_.join(offer, ["node", "name"])
        found = met.filter("n = 1").select("call_id", "symbol_id", F.lit(hops).alias("hops"))
        done = found if done is None else done.unionByName(found)
        if hops % 32 == 31:  # a short plan for long chains
            done = materialize(done, "inherited-found")
        # the mark moves at powers of two, so each cycle comes back to it
        mark = F.col("node") if hops & (hops - 1) == 0 else F.col("mark")
        rest = open_.join(offer, ["node", "name"], "left_anti").withColumn("mark", mark).join(chain, "node")
        rest = rest.filter("parent <> mark").select("call_id", F.col("parent").alias("node"), "name", "mark")
        open_, hops = materialize(rest, "inherited"), hops + 1
        if open_.isEmpty():
            break
    return done


def module_chains(parents: DataFrame) -> DataFrame:
    """parents: (node, parent).  node, ancestors: how many modules are above; modules that lie on a cycle, or below one, have no chain."""
    up = closure(parents.select(F.col("node").alias("root"), F.col("parent").alias("node")), parents.select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    cyclic = up.filter("root = node").select(F.col("node").alias("bad")).distinct()
    lost = up.join(cyclic, F.col("node") == F.col("bad"), "left_semi").select("root").union(cyclic).distinct()
    return up.join(lost, "root", "left_anti").groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("ancestors"))


def first_edges(found: DataFrame) -> DataFrame:
    """found: (src, dst, ordinal).  Edges once each, in the order in which they were found first."""
    return found.groupBy("src", "dst").agg(F.min("ordinal").alias("ordinal"))
