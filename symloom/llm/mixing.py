r"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the rate of its documents: the whole part of the rate is taken of every
document, and the rest is an inclusion probability.  The cube method settles these probabilities: within a block
of documents of one source, vectors in the null space of the two balancing constraints (number of documents and
number of words) move the probabilities until all but two at most are 0 or 1.  What blocks leave over forms
the blocks of the next level, until one block per source is left.  There ``LANDING`` documents, short and long, stay out of the flight; the
landing takes the outcome of these few that comes nearest to the word total, and then to the document total.  Documents too long
for the landing to make up for are drawn before that flight, and the others' probabilities make up for them.
No task has more than about ``BLOCK`` rows.

Sizes are numbers of words ``[^\x20\x09-\x0D]+``.  Sources are sorted by code point, null last, with weights 1, 2, 3
repeating; targets share the sum of all sizes and stop at ``CEILING`` times the source's size, the excess being shared
again by weight.  Choices depend on ids, texts and ``seed`` only, so reruns agree.

Ties: blocks fly in the order of size (longest first), hash of the text, id; of landings that are equally near, the one with the
nearest document total is taken, then the first in binary order over that order of documents.  The landing is the best of all
outcomes of at most LANDING + 2 documents, not a random one, so these last choices aren't strictly unbiased.

Defined results: null texts have size 0 and take part with no words; a source of size 0 has target 0; repeated rows
are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, materialize, one_of_each, row_hash, salted_join, text_of, unpacked

WEIGHTS, CEILING, BLOCK, LANDING, SEED = (1, 2, 3), 3, 4000, 14, 17
#: Sources up to which their table, some 100 MB, is broadcast; more are joined by their keys, hot ones salted.
BROADCAST_SOURCES = 1_000_000


def _measure(batches):
    for b in batches:
        size = [len(t.as_buffer().to_pybytes().split()) for t in b.column(3)]  # bytes.split knows the six ASCII spaces only
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), b.column(2)], ["doc_id", "source", "size", "mark"])


def measured(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, source, size, mark, a hash of the text or of the whole row, and nth, which tells rows apart that repeat all of
    these.  Such rows are counted before they are shuffled, so a third of all rows may be one row repeated."""
    mark = row_hash(docs, lambda c: docs[f"`{c}`"]) if whole_rows else F.xxhash64(text_of())
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), mark.alias("mark"), text_of().alias("text"))
    rows = rows.mapInArrow(_measure, "doc_id long, source string, size long, mark long")
    rows = rows.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def targets(sizes: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """sizes: (source, size, n), written, one row per source.  Adds source_no, the place by code point, null last, and target: the
    sum of sizes shared by weight; who would get over ceiling times the own size gets just that, and the rest is shared
    again among the others.  Rounds are aggregations of this table; each closes a source or is the last."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # one task, of as many rows as there are sources
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    state = sizes.withColumn("source_no", (F.row_number().over(order) - 1).cast("int")).withColumn("weight", weight).withColumn("target", F.lit(None).cast("double"))
    state = materialize(state, "sources")
    while True:
        open_ = F.col("target").isNull()
        sums = state.agg(F.sum("size").alias("all"), F.sum("target").alias("given"), F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        if not sums["weight"]:
            return state.drop("weight")
        share = F.lit(float(sums["all"] - (sums["given"] or 0.0))) * F.col("weight") / F.lit(sums["weight"])
        over = open_ & (share > ceiling * F.col("size"))
        closed = materialize(state.withColumn("target", F.when(over, ceiling * F.col("size").cast("double")).otherwise(F.col("target"))), "sources")
        if closed.filter(F.col("target").isNotNull()).count() == state.filter(F.col("target").isNotNull()).count():
            return state.withColumn("target", F.coalesce("target", share)).drop("weight")
        state = closed


def _giants_first(p: list[float], size: list[int], rng: np.random.Generator) -> list[float]:
    """Documents so long that the landing couldn't make up for them are drawn before the flight, by their probability; the others'
    probabilities take over the words that this gives or leaves, each by its size and by how open it is.  A draw that they
    couldn't make up for is turned round."""
    split = [i for i, v in enumerate(p) if 0 < v < 1]
    sizes = sorted(size[i] for i in split if size[i])
    if len(sizes) <= LANDING:
        return p
    limit = sizes[len(sizes) // 2] * LANDING / 2
    giants, rest = [i for i in split if size[i] > limit], [i for i in split if size[i] <= limit]
    if not giants:
        return p
    p, owed = list(p), 0.0
    q, s = np.array([p[i] for i in rest]), np.array([size[i] for i in rest], float)
    more, less = 0.9 * float((s * (1 - q)).sum()), 0.9 * float((s * q).sum())
    for i in giants:
        took = float(rng.random() < p[i])
        if not -less <= owed + size[i] * (p[i] - took) <= more:
            took = 1 - took
        owed += size[i] * (p[i] - took)
        p[i] = took
    for _ in range(100):
        open_ = s * q * (1 - q)
        total = float((s * open_).sum())
        if abs(owed) < 1e-6 or total <= 0:
            break
        moved = np.clip(q + owed * open_ / total, 0.0, 1.0)
        owed -= float((s * (moved - q)).sum())
        q = moved
    for i, v in zip(rest, q.tolist(), strict=True):
        p[i] = v
    return p


def settle(p: list[float], size: list[int], rng: np.random.Generator, land: bool) -> list[float]:
    """Flight over units in their order: at most two probabilities stay between 0 and 1, none if land."""
    p, tiny = _giants_first(p, size, rng) if land else list(p), 1e-9
    split = [i for i, v in enumerate(p) if 0 < v < 1]
    apart = set(split[round(k * (len(split) - 1) / (LANDING - 1))] for k in range(LANDING)) if land and len(split) > LANDING else set(split if land else [])
    draws, used = rng.random(len(p) + 8), 0
    active: list[int] = []
    todo = iter([i for i in range(len(p)) if i not in apart])

    def move(at: list[int], u: list[float]) -> None:
        nonlocal used
        up = min(((1 - p[i]) / d if d > 0 else p[i] / -d) for i, d in zip(at, u, strict=True) if d)
        down = min((p[i] / d if d > 0 else (1 - p[i]) / -d) for i, d in zip(at, u, strict=True) if d)
        step = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        for i, d in zip(at, u, strict=True):
            v = p[i] + step * d
            p[i] = 0.0 if v < tiny else 1.0 if v > 1 - tiny else v
        active[:] = [i for i in active if 0 < p[i] < 1]

    while True:
        while len(active) < 3 and (i := next(todo, None)) is not None:
            if 0 < p[i] < 1:
                active.append(i)
        if len(active) < 3:
            break
        a, b, c = (size[i] for i in active)
        top = max(abs(b - c), abs(c - a), abs(a - b))
        move(list(active), [(b - c) / top, (c - a) / top, (a - b) / top] if top else [1.0, -1.0, 0.0])
    if len(active) == 2 and size[active[0]] == size[active[1]]:
        move(list(active), [1.0, -1.0])
    if rest := sorted(apart | set(active) if land else ()):
        outcome = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
        off = outcome - np.array([p[i] for i in rest])
        words, number = np.abs(off @ np.array([size[i] for i in rest], float)), np.abs(off.sum(axis=1))
        for i, v in zip(rest, outcome[np.lexsort((number, words.round(6)))[0]].tolist(), strict=True):
            p[i] = float(v)
    return p


def _key(column: str):
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n")).alias("key")


def _flight(seed: int, level: int):
    def fly(table: pa.Table) -> pa.Table:
        size, mark, p = (table.column(c).to_numpy() for c in ("size", "mark", "p"))
        ids, nth = table.column("doc_id").fill_null(-(2**63)).to_numpy(), table.column("nth").to_numpy()
        order = np.lexsort((nth, ids, mark, -size))  # long documents first: what is left over is short
        source, block = table.column("source_no")[0].as_py(), table.column("block")[0].as_py()
        rng = np.random.default_rng([seed, level, source, block])
        done = np.empty(len(p))
        done[order] = settle(p[order].tolist(), size[order].tolist(), rng, table.column("blocks")[0].as_py() == 1)
        return table.set_column(table.column_names.index("p"), "p", pa.array(done))

    return fly


def decisions(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING, seed: int = SEED, whole_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, mark for every row."""
    spark = docs.sparkSession
    rows = materialize(measured(docs, whole_rows), "sizes")
    per = materialize(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "source-sizes")
    few = per.count() <= BROADCAST_SOURCES
    rate = F.col("target") / F.col("size")
    whole = F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("int")
    wanted = targets(per, weights, ceiling).withColumn("whole", whole).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    source = materialize(wanted.select(_key("source"), "source_no", F.col("size").alias("source_size"), "target", "whole", "p", "n"), "targets")

    def met(left: DataFrame, facts: DataFrame, key: str) -> DataFrame:
        if few:
            return left.join(F.broadcast(facts.drop("n")), key)
        return salted_join(left, facts, [key], "n", F.xxhash64("doc_id", "mark", "nth")).drop("n")

    state, level, settled = met(rows.withColumn("key", _key("source")), source, "key").drop("key"), 0, []
    left = source.select("source_no", "n")
    while True:
        blocks = left.select("source_no", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        state = met(state, blocks, "source_no").withColumn("block", F.pmod(F.xxhash64("doc_id", "mark", "nth", F.lit(level)), F.col("blocks")).cast("int"))
        flown = materialize(state.groupBy("source_no", "block").applyInArrow(_flight(seed, level), state.schema), "flight").drop("block", "blocks")
        between = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(flown.filter(~between))
        state = flown.filter(between)
        left = materialize(state.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")), "unsettled")
        level += 1
        if left.isEmpty():
            break
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = (F.col("whole") + F.col("p").cast("int")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "mark")


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as they are taken, with all their columns.  Rows that repeat every column are
    interchangeable: one of them stands for what their decisions add up to."""
    as_key = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(-(2**63) if kind == "long" else "\0"))
    chosen = decisions(docs, weights, ceiling, seed, True)
    chosen = chosen.groupBy(as_key("doc_id", "long").alias("id"), as_key("source", "string").alias("from"), "mark").agg(F.sum("copies").alias("all"))
    chosen = materialize(chosen.filter("all > 0"), "copies")
    rows = one_of_each(docs, {"id": as_key("row.doc_id", "long"), "from": as_key("row.source", "string"), "mark": row_hash(docs, lambda c: F.col("row").getField(c))})
    met = rows.join(chosen.hint("merge"), ["id", "from", "mark"])
    return unpacked(met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("all")))), docs)
