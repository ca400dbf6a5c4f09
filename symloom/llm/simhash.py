r"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: 4-word shingles, repeats included, XXH64 with seed 42, majority bit over shingles.
Fingerprints link at ``max_bits`` or fewer differing bits; documents whose fingerprints are linked, directly
or through others, form a component.

How the join is spread.  The 64 bits are cut into b blocks.  If two fingerprints differ in at most ``max_bits``
bits, b - max_bits of the blocks at least are equal in both, so for every choice of so many blocks the
fingerprints are put under the bits of those blocks, which become the top of a trie: the pair surely meets
below one such node.  Each node is the root of a self-join of its subtrie: pairs of trie nodes are walked down
together, differing bits add up, and a pair goes as soon as they exceed the budget.  b grows slowly with the
number of fingerprints, so that a node has few of them; no choice of b loses a pair.  Nodes with very many
fingerprints are salted into chunks, and every pair of chunks is a task.  A task returns a spanning forest of
the links that it found, never all pairs.  Equal fingerprints are one row in all of this.

Defined results: null texts are empty; texts without a word have fingerprint zero and link like any other;
under four words, the whole sequence is one shingle; repeated rows share a component; an empty table gives
an empty result; ids that are null are not used as a component id unless the component has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, materialize, one_of_each, salted_join, text_of, unpacked
from symloom.llm.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Fingerprints that a node has on average at most, and that a chunk of a node has.
NODE_MEAN, CHUNK = 64, 8192
#: Node pairs of up to so many fingerprint pairs are compared one by one; pairs of nodes that are walked at once.
LEAF, FRONT = 64, 1 << 19


def fingerprint(text: bytes) -> int:
    """bytes.lower() and bytes.split() know ASCII letters and the six ASCII spaces only, as asked."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - SHINGLE] + 1).tolist()]
        ends = [*gaps[SHINGLE - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        texts = b.column(2)
        codes = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes.view(np.int64))], ["doc_id", "mark", "code"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, code): mark is a hash of the text, code holds the 64 bits as a signed long."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, mark long, code long")


def blocks_for(n: int, max_bits: int) -> int:
    b = max_bits + 1
    while n / 2 ** (64 * (b - max_bits) / b) > NODE_MEAN and b < 16:
        b += 1
    return b


def layouts(blocks: int, max_bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For every choice of blocks - max_bits blocks: how many bits they have, and all (shift, width) with those first."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    cut = [(64 - edge[i + 1], edge[i + 1] - edge[i]) for i in range(blocks)]
    chosen = combinations(range(blocks), blocks - max_bits)
    return [(sum(cut[i][1] for i in c), [cut[i] for i in c] + [cut[i] for i in range(blocks) if i not in c]) for c in chosen]


def _placed(blocks: int, max_bits: int):
    plans = layouts(blocks, max_bits)

    def place(batches):
        for b in batches:
            code = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (top, order) in enumerate(plans):
                key = np.zeros(len(code), np.uint64)
                for shift, width in order:
                    key = (key << np.uint64(width)) | ((code >> np.uint64(shift)) & np.uint64((1 << width) - 1))
                node = key >> np.uint64(64 - top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), k, np.int32)), pa.array(node.astype(np.int64)), pa.array(key.view(np.int64)), b.column(0)],
                    ["layout", "node", "key", "code"],
                )

    return place


def trie_pairs(keys: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray, max_bits: int):
    """Yields arrays (i, j) of rows of keys within the budget.  keys: sorted within each root; root r is the
    trie of keys[first[r]:last[r]], whose upper depth[r] bits are equal."""
    ones = np.zeros((65, len(keys) + 1), np.int32)  # ones[k]: running count of set bits at depth k
    for k in range(64):
        np.cumsum((keys >> np.uint64(63 - k)) & np.uint64(1), out=ones[k, 1:])
    work = [(depth, first, last, first, last, np.zeros(len(first), np.int8))]
    while work:
        k, a0, a1, b0, b1, bits = work.pop()
        if len(k) > FRONT:  # depth first, in bounded fronts
            half = len(k) // 2
            work += [tuple(x[half:] for x in (k, a0, a1, b0, b1, bits)), tuple(x[:half] for x in (k, a0, a1, b0, b1, bits))]
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= LEAF) | (k >= 64)
        if small.any():
            n = size[small]
            for at in np.split(np.arange(len(n)), np.searchsorted(np.cumsum(n), np.arange(1 << 22, n.sum(), 1 << 22))):
                if len(at):
                    m = n[at]
                    of = np.repeat(np.flatnonzero(small)[at], m)
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
                    width = (b1 - b0)[of]
                    i, j = a0[of] + nth // width, b0[of] + nth % width
                    near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= max_bits)
                    yield i[near], j[near]
        k, a0, a1, b0, b1, bits = (x[~small] for x in (k, a0, a1, b0, b1, bits))
        if not len(k):
            continue
        am, bm = a1 - (ones[k, a1] - ones[k, a0]), b1 - (ones[k, b1] - ones[k, b0])  # where the second children begin
        own = a0 == b0
        children = [(a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1), (am, a1, b0, bm, bits + 1)]
        use = [np.ones(len(k), bool), np.ones(len(k), bool), np.ones(len(k), bool), ~own]
        parts = []
        for (x0, x1, y0, y1, d), u in zip(children, use, strict=True):
            live = u & (x1 > x0) & (y1 > y0) & (d <= max_bits)
            live &= ~((x0 == y0) & (x1 - x0 < 2))
            parts.append((k[live] + 1, x0[live], x1[live], y0[live], y1[live], d[live]))
        work.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))


def forest(n: int, pairs) -> np.ndarray:
    """The least row that each of n rows is linked with, from blocks of pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            live = a != b
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _links(blocks: int, max_bits: int):
    tops = np.array([top for top, _ in layouts(blocks, max_bits)])

    def joined(table: pa.Table):
        layout, node, x, y, key, code = (table.column(c).to_numpy() for c in ("layout", "node", "x", "y", "key", "code"))
        key = key.view(np.uint64)
        order = np.lexsort((key, y, x, node, layout))
        layout, node, x, y, key, code = (v[order] for v in (layout, node, x, y, key, code))
        new = np.flatnonzero(np.r_[True, (layout[1:] != layout[:-1]) | (node[1:] != node[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        end = np.r_[new[1:], len(key)]
        label = forest(len(key), trie_pairs(key, new, end, tops[layout[new]], max_bits))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(code[linked]), pa.array(code[label[linked]])], ["a", "b"])

    def link(batches):
        """Rows come ordered by task; tasks are joined together in runs of about 2^17 rows, each task whole."""
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 17:
                t = pa.Table.from_batches(held).combine_chunks()
                same = np.ones(len(t), bool)
                for c in ("layout", "node", "x", "y"):
                    v = t.column(c).to_numpy()
                    same &= v == v[-1]
                tail = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if tail:
                    yield joined(t.slice(0, tail))
                held, rows = t.slice(tail).to_batches(), len(t) - tail
        if rows:
            yield joined(pa.Table.from_batches(held).combine_chunks())

    return link


def links(codes: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """codes: distinct ``code``.  Returns (a, b), a spanning forest of each task's links."""
    blocks = blocks_for(codes.count(), max_bits)
    placed = materialize(codes.select("code").mapInArrow(_placed(blocks, max_bits), "layout int, node long, key long, code long"), "placed")
    large = placed.groupBy("layout", "node").count().filter(F.col("count") > chunk)
    large = large.select("layout", "node", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    salted = placed.join(large, ["layout", "node"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")
    salted = salted.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = salted.select("layout", "node", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "key", "code")
    task = ["layout", "node", "x", "y"]
    return tasks.repartition(*task).sortWithinPartitions(*task).mapInArrow(_links(blocks, max_bits), "a long, b long")


def classes(docs: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, code, salt) for every row of docs, and (code, first, rows) for every code: first is the row that stands
    for the component, the one with the smallest id, null ids last, as (no_id, doc_id, mark); rows have the code."""
    marked = materialize(fingerprints(docs).withColumn("salt", F.monotonically_increasing_id()), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    codes = materialize(marked.groupBy("code").agg(F.min(first).alias("least"), F.count(F.lit(1)).alias("rows")), "codes")
    of = components(materialize(links(codes, max_bits).distinct(), "fingerprint-links"))
    # fingerprints without a link are their own component
    named = codes.join(of, codes["code"] == of["node"], "left").select("code", "least", "rows", F.coalesce("component", "code").alias("component"))
    named = materialize(named, "code-components")
    ids = materialize(named.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("codes")), "component-firsts")
    met = salted_join(named, ids, ["component"], "codes", F.xxhash64("code"))
    return marked, materialize(met.select("code", "first", "rows"), "component-ids")


def decisions(docs: DataFrame) -> DataFrame:
    marked, verdict = classes(docs)
    met = salted_join(marked, verdict, ["code"], "rows", F.xxhash64("salt"))
    return met.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component: the one with the smallest id, null ids last; of rows that repeat id and text, one.
    All columns of docs."""
    as_key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    _, verdict = classes(docs, max_bits)
    stay = verdict.select(as_key("first.doc_id").alias("id"), F.col("first.mark").alias("mark")).distinct()
    rows = one_of_each(docs, {"id": as_key("row.doc_id"), "mark": F.xxhash64(text_of(F.col("row.text")))})
    return unpacked(rows.join(stay, ["id", "mark"], "left_semi"), docs)
