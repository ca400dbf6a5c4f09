"""Packing documents into sequences of fixed length by linear grouping.

1. Executors turn texts into token ids and cut the long documents; only lengths leave this step.
2. A histogram of lengths (at most ``capacity`` rows, whatever the input) goes to the driver.
3. Long lengths are split into groups of equal cardinality and rounded up to the longest of their group; the
   configurations of these few sizes are optimised by column generation over a linear program; the actual
   lengths take the places; short lengths, and the few that rounding left, go best-fit into what is free.
   This is done for several bounds of "long", and the plan with the fewest sequences is taken.
4. The plan is a list of runs ("so many sequences with these lengths"), so each piece finds its place from
   its rank among pieces of its length.  Ranks are counted in salted parts, so a length that a third of
   all pieces have is no hot group.

Defined results: a null or empty text is the single end token; the text of a special token is that token, as the tokenizers
library reads it; pieces of equal length take their places by (doc_id, piece, ids_crc32); a document longer than a sequence is cut into full
pieces with the shorter piece first; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import re
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, materialize, text_of

CAPACITY, END = 2048, 0
#: Lengths above capacity / LARGE are grouped, for each LARGE; groups; rows that one salted part of a length has about.
LARGE, GROUPS, PART = (2, 3, 4, 8), 48, 50_000


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str | None):
    """text -> numpy array of ids.  ``ranks`` is the same vocabulary in another format; the faster library reads it, and is used
    where both cut words alike: texts whose characters all lie in U+0000-U+024F or U+2010-U+2027, without 2,000 characters in
    a row that are all spaces or all no spaces, and without the text of a special token.  Any other text goes to the
    tokenizers library as it is."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks is None:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("symloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = "".join(f"|{re.escape(t.content)}" for t in whole.get_added_tokens_decoder().values())
    rare = re.compile(r"[^\x00-ɏ‐-‧]|[^\s]{2000}|\s{2000}" + special)
    return lambda text: slow(text) if rare.search(text) else fast.encode_to_numpy(text)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: the first takes what isn't a full piece."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt and, if asked for, ids: one row per piece.  salt counts the rows of a
    task, so that pieces that repeat in all else can be told apart once this is written."""
    files = vocabulary or default_vocabulary()

    def tokenize(batches):
        encode, done = encoder(*files), 0
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[at : at + n]
                    for name, v in zip(out, (doc_id, k, at, n, zlib.crc32(part.tobytes()), part if with_ids else None), strict=True):
                        out[name].append(v)
            columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            names = list(out)[:5] + ["salt"] + ["ids"] * with_ids
            columns.append(pa.array(np.arange(done, done + len(out["piece"]))))
            done += len(out["piece"])
            if with_ids:
                columns.append(pa.array([x.tolist() for x in out["ids"]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + ", ids array<int>" * with_ids
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(tokenize, schema)


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Splits (length, count), longest first, into groups of equal cardinality; a length may be split."""
    total = sum(c for _, c in lengths)
    share = max(1, -(-total // groups))
    out, room = [[]], share
    for length, count in lengths:
        while count:
            if not room:
                out.append([])
                room = share
            n = min(count, room)
            out[-1].append((length, n))
            count, room = count - n, room - n
    return [g for g in out if g]


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack over few sizes."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        gain = np.where(sizes <= room, best[np.maximum(room - sizes, 0)] + value, -1.0)
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], took[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    config, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0 or best[room] == best[room - 1]:
            room -= 1
        else:
            config[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[capacity]), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Column generation with a revised simplex: minimise the number of sequences that cover the demand.  Returns
    configurations and how often each is used, rounded down; what that leaves over is packed best-fit.  Every basis covers the
    demand, so a stop after ``rounds`` steps, which is logged, costs some sequences and no document."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        x = np.linalg.solve(basis, demand.astype(float))
        cost = (basis > 0).any(axis=0).astype(float)  # a surplus column costs nothing
        dual = np.linalg.solve(basis.T, cost)
        if (dual < -1e-9).any():
            column, price = np.zeros(m), 0.0
            column[int(dual.argmin())] = -1.0
        else:
            gain, config = best_configuration(sizes, np.maximum(dual, 0), capacity)
            if gain <= 1 + 1e-6:
                break
            column, price = config.astype(float), 1.0
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    else:
        logging.getLogger("symloom").warning("column generation stopped after %d steps", rounds)
    x = np.linalg.solve(basis, demand.astype(float))
    return [(np.maximum(basis[:, k], 0).astype(np.int64), int(x[k] + 1e-6)) for k in range(m) if (basis[:, k] > 0).any() and x[k] >= 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (sequences, [(length, so many in each sequence)]) that hold every piece of the histogram."""
    return min((plan_for(histogram, capacity, groups, bound) for bound in large), key=lambda runs: sum(times for times, _ in runs))


def plan_for(histogram: dict[int, int], capacity: int, groups: int, large: int) -> list[tuple[int, list[tuple[int, int]]]]:
    left = {n: c for n, c in histogram.items() if c}
    runs: list[list] = []  # [free, sequences, contents]
    if full := left.pop(capacity, 0):
        runs.append([0, full, [(capacity, 1)]])
    long = sorted(((n, c) for n, c in left.items() if n * large > capacity), reverse=True)
    if long:
        stock = grouped(long, groups)
        sizes, demand = np.array([g[0][0] for g in stock]), np.array([sum(c for _, c in g) for g in stock])
        for config, times in configurations(sizes, demand, capacity):
            # each place takes the next documents of its group; runs break where an actual length changes
            places = []
            for g, k in enumerate(config):
                for _ in range(k):
                    got, need = [], times
                    while need and stock[g]:
                        n, c = stock[g][0]
                        use = min(c, need)
                        got.append((n, use))
                        need -= use
                        stock[g][0] = (n, c - use)
                        if c == use:
                            stock[g].pop(0)
                    places.append(got + [(0, need)] * bool(need))
            done = 0
            while done < times:
                n = min(p[0][1] for p in places)
                took = [p[0][0] for p in places if p[0][0]]
                contents = [(v, took.count(v)) for v in sorted(set(took), reverse=True)]
                if contents:
                    runs.append([capacity - sum(took), n, contents])
                done += n
                for p in places:
                    p[0] = (p[0][0], p[0][1] - n)
                    if not p[0][1]:
                        p.pop(0)
        for v, _ in long:
            left.pop(v, None)
        for g in stock:
            for v, c in g:
                left[v] = left.get(v, 0) + c
    # best fit, longest first: the run with the least room that is enough takes as many as fit
    by_room: dict[int, list] = {}
    rooms: list[int] = []

    def put(run: list) -> None:
        if run[0] not in by_room or not by_room[run[0]]:
            if run[0] not in by_room:
                rooms.insert(bisect_left(rooms, run[0]), run[0])
            by_room[run[0]] = []
        by_room[run[0]].append(run)

    for run in runs:
        put(run)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect_left(rooms, length)
            while at < len(rooms) and not by_room[rooms[at]]:
                at += 1
            if at < len(rooms):
                free, times, contents = by_room[rooms[at]].pop()
            else:
                free, times, contents = capacity, -(-count // (capacity // length)), []
            each = min(free // length, count)
            n = min(times, count // each)
            if times > n:
                put([free, times - n, contents])
            put([free - each * length, n, [*contents, (length, each)]])
            count -= n * each
    return [(times, contents) for room in rooms for _, times, contents in by_room[room]]


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For every length and range of ranks: the first sequence, the offset there and the pieces per sequence."""
    rows, rank, first = [], {}, 0
    for times, contents in runs:
        offset = 0
        for length, each in contents:
            at = rank.get(length, 0)
            rows.append(((length << 44) + at, first, offset, each))
            rank[length] = at + times * each
            offset += length * each
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "first", "offset", "each"), table.T, strict=True))


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces() that are cheap to read twice (a written table)."""
    spark = cut_pieces.sparkSession
    count = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = spark.sparkContext.broadcast(places(plan(count, capacity, groups, large)))
    parts = spark.createDataFrame([(n, -(-c // PART)) for n, c in count.items()], "length long, parts int")  # at most capacity rows
    mine = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.col("parts")).cast("int")
    salted = cut_pieces.join(F.broadcast(parts), "length").withColumn("part", mine)
    before = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, ["length", "part"])
    ranked = ranked.select(*[c for c in cut_pieces.columns if c != "salt"], (F.col("before") + F.col("nth") - 1).alias("rank"))
    names, at = ranked.columns, ranked.columns.index

    def place(batches):
        t = sent.value
        for b in batches:
            length, rank = b.column(at("length")).to_numpy(), b.column(at("rank")).to_numpy()
            k = np.searchsorted(t["key"], (length << 44) + rank, "right") - 1
            nth = rank - (t["key"][k] & ((1 << 44) - 1))
            sequence = t["first"][k] + nth // t["each"][k]
            offset = t["offset"][k] + nth % t["each"][k] * length
            kept = [b.column(i) for i, c in enumerate(names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary=None, with_ids: bool = False) -> DataFrame:
    return pack(materialize(pieces(docs, capacity, vocabulary, with_ids), "pieces"), capacity)
