r"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, so every inner node of the tree of 256 bytes has a context tree of its own, whose
contexts are the up to ``DEPTH`` bytes before.  At each context the Krichevsky-Trofimov estimate of its counts and
the product of what its longer contexts say are mixed half and half, which weighs all prunings of the tree; a
decision's probability is the mixture of the estimates along its context, from the whole tree of the training texts.
The text's score is the sum over its bytes and one end mark, so a code length per byte follows from it.

How it is spread.  A string is the DEPTH bytes before a byte, the nearest first, and that byte: 64 bits, whose order puts all
strings of a context side by side.

1. Each input task packs its documents into chunks of about ``CHUNK`` bytes and writes them, compressed.
2. From each chunk come its distinct strings with their counts in training texts - held-out texts add what they need with
   count zero - dealt to parts by the nearest two bytes and a class of the third, as sorted, compressed blobs.
3. A part merges its blobs, notes where each chunk's strings lie among them, and weighs its trees from the longest contexts up
   to those of three bytes.  Only the sums for contexts of two bytes go to the driver: at most 65,536 x 255 nodes whatever
   the corpus, some hundred thousand for text.  The driver weighs these, one byte and none: the top.
4. Slices of parts get the top by broadcast, mix from the top down and send each chunk the values of its strings.
5. Each chunk meets its values and scores its documents.

So no task, broadcast or driver holds a model that grows with the corpus, and no string or context is left out.

The base score is the add-one unigram model over tokens, which travel as words, not as hashes.

Defined results: null texts are empty: one end token, one end mark; with no training text every estimate is uniform
and N is 0; repeated rows get equal scores; texts of any length are scored whole, in slices; other columns are ignored; an
empty table gives an empty result.  Values of strings travel with four bytes, so scores have some six digits.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, id_bucket, materialize, text_of

#: Seven bytes before and the byte itself fill the 64-bit key.
DEPTH, FOLDS, HELD_OUT = 7, 7, 2
#: Bytes of text that a chunk has about, that are sorted at once, and that a part is meant for.
CHUNK, SLICE, PART = 12_000_000, 4_000_000, 12_000_000
#: Partitions of a shuffle at most.
TASKS = 20_000
#: Strings that are weighed at once; classes of the third byte; bytes of places that a row of a slice carries about.
AT_ONCE, CLASSES, CARRIED = 1 << 19, 16, 8_000_000
END_MARK = b"\xff"
GRAM, WORD, TEXT, NODES = 0, 1, 2, 3


# ---- blobs


def pack(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def unpack(blob) -> list[memoryview]:
    view = memoryview(blob)
    n = struct.unpack_from("<q", view)[0]
    sizes = struct.unpack_from(f"<{n}q", view, 8)
    at, out = 8 * (n + 1), []
    for size in sizes:
        out.append(view[at : at + size])
        at += size
    return out


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes, compressed: equal upper bytes cost next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(blob, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    mixed = keys.copy()
    mixed[1:] ^= keys[:-1]
    return squeeze(mixed)


def unsqueeze_sorted(blob) -> np.ndarray:
    return np.bitwise_xor.accumulate(unsqueeze(blob, np.uint64))


# ---- strings of texts


def segments(texts: list[bytes]):
    """Lists of (text number, DEPTH bytes before and what follows) of about SLICE bytes; the end mark closes a text."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw) + 1, SLICE):
            before = raw[max(0, at - DEPTH) : at].rjust(DEPTH, b"\0")
            part = before + raw[at : at + SLICE] + (END_MARK if at + SLICE > len(raw) else b"")
            if size + len(part) > SLICE + DEPTH and held:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield held


def strings(parts: list[bytes]) -> np.ndarray:
    """For each byte after the first DEPTH of every part: the bytes before, the nearest first, and the byte itself."""
    joined = b"".join([b"\0", *parts])
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    own = np.ones(len(joined) - 1, bool)
    own[((ends - size)[:, None] + np.arange(DEPTH)).ravel()] = False
    # the eight bytes before each byte, read as a little-endian number, have the nearest on top; the eighth gives way to the byte
    code = np.ndarray(len(joined) - 1 - DEPTH, "<u8", joined, strides=(1,)).copy()
    code &= np.uint64(0xFFFFFFFFFFFFFF00)
    code |= np.frombuffer(joined, np.uint8, offset=DEPTH + 1)
    return code[own[DEPTH:]]


def runs(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def tally(code: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    code.sort()
    first = runs(code)
    return code[first], np.diff(np.r_[first, len(code)]) * weight


def summed(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(tallies) == 1:
        return tallies[0]
    keys = np.concatenate([k for k, _ in tallies]) if tallies else np.empty(0, np.uint64)
    counts = np.concatenate([c for _, c in tallies]) if tallies else np.empty(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def counted_strings(texts: list[bytes], learn: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of the texts, sorted, with their counts in those that are learned from."""
    tallies = []
    for weight in (1, 0):
        for held in segments([t for t, own in zip(texts, learn, strict=True) if own == bool(weight)]):
            tallies.append(tally(strings([p for _, p in held]), weight))
    return summed(tallies)


def counted_words(texts: list[bytes], learn: list[bool]) -> Counter:
    """bytes.lower and bytes.split know ASCII only, as asked.  Words of held-out texts alone count zero.  In the order in which
    they are met, those of learned texts first."""
    out: Counter = Counter()
    for raw, own in zip(texts, learn, strict=True):
        if own:
            out.update(raw.lower().split())
    for raw, own in zip(texts, learn, strict=True):
        if not own:
            for w in raw.lower().split():
                out.setdefault(w, 0)
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    near = ((keys >> np.uint64(48)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(12)
    third = ((keys >> np.uint64(40)) & np.uint64(255)) * np.uint64(0x9E3779B1) >> np.uint64(8) & np.uint64(CLASSES - 1)
    return ((near + third) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def word_parts(words, parts: int) -> dict[int, list[bytes]]:
    """Words by part, in the order in which they come."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % parts, []).append(w)
    return out


# ---- trees


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


_HALVES = np.array([0.0, *(math.lgamma(k / 2) for k in range(1, 4096))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive multiples of a half: by table, or by Stirling's series."""
    twice = x * 2
    small = twice < len(_HALVES)
    if small.all():
        return _HALVES[twice.astype(np.int64)]
    inverse = 1 / x
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260))
    out = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series
    out[small] = _HALVES[twice[small].astype(np.int64)]
    return out


def weighted(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability of nodes with longer contexts, and the weight of the node's own estimate."""
    own, deeper = log_kt(zeros, ones) - math.log(2), children - math.log(2)
    total = np.logaddexp(own, deeper)
    return total, np.exp(own - total)


class Trees:
    """All contexts of sorted distinct strings that end in whole suffixes of three bytes.

    At each depth there is one entry for each context and byte.  Entries lie sorted, so at a depth the entries of a decision,
    a context and the upper bits of the byte, are a run; ``up`` leads from an entry to the one with a byte less context."""

    TOP = 2

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.entry, self.count, self.up = {DEPTH: keys}, {DEPTH: counts.astype(float)}, {}
        for depth in range(DEPTH - 1, self.TOP - 1, -1):
            deeper = self.entry[depth + 1]
            shorter = (deeper >> np.uint64(16) << np.uint64(8)) | (deeper & np.uint64(255))
            order = np.argsort(shorter, kind="stable")
            ordered = shorter[order]
            first = runs(ordered)
            up = np.empty(len(order), np.int32)
            up[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(order)]))
            self.entry[depth], self.up[depth] = ordered[first], up
            self.count[depth] = np.add.reduceat(self.count[depth + 1][order], first)

    def _decision(self, depth: int, k: int):
        """Of the k-th decision: its runs' names and first entries, the run and bit of each entry, zeros and ones of each run."""
        entry, count = self.entry[depth], self.count[depth]
        name = entry >> np.uint64(8 - k)
        first = runs(name)
        run = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(name)]))
        bit = ((entry >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        ones = np.add.reduceat(np.where(bit, count, 0.0), first)
        return name[first], first, run, bit, np.add.reduceat(count, first) - ones, ones

    def _upward(self, k: int):
        """From the longest contexts to those of three bytes: (run, bit, estimate of a one, own weight) by depth, and for the
        contexts of two bytes the decision's names, zeros, ones and the sum over what is longer."""
        levels, total, below_first = {}, None, None
        for depth in range(DEPTH, self.TOP - 1, -1):
            name, first, run, bit, zeros, ones = self._decision(depth, k)
            below = None
            if total is not None:
                below = np.bincount(run[self.up[depth][below_first]], total, len(first))
            if depth == self.TOP:
                return levels, (name, run, bit, zeros, ones, below)
            if below is None:
                total, own = log_kt(zeros, ones), None
            else:
                total, own = weighted(zeros, ones, below)
            levels[depth] = (run, bit, (ones + 0.5) / (zeros + ones + 1), own)
            below_first = first
        raise AssertionError

    def nodes(self) -> tuple[np.ndarray, ...]:
        """(suffix of two bytes and node, zeros, ones, sum of the logs below) for the top."""
        out = []
        for k in range(8):
            _, (name, _, _, zeros, ones, below) = self._upward(k)
            out.append((_node_key(name, k), zeros, ones, below))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def values(self, top: Top) -> np.ndarray:
        """log10 of the probability of each string's byte after its context."""
        result = np.zeros(len(self.entry[DEPTH]))
        for k in range(8):
            levels, (name, run, bit, _, _, _) = self._upward(k)
            zero, one, weight = top.mixed(_node_key(name, k))
            sofar, left = np.where(bit, one[run], zero[run]), weight[run]
            for depth in range(self.TOP + 1, DEPTH + 1):
                up = self.up[depth - 1]
                run, bit, p, own = levels[depth]
                chance = np.where(bit, p[run], 1 - p[run])
                sofar, left = sofar[up], left[up]
                if own is None:
                    sofar += left * chance
                else:
                    mine = left * own[run]
                    sofar += mine * chance
                    left -= mine
            result += np.log10(sofar)
        return result


def _node_key(name: np.ndarray, k: int) -> np.ndarray:
    """The suffix and the node of the byte tree, 1 to 255, as one number; nearest byte first."""
    return (name >> np.uint64(k) << np.uint64(8)) | np.uint64(1 << k) | (name & np.uint64((1 << k) - 1))


class Top:
    """The contexts of two bytes, of one and of none.  nodes: sorted (suffix and node); with their counts and sums below."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.nodes = nodes.astype(np.uint64)
        total, own = weighted(zeros, ones, below)
        self.own, self.p = own, (ones + 0.5) / (zeros + ones + 1)
        last, node = (self.nodes >> np.uint64(16)).astype(np.int64), (self.nodes & np.uint64(255)).astype(np.int64)
        at = last << 8 | node
        z1, o1, b1 = (np.bincount(at, w, 1 << 16) for w in (zeros, ones, total))
        total1, self.own1 = weighted(z1, o1, b1)
        self.p1 = (o1 + 0.5) / (z1 + o1 + 1)
        seen = np.bincount(at, minlength=1 << 16) > 0
        z0, o0, b0 = (np.bincount(np.arange(1 << 16) & 255, w, 256) for w in (z1, o1, np.where(seen, total1, 0)))
        _, self.own0 = weighted(z0, o0, b0)
        self.p0 = (o0 + 0.5) / (z0 + o0 + 1)

    def mixed(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For nodes: what the contexts up to two bytes say of a zero and of a one, and the weight that is left."""
        at = np.searchsorted(self.nodes, wanted)
        last, node = (wanted >> np.uint64(16)).astype(np.int64) << 8, (wanted & np.uint64(255)).astype(np.int64)
        near = last | node
        left = np.ones(len(wanted))
        one, zero = np.zeros(len(wanted)), np.zeros(len(wanted))
        for own, p in ((self.own0[node], self.p0[node]), (self.own1[near], self.p1[near]), (self.own[at], self.p[at])):
            one += left * own * p
            zero += left * own * (1 - p)
            left = left * (1 - own)
        return zero, one, left


def cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about AT_ONCE strings that break no suffix of three bytes."""
    edge = np.r_[runs(keys >> np.uint64(40)), len(keys)]
    out, at = [], 0
    while at < len(keys):
        k = np.searchsorted(edge, at + AT_ONCE, "right") - 1
        end = int(edge[k] if edge[k] > at else edge[k + 1])
        out.append((at, end))
        at = end
    return out


# ---- steps


def _row(names: list[str], kinds: list, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)


def _chunks(batches):
    """doc_id, learn, text to chunks of whole texts."""
    names, kinds = ["chunk", "size", "learned", "data"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def closed(ids, learn, texts):
        known = np.array([i is not None for i in ids], bool)
        numbers = np.array([i or 0 for i in ids], np.int64)
        text = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        head = [squeeze(numbers), squeeze(known), squeeze(np.array(learn, bool)), squeeze(np.array([len(t) for t in texts], np.int64))]
        name = int.from_bytes(os.urandom(8), "little") >> 1
        return _row(names, kinds, name, sum(map(len, texts)) + len(texts), int(sum(learn)), pack(*head, text))

    ids, learn, texts, size = [], [], [], 0
    for b in batches:
        for i, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            if ids and size + len(raw) > CHUNK:
                yield closed(ids, learn, texts)
                ids, learn, texts, size = [], [], [], 0
            ids.append(i)
            learn.append(own)
            texts.append(raw)
            size += len(raw) + 1
    if ids:
        yield closed(ids, learn, texts)


def opened(blob) -> tuple[list, list[bool], list[bytes]]:
    numbers, known, learn, sizes, text = unpack(blob)
    raw = zstandard.ZstdDecompressor().decompress(bytes(text)) if len(text) else b""
    ends = np.cumsum(unsqueeze(sizes, np.int64)).tolist()
    ids = [i if k else None for i, k in zip(unsqueeze(numbers, np.int64).tolist(), unsqueeze(known, bool).tolist(), strict=True)]
    return ids, unsqueeze(learn, bool).tolist(), [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _dealt(parts: int):
    names, kinds = ["kind", "part", "chunk", "data"], [pa.int8(), pa.int32(), pa.int64(), pa.binary()]

    def deal(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, learn, texts = opened(blob.as_buffer())
                keys, counts = counted_strings(texts, learn)
                part = part_of(keys, parts)
                order = np.argsort(part, kind="stable")
                first = runs(part[order])
                for a, e in zip(first, np.r_[first[1:], len(order)], strict=True):
                    own = order[a:e]
                    yield _row(names, kinds, GRAM, int(part[own[0]]), chunk, pack(squeeze_sorted(keys[own]), squeeze(counts[own].astype(np.uint64))))
                del keys, counts, part, order
                seen = counted_words(texts, learn)
                for p, words in word_parts(seen, parts).items():
                    n = np.array([seen[w] for w in words], np.uint64)
                    yield _row(names, kinds, WORD, p, chunk, pack(zstandard.ZstdCompressor(level=3).compress(b" ".join(words)), squeeze(n)))

    return deal


MERGED = "kind byte, part int, slice int, chunk long, n long, v long, data binary"


def _merge(table: pa.Table) -> pa.Table:
    """A part: its merged strings in slices, with the places of each chunk's, and the sums for the top; or its words."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    rows = []
    chunks, blobs = table.column("chunk").to_pylist(), [unpack(x.as_buffer()) for x in table.column("data")]
    if kind == WORD:
        total: Counter = Counter()
        lists = []
        for words, counts in blobs:
            own = zstandard.ZstdDecompressor().decompress(bytes(words)).split(b" ")
            for w, c in zip(own, unsqueeze(counts, np.uint64).tolist(), strict=True):
                total[w] += c
            lists.append(own)
        n, v = sum(total.values()), sum(c > 0 for c in total.values())
        for k, (chunk, own) in enumerate(zip(chunks, lists, strict=True)):
            rows.append((WORD, part, 0, chunk, n if k == 0 else 0, v if k == 0 else 0, squeeze(np.array([total[w] for w in own], np.uint64))))
    else:
        lists = [unsqueeze_sorted(keys) for keys, _ in blobs]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = runs(ordered)
        keys = ordered[first]
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        counts = np.add.reduceat(np.concatenate([unsqueeze(c, np.uint64) for _, c in blobs])[order], first)
        del every, ordered, order
        ends = np.cumsum([len(x) for x in lists])
        places = [place[e - len(x) : e] for x, e in zip(lists, ends, strict=True)]
        nodes = []
        for s, (a, e) in enumerate(cuts(keys)):
            nodes.append(Trees(keys[a:e], counts[a:e]).nodes())
            head = (squeeze_sorted(keys[a:e]), squeeze(counts[a:e]))
            held, size = [], 0
            for chunk, own in zip(chunks, places, strict=True):
                lo, hi = np.searchsorted(own, (a, e))
                if lo == hi:
                    continue
                mine = own[lo:hi] - a
                mine[1:] -= mine[:-1].copy()
                held.append((chunk, squeeze(mine.astype(np.uint32))))
                size += len(held[-1][1])
                if size > CARRIED:
                    rows.append((GRAM, part, s, None, 0, 0, _slice(head, held)))
                    held, size = [], 0
            if held:
                rows.append((GRAM, part, s, None, 0, 0, _slice(head, held)))
        name, *sums = (np.concatenate(c) for c in zip(*nodes, strict=True))
        name, at = np.unique(name, return_inverse=True)
        sums = [np.bincount(at, x, len(name)) for x in sums]
        rows.append((NODES, part, 0, None, 0, 0, pack(squeeze_sorted(name), *(x.tobytes() for x in sums))))
    kinds = [pa.int8(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "part", "slice", "chunk", "n", "v", "data"])


def _slice(head: tuple, held: list) -> bytes:
    return pack(*head, np.array([c for c, _ in held], np.int64).tobytes(), *(x for _, x in held))


def _nodes(batches):
    for b in batches:
        for blob in b.column(0):
            name, *sums = unpack(blob.as_buffer())
            key = unsqueeze_sorted(name).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.frombuffer(x, float)) for x in sums)], ["node", "zeros", "ones", "below"])


ANSWER = "chunk long, kind byte, part int, slice int, data binary"


def _answers(sent):
    """Slices to the values of each chunk's strings."""
    names, kinds = ["chunk", "kind", "part", "slice", "data"], [pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.binary()]

    def answer(batches):
        for b in batches:
            for part, s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                keys, counts, chunks, *places = unpack(blob.as_buffer())
                values = Trees(unsqueeze_sorted(keys), unsqueeze(counts, np.uint64)).values(sent.value).astype(np.float32)
                for chunk, own in zip(np.frombuffer(chunks, np.int64).tolist(), places, strict=True):
                    at = np.cumsum(unsqueeze(own, np.uint32).astype(np.int64))
                    yield _row(names, kinds, chunk, GRAM, part, s, squeeze(values[at]))

    return answer


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _scores(parts: int, n: int, v: int, learned: int):
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def score(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        data = [x.as_buffer() for x in table.column("data")]
        where = list(zip(table.column("part").to_pylist(), table.column("slice").to_pylist(), strict=True))
        ids, learn, texts = opened(data[kind.index(TEXT)])
        # words: a value and whether it is known by its number, then sums by text
        said = [t.lower().split() for t in texts]
        first_met = [*(s for s, own in zip(said, learn, strict=True) if own), *(s for s, own in zip(said, learn, strict=True) if not own)]
        words = word_parts(dict.fromkeys(chain.from_iterable(first_met)), parts)  # as they were dealt
        number: dict[bytes, int] = {}
        counts = []
        for r, k in enumerate(kind):
            if k == WORD:
                for w in words[where[r][0]]:
                    number[w] = len(number)
                counts.append(unsqueeze(data[r], np.uint64))
        count = np.concatenate(counts) if counts else np.empty(0, np.uint64)
        log, known = np.log10(count.astype(float) + 1) - math.log10(n + v + 1), count > 0
        own = [np.fromiter(map(number.__getitem__, s), np.int32, len(s)) for s in said]
        base = [(len(x), int(known[x].sum()), float(log[x].sum())) for x in own]
        del said, first_met, words, number, own
        # strings: each slice's distinct ones, then the chunk's, in the order in which they were dealt
        held = []
        for some in segments(texts):
            code = strings([p for _, p in some])
            order = np.argsort(code)
            ordered = code[order]
            first = runs(ordered)
            at = np.empty(len(order), np.int32)
            at[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(order)]))
            held.append(([i for i, _ in some], np.array([len(p) - DEPTH for _, p in some]), ordered[first], at))
            del code, order, ordered
        keys = held[0][2] if len(held) == 1 else np.sort(np.concatenate([k for _, _, k, _ in held]))
        keys = keys[runs(keys)]
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        got = sorted((*where[r], r) for r, k in enumerate(kind) if k == GRAM)
        value = np.empty(len(keys), np.float32)
        value[order] = np.concatenate([unsqueeze(data[r], np.float32) for _, _, r in got])
        total = np.zeros(len(texts))
        for numbers, size, mine, at in held:
            sums = np.add.reduceat(value[np.searchsorted(keys, mine)][at], np.cumsum(size) - size, dtype=float)
            np.add.at(total, numbers, sums)
        del held, keys, value
        end = math.log10(learned + 1) - math.log10(n + v + 1)
        rows = []
        for i, learn_, raw, s, (m, k, b) in zip(ids, learn, texts, total.tolist(), base, strict=True):
            bits = -s / math.log10(2) / (len(raw) + 1)
            rows.append((i, not learn_, m + 1, k + (learned > 0), n, b + end, s, len(raw), bits))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return score


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row."""
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", FOLDS) != HELD_OUT).alias("learn"), text_of().alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks, "chunk long, size long, learned long, data binary"), "chunks")
    sizes = chunks.agg(F.sum("size").alias("size"), F.sum("learned").alias("learned"), F.count(F.lit(1)).alias("chunks")).first()
    learned, parts = sizes["learned"] or 0, -(-(sizes["size"] or 0) // PART) or 1
    dealt = chunks.select("chunk", "data").mapInArrow(_dealt(parts), "kind byte, part int, chunk long, data binary")
    merged = materialize(dealt.repartition(min(2 * parts, TASKS), "kind", "part").groupBy("kind", "part").applyInArrow(_merge, MERGED), "context-trees")
    words = merged.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = (words["n"] or 0) + learned, (words["v"] or 0) + (learned > 0)
    nodes = merged.filter(F.col("kind") == NODES).select("data").mapInArrow(_nodes, "node long, zeros double, ones double, below double")
    top = nodes.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).orderBy("node").toArrow()  # 65,536 x 255 rows at most
    sent = spark.sparkContext.broadcast(Top(*(top.column(c).to_numpy() for c in ("node", "zeros", "ones", "below"))))
    answers = merged.filter(F.col("kind") == GRAM).select("part", "slice", "data").mapInArrow(_answers(sent), ANSWER)
    counts = merged.filter(F.col("kind") == WORD).select("chunk", "kind", "part", "slice", "data")
    texts = chunks.select("chunk", F.lit(TEXT).cast("byte").alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("slice"), "data")
    # as many partitions as chunks, whatever the session's number is; beyond TASKS a task has several, one after the other
    return texts.unionAll(counts).unionAll(answers).repartition(min(max(1, sizes["chunks"]), TASKS), "chunk").groupBy("chunk").applyInArrow(_scores(parts, n, v, learned), RESULT)
