"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: of the whole word and of its first bytes, so that inflected forms share
what they have in common.  Filters of several widths slide over the words of the whole text, each keeps
its maximum, and a logistic layer turns the maxima into a score.  Language is not an input.  For the
operator's own verdict, ``flagged``, a threshold per language is calibrated on a part of the sample that the
filters weren't trained on; ``predicted`` in the query is score >= 0.5.

It learns from all labelled rows that aren't held out.  ``SAMPLE`` rows of each class, whose whole texts have at most
``labelled.MOST_BYTES`` bytes in all, start it on the driver; if these aren't all rows, executors pass over all of them, and counts of
words and thresholds come from all of them, too.  A language with fewer than ``CALIBRATED`` toxic rows among those that calibrate takes
the threshold of all languages, and one that isn't among them 0.5.

Defined results: null and empty texts are scored as a text without words; texts of any length are scored whole, in slices of
words that overlap by a filter; repeated rows get equal scores; of equal maxima the first one learns; other columns are ignored,
whatever their names;
without labelled rows of both classes every score is the share of ones with one of each added (zero rows: 0.5,
just not under the threshold, so such a model predicts 1); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, text_of
from symloom.llm.labelled import every, held_out, sample
from symloom.sources.scratch import release

SAMPLE, PREFIXES, BUCKETS, WIDTH, FILTERS, WIDTHS = 3000, (4, 5, 6), 1 << 18, 12, 8, (1, 2, 3)
STEPS, BATCH, RATE, SEED = 900, 48, 0.05, 5
#: Share of words left out of a text in a training step; texts that must have a bucket, else it stays zero: words of
#: a single text could only be learned by heart.
DROPPED, MIN_TEXTS = 0.1, 3
#: Toxic rows of a language that its own threshold needs.
CALIBRATED = 15
KINDS = 1 + len(PREFIXES)
#: Words that are convolved at once.
SLICE = 1 << 16

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def word_ids(raw: bytes) -> np.ndarray:
    """(words, KINDS) buckets: the whole word and its prefixes, each salted by its kind.  Hashes are polynomials in the
    bytes, summed with reduceat over words."""
    joined = b" ".join(raw.translate(_PLAIN).split())
    if not joined:
        return np.empty((0, KINDS), np.int32)
    data = np.frombuffer(joined, np.uint8)
    starts = np.r_[0, np.flatnonzero(data == 32) + 1]
    within = (np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))).astype(np.uint64)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * ((within * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(_BASE))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed[data == 32] = 0
    out = np.empty((len(starts), KINDS), np.int32)
    for k, cut in enumerate((None, *PREFIXES)):
        h = np.add.reduceat(mixed if cut is None else np.where(within < cut, mixed, np.uint64(0)), starts) + np.uint64(k * _BASE % 2**64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    return out


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.words = (rng.standard_normal((BUCKETS, WIDTH)) * 0.05).astype(np.float32)
        self.filters = [(rng.standard_normal((w * WIDTH, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.last = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.prior, self.thresholds = 0.0, {}

    def copy(self) -> Network:
        own = Network.__new__(Network)
        own.words, own.filters, own.shifts = self.words.copy(), [f.copy() for f in self.filters], [x.copy() for x in self.shifts]
        own.last, own.bias, own.prior, own.thresholds = self.last.copy(), self.bias, self.prior, dict(self.thresholds)
        return own

    def flat(self) -> np.ndarray:
        """All but the words in a row."""
        return np.concatenate([*[f.ravel() for f in self.filters], *self.shifts, self.last, [self.bias]]).astype(np.float32)

    def put(self, flat: np.ndarray) -> None:
        flat, at = flat.astype(np.float32), 0
        for p in (*self.filters, *self.shifts, self.last):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.bias = np.float32(flat[at])

    def maxima(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one text: the maximum of each filter and the word where it is; words beyond the end are zero."""
        best, at = np.full(len(self.last), -np.inf, np.float32), np.zeros(len(self.last), np.int64)
        n = max(1, len(ids))
        for begin in range(0, n, SLICE):
            part = ids[begin : begin + SLICE + max(WIDTHS) - 1]
            x = np.zeros((len(part) + max(WIDTHS), WIDTH), np.float32)
            if len(part):
                x[: len(part)] = self.words[part].sum(axis=1)
            m = min(SLICE, n - begin)
            for k, (w, f, s) in enumerate(zip(WIDTHS, self.filters, self.shifts, strict=True)):
                z = x[:m] @ f[:WIDTH]
                for j in range(1, w):
                    z += x[j : j + m] @ f[j * WIDTH : (j + 1) * WIDTH]
                top = z.argmax(axis=0)
                v = z[top, np.arange(FILTERS)] + s
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                better = v > best[own]
                best[own], at[own] = np.where(better, v, best[own]), np.where(better, top + begin, at[own])
        return best, at

    def score(self, ids: np.ndarray) -> float:
        if self.last is None:
            return self.prior
        best, _ = self.maxima(ids)
        return float(1 / (1 + np.exp(-np.clip(np.tanh(best) @ self.last + self.bias, -40, 40))))

    def batch_maxima(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For several texts at once, laid out one after the other with zero words between: maxima (texts, filters), the row
        of each maximum, the words' vectors by row and the first row of each text."""
        gap = max(WIDTHS)
        size = np.array([max(1, len(t)) for t in texts])
        first = np.r_[0, np.cumsum(size + gap)]
        x = np.zeros((first[-1], WIDTH), np.float32)
        of = np.concatenate([np.arange(a, a + len(t)) for a, t in zip(first, texts, strict=False)])
        x[of] = self.words[np.concatenate(texts)].sum(axis=1)
        first = first[:-1]
        rows = np.arange(len(x))[:, None]
        best = np.empty((len(texts), len(self.last)), np.float32)
        at = np.empty(best.shape, np.int64)
        inside = np.zeros(len(x), bool)
        inside[np.concatenate([np.arange(a, a + n) for a, n in zip(first, size, strict=True)])] = True
        text = np.repeat(np.arange(len(texts)), size + gap)
        for k, (w, f, s) in enumerate(zip(WIDTHS, self.filters, self.shifts, strict=True)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            z = x @ f[:WIDTH]
            for j in range(1, w):
                z[:-j] += x[j:] @ f[j * WIDTH : (j + 1) * WIDTH]
            z[~inside] = -np.inf
            top = np.maximum.reduceat(z, first)
            at[:, own] = np.minimum.reduceat(np.where(z == top[text], rows, len(x)), first)
            best[:, own] = top + s
        return best, at, x, first

    def train(self, texts: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Steps over balanced picks of texts."""
        rng = np.random.default_rng(seed)
        classes = [np.flatnonzero(y == c) for c in (0, 1)]
        seen = np.zeros(BUCKETS, np.int32)
        for ids in texts:
            seen[np.unique(ids)] += 1
        known = seen >= MIN_TEXTS
        self.words[~known] = 0

        def picks():
            for step in range(steps):
                pick = np.r_[rng.choice(classes[0], BATCH // 2), rng.choice(classes[1], BATCH // 2)]
                some = [texts[i][rng.random(len(texts[i])) >= DROPPED] for i in pick]
                yield some, y[pick], 1, RATE * min(1.0, 2.0 - 2.0 * step / steps)

        self.descend(picks(), known)

    def descend(self, batches, known: np.ndarray) -> None:
        """Adagrad over batches of (texts, labels, weights, rate); gradients reach only the words where a filter has its maximum."""
        params = [*self.filters, *self.shifts, self.last]
        grown = [np.full_like(p, 0.1) for p in params]
        grown_words, grown_bias = np.full(BUCKETS, 0.1, np.float32), 0.1
        for some, truth, weight, rate in batches:
            best, at, x, first = self.batch_maxima(some)
            hidden = np.tanh(best)
            g = ((1 / (1 + np.exp(-np.clip(hidden @ self.last + self.bias, -40, 40))) - truth) * weight / len(some)).astype(np.float32)
            grads: list[np.ndarray] = [np.empty(0)] * len(params)
            grads[-1] = g @ hidden
            inner = g[:, None] * self.last * (1 - hidden**2)
            every = np.concatenate(some) if some else np.empty((0, KINDS), np.int32)
            words_before = np.r_[0, np.cumsum([len(t) for t in some])]
            length = np.array([len(t) for t in some])
            rows, word_grads = [], []
            for k, w in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                d, where = inner[:, own], at[:, own]
                grads[len(WIDTHS) + k] = d.sum(axis=0)
                grads[k] = np.zeros_like(self.filters[k])
                for j in range(w):
                    block = slice(j * WIDTH, (j + 1) * WIDTH)
                    place = where + j - first[:, None]
                    live = place < length[:, None]
                    grads[k][block] = np.einsum("tfw,tf->wf", x[np.minimum(where + j, len(x) - 1)], np.where(live, d, 0))
                    t, f = np.nonzero(live)
                    rows.append(every[words_before[t] + place[t, f]])
                    word_grads.append(self.filters[k][block][:, f].T * d[t, f][:, None])
            bias_grad = g.sum()
            for p, grad, s in zip(params, grads, grown, strict=True):
                grad = grad + 1e-5 * p
                s += grad * grad
                p -= (rate * grad / np.sqrt(s)).astype(np.float32)
            grown_bias += bias_grad**2
            self.bias -= np.float32(rate * bias_grad / np.sqrt(grown_bias))
            at_, grad = np.concatenate(rows), np.concatenate(word_grads)
            u, inverse = np.unique(at_.ravel(), return_inverse=True)
            spread = np.repeat(grad, KINDS, axis=0)
            total = np.stack([np.bincount(inverse, spread[:, c], len(u)) for c in range(WIDTH)], axis=1).astype(np.float32)
            u, total = u[known[u]], total[known[u]]
            grown_words[u] += (total**2).mean(axis=1)
            self.words[u] -= rate * 4 * total / np.sqrt(grown_words[u])[:, None]


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, half-way to the next lower score; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][np.diff(scores[order]) == 0] = -1  # no cut between equal scores
    k = int(f1.argmax())
    below = scores[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((scores[order[k]] + below) / 2)


def _apart(doc_id) -> np.ndarray:
    """Which rows calibrate instead of being learned from."""
    return (np.asarray(doc_id).astype(object) * 2654435761 >> 7) % 6 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Network:
    """From every labelled row.  ``rows`` of each class start it on the driver; if there are more, all of them are passed over after that."""
    got = sample(docs, labels, "toxic", rows, True, lambda raw: word_ids(raw).tobytes(), "binary")
    all_ = every(docs, labels, "toxic")
    counts = {r["y"]: r["n"] for r in all_.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    y = np.array([r["y"] for r in got], np.float32)
    net = Network()
    if len(counts) < 2 or not 0 < y.sum() < len(y):
        net.last, net.prior, net.words = None, (counts.get(1, 0) + 1) / (sum(counts.values()) + 2), None
        return net
    texts = [np.frombuffer(r["x"], np.int32).reshape(-1, KINDS) for r in got]
    apart = _apart([r["doc_id"] for r in got]).astype(bool)
    if not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False
    learn = np.flatnonzero(~apart)
    net.train([texts[i] for i in learn], y[learn])
    if len(got) < sum(counts.values()):
        _pass_over(net, all_, counts)
        _calibrate(net, all_)
        return net
    scores = np.array([net.score(texts[i]) for i in np.flatnonzero(apart)])
    lang = np.array([r["lang"] or "" for r in got])[apart]
    pooled = best_threshold(scores, y[apart])
    for v in np.unique(lang):  # a language with few toxic rows takes the threshold of all
        own = lang == v
        net.thresholds[str(v)] = best_threshold(scores[own], y[apart][own]) if y[apart][own].sum() >= CALIBRATED else pooled
    return net


#: Tables of words are added up in so many blocks; labelled rows are dealt to so many tasks in a pass, and passed over so often.
BLOCKS, SHARDS, PASSES = 64, 12, 2
#: Words of a batch in a pass, unless a single text has more; the rate of a pass.
BATCH_WORDS, PASS_RATE = 1 << 17, 0.02


def _summed(rows: DataFrame, make, width: int) -> tuple[np.ndarray, np.ndarray]:
    """make(batches) gives a table (BUCKETS, width) for each task; their sum, and in how many of them a bucket isn't zero.  Blocks of
    the tables are added up by Spark, so that one table comes to the driver."""

    def tables(batches):
        table = make(batches)
        for k, part in enumerate(np.split(table.astype(np.float32), BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "part"])

    def add(group):
        total, some = 0.0, 0.0
        for x in sorted(group.column("part").to_pylist()):  # else sums may differ in their last bits
            part = np.frombuffer(x, np.float32).reshape(-1, width)
            total, some = total + part.astype(float), some + (part[:, :WIDTH] != 0).any(axis=1)
        both = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (total, some)]
        return pa.table([group.column("k").combine_chunks().cast(pa.int32())[:1], *both], names=["k", "total", "n"])

    got = sorted(rows.mapInArrow(tables, "k int, part binary").groupBy("k").applyInArrow(add, "k int, total binary, n binary").collect())
    both = [np.concatenate([np.frombuffer(r[c], np.float32) for r in got]) for c in ("total", "n")]
    return both[0].reshape(BUCKETS, width), both[1]


def _pass_over(net: Network, all_: DataFrame, counts: dict) -> None:
    """Every row that doesn't calibrate, in PASSES passes: each task goes on from the same network over its rows, and the changes are
    averaged, those of a word over the tasks that met it.  Classes weigh the same.  Words count by the texts of all rows."""
    weigh = {c: sum(counts.values()) / (2 * n) for c, n in counts.items()}
    shards = all_.repartition(SHARDS, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("doc_id", "y", "text")

    def rows(batches):
        for b in batches:
            apart = _apart(b.column(0).to_pylist())
            for one, c, t in zip(apart, b.column(1).to_pylist(), b.column(2), strict=True):
                if not one:
                    yield word_ids(t.as_buffer().to_pybytes()), c

    def count(batches):
        seen = np.zeros((BUCKETS, 1), np.float32)
        for ids, _ in rows(batches):
            seen[np.unique(ids)] += 1
        return seen

    spark = all_.sparkSession
    known = _summed(all_.select("doc_id", "y", "text"), count, 1)[0][:, 0] >= MIN_TEXTS
    sizes = [len(p.ravel()) for p in (*net.filters, *net.shifts, net.last)]
    rest = sum(sizes) + 1
    for turn in range(PASSES):
        sent = spark.sparkContext.broadcast((net, known))

        def change(batches, turn=turn, sent=sent):
            base, known = sent.value
            own = base.copy()

            def picks():
                some, truth, words = [], [], 0
                for ids, c in rows(batches):
                    some.append(ids)
                    truth.append(c)
                    words += len(ids)
                    if len(some) == BATCH or words >= BATCH_WORDS:
                        yield some, np.array(truth, np.float32), np.array([weigh[c] for c in truth], np.float32), PASS_RATE / (turn + 1)
                        some, truth, words = [], [], 0
                if some:
                    yield some, np.array(truth, np.float32), np.array([weigh[c] for c in truth], np.float32), PASS_RATE / (turn + 1)

            began = own.flat()
            own.descend(picks(), known)
            # the words' changes, and those of all else in a column of its own
            table = np.zeros((BUCKETS, WIDTH + 1), np.float32)
            table[:, :WIDTH] = own.words - base.words
            table[:rest, WIDTH] = own.flat() - began
            table[rest, WIDTH] = float((table != 0).any())
            return table

        total, n = _summed(shards, change, WIDTH + 1)
        tasks = max(1.0, float(total[rest, WIDTH]))  # those that had rows
        net.words = net.words + total[:, :WIDTH] / np.maximum(1, n)[:, None]
        net.put(net.flat() + total[:rest, WIDTH] / tasks)
        sent.unpersist()
        release(spark)


def _calibrate(net: Network, all_: DataFrame) -> None:
    """Thresholds of languages from all rows that calibrate, by counts of scores to four digits."""
    sent = all_.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        for b in batches:
            apart = _apart(b.column(0).to_pylist()).astype(bool)
            kept = b.filter(pa.array(apart))
            s = [round(sent.value.score(word_ids(t.as_buffer().to_pybytes())) * 10_000) for t in kept.column(3)]
            yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2), pa.array(s, pa.int32())], ["lang", "y", "s"])

    cells = all_.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "y", "text").mapInArrow(score, "lang string, y int, s int")
    cells = cells.groupBy("lang", "s").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n"))
    few = cells.groupBy("lang").agg(F.sum("ones").alias("ones"))
    kept = few.filter(F.col("ones") >= CALIBRATED).select("lang")
    pooled = _cut(cells.groupBy("s").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect())
    net.thresholds = {r["lang"]: pooled for r in few.select("lang").collect()}
    own: dict = {}
    for r in cells.join(kept, "lang", "left_semi").collect():  # 10,001 rows a language at most
        own.setdefault(r["lang"], []).append(r)
    net.thresholds |= {v: _cut(found) for v, found in own.items()}


def _cut(cells: list) -> float:
    """best_threshold of counted scores: the best F1, half-way to the next lower score; 0.5 without both classes."""
    cells = sorted(cells, key=lambda r: -r["s"])
    ones, n = (np.array([r[c] for r in cells], float) for c in ("ones", "n"))
    if not 0 < ones.sum() < n.sum():
        return 0.5
    k = int((2 * np.cumsum(ones) / (np.cumsum(n) + ones.sum())).argmax())
    below = cells[k + 1]["s"] if k + 1 < len(cells) else 0
    return (cells[k]["s"] + below) / 20_000


def decisions(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), flagged (score at or over the language's threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    columns = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), lang.alias("lang"), text_of().alias("text"))

    def score(batches):
        net = sent.value
        for b in batches:
            s = np.array([net.score(word_ids(t.as_buffer().to_pybytes())) for t in b.column(3)], float)
            limit = np.array([net.thresholds.get(v or "", 0.5) for v in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= limit)], ["doc_id", "held_out", "score", "predicted", "flagged"])

    return columns.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, flagged boolean")
