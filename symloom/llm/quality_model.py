"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a row of cheap measures.  Measures are cut into bins at quantiles of the sample; shallow trees
over the bins of one measure at a time are boosted in cycles and add up to one lookup table per measure; then
the pairs of measures that explain most of what is left get two-dimensional tables in the same way.  A score
is the sigmoid of a sum of table entries, found for a whole batch by indexing.

Inputs of the score are the text alone.  The model learns from at most ``SAMPLE`` labelled rows that aren't held out.

Defined results: null and empty texts are scored as the empty text; repeated rows get equal scores; with no labelled
row, or one class only, every score is the share of ones with one of each added; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, packed, text_of, unpacked
from symloom.llm.labelled import held_out, sample

SAMPLE, ACCEPT = 20_000, 0.3
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, PENALTY = 32, 8, 300, 100, 6, 0.1, 1.0
MEASURES = (
    "log_bytes", "log_words", "word_bytes", "symbols", "bangs", "bars", "upper", "digits", "marks", "foreign", "newlines", "distinct", "top_word",
    "stutter", "lines_distinct", "lines_closed", "line_words", "long_words", "short_words", "packed_size", "symbol_words", "upper_words",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>{}=~^_\\", np.uint8)
_MARKS = np.frombuffer(b".,;:?'\"()-", np.uint8)
_CLOSED = (b".", b"!", b"?", b":", b'"', b")")
_ENDS = tuple(bytes([c]) for c in b"#*$%&|<>!")


def measures(raw: bytes) -> list[float]:
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(MEASURES) - 1)
    n, size = len(words), len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    tally = Counter(words)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    letters = max(1, int(c[65:91].sum() + c[97:123].sum()))
    return [
        float(v)
        for v in (
            np.log1p(size), np.log1p(n), lengths.mean(), c[_SYMBOLS].sum() / n, c[33] / n, c[124] / n, c[65:91].sum() / letters, c[48:58].sum() / size,
            c[_MARKS].sum() / n, c[128:].sum() / size, c[10] / n, len(tally) / n, max(tally.values()) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, len(set(lines)) / len(lines), sum(x.rstrip().endswith(_CLOSED) for x in lines) / len(lines),
            np.log1p(n / len(lines)), (lengths > 14).mean(), (lengths <= 3).mean(), len(zlib.compress(raw, 1)) / size,
            sum(w.endswith(_ENDS) for w in words) / n, sum(map(bytes.isupper, words)) / n,
        )
    ]


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree with few leaves over ordered bins, from sums of gradients and curvatures."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    score = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + PENALTY)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for a, b in parts:
            at = np.arange(a + 1, b)
            if len(at):
                gain = score(a, at) + score(at, b) - score(a, b)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], a, int(at[k]), b)
        if best is None:
            break
        _, a, m, b = best
        parts = sorted([p for p in parts if p != (a, b)] + [(a, m), (m, b)])
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + PENALTY)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-dimensional table into four quadrants: its gain and its values."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    n, m = g.shape

    def quadrants(c):
        a = c[1:n, 1:m]
        b = c[1:n, m][:, None] - a
        d = c[n, 1:m][None, :] - a
        return a, b, d, c[n, m] - a - b - d

    if n < 2 or m < 2:
        return 0.0, np.zeros_like(g)
    value = [x / (y + PENALTY) for x, y in zip(quadrants(cg), quadrants(ch), strict=True)]
    gain = sum(x * v for x, v in zip(quadrants(cg), value, strict=True)) - cg[n, m] ** 2 / (ch[n, m] + PENALTY)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = (v[i, j] for v in value)
    return float(gain[i, j]), out


class AdditiveModel:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        ones = int(y.sum())
        self.base = float(np.log((ones + 1) / (len(y) - ones + 1)))
        self.cuts, self.tables, self.pairs = [], [], []
        if not 0 < ones < len(y):
            return
        self.cuts = [_cuts(v, BINS) for v in x.T]
        bins = [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        out = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for b, table in zip(bins, self.tables, strict=True):
                p = 1 / (1 + np.exp(-out))
                step = RATE * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), 3)
                table += step
                out += step[b]
        coarse = [_cuts(v, PAIR_BINS) for v in x.T]
        cbins = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T, strict=True)]

        def sums(i, j, p):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cell = cbins[i] * shape[1] + cbins[j]
            return cell, *(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

        p = 1 / (1 + np.exp(-out))
        ranked = sorted(((_cross(*sums(i, j, p)[1:])[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
        self.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, _, _, table in self.pairs:
                cell, g, h = sums(i, j, 1 / (1 + np.exp(-out)))
                step = RATE * _cross(g, h)[1]
                table += step
                out += step.ravel()[cell]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for v, cuts, table in zip(x.T, self.cuts, self.tables, strict=False):
            out += table[np.searchsorted(cuts, v, "right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> AdditiveModel:
    got = sample(docs, labels, "quality", rows, False, measures, "array<float>")
    x = np.array([r["x"] for r in got], np.float32).reshape(-1, len(MEASURES))
    return AdditiveModel(x, np.array([r["y"] for r in got], float))


def _table(texts) -> np.ndarray:
    # the sample comes to the driver as float32: so do rows that are scored
    return np.array([measures(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], np.float32).reshape(-1, len(MEASURES))


def decisions(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ACCEPT) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def score(batches):
        for b in batches:
            s = sent.value.scores(_table(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    columns = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return columns.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs with a score of accept or more, with all their columns; no exchange."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    inside = packed(bounded_batches(docs)).select("row", text_of(F.col("row.text")).alias("text"))

    def chosen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(sent.value.scores(_table(b.column(1))) >= accept))], ["row"])

    return unpacked(inside.mapInArrow(chosen, inside.select("row").schema), docs)
