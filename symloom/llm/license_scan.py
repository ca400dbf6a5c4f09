r"""License scans by diagonal voting.

Words are what is between ASCII characters other than letters and digits, lower-cased in A-Z.  Hashes of all
rolling word k-grams of all documents are joined in Spark with the positions of the same k-grams in the templates (a
fixed, small table, so it is broadcast).  Matches vote for a diagonal: position in the document minus position in
the template.  Neighbouring diagonals that continue each other, as after a few inserted or missing words, are
merged to one span, and a span is verified word by word against its template: it counts if the words that agree
make up ``MIN_COVER`` of the template.  Spans that fall short alone are chained in the template's order, as after longer
insertions or replaced runs, and count together.

Base phrases are counted exactly, wherever their words stand one after the other; their labels always stay.

The texts that are verified are those with a template's k-gram; only they travel to their votes, all other documents do with
their counts alone.  Ties: of equally near diagonals a match continues the one that was opened first; of chains that agree
equally the one with the later last piece goes on.

Defined results: a null or empty text has no words and empty labels; rows that repeat id and text get equal results;
whole texts are scanned at any length; an empty table gives an empty result.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.common import bounded_batches, materialize, text_of

K, DRIFT, MIN_COVER = 4, 8, 0.8

# Base phrases, then templates of the method, by label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: ASCII characters that aren't letters or digits become spaces, A-Z become a-z, all other bytes stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class _Powers:
    """Powers of an odd base modulo 2^64, and their inverses, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def gram_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    """Hash of every k words in a row: a polynomial over their bytes, from running sums, then mixed."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts = np.r_[0, gaps + 1][: len(words) - k + 1]
    ends = np.r_[gaps, len(data)][k - 1 :]
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _gram_rows(k: int):
    def rows(batches):
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):  # small batches of hashes
            grams = [gram_hashes(words_of(t.as_buffer().to_pybytes()), k).view(np.int64) for t in b.column(2)]
            offsets = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            values = pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "mark", "grams"])

    return rows


def template_positions(spark, templates: dict[str, list[str]], k: int) -> DataFrame:
    """(gram, template, at): fixed by the templates, some thousand rows."""
    flat = [(label, text) for label, texts in templates.items() for text in texts]
    rows = [(int(h), n, at) for n, (_, text) in enumerate(flat) for at, h in enumerate(gram_hashes(words_of(text.encode()), k).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def votes(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, mark, hits: for every document with a match, its diagonals with the positions that voted for them."""
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    grams = rows.mapInArrow(_gram_rows(k), "doc_id long, mark long, grams array<long>").select("doc_id", "mark", F.posexplode("grams").alias("pos", "gram"))
    met = grams.join(F.broadcast(template_positions(spark, templates, k)), "gram")
    diagonal = met.groupBy("doc_id", "mark", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    return diagonal.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("template", "diagonal", "at")).alias("hits"))


def merged(hits: list[dict], drift: int, k: int) -> list[tuple[int, int, int]]:
    """(template, first word, end word) of the document: neighbouring diagonals of a template, where one goes on at
    most ``drift`` words after or before the other's end."""
    spans: list[list[int]] = []  # template, start, end, diagonal
    for t, d, at in sorted((h["template"], h["diagonal"], at) for h in hits for at in h["at"]):
        spans.append([t, at, at + k, d])
    spans.sort(key=lambda s: (s[0], s[1], s[3]))
    out: list[list[int]] = []
    open_: list[list[int]] = []
    for s in spans:
        open_ = [o for o in open_ if o[0] == s[0] and s[1] - o[2] <= drift]
        near = min((o for o in open_ if abs(o[3] - s[3]) <= drift), key=lambda o: abs(o[3] - s[3]), default=None)
        if near is None:
            out.append(s)
            open_.append(s)
        else:
            near[2], near[3] = max(near[2], s[2]), s[3]
    return [(t, a, b) for t, a, b, _ in out]


def verified(words: list[bytes], template: list[bytes], start: int, end: int, drift: int) -> tuple[int, int, float]:
    """The span grown to what agrees with the template, and the share of the template's words that agree in order."""
    a, b = max(0, start - drift), min(len(words), end + drift)
    blocks = [m for m in SequenceMatcher(None, words[a:b], template, autojunk=False).get_matching_blocks() if m.size]
    if not blocks:
        return start, end, 0.0
    return a + blocks[0].a, a + blocks[-1].a + blocks[-1].size, sum(m.size for m in blocks) / len(template)


def chained(words: list[bytes], template: list[bytes], pieces: list[tuple[int, int]], drift: int, k: int, min_cover: float) -> list[tuple[int, int, float]]:
    """(first word, end word, cover) of what covers the template: pieces alone, and pieces that follow each other in the
    document as in the template, whatever stands between them.  pieces: ordered by their first words.  Of the chains that
    end at the same word of the template only the one that agrees most is kept, so a text's pieces cost the same each."""
    spans: list[tuple[int, int, float]] = []
    best: dict[int, tuple[int, list[tuple[int, int]]]] = {}  # end word in the template: words that agree, pieces
    for start, end in pieces:
        alone = verified(words, template, start, end, drift)
        if alone[2] >= min_cover:
            spans.append(alone)
            continue
        blocks = [m for m in SequenceMatcher(None, words[start:end], template, autojunk=False).get_matching_blocks() if m.size]
        if not blocks:
            continue
        first, last, n = blocks[0].b, blocks[-1].b + blocks[-1].size, sum(m.size for m in blocks)
        # grams at both sides of a gap may share words
        before = [c for q, c in best.items() if q < last and q - first < k and c[1][-1][1] - start < k]
        agree, chain = max(before, key=lambda c: (c[0], c[1][-1]), default=(0, []))
        chain = [*chain, (start, end)]
        if len(chain) > 1:
            places: list[int] = []
            for i, (a, b) in enumerate(chain):
                stop = min(len(words), b + drift, chain[i + 1][0] if i + 1 < len(chain) else len(words))
                places += range(max(0, a - drift, places[-1] + 1 if places else 0), stop)
            s, e, cover = verified([words[at] for at in places], template, 0, len(places), 0)
            if cover >= min_cover:
                spans.append((places[s], places[e - 1] + 1, cover))
                best = {}
                continue
        if last not in best or agree + n >= best[last][0]:
            best[last] = agree + n, chain
    return spans


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> tuple[list[int], set[str]]:
    found, labels = [], set()
    line = b" " + b" ".join(words) + b" "
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, word, last = line.find(needle), 0, 0
        while at >= 0:
            word += line.count(b" ", last, at)
            last = at
            found.append(word)
            labels.add(label)
            at = line.find(needle, at + 1)
    return found, labels


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K, drift: int = DRIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: counts and labels, and spans, an array of (label, start, end, cover) in words."""
    hits = materialize(votes(docs, templates, k), "license-votes")
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    known = np.unique(np.concatenate([gram_hashes(words_of(t.encode()), k) for texts in templates.values() for t in texts] or [np.empty(0, np.uint64)]))

    def count(batches):
        for b in batches:
            out = []
            for text in b.column(2):
                raw = text.as_buffer().to_pybytes()
                words = words_of(raw)
                places, labels = phrase_places(words, phrases)
                voted = bool(np.isin(gram_hashes(words, k), known).any())
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), raw if voted else None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True))], ["doc_id", "mark", "n_words", "n_base", "first_word", "last_word", "base_labels", "raw"])

    found = rows.mapInArrow(count, "doc_id long, mark long, n_words long, n_base long, first_word long, last_word long, base_labels string, raw binary")
    same = found["doc_id"].eqNullSafe(hits["doc_id"]) & (found["mark"] == hits["mark"])
    # hits has few rows as a rule; Spark knows the written table's size and broadcasts it only if it is small
    met = found.join(hits, same, "left").select(*[found[c] for c in found.columns if c != "mark"], hits["hits"])
    flat = [(label, words_of(text.encode())) for label, texts in templates.items() for text in texts]
    span = T.StructType().add("label", "string").add("start", "long").add("end", "long").add("cover", "double")
    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double").add("spans", T.ArrayType(span))
    names = schema.names
    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))]

    def verify(batches):
        for b in batches:
            out = []
            for base, raw, hit in zip(b.column("base_labels").to_pylist(), b.column("raw"), b.column("hits"), strict=True):
                spans = []
                if hit.is_valid:
                    words = words_of(raw.as_buffer().to_pybytes())
                    for t, own in groupby(sorted(merged(hit.as_py(), drift, k)), key=itemgetter(0)):
                        label, template = flat[t]
                        for s, e, cover in chained(words, template, [(x, y) for _, x, y in own], drift, k, min_cover):
                            spans.append({"label": label, "start": s, "end": e, "cover": cover})
                every = {s["label"] for s in spans} | set(base.split(",") if base else ())
                out.append((",".join(sorted(every)), max([float(base != ""), *(s["cover"] for s in spans)]), spans))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            kept = [b.column(c) for c in names[:6]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names)

    return met.mapInArrow(verify, schema)


def decisions(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
