"""Scores and counts against plain loops; hot keys, repeated rows, repeated batches; clashing names."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from symloom.llm import common, components, exact_dedup, labelled, license_scan, mixing, packing, quality_model, simhash, toxicity
from symloom.sources.scratch import release

WORDS = "the of and to in a is that for it was with as on be by at from or an this which have not are but had his they she".split()


def listed(df):
    return [r.asDict() for r in df.collect()]


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---- hot keys


def test_salted_join_splits_hot_keys(spark):
    rows = [(1, i) for i in range(3000)] + [(k, 0) for k in range(2, 40)]
    left = spark.createDataFrame(rows, "k long, v long")
    facts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") * 10)
    met = common.salted_join(left, facts, ["k"], "n", F.xxhash64("v"))
    assert Counter((r.k, r.v, r.w) for r in met.collect()) == Counter((k, v, k * 10) for k, v in rows)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and "SortMergeJoin" in plan
    nothing = left.limit(0)
    assert common.salted_join(nothing, facts.limit(0), ["k"], "n", F.xxhash64("v")).count() == 0


def test_components_of_a_star(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 2000)] + [(5000, 5001)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(2000)} | {5000: 5000, 5001: 5000}


def test_simhash_of_many_equal_texts(spark):
    rows = [(i, "one two three four five six") for i in range(900)] + [(i, None) for i in range(900, 1500)] + [(2000, "x y"), (2000, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(r["component_id"] for r in listed(simhash.decisions(docs)))
    assert got[0] == 900 and got[900] == 600 and got[2000] == 2
    assert sorted(r["doc_id"] for r in listed(simhash.deduplicate(docs))) == [0, 900, 2000]


def test_near_copies_are_all_linked(spark):
    """Every pair of fingerprints within four bits is in one class: recall against all pairs."""
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(300)) for _ in range(25)]
    texts = []
    for b in base:
        w = b.split()
        texts.append(b)
        for k in (1, 2, 4, 8):
            texts.append(" ".join("zz" if i % (300 // k) == 7 else x for i, x in enumerate(w)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in listed(simhash.decisions(docs))}
    codes = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    pairs = [(i, j) for i in codes for j in codes if i < j and (codes[i] ^ codes[j]).bit_count() <= 4]
    assert len(pairs) > 20
    assert all(got[i]["component_id"] == got[j]["component_id"] for i, j in pairs)


# ---- op10


def test_a_batch_added_twice_is_dropped_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(50)] + [(49, "text 19"), (None, None), (None, None)], "doc_id long, text string")
    root = f"file://{tmp_path}/index"
    one, two = (listed(exact_dedup.decisions(docs, root, 2)) for _ in range(2))
    assert sum(r["kept"] for r in one) == 31 and len(one) == len(two) == 53
    assert not any(r["kept"] for r in two)
    assert {(r["text_sha256"], r["keep_id"]) for r in one} == {(r["text_sha256"], r["keep_id"]) for r in two}
    assert exact_dedup.deduplicate(docs, root).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 31


def test_index_is_compacted(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    for k in range(4):
        exact_dedup.decisions(spark.createDataFrame([(i, f"{k} {i}") for i in range(40)], "doc_id long, text string"), root, 2)
    index = exact_dedup.DigestIndex(spark, root)
    before = sorted(map(tuple, index.table().collect()))
    assert index.files() >= 4 and len(before) == 160
    index.compact()
    assert index.files() == 1 and sorted(map(tuple, index.table().collect())) == before
    index.close()
    again = exact_dedup.DigestIndex(spark, root)
    assert again.generation == 1 and again.table().count() == 160
    again.close()
    rows = listed(exact_dedup.decisions(spark.createDataFrame([(99, "3 7"), (98, "new")], "doc_id long, text string"), root))
    assert {r["doc_id"]: (r["kept"], r["keep_id"]) for r in rows} == {99: (False, 7), 98: (True, 98)}


# ---- repeated rows in op3 and op9


def test_repeated_rows_are_packed_and_mixed(spark):
    rows = [(7, "same words here", "a", 1)] * 400 + [(i, "other words", "b", 1) for i in range(300)] + [(None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    placed = listed(packing.packed_documents(docs))
    assert len(placed) == 705 and len({(r["sequence_id"], r["offset"]) for r in placed}) == 705
    got = listed(mixing.decisions(docs))
    assert len(got) == 705 and sum(r["taken"] for r in got if r["source"] == "a") == pytest.approx(got[0]["target"] if got[0]["source"] == "a" else next(r["target"] for r in got if r["source"] == "a"), abs=4)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.source for r in mixed.collect())["a"] == sum(r["copies"] for r in got if r["source"] == "a")


@pytest.mark.parametrize("few", [mixing.BROADCAST_SOURCES, 0])
def test_mixing_against_plain_targets(spark, monkeypatch, few):
    """With the table of sources broadcast, and joined by key."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "c", "d", None])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    total, fixed = sum(size.values()), {}
    while True:  # who would pass three times the own size gets that, and the rest is shared again
        left, open_ = total - sum(fixed.values()), [s for s in weight if s not in fixed]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s: 3.0 * size[s] for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    want = share | fixed
    got = listed(mixing.decisions(docs))
    again = listed(mixing.decisions(docs.repartition(7)))
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
    for s, t in want.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= 4


# ---- op1, op5, op2 by plain loops


def test_toxicity_scores_by_plain_loops():
    rng = np.random.default_rng(1)
    net = toxicity.Network(3)
    texts = [toxicity.word_ids(" ".join(rng.choice(WORDS, n)).encode()) for n in (0, 1, 2, 3, 40)]
    for ids in texts:
        x = [net.words[row].sum(axis=0) for row in ids] + [np.zeros(toxicity.WIDTH)] * 3
        hidden = []
        for w, f, s in zip(toxicity.WIDTHS, net.filters, net.shifts, strict=True):
            for c in range(toxicity.FILTERS):
                hidden.append(max(sum(float(np.dot(x[i + j], f[j * toxicity.WIDTH : (j + 1) * toxicity.WIDTH, c])) for j in range(w)) for i in range(max(1, len(ids)))) + s[c])
        z = sum(float(np.tanh(h)) * float(w) for h, w in zip(hidden, net.last, strict=True)) + float(net.bias)
        assert net.score(ids) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    best, at, _, first = net.batch_maxima(texts)
    for k, ids in enumerate(texts):
        one, where = net.maxima(ids)
        assert np.allclose(one, best[k], atol=1e-5) and np.array_equal(where, at[k] - first[k])


def test_toxicity_gradient_lowers_the_loss():
    rng = np.random.default_rng(2)
    texts = [toxicity.word_ids((" ".join(rng.choice(WORDS, 30)) + (" vile" if i % 2 else "")).encode()) for i in range(40)]
    y = np.array([i % 2 for i in range(40)], np.float32)
    net = toxicity.Network()
    loss = lambda: -np.mean([np.log(s if t else 1 - s) for s, t in zip((net.score(v) for v in texts), y, strict=True)])
    before = loss()
    net.train(texts, y, 60)
    assert loss() < before / 2


def test_long_and_clashing_rows_are_scored(spark):
    long = " ".join(WORDS * 6000)
    rows = [(i, "word " * (i % 9), "en", 0.5, 1, True) for i in range(60)] + [(60, long, "de", 0.1, 0, False), (60, long, "de", 0.1, 0, False), (61, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, predicted int, held_out boolean")
    marks = spark.createDataFrame([(i, i % 2, i % 3) for i in range(60)], "doc_id long, toxic int, quality int")
    for got in (listed(toxicity.decisions(docs, marks)), listed(quality_model.decisions(docs, marks))):
        assert len(got) == 63 and len({r["score"] for r in got if r["doc_id"] == 60}) == 1
    assert quality_model.keep(docs, marks).columns == docs.columns


def test_sample_is_bounded_in_bytes():
    found = [{"doc_id": i, "y": i % 2, "size": 100 if i < 8 else 10_000, "place": i} for i in range(10)]
    got = labelled.within_bytes(found, 500)
    assert len(got) == 5 and {y for _, y in got} == {0, 1} and all(i < 8 for i, _ in got)
    assert len(labelled.within_bytes(found, 1 << 30)) == 10


def test_quality_scores_by_table_sums():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 4)).astype(np.float32)
    model = quality_model.AdditiveModel(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:50], model.scores(x[:50]), strict=True):
        z = model.base
        for v, cuts, table in zip(row, model.cuts, model.tables, strict=True):
            z += table[sum(v >= c for c in cuts)]
        for i, j, a, b, table in model.pairs:
            z += table[sum(row[i] >= c for c in a)][sum(row[j] >= c for c in b)]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_license_base_by_plain_search(spark):
    rng = random.Random(6)
    bits = ["GNU General", "general public license", "gnu", "Apache", "license", "CC", "by", "cc-BY", "MIT License", "mit", "x", "é", "İ", "\n", ",", "mıt license"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, ""]
    got = {r["doc_id"]: r for r in listed(license_scan.decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | (set() if labels else {""})


def test_toxicity_learns_from_rows_beyond_its_start(spark):
    """Of 300 toxic texts those that start the model say vile, all others nasty, which only a pass over all rows can learn."""
    rng = np.random.default_rng(4)
    text = lambda word: " ".join([*rng.choice(WORDS, 20), word])
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(800)], "doc_id long, toxic int")
    plain = spark.createDataFrame([(i, "x") for i in range(800)], "doc_id long, text string")
    start = {r["doc_id"] for r in labelled.sample(plain, marks, "toxic", 30, True, lambda raw: [1.0], "array<float>")}
    word = lambda i: "" if i % 2 == 0 else "vile" if i in start else "nasty"
    docs = spark.createDataFrame([(i, text(word(i)), "a" if i % 3 else "b") for i in range(800)], "doc_id long, text string, lang string")
    net = toxicity.fit(docs, marks, 30)
    seen = {w: np.mean([net.score(toxicity.word_ids(text(w).encode())) for _ in range(20)]) for w in ("", "vile", "nasty")}
    assert seen["nasty"] > 0.5 > seen[""] and seen["vile"] > 0.5, seen
    assert set(net.thresholds) == {"a", "b"}
    again = toxicity.fit(docs, marks, 30)
    assert (again.words == net.words).all() and (again.flat() == net.flat()).all()


def test_labelled_rows_leave_no_shuffle_behind(spark):
    """Texts are shuffled to meet their labels in pieces, and what was shuffled goes before the classifier passes over the rows."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle"))

    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, rng.bytes(10_000).hex(), "a") for i in range(400)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(0, 400, 2)] + [(2, 1), (6, None), (1000, 1)], "doc_id long, toxic int")
    release(spark)
    time.sleep(2)
    before = shuffled()
    got = labelled.every(docs, marks, "toxic")
    ends = time.monotonic() + 10
    while shuffled() - before > 500_000 and time.monotonic() < ends:
        time.sleep(0.2)
    assert shuffled() - before <= 500_000
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {(r["doc_id"], r["y"]) for r in got.collect()} == {(i, int(i == 2)) for i in range(0, 400, 2) if i not in held}
    assert got.count() == len({i for i in range(0, 400, 2)} - held)
