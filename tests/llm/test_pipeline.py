"""The pipeline's stages on a small corpus, each against what its input asks for."""

import random

import corpus_pipeline as cp
from symloom.llm import mixing

SYLLABLES = "al be co da en fi go ha in jo ka lu mo ne or pa".split()


def corpus(spark, folder):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        rows.append((i, " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(rng.randint(40, 90))) + ".", "en", f"s{i % 4}", 1))
    rows += [(200 + i, rows[i][1], "en", "s0", 1) for i in range(10)]
    rows += [(300 + i, " ".join(w + "***" for w in rows[i][1].split()), "en", "s1", 1) for i in range(100, 160)]
    rows += [(999, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], int(r[0] < 300), 0) for r in rows if r[0] != 999]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    rows = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs
        if k < 4:
            assert docs.columns == before.columns
    kept = {r.doc_id for r in out["quality_classifier"].collect()}
    assert {r[0] for r in rows if r[0] < 300} <= kept and not any(400 <= i < 460 for i in kept)
    exact = {r.doc_id for r in out["exact_dedup"].collect()}
    assert {200 + i for i in range(10)} <= exact and not {i for i in range(10)} & exact
    near = {r.doc_id for r in out["simhash_neardup"].collect()}
    assert near <= exact and len(near) >= 155
    mixed = out["source_mixing"]
    words = "size(split(trim(coalesce(text, '')), ' ')) - int(coalesce(text, '') = '') n"
    per = out["simhash_neardup"].selectExpr("source", words).groupBy("source").agg({"n": "sum", "source": "count"}).selectExpr("source", "`sum(n)` size", "`count(source)` n")
    want = {r.source: r.target for r in mixing.targets(per).collect()}
    got = {r.source: r.n for r in mixed.selectExpr("source", "size(split(trim(coalesce(text, '')), ' ')) - int(coalesce(text, '') = '') n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert all(abs(got.get(s, 0) - v) <= 5 for s, v in want.items())
    assert out["best_fit_packing"].selectExpr("count(distinct doc_id) n").first().n == mixed.select("doc_id").distinct().count()
    assert cp.run(spark, folder).count() == out["best_fit_packing"].count()
    assert cp.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, `row` string, `digest` string, taken long, salt int"


def run_on(spark, folder, rows, marks):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return cp.run(spark, folder).collect()


def test_empty_tables(spark, tmp_path):
    assert run_on(spark, f"file://{tmp_path}/sf", [], []) == []


def test_clashing_columns_nulls_and_repeats(spark, tmp_path):
    rng = random.Random(9)
    more = (0.5, True, "r", "d", 7, 3)
    rows = [(i, " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(50)), "en", "s", 1, *more) for i in range(40)]
    rows += [rows[3]] * 5 + [(None, None, None, None, None, *more)] * 4 + [(70, "", "en", None, 0, *more), (71, rows[5][1].upper(), "en", "s", 1, *more), (72, " ".join(SYLLABLES * 3000), "en", "s", 1, *more)]
    got = run_on(spark, f"file://{tmp_path}/sf", rows, [])
    placed = {(r["sequence_id"], r["offset"]) for r in got}
    ids = {r["doc_id"] for r in got}
    assert len(placed) == len(got) and {i for i in range(40) if i != 5} | {71, 72} <= ids and 5 not in ids
    assert all(r["length"] <= 2048 for r in got)
