"""The columns of the corpus queries that SQL can express, each beside its SQL: the same operators over the same tables."""

from __future__ import annotations

from symloom.llm import context_tree, license_scan, mixing, quality_model, toxicity
from symloom.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: crc32 of an id's text: eight steps for each character.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ch <> ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))))"""
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACES = r"'[^\x20\x09-\x0D]+'"


def _phrase(words: list[str]) -> str:
    return "list_transform(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words)) + "), lambda i: i - 1)"


def base_license_phrases(spark, sf_dir):
    """Words, places and labels of the base phrases."""
    return license_scan.decisions(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_PLACES = ", ".join(f"{_phrase(p.split())} AS p{k}" for k, p in enumerate(license_scan.PHRASES))
_LABELS = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(license_scan.PHRASES.values()))
_ALL = "list_concat(" * (len(license_scan.PHRASES) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(license_scan.PHRASES)))
LICENSE_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), p AS (SELECT doc_id, len(w) AS n_words, {_PLACES} FROM d)
SELECT doc_id, n_words, len({_ALL}) AS n_base, list_min({_ALL}) AS first_word, list_max({_ALL}) AS last_word, array_to_string(list_sort(list_distinct(list_filter([{_LABELS}], lambda x: x IS NOT NULL))), ',') AS base_labels FROM p"""


def base_unigram_scores(spark, sf_dir):
    """Tokens, known tokens and the add-one unigram score."""
    out = context_tree.decisions(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 4) AS base_score")


UNIGRAM_SQL = rf"""WITH d AS (SELECT doc_id, {CRC} % 7 = 2 AS held_out, list_concat(regexp_extract_all({FOLDED}, {SPACES}), [' end']) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1.0))), 4) AS base_score FROM t LEFT JOIN c USING (word), s GROUP BY doc_id, held_out"""


def base_mix_targets(spark, sf_dir):
    """Sizes of documents and sources, and the targets of sources."""
    return mixing.decisions(table(spark, sf_dir, "documents")).selectExpr("doc_id", "size", "source_size", "round(target, 3) AS target")


def _rounds(n: int) -> str:
    """Each round shares what is left among the open sources and closes those that would pass three times their size."""
    out = "r0 AS (SELECT *, NULL::DOUBLE AS got FROM w)"
    for k in range(1, n + 1):
        out += f""", o{k} AS (SELECT *, CASE WHEN got IS NULL THEN ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(got) FROM r{k - 1}), 0)) * weight / (SELECT sum(weight) FROM r{k - 1} WHERE got IS NULL) END AS share FROM r{k - 1}),
r{k} AS (SELECT * EXCLUDE (share, got), CASE WHEN got IS NOT NULL THEN got WHEN share > 3 * source_size THEN 3.0 * source_size WHEN NOT EXISTS (SELECT 1 FROM o{k} WHERE got IS NULL AND share > 3 * source_size) THEN share END AS got FROM o{k})"""
    return out


MIX_SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {SPACES})) AS size FROM documents), z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM z), {_rounds(6)}
SELECT doc_id, size, source_size, round(got, 3) AS target FROM d JOIN r6 ON d.source IS NOT DISTINCT FROM r6.source"""


def held_out_rows(spark, sf_dir):
    """Which rows the two classifiers hold out, and that their verdicts follow from their scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = toxicity.decisions(docs, labels).selectExpr("doc_id", "'toxicity' AS model", "held_out", "score BETWEEN 0 AND 1 AND (predicted = 1) = (score >= 0.5) AS sound")
    return one.unionAll(quality_model.decisions(docs, labels).selectExpr("doc_id", "'quality'", "held_out", "score BETWEEN 0 AND 1 AND (predicted = 1) = (score >= 0.3)"))


HELD_SQL = f"WITH d AS (SELECT doc_id, {CRC} % 5 = 0 AS held_out FROM documents) SELECT doc_id, 'toxicity' AS model, held_out, true AS sound FROM d UNION ALL SELECT doc_id, 'quality', held_out, true FROM d"

QUERIES = {f.__name__: f for f in (base_license_phrases, base_unigram_scores, base_mix_targets, held_out_rows)}
ORACLE = {"base_license_phrases": LICENSE_SQL, "base_unigram_scores": UNIGRAM_SQL, "base_mix_targets": MIX_SQL, "held_out_rows": HELD_SQL}
