r"""Line-first cleaning [native]: rules judge each line, failing lines go, then a document that lost too much goes.

Words are ``[^\x20\x09-\x0D]+``; a line counts if it holds a word.  A line fails if

* punctuation: symbols make up a tenth or more of it,
* navigation: at most ten words, and it begins with a menu entry; or two or more separators, one to four words at least,
* boilerplate: at most twenty-five words with a stock phrase,
* stutter: ten words or more, of which at most a third are distinct,
* fragment: fewer than three words and no closing punctuation, in a document of other lines.

A document is rejected if the base rule fails it (under 20 words, or over 30 % of its words in repeated
8-word windows) or if failing lines hold more than half of its characters.  Only DataFrame functions are used.

Defined results: a null or empty text has no words, so it fails the base rule; whole texts are read at any
length; rows that repeat are judged each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import packed, text_of

# The characters and phrases of the rules.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LINE_SYMBOLS = r"[#*$%&|<>!{}=~^_\\]"
SEPARATORS = "[|>»·]"
CLOSING = r"""[.!?:;"')\]…»”。！？][\x20\x09-\x0D]*$"""
NAVIGATION = r"^[\x20\x09-\x0D]*(?i:home|menu|log ?in|sign ?in|sign ?up|register|search|skip to|back to|next|previous|share|read more|contact us|about us|sitemap)([\x20\x09-\x0D|>/»·]|$)"
BOILERPLATE = r"(?i:cookie|all rights reserved|privacy policy|terms of (use|service)|enable javascript|click here|subscribe to|newsletter|lorem ipsum|powered by)"

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order.  Sorting happens only in
    texts that repeat a window at all: equal hashes become neighbours, their starts are sorted again, and each
    start adds the words that the next one doesn't cover."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(sorted_pairs: Column) -> Column:
        again = lambda x, k: (
            (F.get(sorted_pairs, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(sorted_pairs, k + 1)["h"].eqNullSafe(x["h"]))
        )
        return F.array_sort(F.transform(F.filter(sorted_pairs, again), lambda x: x["i"]))

    def covered(s: Column) -> Column:
        steps = F.transform(s, lambda at, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - at, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        let(pairs, lambda p: let(starts(p), covered))
    )


def line_fails(line: Column, words: Column) -> Column:
    chars, n_words = F.length(line), F.size(words)
    symbols = chars - F.length(F.regexp_replace(line, LINE_SYMBOLS, ""))
    punctuation = symbols * 10 >= chars
    bars = chars - F.length(F.regexp_replace(line, SEPARATORS, ""))
    navigation = ((n_words <= 10) & line.rlike(NAVIGATION)) | ((bars >= 2) & (bars * 4 >= n_words))
    stutter = (n_words >= 10) & (F.size(F.array_distinct(words)) * 3 <= n_words)
    boilerplate = (n_words <= 25) & line.rlike(BOILERPLATE)
    fragment = (n_words < 3) & ~line.rlike(CLOSING)
    return punctuation | navigation | boilerplate | stutter | fragment


def measure(docs: DataFrame) -> DataFrame:
    """All columns of docs in ``row``, and the counts, the verdict and the cleaned text."""
    text = F.col("text")
    rows = packed(docs).select("row", text_of(F.col("row.text")).alias("text"))
    # words never cross lines: each line is split once, and the text's words are those of its lines
    parts = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words"))), lambda p: F.size(p["words"]) > 0)
    rows = rows.select("row", "text", parts.alias("parts"))
    rows = rows.select("row", "text", "parts", F.col("parts.line").alias("lines"), F.flatten("parts.words").alias("words"))
    n = F.size("words")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    )
    rows = rows.select("row", "text", "words", "lines", windows.alias("windows"), F.transform(F.filter("parts", lambda p: ~line_fails(p["line"], p["words"])), lambda p: p["line"]).alias("good"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + F.length(x))
    counted = rows.select(
        "row", "good",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        total("lines").alias("line_chars"), total("good").alias("good_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return counted.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("good_chars") * 2 >= F.col("line_chars"))).alias("kept"),
        F.array_join("good", "\n").alias("clean_text"),
    )


def decisions(docs: DataFrame) -> DataFrame:
    return measure(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the failing lines out of their text."""
    kept = measure(docs).filter("kept")
    return kept.select(*[F.col("clean_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


_W = r"[^\x20\x09-\x0D]+"
_SP = r"[\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_W}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM d),
g AS (SELECT r, i, hash(array_to_string(words[i:i + 7], ' ')) AS h
      FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM s) GROUP BY r),
f AS (SELECT r, line, length(line) AS chars, len(regexp_extract_all(line, '{_W}')) AS n,
        len(list_distinct(regexp_extract_all(line, '{_W}'))) AS n_distinct, len(regexp_extract_all(line, '{SEPARATORS}')) AS bars,
        len(regexp_extract_all(line, '[#*$%&|<>!{{}}=~^_\\]')) AS symbols
      FROM (SELECT r, unnest(lines) AS line FROM w)),
l AS (SELECT r, sum(chars) AS line_chars, coalesce(sum(chars) FILTER (WHERE NOT (symbols * 10 >= chars
        OR (n <= 10 AND regexp_matches(line, '{NAVIGATION}')) OR (bars >= 2 AND bars * 4 >= n)
        OR (n >= 10 AND n_distinct * 3 <= n)
        OR (n <= 25 AND regexp_matches(line, '{BOILERPLATE}'))
        OR (n < 3 AND NOT regexp_matches(line, '{CLOSING.replace("'", "''")}')))), 0) AS good_chars
      FROM f GROUP BY r),
a AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(line_chars, 0) AS line_chars, coalesce(good_chars, 0) AS good_chars
      FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND good_chars * 2 >= line_chars AS kept
FROM b
"""
