"""Corpus operators on what earlier versions left out."""

import random
import re

import numpy as np
import pytest

from symloom.llm import context_tree, license_scan, pii


@pytest.mark.parametrize(
    "text, found",
    [
        ("eight dot eight dot eight dot eight", "eight dot eight dot eight dot eight"),
        ("host one two seven dot zero dot zero dot one is up", "one two seven dot zero dot zero dot one"),
        ("127 dot zero dot zero dot one", "127 dot zero dot zero dot one"),
        ("at one two seven.zero.0.one now", "one two seven.zero.0.one"),
        ("one nine two.one six eight.one.one", "one nine two.one six eight.one.one"),
    ],
)
def test_short_spelled_addresses(text, found):
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text)[1]] == [("ip", found)]


@pytest.mark.parametrize("text", ["one. two. three. four", "one two three four", "three hundred dot one dot two dot six", "one dot two dot three"])
def test_counting_is_no_address(text):
    assert pii.find(text) == ([], [])


class Every:
    def __contains__(self, _):
        return True


def fuzzed(seed):
    rng = random.Random(seed)
    parts = ["one", "Two", "seven", "DOT", "dot", "punkt", "at", "AT", "Arroba", "plus", "+", "@", ".", "-", "jane.doe", "example.com", "example", "com", "[", "]", "(at)", "1", "27", "555", "4111", "un", "x", "&#64;", "fünf", "ZÉRO", "“", "/", '"']
    gaps = ["", " ", " ", " ", "  ", "\n", " \n", ",", " "]
    for _ in range(4000):
        yield "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(3, 14)))


def without_quick_tests(monkeypatch, names):
    for name in names:
        monkeypatch.setattr(pii, name, Every() if name == "_SPOKEN" else re.compile(""))


def test_digits_do_not_depend_on_quick_tests(monkeypatch):
    texts = [*fuzzed(1)]
    got = [pii.find(t) for t in texts]
    without_quick_tests(monkeypatch, ["_DIGIT_HINT", "_SPOKEN"])
    assert [(t, g) for t, g in zip(texts, got, strict=True) if pii.find(t) != g] == []


@pytest.mark.parametrize("text", ["jane.doe  at example.com", "jane.doe \nat example.com", "jane.doe   ArrobA mail.example.com"])
def test_spaces_before_at(text):
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text)[1]] == [("email", text)]


def test_no_verdict_depends_on_quick_tests(monkeypatch):
    texts = [*fuzzed(2)]
    got = [pii.find(t) for t in texts]
    without_quick_tests(monkeypatch, ["_ODD", "_HINT", "_SOFT", "_DIGIT_HINT", "_SPOKEN"])
    assert [(t, g) for t, g in zip(texts, got, strict=True) if pii.find(t) != g] == []


MIT = license_scan.TEMPLATES["mit"][0].split()


@pytest.mark.parametrize("at", [20, 24, 27])
@pytest.mark.parametrize("n", [9, 30, 400])
def test_license_with_a_long_insertion(spark, at, n):
    text = " ".join(["z"] * 30 + MIT[:at] + [f"y{i}" for i in range(n)] + MIT[at:] + ["z"] * 30)
    (r,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["labels"] == "mit" and [(s["start"], s["end"], s["cover"]) for s in r["spans"]] == [(30, 30 + len(MIT) + n, 1.0)]


def cover_of(words):
    words = [w.encode() for w in words]
    template = [w.encode() for w in MIT]
    at = {tuple(template[i : i + license_scan.K]): i for i in range(len(template) - license_scan.K + 1)}
    hits = {}
    for i in range(len(words)):
        if (j := at.get(tuple(words[i : i + license_scan.K]))) is not None:
            hits.setdefault(i - j, []).append(i)
    pieces = license_scan.merged([{"template": 0, "diagonal": d, "at": x} for d, x in hits.items()], license_scan.DRIFT, license_scan.K)
    return license_scan.chained(words, template, [(a, b) for _, a, b in pieces], license_scan.DRIFT, license_scan.K, license_scan.MIN_COVER)


def test_license_pieces():
    filler = [f"y{i}" for i in range(50)]
    assert cover_of(MIT[:20] + filler[:9] + MIT[29:])[0][2] == pytest.approx(1 - 9 / len(MIT))  # a replaced run
    assert cover_of(MIT[:15] + filler + MIT[15:30] + filler + MIT[30:])[0][2] == 1.0
    assert cover_of(MIT[27:] + filler + MIT[:27]) == []  # out of order
    assert cover_of(MIT[:20] + filler + MIT[35:]) == []  # too little of it
    assert cover_of(MIT[:20] + filler + MIT[:20] + filler + MIT[:20]) == []
    assert [x[2] for x in cover_of((MIT[:25] + filler + MIT[25:] + filler) * 3)] == [1.0] * 3


def test_contexts_of_seven_bytes(monkeypatch):
    """What follows depends on the seventh byte before, and weighing the strings of a suffix at a time changes nothing."""
    rng = random.Random(3)
    raw = b"".join((b"a" if (x := rng.random() < 0.5) else b"b") + b"______" + (b"1" if x else b"2") for _ in range(4000))
    keys, n = context_tree.counted_strings([raw], [True])

    def scored():
        trees = [context_tree.Trees(keys[a:b], n[a:b]) for a, b in context_tree.cuts(keys)]
        name, *sums = (np.concatenate(c) for c in zip(*(t.nodes() for t in trees), strict=True))
        name, at = np.unique(name, return_inverse=True)
        top = context_tree.Top(name, *(np.bincount(at, x, len(name)) for x in sums))
        return len(trees), np.concatenate([t.values(top) for t in trees])

    one, whole = scored()
    by = {int(k).to_bytes(8, "big"): v for k, v in zip(keys, whole, strict=True)}
    assert by[b"______a1"] > np.log10(0.9) and by[b"______b2"] > np.log10(0.9)
    monkeypatch.setattr(context_tree, "AT_ONCE", 2)
    many, apart = scored()
    assert one == 1 < many and np.allclose(whole, apart)
