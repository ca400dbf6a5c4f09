r"""Personal data with offset-preserving deobfuscation.

Base detectors (leftmost, not overlapping within a kind) run over the text itself.  Then transducers rewrite
disguises - homoglyphs and invisible characters, spelled digits, "at" and "dot" - into plain characters, each
output character keeping the source characters that it stands for; the same detectors run over the result, and
what they find is mapped back to source characters.  A span found so is added unless a base span of its kind overlaps it.

Defined results: null texts are empty and have no spans; offsets are code points, the end exclusive; texts of any length
are read whole and every scan is linear in them; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, text_of

KINDS = ("email", "ip", "card", "phone")

# What the base asks for, written so that a failing start is never tried again within a run.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Anchored at each @: what stands before it can only be the run that ends there."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = after = m.end()
        else:
            free = at + 1
        at = text.find("@", after)


def ips(text: str):
    for chain in _DOTTED.finditer(text):
        for m in _IP.finditer(text, *chain.span()):
            if all(len(p) < 400 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= len(digits_of(m.group())) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), in order."""
    return [(k, *span) for k, kind in enumerate(KINDS) for span in DETECTORS[kind](text)]


# Characters that look like ASCII ones, then words for digits and marks.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ",
    "l": "ӏ", "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уү",
    "-": "‐‑‒–—−", ".": "․。｡", "@": "﹫", "+": "᛭", " ": "      ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_OPEN, _SHUT = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_AT, _DOT = r"(?:at|arroba|arobase)", r"(?:dot|punkt|point|punto)"
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Four groups or more of one to three digits or digit words with plain or spelled dots between; or digits and digit words in a
#: row, seven or more; at least one of them spelled.
_DIGIT = rf"(?:(?:{_WORD})(?!\w)|[0-9])"
_OCTET = rf"{_DIGIT}(?:[\s-]{{1,3}}{_DIGIT}|(?<=[0-9])[0-9]){{0,2}}"
_SPELLED = re.compile(
    rf"(?<![\w.])(?P<ip>(?i:{_OCTET}(?:(?:\.|\s{{1,3}}{_DOT}\s{{1,3}}){_OCTET}){{3,15}}))(?!\w)(?!(?i:\s{{1,3}}{_DOT}\s|[\s,.()-]{{1,3}})(?i:{_DIGIT}))"
    rf"|(?<!\w)(?i:(?:plus[\s-]{{1,3}}|\+\s{{0,3}})?(?:(?:{_WORD}|[0-9])(?:\s?(?i:{_DOT})\s|[\s,.()-]{{1,3}}|(?=[0-9]))){{6,}}(?:{_WORD}|[0-9]))(?!\w)"
)
_TOKEN = re.compile(rf"(?i:{_WORD})(?!\w)|[0-9]|(?i:plus)(?!\w)|\+|(?i:{_DOT})(?!\w)")
_IP_TOKEN = re.compile(rf"{_TOKEN.pattern}|\.")
_MARKS = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}(?i:{_AT}|@){_SHUT}\s{{0,3}})|(?P<dot>\s{{0,3}}{_OPEN}(?i:{_DOT}|\.){_SHUT}\s{{0,3}})"
    rf"|(?P<bareat>\s{{1,3}}(?i:{_AT})\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:\s{{1,3}}(?i:{_DOT})\s{{1,3}}[A-Za-z0-9-]{{1,63}})))"
    rf"|(?P<baredot>(?<=[A-Za-z0-9])\s{{1,3}}(?i:{_DOT})\s{{1,3}}(?=[A-Za-z0-9]))"
    r"|(?P<coded>&(?:#0*64|#x0*40|commat);)|(?P<codeddot>&(?:#0*46|#x0*2e|period);)"
    rf"|(?P<softat>\s{{1,3}}(?i:{_AT})\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})+))"
    rf"|(?P<spaced>(?<=[A-Za-z0-9])\s{{1,2}}@\s{{1,2}}(?=[A-Za-z0-9-]{{1,63}}\.[A-Za-z]))"
)
#: A text without any of these characters or words has no disguise: whatever ``_MARKS`` takes has one of them.
_HINT = re.compile(rf"&(?:#|commat|period)|\s(?i:{_AT})\s{{1,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9-]|[\[({{<]\s{{0,3}}(?i:{_AT}|{_DOT}|@|\.)\s{{0,3}}[\])}}>]|\s(?i:{_DOT})\s|\s@\s")
#: A name with an inner mark, as mailboxes have: before a bare "at" and a plain domain nothing else counts.
_MAILBOX = re.compile(r"[A-Za-z0-9]+(?:[._%+-][A-Za-z0-9]+)+\Z")
#: Four groups of four digits with marks other than a card's between them.
_GROUPS = re.compile(r"[0-9]{4}([._/|:])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
#: A digit word beside another or a digit, as any run that ``_SPELLED`` takes and that has a word has it.
_NEXT = rf"(?:\s{{0,3}}(?i:{_DOT})\s{{1,3}}|[\s,.()-]{{1,3}})"
_SPELLED_HINT = rf"(?<!\w)(?i:{_WORD})(?:{_NEXT}(?:(?i:{_WORD})(?:(?![^\W\d])|(?=(?i:{_DOT})\s))|[0-9])|[0-9])|[0-9]{_NEXT}(?i:{_WORD})(?!\w)"
_DIGIT_HINT = re.compile(rf"&(?:#|commat|period)|(?<=[A-Za-z0-9])\s(?i:{_AT})\s{{1,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9]|{_SPELLED_HINT}")

#: Quick tests that let nearly every clean text pass without the slower patterns: characters outside of plain Latin; words
#: for digits and dots; a bare "at" before a domain; brackets and codes.
_ODD = re.compile("[\u00a0\u00ad\u0131\u0250-\U0010ffff]")
_SOFT = re.compile(rf"\s(?i:{_AT})\s{{1,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9-]")
_SPOKEN = frozenset(w.encode() for w in [*DIGIT_WORDS, "dot", "punkt", "point", "punto"])
#: Only letters of these words, and digits, stay together.
_APART = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c in "éü".encode() else 32 for c in range(256))


@lru_cache(maxsize=1)
def letters() -> tuple[dict[int, str], re.Pattern]:
    """Every character that stands for one ASCII character: the lookalikes, and by rule full-width forms, the
    mathematical alphabets, circled and foreign digits."""
    table = {ord(c): plain for plain, same in LOOKALIKES.items() for c in same}
    for start, end in ((0x0660, 0x0670), (0x06F0, 0x06FA), (0x0966, 0x0970), (0x2070, 0x20A0), (0x2460, 0x2474), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for code in range(start, end):
            plain = unicodedata.normalize("NFKC", chr(code))
            number = unicodedata.digit(chr(code), None)
            if number is not None:
                table[code] = str(number)
            elif len(plain) == 1 and " " < plain < "\x7f":
                table.setdefault(code, plain)
    every = sorted(table) + [ord(c) for c in INVISIBLE]
    return table, re.compile("[" + "".join(f"\\U{c:08x}" for c in every) + "]")


class Traced:
    """A text whose every character knows the source span that it stands for.  starts is None while they are the same."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def rewrite(self, edits) -> Traced:
        """edits: (start, end, new text), ordered and apart."""
        edits = list(edits)
        if not edits:
            return self
        starts = self.starts or list(range(len(self.text)))
        ends = self.ends or list(range(1, len(self.text) + 1))
        text, s, e, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            s += starts[at:a] + [starts[a]] * len(new)
            e += ends[at:a] + [ends[b - 1]] * len(new)
            at = b
        return Traced("".join(text) + self.text[at:], s + starts[at:], e + ends[at:])


def plain_letters(t: Traced) -> Traced:
    table, pattern = letters()
    return t.rewrite((m.start(), m.end(), table.get(ord(m.group()), "")) for m in pattern.finditer(t.text))


def plain_digits(t: Traced) -> Traced:
    """Each word of a run becomes its digit; what stands between goes with it, but a spelled dot stays a dot, and so do the plain dots of an address."""

    def edits():
        for run in _SPELLED.finditer(t.text):
            tokens = list((_IP_TOKEN if run["ip"] else _TOKEN).finditer(t.text, *run.span()))
            if not any(x.group().lower() in DIGIT_WORDS for x in tokens):
                continue
            for k, x in enumerate(tokens):
                word = x.group().lower()
                new = DIGIT_WORDS.get(word) or ("+" if word in ("plus", "+") else word if word.isdigit() else ".")
                yield x.start(), tokens[k + 1].start() if k + 1 < len(tokens) else x.end(), new

    return t.rewrite(edits())


def plain_marks(t: Traced) -> Traced:
    def edits():
        for m in _MARKS.finditer(t.text):
            if m.lastgroup != "softat":
                yield m.start(), m.end(), "@" if m.lastgroup in ("at", "bareat", "spaced", "coded") else "."
            elif _MAILBOX.search(t.text, max(0, m.start() - 64), m.start()):
                yield m.start(), m.end(), "@"

    return t.rewrite(edits())


def plain_groups(t: Traced) -> Traced:
    """The marks between four groups of digits become the card's own."""
    return t.rewrite((m.start() + k, m.start() + k + 1, "-") for m in _GROUPS.finditer(t.text) if not t.text[m.start() - 1 : m.start()].isdigit() for k in (4, 9, 14))


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that deobfuscation adds."""
    base = detect(text)
    t = Traced(text)
    if _ODD.search(text):
        t = plain_letters(t)
    spoken = any(map(_SPOKEN.__contains__, t.text.encode(errors="replace").translate(_APART).split())) or "\u00c9" in t.text or "\u00dc" in t.text
    if spoken and _DIGIT_HINT.search(t.text):
        t = plain_digits(t)
    if (spoken or any(c in t.text for c in "[({<&@") or _SOFT.search(t.text)) and _HINT.search(t.text):
        t = plain_marks(t)
    if _GROUPS.search(t.text):
        t = plain_groups(t)
    if t.starts is None:
        return base, []
    taken: list[list[tuple[int, int]]] = [[(s, e) for k, s, e in base if k == n] for n in range(len(KINDS))]
    more, at = [], [0] * len(KINDS)
    for kind, a, b in detect(t.text):
        s, e = t.source(a, b)
        own = taken[kind]
        while at[kind] < len(own) and own[at[kind]][1] <= s:
            at[kind] += 1
        if at[kind] == len(own) or own[at[kind]][0] >= e:
            more.append((kind, s, e))
    return base, more


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _scan(batches):
    for b in batches:
        rows = []
        for text in b.column(1):
            base, more = find(text.as_py() or "")
            every = sorted(base + more)
            counts = [sum(k == n for k, _, _ in base) for n in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), joined(more)))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added"])


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and added (those that the method found)."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added string")
