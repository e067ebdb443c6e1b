"""Personal data in texts: plain identifiers, and disguised ones found by offset-preserving deobfuscation.

Three transducers read a text one after the other and write it anew: one character at a time
(homoglyphs, letters that Unicode decomposes into one Latin letter, digits of other scripts, invisible characters,
character references and percent forms, and characters that spaces part around an @), then token by token
(spelled digits, "plus"), then marker by marker (at and dot disguises). Each keeps, for every
character that it writes, the source characters that it stands for. Detectors run on what is
written; their spans are mapped back to the source. Plain ("base") spans are detected on the
source itself and always stay; a disguised span is added where it overlaps no base span of its
kind. Every step is linear in the text's length.

A bare "at" is common in prose, so by itself it makes no address: it needs a second sign, which is a disguised dot or bracket,
a name with a digit, dot or underscore in it, or a cue such as "mail" shortly before.

Spans are code points, end exclusive. Null and empty texts have no spans; repeated rows each
get their row; order of rows and extra columns do not matter. Parts of addresses may have any
number of digits.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, texts_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Characters that look like a Latin letter or stand for one.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ",
}
#: Full-width forms stand 0xFEE0 above the ASCII characters; digits of other scripts count by their value.
WIDE = range(0xFF01, 0xFF5F)
#: Written to nothing: they only part the characters of an identifier.
INVISIBLE = frozenset("​‌‍⁠﻿­")
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Top-level domains that an address with a bare "at" and no bracket must end in, so that prose is left alone.
TOP_LEVEL = frozenset("com org net edu gov mil info biz io co ai app dev me us uk de fr es it nl eu ch at be pl se no dk fi pt ru cn jp in br au ca example test".split())

#: Words that begin prose rather than a domain after a bare "at".
PROSE = frozenset("the a an this that these those my your our his her its their it one home least last first all any some no".split())

#: Markers without the white space around them, which a scan adds: a regular expression that begins with it would look at long runs again and again.
_AT = re.compile(r"(?i)[\[({<]\s*+(?:at|arroba|@)\s*+[\])}>]|(?<!\S)(?:at|arroba)(?!\S)|@")
_DOT = re.compile(r"(?i)[\[({<]\s*+(?:dot|punkt|point|punto|ponto|\.)\s*+[\])}>]|(?<!\S)(?:dot|punkt|point|punto|ponto)(?!\S)")
#: Words that say that an address follows, and how far before it they may stand.
_CUE = re.compile(r"(?i)(?<![a-z])(?:e-?mails?|mail(?:to|ing)?|contact|write|reach|address|schreib\w*|kontakt|adresse|courriel|contacte[rz]?|correo|escrib\w*|contacto|direcci[oó]n)(?![a-z])")
_CUE_REACH = 40
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});|%[2-7][0-9A-Fa-f]")
_PARTED = re.compile(r"(?<!\S)[A-Za-z0-9._@+-](?:[ \t][A-Za-z0-9._@+-](?!\S)){4,}")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NAMED = re.compile("[0-9._]")
#: Wherever a transducer would change something that matters, this finds something.
_HINT = re.compile(r"(?i)\b(?:dot|punkt|point|punto|ponto|arroba)\b|&[#a-z]|%[2-7][0-9a-f]|[\[({<]\s*+(?:at|@|dot|punkt|point|punto|ponto|arroba|\.)\s*+[\])}>]|\sat\s++[a-z0-9-]++\.[a-z0-9-]|\s@|@\s|(?<![a-z])plus[\s-]++(?:[0-9]|zero|oh|one|two|three|four|five|six|seven|eight|nine)|(?<![a-z])(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\s,.-]++(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]|[\s,.-]+|[^A-Za-z0-9\s,.-]+")
_ODD = re.compile("[^\x00-\x7fÀ-ÿ]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Works outward from each @: left over the local part, right over the domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL_SET:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((a, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of numbers joined by dots, taken four at a time from the left."""
    found = []
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, ends = m.start(), []
        parts = m[0].split(".")
        for p in parts:
            ends.append((at, at + len(p), len(x := p.lstrip("0")) < 4 and int(x or "0") <= 255))
            at += len(p) + 1
        for k in range(0, len(ends) - 3, 4):
            if all(small for _, _, small in ends[k : k + 4]):
                found.append((ends[k][0], ends[k + 3][1]))
    return found


def cards(text: str) -> list[tuple[int, int]]:
    if not _RUN.search(text):
        return []
    found = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


DETECTORS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    return [
        emails(text) if "@" in text else [],
        addresses(text) if "." in text else [],
        cards(text),
        phones(text) if "+" in text else [],
    ]


class Rewritten:
    """A text with, for each of its characters, the source range it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new), in order and apart. The first new character stands for the whole old range."""
        out, start, end, at = [], [], [], 0
        for a, b, new in edits:
            out.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            if new:
                out.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(out), start, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


@cache
def fold(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if ord(c) in WIDE:
        return chr(ord(c) - 0xFEE0)
    value = unicodedata.digit(c, None) if c.isdecimal() else None
    if value is not None:
        return str(value)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


Edit = tuple[int, int, str]


def characters(text: str) -> list[Edit]:
    """First transducer: each character by itself, however it is written."""
    odd = [(m.start(), m.end(), n) for m in _ODD.finditer(text) if (n := fold(m[0])) != m[0]]
    if "&" in text or "%" in text:
        odd += [(m.start(), m.end(), n) for m in _REFERENCE.finditer(text) if (n := referred(m[0])) is not None]
    if "@" in text:
        parted = [m for m in _PARTED.finditer(text) if "@" in m[0]]
        odd += [(at, at + 1, "") for m in parted for at in range(m.start() + 1, m.end(), 2)]
    return sorted(odd)


@cache
def referred(code: str) -> str | None:
    """The printable ASCII character that a character reference or a percent form stands for."""
    c = chr(int(code[1:], 16)) if code[0] == "%" else html.unescape(code)
    return c if len(c) == 1 and " " < c < "\x7f" else None


# Second transducer: states, and the token classes that lead on.
OUTSIDE, NUMBER, GAP, SIGN = range(4)


def digits(text: str) -> list[Edit]:
    """Second transducer: runs of spelled digits, and "plus" before a digit, token by token.

    A run begins with a spelled digit and goes on over a gap to a spelled digit or a figure; a run
    of one counts only beside the word "dot". What a run would write is held until it ends.
    """
    edits: list[Edit] = []
    held: list[Edit] = []
    state, sign, before = OUTSIDE, None, ""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]

    def end(after: str, gap: Edit | None) -> None:
        nonlocal held
        if len(held) == 1:
            beside = after == "dot" and gap is not None and gap[2].isspace() or before == "dot"
            held = held if beside and text[held[0][0] : held[0][1]].lower() != "oh" else []
        edits.extend(held)
        held = []

    gap: Edit | None = None
    last_word, last_gap = "", ""
    for a, b, token in tokens:
        low = token.lower()
        figure = SPELLED.get(low) or (token if token.isdigit() else None)
        spacing = token[0] in ",.-" or token[0].isspace()
        if state == SIGN and not spacing:
            if (figure is not None) and sign is not None:
                edits.append(sign)
            state, sign = OUTSIDE, None
        if state == NUMBER:
            if spacing:
                state, gap = GAP, (a, b, token)
                last_gap = token
                continue
            if token[0].isalpha() and text[held[-1][0] : held[-1][1]].isdigit():  # a figure that goes on in letters is no digit of its own
                held = held[:-2]
            end(low, None)
            state = OUTSIDE
        elif state == GAP:
            if figure is not None:
                held += [(gap[0], gap[1], ""), (a, b, figure)]
                state = NUMBER
                last_word, last_gap = low, ""
                continue
            end(low, gap)
            state = OUTSIDE
        if low in SPELLED:
            before = last_word if last_gap == " " else ""
            held, state = [(a, b, SPELLED[low])], NUMBER
        elif low == "plus":
            state, sign = SIGN, None
        elif state == SIGN and spacing and all(c.isspace() or c == "-" for c in token):
            sign = (a - 4, b, "+")
            continue
        if spacing:
            last_gap = token
        else:
            last_word, last_gap = low, ""
    if held:
        end("", None)
    return sorted(edits)


def spaced(text: str, a: int, b: int) -> tuple[int, int]:
    """The span with the white space around it."""
    while a > 0 and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    return a, b


def markers(text: str) -> list[Edit]:
    """Third transducer: from each at outward, over labels that plain or disguised dots join; disguised dots between figures as well.

    Each stretch of text is read at most twice, by the at before it and the at after it.
    """
    dots = [spaced(text, m.start(), m.end()) for m in _DOT.finditer(text)]
    edits = [(a, b, ".") for a, b in dots if a and b < len(text) and text[a - 1].isdigit() and text[b].isdigit()]
    starts, ends = {a: b for a, b in dots}, {b: a for a, b in dots}
    floor = 0
    for m in _AT.finditer(text):
        a, b = spaced(text, m.start(), m.end())
        if m[0] == "@" and (a, b) == m.span() and not dots:
            continue  # a plain address as it is
        left, used = a, []
        while left > floor:
            if text[left - 1] in _LOCAL_SET:
                left -= 1
            elif left < a and left in ends and ends[left] > floor and text[ends[left] - 1] in _LOCAL_SET and text[left] != ".":
                used.append((ends[left], left, "."))
                left = ends[left]
            else:
                break
        label = _LABEL.match(text, b)
        if left == a or label is None:
            continue
        first, right, bracket, worded, joints = label[0].lower(), label.end(), False, bool(used), 0
        while right < len(text):
            after = right + 1 if text[right] == "." else starts.get(right)
            label = _LABEL.match(text, after) if after else None
            if label is None:
                break
            bracket |= any(c in "[({<" for c in text[right:after])
            if text[right:after] != ".":
                used.append((right, after, "."))
                worded = True
            right, joints = label.end(), joints + 1
        if not joints:
            continue
        last, bare = label_before(text, right), m[0].lower() == "at"
        if bare and (first in PROSE or not (worded or _NAMED.search(text, left, a) or _CUE.search(text, max(0, left - _CUE_REACH), left))):
            continue
        # Every label of two letters may be a country's.
        if last in TOP_LEVEL or worded and len(last) == 2 and last.isalpha() or not (bare and not bracket) and len(last) > 1 and last[0].isalpha():
            edits += [*used, (a, b, "@")]
            floor = right
    return sorted(set(edits))


def label_before(text: str, end: int) -> str:
    a = end
    while a > 0 and (text[a - 1].isalnum() and text[a - 1].isascii() or text[a - 1] == "-"):
        a -= 1
    return text[a:end].lower()


def disguised_spans(text: str) -> list[list[tuple[int, int]]] | None:
    """The spans found after rewriting, or None where there is nothing to rewrite."""
    odd = characters(text)
    if not (odd or _HINT.search(text)):
        return None
    r = Rewritten(text)
    for edits in (lambda _: odd, digits, markers):
        if found := edits(r.text):
            r.replace(found)
    return [[r.source(a, b) for a, b in find(r.text)] for find in DETECTORS]


def apart(new: list[tuple[int, int]], old: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of `new` that overlap none of `old`, which are in order and apart."""
    starts = [a for a, _ in old]
    out = []
    for a, b in new:
        k = bisect_left(starts, b)  # those before begin ahead of b; the last of them ends last
        if k == 0 or old[k - 1][1] <= a:
            out.append((a, b))
    return out


def all_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans, and base with disguised spans, by kind and start."""
    base = base_spans(text)
    more = disguised_spans(text)
    if more is None:
        return base, base
    return base, [sorted(old + apart(new, old)) for old, new in zip(base, more, strict=True)]


def written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=True) for a, b in own)


def personal_spans(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: how many plain spans of each kind, their digest, and all spans."""

    def work(batch: pa.RecordBatch) -> list:
        counts: list[list[int]] = [[], [], [], []]
        digests, spans = [], []
        for x in texts_of(batch):
            base, both = all_spans(x)
            for c, own in zip(counts, base, strict=True):
                c.append(len(own))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(both))
        return [*counts, digests, spans]

    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return map_texts(df, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", names, work, doc_id=doc_id, text=text)


def redact(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: the text with every span replaced by its kind in angle brackets; of overlapping spans the first and longest."""

    def work(batch: pa.RecordBatch) -> list:
        out = []
        for x in texts_of(batch):
            at, parts = 0, []
            for a, b, k in sorted(((a, -b, k) for k, own in zip(KINDS, all_spans(x)[1], strict=True) for a, b in own)):
                if a >= at:
                    parts += [x[at:a], f"<{k}>"]
                    at = -b
            out.append("".join([*parts, x[at:]]))
        return [out]

    return map_texts(df, "doc_id long, text string", ["text"], work, doc_id=doc_id, text=text)
