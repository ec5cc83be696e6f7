"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. A chain of transducers then normalises disguises:
characters that look like ASCII (fullwidth forms, Cyrillic and Greek look-alikes, foreign digits,
odd hyphens and spaces) become it one to one, invisible characters go, spelled digits become digits,
and at/dot disguises become signs. Each transducer keeps a piecewise map of offsets, identifiers are
detected again in the normalised text, and spans that a rewritten piece took part in are mapped back
to source characters and added. Base spans are never removed.

Defined cases: a null text counts as empty; repeated rows give repeated results; an empty table
gives no rows; further columns are ignored. Texts are handled whole; every scan is linear.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.arrow import map_texts, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        free, at = end, text.find("@", end)
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit of a number fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base identifiers of a text, kind by kind, leftmost and non-overlapping within a kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# --- transducer 1: characters, one to one ---------------------------------------------------

#: Characters drawn like an ASCII letter, beside the letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ｅ": "e", "٫": ".", "。": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "﹫": "@", "⊕": "+", "➕": "+",
}
_INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"


class _Characters(dict):
    """For ``str.translate``: look-alikes, and whatever compatibility maps to one ASCII character."""

    def __missing__(self, code: int):
        char = chr(code)
        to = LOOKALIKES.get(char)
        if to is None and char not in _INVISIBLE:
            if (digit := unicodedata.decimal(char, None)) is not None:
                to = str(digit)
            elif char.isspace():
                to = char if char in "\t\n\r\x0b\x0c" else " "
            else:
                flat = unicodedata.normalize("NFKC", char)
                to = flat if len(flat) == 1 and flat.isascii() else None
        self[code] = to or char
        return self[code]


_CHARACTERS = _Characters({i: chr(i) for i in range(0xA0)})
#: Anything outside Latin letters and common typography is worth the character transducer.
_ODD = re.compile("[^\x00-\x7f\xa1-\xac\xae-\xb1\xb4-\xb8\xbb\xbf-İĲ-ſ]")


# --- transducer 2: words, with a map of offsets ---------------------------------------------

#: Digit names in the four languages.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Names of the signs.
_AT, _DOT, _PLUS, _HYPHEN = "at|arroba|arobase|klammeraffe", "dot|punkt|punto|point", "plus|más|mas", "dash|hyphen|minus|guion|tiret|bindestrich"
#: Endings that make "x at y dot z" in plain words an address.
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv us uk eu de fr es it nl be ch at pt pl se no fi dk ie ca au nz jp cn in br mx ru test example invalid localhost".split())

_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
#: A whole run of digits and digit names, taken once (possessively); whether it holds a name is seen afterwards.
_DIGIT_RUN = re.compile(rf"(?<!\w)(?:{_WORD}|[0-9])(?!\w)(?:[\s,;/()-]{{1,3}}(?:{_WORD}|[0-9])(?!\w))++", re.IGNORECASE)
_ADDRESS_RUN = re.compile(rf"(?<!\w)(?:{_WORD}|[0-9]{{1,3}})(?:[ \t]+(?:{_DOT})[ \t]+(?:{_WORD}|[0-9]{{1,3}})){{3}}(?!\w)", re.IGNORECASE)
_UNIT = re.compile(rf"{_WORD}|[0-9]", re.IGNORECASE)
_NAME = re.compile(_WORD, re.IGNORECASE)
_PLUS_WORD = re.compile(rf"(?<!\w)(?:{_PLUS})[\s,]{{0,2}}(?=[0-9(])", re.IGNORECASE)
_BRACKET_AT = re.compile(rf"[\[({{<][ \t]*+(?:{_AT}|@)[ \t]*+[\])}}>]|(?<=\w)[_*-](?:{_AT})[_*-](?=\w)", re.IGNORECASE)
_BRACKET_DOT = re.compile(rf"[\[({{<][ \t]*+(?:{_DOT}|\.)[ \t]*+[\])}}>]", re.IGNORECASE)
_BRACKET_HYPHEN = re.compile(rf"[\[({{<][ \t]*+(?:{_HYPHEN}|-)[ \t]*+[\])}}>]", re.IGNORECASE)
_PLAIN_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]++(?:{_DOT})[ \t]++(?=[A-Za-z0-9])", re.IGNORECASE)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,2}@[ \t]{0,2}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \t]{0,2}@[ \t]{1,2}(?=[A-Za-z0-9])")
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]++(?:{_AT})[ \t]++(?=([A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+))", re.IGNORECASE)
_STRONG = re.compile("[0-9._%+-]")
#: What betrays a disguise: the names above, each kind looked for closely only where one of its words occurs.
_TO_SPACES = str.maketrans({i: " " for i in range(128) if not chr(i).isalpha()})
_DIGIT_NAMES, _AT_NAMES, _DOT_NAMES, _PLUS_NAMES, _HYPHEN_NAMES = (frozenset(x) for x in (DIGITS, _AT.split("|"), _DOT.split("|"), _PLUS.split("|"), _HYPHEN.split("|")))
_DIGIT_HINT = re.compile(rf"(?<!\w)(?:{_WORD})[\s,;/()-]{{1,3}}(?:{_WORD}|[0-9])|(?<!\w)[0-9][\s,;/()-]{{1,3}}(?:{_WORD})(?!\w)", re.IGNORECASE)
_AT_HINT = re.compile(rf"[\[({{<_*-][ \t]*+(?:{_AT})[ \t]*+[\])}}>_*-]|[A-Za-z0-9][ \t]++(?:{_AT})[ \t]++[A-Za-z0-9-]++[.]", re.IGNORECASE)
_SIGN_HINT = re.compile(r"[\[({<][ \t]*+[@.-][ \t]*+[\])}>]|[ \t]@|@[ \t]")
_HYPHEN_HINT = re.compile(rf"[\[({{<][ \t]*+(?:{_HYPHEN})[ \t]*+[\])}}>]", re.IGNORECASE)
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")
_OWN_DOT = ""


class Pieces:
    """A text under rewriting, with the source span of every rewritten piece."""

    def __init__(self, text: str):
        self.text = text
        self.pieces: list[tuple[int, int, int, int]] = []  # in the new text from, to; in the source from, to

    def source(self, at: int, stop: bool) -> int:
        """Place in the source of a boundary in the new text; inside a piece, its outer edge."""
        i = bisect.bisect_right(self.pieces, (at, 1 << 60, 0, 0)) - 1
        if i < 0:
            return at
        a, b, c, d = self.pieces[i]
        if at >= b:
            return d + at - b
        return d if stop and at > a else c

    def touched(self, start: int, stop: int) -> bool:
        i = bisect.bisect_left(self.pieces, (stop, -1, -1, -1)) - 1
        return i >= 0 and (self.pieces[i][1] > start or self.pieces[i][0] > start)

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str | None], blanks: bool = False) -> bool:
        """Replace matches; None keeps one. A match that a piece crosses takes the piece in.

        With ``blanks`` the spaces and tabs around a match go with it.
        """
        out: list[str] = []
        fresh: list[tuple[int, int, int, int]] = []
        last, shift, changed = 0, 0, []
        for m in pattern.finditer(self.text):
            if (new := to(m)) is not None:
                start, stop = m.span()
                if blanks:
                    while start > last and self.text[start - 1] in " \t":
                        start -= 1
                    while stop < len(self.text) and self.text[stop] in " \t":
                        stop += 1
                out += [self.text[last:start], new]
                a = start + shift
                fresh.append((a, a + len(new), self.source(start, False), self.source(stop, True)))
                changed.append((start, stop, len(new)))
                shift += len(new) - (stop - start)
                last = stop
        if not fresh:
            return False
        out.append(self.text[last:])
        kept, k, moved = [], 0, 0
        for a, b, c, d in self.pieces:
            while k < len(changed) and changed[k][1] <= a:
                moved += changed[k][2] - (changed[k][1] - changed[k][0])
                k += 1
            if k < len(changed) and b > changed[k][0]:
                continue  # inside a rewritten match
            kept.append((a + moved, b + moved, c, d))
        self.text, self.pieces = "".join(out), sorted(kept + fresh)
        return True


def _plain_at(m: re.Match) -> str | None:
    domain = m[1]
    if _OWN_DOT in domain:
        return "@" if re.split(f"[.{_OWN_DOT}]", domain)[-1].lower() in ENDINGS else None
    start = m.start()
    while start > 0 and m.string[start - 1] in _LOCAL:
        start -= 1
    strong = _STRONG.search(m.string, start, m.start()) and domain.rsplit(".", 1)[-1].lower() in ENDINGS
    return "@" if strong else None


def _spelled(m: re.Match) -> str | None:
    """The digits of a run that holds a digit's name; a run of digits alone stays."""
    return "".join(DIGITS.get(u.lower(), u) for u in _UNIT.findall(m[0])) if _NAME.search(m[0]) else None


def suspect(text: str) -> bool:
    """Whether one of the rewrites may find something in a text as it is."""
    if ("@" in text or "." in text or "-" in text) and _SIGN_HINT.search(text):
        return True
    if any(c in text for c in "İıſK"):  # equal to ASCII letters when case is ignored
        return True
    words = set(text.lower().translate(_TO_SPACES).split())
    if not words.isdisjoint(_DOT_NAMES):
        return True
    if not words.isdisjoint(_DIGIT_NAMES) and _DIGIT_HINT.search(text):
        return True
    if not words.isdisjoint(_AT_NAMES) and _AT_HINT.search(text):
        return True
    if not words.isdisjoint(_PLUS_NAMES) and _PLUS_WORD.search(text):
        return True
    return bool(not words.isdisjoint(_HYPHEN_NAMES) and _HYPHEN_HINT.search(text))


def normalise(text: str) -> Pieces | None:
    """The text without disguises and the map back to it; None where nothing is disguised."""
    flat = text if text.isascii() or not _ODD.search(text) else text.translate(_CHARACTERS)
    if flat is text and not suspect(text):
        return None
    p = Pieces(flat)
    p.rewrite(_HIDDEN, lambda m: "")
    p.rewrite(_DIGIT_RUN, _spelled)
    p.rewrite(_ADDRESS_RUN, lambda m: ".".join(DIGITS.get(w.lower(), w) for w in m[0].split()[::2]))
    p.rewrite(_PLUS_WORD, lambda m: "+")
    p.rewrite(_BRACKET_HYPHEN, lambda m: "-", blanks=True)
    p.rewrite(_BRACKET_DOT, lambda m: ".", blanks=True)
    p.rewrite(_BRACKET_AT, lambda m: "@", blanks=True)
    p.rewrite(_SPACED_AT, lambda m: "@")
    p.rewrite(_PLAIN_DOT, lambda m: _OWN_DOT)
    p.rewrite(_PLAIN_AT, _plain_at)
    p.text = p.text.replace(_OWN_DOT, ".")
    return p if p.pieces or p.text != text else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a whole text, in source characters."""
    base = detect(text)
    p = normalise(text)
    if p is None:
        return base, []
    had: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}  # base spans by kind lie apart and in order
    for kind, a, b in base:
        had[kind][0].append(a)
        had[kind][1].append(b)
    added: list[Span] = []
    for kind, a, b in detect(p.text):
        start, stop = p.source(a, False), p.source(b, True)
        if p.touched(a, b) or text[start:stop] != p.text[a:b]:
            starts, stops = had[kind]
            i = bisect.bisect_right(starts, start) - 1
            inside = i >= 0 and stop <= stops[i]
            if not inside and not (added and added[-1][0] == kind and added[-1][1] <= start and stop <= added[-1][2]):
                added.append((kind, start, stop))
    return base, added


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def summary(text: str) -> tuple:
    base, added = find(text)
    counts = [sum(s[0] == k for s in base) for k in KINDS]
    return (*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added))


def redact(text: str) -> str:
    """The whole text with every identifier, disguised or not, replaced by its kind in brackets."""
    base, added = find(text)
    out, last = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if b <= last:
            continue
        out += [text[last : max(a, last)], f"<{kind.upper()}>" if a >= last else ""]
        last = b
    return "".join([*out, text[last:]])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: base counts by kind, a digest of the base spans, and all spans."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
    schema = f"`{doc_id}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(docs, summary, [doc_id], text, schema, names, [pa.int64()] * 4 + [pa.string()] * 2)


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with identifiers masked in ``text`` (null stays null) and ``n_chars`` brought up to date."""
    mask = F.pandas_udf(lambda s: s.map(lambda t: redact(t) if t else t), "string")
    out = small_batches(docs).withColumn(text, mask(F.col(text)))
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
