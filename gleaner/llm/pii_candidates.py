"""Candidate spans of personal information in one text, on a folded copy with a map back to the text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .confusables import prototype

CLASSES = ("email", "phone", "id_number", "address", "person")

_MARK = re.compile("[̀-ͯ]")
_cache: dict[str, str] = {}


def _fold_char(ch: str) -> str:
    to = _cache.get(ch)
    if to is None:
        _cache[ch] = to = "ss" if ch == "ß" else _MARK.sub("", unicodedata.normalize("NFD", "".join(prototype(c) for c in prototype(ch))))
    return to


def fold(text: str) -> tuple[str, list[int] | range]:
    """``text`` with look-alikes settled and accents and invisible characters gone; and where each of its characters was."""
    if text.isascii():
        return text, range(len(text))
    out, at = [], []
    for i, ch in enumerate(text):
        for c in _fold_char(ch):
            out.append(c)
            at.append(i)
    return "".join(out), at


def folded(text: str) -> str:
    return fold(text)[0]


def _alt(words: str) -> str:
    return "|".join(re.escape(folded(w)) for w in sorted(words.split(), key=len, reverse=True))


LETTER = r"(?:[^\W\d_]|[ऀ-ॣॱ-ॿ])"
_W = rf"{LETTER}(?:{LETTER}|['’\-](?={LETTER}))*"

# Words of addresses, by their place in it.
_EN_END = _alt("road street lane drive avenue close row ropewalk way court square terrace crescent walk gardens place boulevard mews")
_FIRST = _alt("calle c/ paseo plaza avenida travesía via viale corso piazza vicolo largo rua beco travessa rue chemin impasse quai allée boulevard place улица ул. переулок проспект площадь")
_LAST = _alt("улица переулок проспект मार्ग गली टोला पथ नगर रोड")
_JOINED = _alt("straße strasse str. gasse weg platz allee rain ring damm ufer laan kade straat plein gracht singel dijk turfweg")
_UNIT = _alt("flat apartment apt. apt unit suite फ्लैट मकान")
_BOX = r"(?:p\.?\s?o\.?\s?box|b\.?p\.?|postfach|postbus|apartado(?: de correos)?|casella postale|caixa postal|a/я|а/я|पोस्ट बॉक्स)"
_SMALL = r"(?:de|des|del|della|delle|dei|do|da|dos|das|du|la|las|le|les|los|lo|aux|au|der|den|dem|d'|l')"
# Endings of file names that look like the end of a mail domain.
_FILES = frozenset("png jpg jpeg gif svg webp css js ts py rs md json html txt pdf csv xml yml yaml log".split())
# Number words of spoken digits, particles of names.
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
PARTICLES = frozenset("van von de da der den del della dell di du do dos das la le ter ten zu af al el y e dell' d'".split())

_LOCAL, _LABEL = r"(?<![\w.+%\-])\w[\w.+%\-]*", r"[A-Za-z0-9](?:[\w\-]*[A-Za-z0-9])?"
_EMAIL = [
    (2, re.compile(rf"{_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.([A-Za-z]{{2,}})\b")),
    (2, re.compile(rf"{_LOCAL}\s?[\[({{]\s?at\s?[\])}}]\s?{_LABEL}(?:(?:\.|\s?[\[(]dot[\])]\s?| dot ){_LABEL})*(?:\.|\s?[\[(]dot[\])]\s?| dot )([A-Za-z]{{2,}})\b", re.I)),
    (1, re.compile(rf"{_LOCAL} at {_LABEL}(?: dot {_LABEL})* dot ([A-Za-z]{{2,}})\b", re.I)),
]
_PHONE = [
    (2, 9, re.compile(r"(?<![\w+.\-/])\+\d{1,3}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\d{1,11}){1,6}(?!\w|[.\-/]\d)")),
    (2, 10, re.compile(r"(?<![\w+.\-/])00\d{1,3}(?:[ .\-/]?\d{1,6}){2,6}(?!\w|[.\-/]\d)")),
    (2, 10, re.compile(r"(?<![\w+.\-/])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\w|[.\-/]\d)")),
    (1, 9, re.compile(r"(?<![\w+.\-/])0\d{1,4}(?:[ .\-/]?\d{2,8}){1,5}(?!\w|[.\-/]\d)")),
    (2, 0, re.compile(rf"\b{_DIGIT}(?:,? {_DIGIT}){{6,14}}\b", re.I)),
]
_ID = [
    (2, re.compile(r"(?<![\w\-.+/])\d{3}([- ])\d{2}\1\d{4}(?![\w\-/]|\.\d)")),
    (2, re.compile(r"(?<![\w\-.+/])[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z](?![\w\-/])", re.I)),
    (2, re.compile(r"(?<![\w\-.+/])[A-Z]{2}-\d{3}-\d{3}-\d{2}(?![\w\-/])", re.I)),
    (2, re.compile(r"(?<![\w\-.+/])\d{8}-[A-Z](?![\w\-/])", re.I)),
    (1, re.compile(r"(?<![\w\-.+/])(?:[A-Z] ?\d{7,8}|[A-Z]{2}\d{7}|\d{7}[A-Z]{2})(?![\w\-/])", re.I)),
    (1, re.compile(r"(?<![\w\-.+/])(?:\d{9}|\d{11})(?![\w\-/]|\.\d)")),
    (1, re.compile(r"(?<![\w\-.+/=])(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z\d]{9,10}(?![\w\-/]|\.\w)", re.I)),
]
_NO = r"(?:,?\s*(?:n\.?\s?[º°o]\.?|n\.|nr\.?|no\.?|№|д\.|дом))?"
_TAIL = r"\d{1,4}(?:\s?bis\b|[a-z](?!\w)|/[a-z](?!\w)|-\d{1,3}(?!\w))?(?:,\s*(?:hinterhaus|vorderhaus|кв\.?\s*\d+|\d{1,2}\.?\s?[º°]\.?\s*(?:esq\.?|dto\.?|dir\.?|fte\.?|[a-z](?!\w))))?".replace("кв", folded("кв")).replace("д", folded("д"))
_NO = _NO.replace("дом", folded("дом")).replace("д", folded("д"))
_HEAD = rf"(?:(?:{_UNIT})\s*\d{{1,4}},\s*)?(?:\d{{1,4}}(?:\s?bis|\s?[a-z])?,?\s+)?"


def lowered(f: str) -> str:
    """Small letters, code point by code point, so that offsets stay."""
    low = f.lower()
    return low if len(low) == len(f) else "".join(c.lower() if len(c.lower()) == 1 else c for c in f)


# Forms of streets, for text in small letters: engines are faster where case need not be ignored.
_NAMED = rf"(?:{_FIRST})\s*(?:{_SMALL}\s*)*{_W}(?:[\s'](?:{_SMALL}[\s'])*{_W})"
_BOXES = re.compile(rf"(?<![\w.]){_BOX}\s*\d{{2,6}}(?!\w)")
_NUMBERED = re.compile(rf"(?<![\w.\-/#])\d{{1,4}}(?:\s?bis|[a-z])?,?\s+(?:(?:{_W}\s+){{1,3}}(?:{_EN_END})\b|{_NAMED}{{0,2}}|(?:{_W}\s+){{1,3}}(?:{_LAST}))(?!\w)")
_ENDING = re.compile(rf"(?<![\w\-/])(?:{_NAMED}{{0,2}}?|{_W}\s+(?:{_LAST})|(?:(?:am|oude|nieuwe|{_W}er)\s+)?(?:{LETTER}+(?:{_JOINED})|(?:{_W}er\s+)(?:{_JOINED}))){_NO}\s*,?\s*{_TAIL}(?![\w.\-]*@)(?!\w)")
#: Without one of these no street known by its kind alone can match.
_KIND_END = re.compile(rf"(?:{_JOINED}|{_LAST}){_NO}\s*,?\s*\d")
_KIND_FIRST = re.compile(rf"(?<!\w)(?:{_FIRST})\s*\w")
_RUN = re.compile(r"[^\W\d_]+")


def street_key(street: str) -> str:
    """The longest run of letters of a street: no text without it holds the street."""
    return max(_RUN.findall(street), key=lambda w: (len(w), w), default="")


@lru_cache(maxsize=4096)
def _known(streets: tuple[str, ...]) -> re.Pattern:
    known = "|".join(re.escape(s).replace(r"\ ", r"\s+") for s in sorted(streets, key=len, reverse=True))
    return re.compile(rf"(?<![\w/]){_HEAD}(?:{known})(?!\w)(?:{_NO}\s*,?\s*{_TAIL})?(?!\w)")


class Streets:
    """Known streets (in small letters), found by an automaton over their keys."""

    def __init__(self, streets):
        import ahocorasick

        held: dict[str, list[str]] = {}
        for s in streets:
            if key := street_key(s):
                held.setdefault(key, []).append(s)
        self.automaton = ahocorasick.Automaton()
        for key, own in held.items():
            self.automaton.add_word(key, tuple(own))
        self.empty = not held
        if held:
            self.automaton.make_automaton()

    def in_text(self, low: str) -> tuple[str, ...]:
        """Streets whose key the text holds."""
        return () if self.empty else tuple(sorted({s for _, own in self.automaton.iter(low) for s in own}))


def addresses(low: str, known: tuple[str, ...]):
    """(strength, match) of streets and boxes in a text in small letters; ``known`` are the listed streets that may be in it."""
    for m in _BOXES.finditer(low):
        yield 2, m
    if known:
        for m in _known(known).finditer(low):
            yield 2, m
    for m in _NUMBERED.finditer(low):
        yield 1, m
    if _KIND_END.search(low) or _KIND_FIRST.search(low):
        for m in _ENDING.finditer(low):
            yield 1, m


_TOKEN = re.compile(_W)
_PERSON = re.compile(r"[NL](?:_I)*c[NF](?:_[IN])*|(?:[NFL]|I)_(?:[NFLI]_)*(?:P_){0,3}[NFL]|[NFL]")


def name_sequences(f: str, names: dict[str, str]):
    """(start, end, parts) of names in folded text: words of ``names`` (word: F, L or N for both) with initials and particles between."""
    marks, spans = [], []
    end = None
    for m in _TOKEN.finditer(f):
        a, b = m.span()
        w = m.group().lower()
        gap = f[end:a] if end is not None else "|"
        if spans:
            first = marks[-1] == "I"
            marks.append("_" if gap in (" ", "  ") or first and gap in (". ", ".") else "c" if gap == ", " else "|")
        kind = names.get(w)
        if kind is None and len(w) == 1 and f[b : b + 1] == "." and m.group().isupper() | (f == f.lower()):
            kind = "I"
        elif kind is None and (w in PARTICLES or w.endswith("'")):
            kind = "P"
        elif kind and (a and f[a - 1] in "@._/\\" or f[b : b + 1] in tuple("@_/\\") or f[b : b + 1] == "." and f[b + 1 : b + 2].isalnum()):
            kind = None
        marks.append(kind or "O")
        spans.append((a, b))
        end = b + 1 if f[b : b + 1] == "'" and w in ("dell", "d") else b
        if w in ("dell", "d") and f[b : b + 1] == "'":
            marks[-1] = "P"
    code = "".join(marks)
    for m in _PERSON.finditer(code):
        i, j = m.start() // 2, (m.end() - 1) // 2
        if m.start() % 2 == 0:
            a, b = spans[i][0], spans[j][1]
            if marks[2 * j] == "I" and f[b : b + 1] == ".":
                b += 1
            yield a, b, j - i + 1


_BRACKETED_AT, _DIGIT_ANY = re.compile(r"[\[({]\s?at\s?[\])}]", re.I), re.compile(r"\d")


def candidates(f: str, names: dict[str, str], streets: Streets) -> list[tuple[int, int, str, int]]:
    """(start, end, class, strength) of every candidate in folded text; strength 2 for a telling form, 1 for a weak one."""
    out = []
    low = lowered(f)
    tests = ("@" in f, _BRACKETED_AT.search(f) is not None, " at " in low and " dot " in low)
    for (strength, p), there in zip(_EMAIL, tests):
        if there:
            for m in p.finditer(f):
                if m.group(1).lower() not in _FILES:
                    out.append((*m.span(), "email", strength))
    numbers = _DIGIT_ANY.search(f) is not None
    for strength, digits, p in _PHONE:
        if numbers if digits else "," in f or " " in f:
            for m in p.finditer(f):
                if not digits or digits <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((*m.span(), "phone", strength))
    if numbers:
        for strength, p in _ID:
            for m in p.finditer(f):
                if strength == 2 or sum(c.isdigit() for c in m.group()) >= 1:
                    out.append((*m.span(), "id_number", strength))
        for strength, m in addresses(low, streets.in_text(low)):
            if any(c.isdigit() for c in m.group()):
                out.append((*m.span(), "address", strength))
    for a, b, parts in name_sequences(f, names):
        out.append((a, b, "person", 2 if parts > 1 else 1))
    return out
