"""All patterns over one text in one call: cheap tests first, then the forms, then the rules that drop look-alikes."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

from gleaner.functions import patterns as P

Span = tuple[str, int, int]

#: Opaque ids are made of these characters; a fragment of one is no finding of its own.
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.+=-")
#: Ends of a run count as opaque from so many bytes on.
_OPAQUE = 20
#: Characters before a finding in which a credential's field name is looked for.
_LOOKBACK = 48

# ------------------------------------------------------------------ tests: a text that fails one holds no match


class Facts:
    """What the tests of several patterns ask about one text, found once."""

    def __init__(self, text: str):
        self.text = text
        self.ascii = text.isascii()
        self._low: str | None = None
        self._run = -1

    @property
    def low(self) -> str:
        if self._low is None:
            self._low = self.text.lower() if self.ascii else self.text.casefold()
        return self._low

    @property
    def digit_run(self) -> int:
        """Length of the longest run of digits."""
        if self._run < 0:
            self._run = max(map(len, _DIGIT_RUNS.findall(self.text)), default=0)
        return self._run


_DIGIT_RUNS = re.compile(r"\d+")


def _has(*words: str) -> Callable[[Facts], bool]:
    return lambda f: any(w in f.text for w in words)


def _says(*words: str) -> Callable[[Facts], bool]:
    return lambda f: any(w in f.low for w in words)


def _digits(n: int) -> Callable[[Facts], bool]:
    return lambda f: f.digit_run >= n


def _like(form: str) -> Callable[[Facts], bool]:
    search = re.compile(form, re.I).search
    return lambda f: search(f.text) is not None


def _any(*tests: Callable[[Facts], bool]) -> Callable[[Facts], bool]:
    return lambda f: any(t(f) for t in tests)


def _all(*tests: Callable[[Facts], bool]) -> Callable[[Facts], bool]:
    return lambda f: all(t(f) for t in tests)


_MONTHS = _has("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
TESTS: dict[str, Callable[[Facts], bool]] = {
    "email": _has("@"),
    "phone_us": _all(_digits(4), _like(r"[2-9]\d\d\)?[-.\s]?[2-9]\d\d[-.\s]?\d{4}")),
    "phone_labelled": _all(_digits(1), _says("phone", "tel", "fax", "mobil", "handy", "cell")),
    "phone_intl": _has("+"),
    "ssn": _all(_digits(4), _like(r"\d{3}[-.\s]\d{2,3}[-.\s]\d{4}")),
    "ssn_nodash": _digits(9),
    "credit_card": _all(_digits(4), _like(r"[3-6]\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}")),
    "credit_card_nodash": _digits(15),
    "ipv4": _like(r"\d\.\d{1,3}\.\d"),
    "ipv6": _like(r":[0-9a-f]{1,4}:[0-9a-f]{1,4}:"),
    "mac": _like(r"[:-][0-9a-f]{2}[:-][0-9a-f]{2}[:-]"),
    "uuid": _like(r"-[0-9a-f]{4}-[0-9a-f]{4}-"),
    "jwt": _has("eyJ"),
    "vendor_secret": _has("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AIza", "hf_", "npm_", "pypi-", "k_live_", "k_test_", "whsec_", "SG.", "dop_v1_", "shpat_", "shpss_", "shpca_", "tskey-", "lin_api_", "gsk_"),
    "secret_assignment": _all(_says("passw", "secret", "token", "key"), _has(":", "=")),
    "url_credentials": _all(_has("://"), _has("@")),
    "private_key": _has("-----BEGIN"),
    "passport_us": _digits(8),
    "date": _any(_like(r"\d[-/.]\d{1,2}[-/.]\d"), _all(_digits(1), _MONTHS)),
    "time": _any(_like(r"\d(?::[0-5]|\s?[ap]m|\s+o'clock)"), _says("quarter", "half")),
    "username": _says("user", "login", "handle"),
    "home_dir": _says("users", "home", "volumes"),
    "unix_path": _has("/"),
    "twitter_handle": _has("@"),
    "social_handle": _has("@"),
    "social_url": _has("://"),
    "geocoord": _like(r"\.\d+\s*,"),
    "uk_nino": _like(r"\d\d\s?\d\d\s?\d\d\s?[a-d]"),
    "fr_nir": _like(r"[12]\s?\d\d\s?\d\d\s?\d\d\s?\d{3}\s?\d{3}"),
    "it_cf": _like(r"\d\d[a-z]\d\d[a-z]\d{3}"),
    "es_dni": _digits(7),
    "eu_id": _digits(6),
    "drivers_license": _any(_like(r"[a-z][.-]?\d\d"), _like(r"\b(?:d\.?l|lic)")),
}

# ------------------------------------------------------------------ rules: which matches stand


class Match:
    """A match in its text: the finding's own span, and the whole match around it."""

    __slots__ = ("text", "start", "end", "whole_start", "whole_end", "runs")

    def __init__(self, text: str, start: int, end: int, whole_start: int, whole_end: int, runs: list[int]):
        self.text, self.start, self.end, self.whole_start, self.whole_end, self.runs = text, start, end, whole_start, whole_end, runs

    @property
    def value(self) -> str:
        return self.text[self.start : self.end]

    @property
    def whole(self) -> str:
        return self.text[self.whole_start : self.whole_end]

    def run(self) -> tuple[int, int]:
        """The span with all id characters that go on at its sides; remembered, so that many matches of one run read it once."""
        t, lo, hi = self.text, self.start, self.end
        known = self.runs
        if not (known and known[0] <= lo and hi <= known[1]):
            while lo and t[lo - 1] in _RUN:
                lo -= 1
            while hi < len(t) and t[hi] in _RUN:
                hi += 1
            known[:] = [lo, hi] if all(c in _RUN for c in self.value) else []
            return lo, hi
        return known[0], known[1]


_LETTER, _BLANK = re.compile("[A-Za-z]"), re.compile(r"\s")
_FIELD = re.compile(f"(?:{'|'.join(P.CREDENTIAL_NAMES)})" + r"""[^A-Za-z0-9_\-]*[=:"' ,][^=:"' ,]*\Z""", re.I)


def part_of_id(m: Match) -> bool:
    """a piece of a longer opaque id, unless that id is the value of a credential's field."""
    lo, hi = m.run()
    if (lo, hi) == (m.start, m.end) or len(m.text[lo:hi].encode()) < _OPAQUE or not _LETTER.search(m.text, lo, hi) or _BLANK.search(m.value):
        return False
    return not _FIELD.search(m.text[max(0, m.start - _LOOKBACK) : m.start])


def part_of_number(m: Match) -> bool:
    """A decimal, a longer number or a chain of digit groups goes on at one of the sides."""
    left, right = m.text[max(0, m.start - 2) : m.start], m.text[m.end : m.end + 2]
    return left[-1:].isdecimal() or (left[:-1].isdecimal() and left[-1:] in tuple(".-/")) or right[:1].isdecimal() or (right[:1] in tuple(".-/,") and right[1:].isdecimal())


_STRIPPED = "\"'`"
# How a reference to a secret kept elsewhere is written.
_REFERENCE = re.compile(rf"(?:{'|'.join(map(re.escape, P.REFERENCE_SCHEMES))})|process\.env\.|os\.environ|env\[|\$\{{|\{{\{{|<.*>\Z|%.+%\Z", re.I | re.S)
_MASK = re.compile(r"[*.\-_#]+\Z")
_ONLY_X = re.compile(r"[xX]{3,}\Z")
_PART = re.compile("[A-Za-z0-9]+")


def no_secret(value: str) -> bool:
    """a reference, a mask, or words of a sample with nothing random among them."""
    v = value.strip(_STRIPPED)
    if _REFERENCE.match(v) or "getenv(" in v.lower() or _MASK.match(v) or _ONLY_X.match("".join(c for c in v if c.isalnum())):
        return True
    words = _PART.findall(v)
    return any(w.lower() in P.PLACEHOLDER_WORDS or _ONLY_X.match(w) for w in words) and not any(len(w) >= 8 and not w.isalpha() and not w.isdigit() for w in words)


# Networks that name no public host.
LOCAL_NETWORKS = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"
_LOCAL = [(int(n[0]), int(n[-1])) for n in map(ipaddress.ip_network, LOCAL_NETWORKS.split())]


def is_local(address: str) -> bool:
    """Private, reserved and documentation addresses, by their number."""
    n = 0
    for part in address.split("."):
        n = n * 256 + int(part)
    return any(low <= n <= high for low, high in _LOCAL)


def iban_end(m: Match) -> int | None:
    """Where the IBAN that begins at the match ends: cut at its country's length; null if length or checksum is wrong."""
    text, size = m.value, P.IBAN_LENGTHS.get(m.value[:2])
    if size and " " in text:
        size += (size - 1) // 4  # a blank after every fourth character
    taken = text[:size] if size else text
    letters = taken.replace(" ", "")
    right = len(letters) == P.IBAN_LENGTHS[letters[:2]] if size else 15 <= len(letters) <= 34
    if not right or text[len(taken) : len(taken) + 1].strip():
        return None
    number = int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4]))
    return m.start + len(taken) if number % 97 == 1 else None


_AFTER_SCHEME = re.compile(r"://[^/@ \t\n]+:\Z")
_HEX, _INNER_PATH, _ENTITY = re.compile("[0-9a-f]{7,}"), re.compile("/.*/"), re.compile(r"&[A-Za-z0-9#]{2,8};")


def _good_mail(m: Match) -> bool:
    local, _, domain = m.value.partition("@")
    top = domain.rpartition(".")[2].lower()
    if local == "git" or top in P.FILE_EXTENSIONS or not top.isalpha():
        return False
    return not _AFTER_SCHEME.search(m.text[m.text.rfind("://", 0, m.start) : m.start] if m.text[m.start - 1 : m.start] == ":" else "")


def _good_api_key(m: Match) -> bool:
    v = m.value
    bare = v.strip(".,;")
    return len(v) >= 12 and not no_secret(v) and not (_HEX.fullmatch(bare.lower()) or bare.startswith(("/", "~/")) or _INNER_PATH.search(v) or _ENTITY.search(v))


_NAMED_KEY = re.compile(r"([A-Z][A-Z0-9_]*_KEY)\s*[:=]")
_CREDENTIAL_KEY = re.compile("PASSWORD|PASSWD|SECRET|TOKEN|API_KEY|APIKEY|ACCESS_KEY|PRIVATE_KEY")


def _good_assignment(m: Match) -> bool:
    key = _NAMED_KEY.match(m.whole)
    return not no_secret(m.value) and not (key and key[1].endswith(tuple(P.IDENTIFIER_KEYS)) and not _CREDENTIAL_KEY.search(key[1]))


def _good_url_password(m: Match) -> bool:
    v, user = m.value.lower(), m.whole.partition("://")[2].partition(":")[0].lower()
    return v != user and v not in P.DEFAULT_URL_PASSWORDS and not no_secret(m.value)


_DOMAIN_TAIL = re.compile(r"\.[a-z]{2,}", re.I)


def _good_handle(m: Match) -> bool:
    before = m.text[m.start - 1 : m.start] if m.start else ""
    return not (regex.match(r"[\p{L}\p{N}._+\-]", before) or _DOMAIN_TAIL.match(m.text, m.end))


RULES: dict[str, Callable[[Match], bool]] = {
    "email": _good_mail, "api_key": _good_api_key, "secret_assignment": _good_assignment, "url_credentials": _good_url_password,
    "ipv4": lambda m: not is_local(m.value), "twitter_handle": _good_handle, "social_handle": _good_handle,
    **dict.fromkeys(("phone_us", "phone_intl"), lambda m: not part_of_id(m) and not part_of_number(m)),
    **dict.fromkeys(("ssn", "ssn_nodash", "credit_card", "credit_card_nodash", "date", "time", "geocoord", "mac"), lambda m: not part_of_id(m)),
}

# ------------------------------------------------------------------ the scan

_MAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Forms the second engine runs faster on plain text.
_FASTER = {"email", "ipv4", "uuid", "ssn", "social_url", "url_credentials", "date"}


@lru_cache(maxsize=None)
def _compiled(name: str, plain: bool):
    form = P.BY_NAME[name].form.replace("$)", r"\Z)")
    if plain and name not in _FASTER:
        return re.compile(form.replace(r"\p{L}\p{N}\p{M}", "A-Za-z0-9"), re.ASCII)
    return regex.compile(form, regex.ASCII if plain else 0)


@lru_cache(maxsize=None)
def _mail_tail(plain: bool):
    return regex.compile(r"@[a-z0-9.-]+\.[a-z]{2,}\b", regex.I | (regex.ASCII if plain else 0)), regex.compile(r"\b", regex.ASCII if plain else 0)


def _mails(text: str, plain: bool) -> Iterator[tuple[int, int]]:
    """Matches of the email form, found from the ``@`` on both sides, so that long runs are read once."""
    tail, edge = _mail_tail(plain)
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _MAIL_LOCAL:
            start -= 1
        while start < at and not edge.match(text, start):
            start += 1
        m = tail.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


class Scanner:
    """Findings of the chosen patterns in a text."""

    def __init__(self, names: list[str] | None = None, private_ipv4: bool = False):
        self.names = [p.name for p in P.ALL if names is None or p.name in names]
        self.rules = {n: r for n, r in RULES.items() if n != "ipv4" or not private_ipv4}

    def matches(self, name: str, text: str, plain: bool) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, start of all, end of all) of every match of a form."""
        if name == "email":
            yield from ((a, b, a, b) for a, b in _mails(text, plain))
            return
        pairs = P.BY_NAME[name].pairs
        for m in _compiled(name, plain).finditer(text):
            k = next((2 * i + 2 for i in range(pairs) if m.group(2 * i + 2)), 0)
            yield *m.span(k), *m.span()

    def scan(self, text: str) -> Iterator[Span]:
        """(pattern, start, end) of every finding, in code points, pattern by pattern; findings may overlap."""
        facts = Facts(text)
        runs: list[int] = []
        for name in self.names:
            test = TESTS.get(name)
            if test and not test(facts):
                continue
            rule = self.rules.get(name)
            for a, b, lo, hi in self.matches(name, text, facts.ascii):
                m = Match(text, a, b, lo, hi, runs)
                if name == "iban":
                    b = iban_end(m)
                if b is not None and (rule is None or rule(m)):
                    yield name, a, b
