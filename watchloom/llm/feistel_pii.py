"""Format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that pass their format's own test (Luhn, mod 97, octet ranges, the calendar) are replaced by
others of the same format that pass it too. The replacement is a keyed permutation of the format's valid values, so
equal values stay equal across documents and across ways to write them, different ones stay different, and the key's holder can undo it.

The permutation P is a Feistel network over mixed-radix halves with a keyed hash as round function; values
outside an odd-shaped domain are permuted again until they fall inside (cycle walking). What is used is x -> P'(P(x) + 1):
one cycle through the whole domain, so that no value is ever its own pseudonym.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8


class Permutation:
    """Keyed permutation of 0..size-1 without fixed points (size 1 apart)."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = math.isqrt(size - 1) + 1
        self.hash = hashlib.blake2b(key=key[:64], person=hashlib.blake2b(f"{tweak}|{size}".encode(), digest_size=16).digest(), digest_size=16)

    def _f(self, i: int, x: int) -> int:
        h = self.hash.copy()
        h.update(b"%d|%d" % (i, x))
        return int.from_bytes(h.digest(), "big") % self.half

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.half)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = (b - self._f(i, a)) % self.half, a
            else:
                a, b = b, (a + self._f(i, b)) % self.half
        return a * self.half + b

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x

    def shift(self, x: int, by: int) -> int:
        return self._walk((self._walk(x, False) + by) % self.size, True)


@functools.lru_cache(maxsize=256)
def _permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


@functools.lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """What a letter or digit may become: a-z or 0-9; beyond ASCII the characters of its kind among the 256 code points of its block."""
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"
    first, kind = ord(c) & ~0xFF, unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind)


def _permute_chars(text: str, key: bytes, tweak: str, by: int) -> str:
    """Permutes letters and digits within their alphabets at their places; all else, and the case of ASCII letters, stays."""
    low = [c.lower() if c.isascii() else c for c in text]
    alphabets = [_alphabet(c) for c in low if c.isalnum()]
    if not alphabets:
        return text
    x, size = 0, 1
    for alphabet, c in zip(alphabets, (c for c in low if c.isalnum())):
        x, size = x * len(alphabet) + alphabet.index(c), size * len(alphabet)
    form = "".join("d" if a[0] == "0" else "a" if a[0] == "a" else f"u{ord(a[0]):x}" for a in alphabets)
    x = _permutation(key, f"{tweak}|{form}", size).shift(x, by)
    out = []
    for alphabet in reversed(alphabets):
        x, r = divmod(x, len(alphabet))
        out.append(alphabet[r])
    new = iter(reversed(out))
    return "".join((lambda o: o.upper() if c.isascii() and c.isupper() else o)(next(new)) if c.isalnum() else c for c in text)


def _fill_digits(form: str, digits: str) -> str:
    d = iter(digits)
    return "".join(next(d) if c.isdigit() else c for c in form)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _ip(s: str, key: bytes, by: int) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = functools.reduce(lambda a, p: a * 256 + int(p), parts, 0)
    x = _permutation(key, "ipv4", 1 << 32).shift(x, by)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _card(s: str, key: bytes, by: int) -> str | None:
    digits = "".join(c for c in s if c.isdigit())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = f"{_permutation(key, 'card', 10 ** (len(digits) - 1)).shift(int(digits[:-1]), by):0{len(digits) - 1}d}"
    return _fill_digits(s, payload + luhn_digit(payload))


#: How cards of 13 to 19 digits are usually printed, as lengths of groups.
CARD_GROUPS = [(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 6, 4), *((n,) for n in range(13, 20))]


def _cards(run: str) -> Iterator[tuple[int, int]]:
    """Spans of a run of digit groups that may be cards, the likeliest first: groups as printed on cards, then any groups of 13 to 19 digits in all."""
    groups = [m.span() for m in re.finditer(r"[0-9]+", run)]
    sizes = [b - a for a, b in groups]
    for form in CARD_GROUPS:
        for i in range(len(groups) - len(form) + 1):
            if tuple(sizes[i : i + len(form)]) == form:
                yield groups[i][0], groups[i + len(form) - 1][1]
    for i in range(len(groups)):
        total = 0
        for j in range(i, len(groups)):
            total += sizes[j]
            if total > 19:
                break
            if total >= 13:
                yield groups[i][0], groups[j][1]


#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _ibans(run: str) -> Iterator[tuple[int, int]]:
    """As many letters and digits as the country's IBANs have; of other countries, in capitals, 34 down to 15 that end at a group."""
    at = [i for i, c in enumerate(run) if c.isalnum()]
    n = IBAN_LENGTHS.get(run[:2].upper())
    for size in [n] if n else range(34, 14, -1) if run.isupper() else []:
        if size <= len(at) and (size == len(at) or at[size] > at[size - 1] + 1):
            yield 0, at[size - 1] + 1


def _iban(s: str, key: bytes, by: int) -> str | None:
    flat = s.replace(" ", "").upper()
    if not 15 <= len(flat) <= 34 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    rest = _permute_chars(flat[4:], key, "iban" + flat[:2], by)
    new = iter(flat[:2] + iban_check(flat[:2], rest) + rest)
    return "".join(c if c == " " else next(new).lower() if c.islower() else next(new) for c in s)


_SSN_AREAS = [a for a in range(1, 900) if a != 666]


def _ssn(s: str, key: bytes, by: int) -> str | None:
    area, group, serial = (int(s[i:j]) for i, j in ((0, 3), (4, 6), (7, 11)))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(_permutation(key, "ssn", len(_SSN_AREAS) * 99 * 9999).shift(x, by), 9999)
    area, group = divmod(x, 99)
    return f"{_SSN_AREAS[area]:03d}{s[3]}{group + 1:02d}{s[6]}{serial + 1:04d}"


#: Country calling codes of two digits; those that begin with 1 or 7 have one, all others three.
COUNTRY_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phones(run: str) -> Iterator[tuple[int, int]]:
    """A number from its start on, to the end of a group, longer ones first."""
    for m in reversed(list(re.finditer(r"[0-9]+", run))):
        yield 0, m.end()


def _phone(s: str, key: bytes, by: int) -> str | None:
    digits = "".join(c for c in s if c.isdigit())
    head = 0 if s[0] != "+" else 1 if digits[0] in "17" else 2 if digits[:2] in COUNTRY_CODES else 3
    if not 7 <= len(digits) - head <= 12:
        return None
    rest = digits[head:]
    return _fill_digits(s, digits[:head] + f"{_permutation(key, 'phone', 10 ** len(rest)).shift(int(rest), by):0{len(rest)}d}")


#: Years that are permuted among themselves; all other years are too.
MODERN = range(1900, 2100)


def _shifted_day(day: dt.date, key: bytes, by: int) -> dt.date:
    """One permutation for all ways to write a date. A day of the month over 12 stays one, so month-first dates read as before, and years stay within MODERN or without."""
    modern, late = day.year in MODERN, day.day > 12
    first, days = (13, 19) if late else (1, 12)
    years = len(MODERN) if modern else 9999 - len(MODERN)
    year = day.year - MODERN.start if modern else day.year - 1 if day.year < MODERN.start else day.year - 1 - len(MODERN)
    x = (year * 12 + day.month - 1) * days + day.day - first
    while True:  # on along the cycle to the next day that the calendar has
        x = _permutation(key, f"date|{modern}|{late}", years * 12 * days).shift(x, by)
        rest, d = divmod(x, days)
        year, m = divmod(rest, 12)
        year = year + MODERN.start if modern else year + 1 if year + 1 < MODERN.start else year + 1 + len(MODERN)
        try:
            return dt.date(year, m + 1, d + first)
        except ValueError:
            continue


def _date(s: str, key: bytes, by: int) -> str | None:
    """ISO dates, and day-month-year or month-day-year with one kind of separator: the reading that the calendar allows, day first."""
    a, b, c = re.findall(r"[0-9]+", s)
    order = "YMD" if len(a) == 4 else "DMY" if int(b) <= 12 else "MDY"
    part = dict(zip(order, (a, b, c)))
    try:
        new = _shifted_day(dt.date(int(part["Y"]), int(part["M"]), int(part["D"])), key, by)
    except ValueError:
        return None
    return _fill_digits(s, "".join({"Y": f"{new.year:04d}", "M": f"{new.month:02d}", "D": f"{new.day:02d}"}[k] for k in order))


def _email(s: str, key: bytes, by: int) -> str | None:
    local, _, domain = s.rpartition("@")
    return f"{_permute_chars(local, key, 'email', by)}@{domain}"


def _secret(s: str, key: bytes, by: int) -> str | None:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        new = f"{_permutation(key, 'hex', 16 ** len(s)).shift(int(s, 16), by):0{len(s)}x}"
        return new.upper() if s.isupper() else new
    return _permute_chars(s, key, "secret", by)


def _all(run: str) -> Iterator[tuple[int, int]]:
    yield 0, len(run)


#: In order of precedence: what an earlier kind has replaced, a later one doesn't see. A pattern finds a run (its group ``v``, or all of it), the
#: next function the spans of the run to try, in order, and the last gives a span's pseudonym, or None if it isn't valid.
KINDS: list[tuple[str, str, Callable[[str], Iterator[tuple[int, int]]], Callable[[str, bytes, int], str | None]]] = [
    ("email", r"(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", _all, _email),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\b\s*[=:]\s*[\"']?)(?P<v>[A-Za-z0-9+/_\-]{8,})", _all, _secret),
    ("iban", r"\b[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}", _ibans, _iban),
    ("ip", r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\d]|\.\d)", _all, _ip),
    ("date", r"(?<!\d)(?:[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{2}(?P<s2>[-/.])[0-9]{2}(?P=s2)[0-9]{4})(?!\d)", _all, _date),
    ("ssn", r"(?<![\d\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d\-])", _all, _ssn),
    ("phone", r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}(?!\d)", _phones, _phone),
    ("card", r"(?<!\d)[0-9](?:[ \-\u00a0]?[0-9]){12,}(?!\d)", _cards, _card),
    ("phone_local", r"(?<![\d\w])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?!\d)", _all, _phone),
]
_COMPILED = [(name, re.compile(p), spans, f) for name, p, spans, f in KINDS]
_REPLACE = {name: f for name, _, _, f in KINDS}


def _hits(s: str, pattern: re.Pattern, spans, f, key: bytes, by: int) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) in s, in order. Where a run has no valid span the search goes on at its second character, or, as all spans of card runs are tried, after it."""
    out, at = [], 0
    while m := pattern.search(s, at):
        first, last = m.span("v") if "v" in pattern.groupindex else m.span()
        taken, found = bytearray(last - first), []
        for a, b in spans(s[first:last]):
            if not any(taken[a:b]) and (new := f(s[first + a : first + b], key, by)) is not None:
                taken[a:b] = b"\1" * (b - a)
                found.append((first + a, first + b, new))
        out += sorted(found)
        at = max(y for _, y, _ in found) if found else m.end() if spans is _cards else m.start() + 1
    return out


def pseudonymise(text: str | None, key: bytes, by: int = 1) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text, in order.

    A pseudonym depends on the key and the value only. by=-1 undoes by=1 where the new text's runs are read as the old one's were; restore() always does.
    """
    if not text or not ("@" in text or any(map(text.__contains__, "0123456789")) or "=" in text or ":" in text):
        return text, []
    pieces: list[tuple[str | None, str]] = [(None, text)]
    for name, pattern, spans, f in _COMPILED:
        after: list[tuple[str | None, str]] = []
        for kind, s in pieces:
            hits = _hits(s, pattern, spans, f, key, by) if kind is None else []
            at = 0
            for a, b, new in hits:
                after += [(None, s[at:a]), (name, new)]
                at = b
            after.append((kind, s[at:]))
        pieces = after
    out, found, at = [], [], 0
    for kind, s in pieces:
        if kind is not None:
            found.append((kind, at, len(s)))
        out.append(s)
        at += len(s)
    return "".join(out), found


def restore(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    """The text that pseudonymise() gave this text and these spans for."""
    out, at = [], 0
    for kind, start, length in spans:
        out += [text[at:start], _REPLACE[kind](text[start : start + length], key, -1)]
        at = start + length
    return "".join([*out, text[at:]])


def pseudonymise_documents(docs: DataFrame, key: bytes, *, text_col: str = "text", spans_col: str = "pii_spans", by: int = 1) -> DataFrame:
    """docs with text_col replaced by its pseudonymised text and spans_col added: array<struct<kind, start, length>>.

    Row by row, without a shuffle. Null texts stay null and empty ones empty, both without spans; whole texts
    are read however long. Equal values get equal pseudonyms everywhere under one key, so repeated rows stay alike. Where several spans
    of one run of digits are valid, those grouped as on cards go first, then earlier ones. An empty table gives an
    empty table. All other columns stay as they are, but a column named spans_col is replaced.
    """
    docs = docs.drop(spans_col)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text_col)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [pseudonymise(t, key, by) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            spans = pa.array([[{"kind": k, "start": s, "length": n} for k, s, n in x] for _, x in done], spans_type)
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*b.schema.names, spans_col])

    return docs.mapInArrow(run, f"{schema}, `{spans_col}` array<struct<kind:string,start:bigint,length:bigint>>")
