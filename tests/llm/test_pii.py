"""Pseudonyms: what the formats' own tests accept never stays, equal values stay linked, and a second, plain version of the permutation agrees."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from watchloom.llm.feistel_pii import Permutation, pseudonymise, pseudonymise_documents, restore

KEY = b"key"
CARD = "4111 1111 1111 1111"
LEAKS = [
    "4111 1111 1111 1111 12/27", "4111 1111 1111 1111 123", "pay 4111-1111-1111-1111 2 items", "2 4111111111111111", "4111111111111111 0127", "order 77 4111 1111 1111 1111 cvv 123", "5551234 4111 1111 1111 1111",
    "4111 1111 1111 1111 1", "3782 822463 10005 9999", "01 02 03 04 4111111111111111 05 06",
    "GB82 WEST 1234 5698 7654 32 EUR", "IBAN GB82WEST12345698765432 BIC", "DE89 3704 0044 0532 0130 00 OK", "gb82 west 1234 5698 7654 32 and more", "IBAN: DE89370400440532013000, BIC COBADEFF",
    "+1 212 555 1234 2024 2025", "call +44 20 7946 0958 12 34",
]
VALUES = ["4111111111111111", "378282246310005", "GB82WEST12345698765432", "DE89370400440532013000", "12125551234", "442079460958"]


@pytest.mark.parametrize("text", LEAKS)
def test_no_valid_value_stays(text):
    flat = lambda t: re.sub(r"[^A-Z0-9]", "", t.upper())
    new, spans = pseudonymise(text, KEY)
    hidden = [v for v in VALUES if v in flat(text)]
    assert hidden and spans and not any(v in flat(new) for v in hidden)
    assert len(new) == len(text) and [c for c in new if not c.isalnum()] == [c for c in text if not c.isalnum()]
    assert restore(new, spans, KEY) == text


def test_values_are_linked_however_they_are_written():
    def one(text):
        new, ((_, start, n),) = pseudonymise(text, KEY)
        return new[start : start + n]

    digits = lambda t: re.sub(r"\D", "", one(t))
    assert len({digits(t) for t in (CARD, "4111-1111-1111-1111", "x 4111111111111111.", "4111 1111 1111 1111 12/27", "pay 4111-1111-1111-1111 2 items")}) == 1
    assert len({one(t).replace(" ", "").upper() for t in ("GB82 WEST 1234 5698 7654 32 EUR", "IBAN GB82WEST12345698765432 BIC", "gb82west12345698765432")}) == 1
    assert len({digits(t)[-10:] for t in ("+1 212 555 1234", "+12125551234", "(212) 555-1234", "212-555-1234")}) == 1
    for iso, dmy in (("1990-02-28", "28/02/1990"), ("1990-02-03", "03.02.1990"), ("1815-06-18", "18-06-1815"), ("2024-02-29", "29.02.2024")):
        a, b = one(iso), one(dmy)
        assert a.split("-") == re.findall(r"\d+", b)[::-1] and a != iso
    assert one("1999-12-31").split("-") == [one("12/31/1999").split("/")[i] for i in (2, 0, 1)]


def test_dates_and_locals_and_what_is_no_value():
    rnd = random.Random(1)
    for _ in range(300):
        y, m, d = rnd.randrange(1, 10000), rnd.randrange(1, 13), rnd.randrange(1, 29)
        text = rnd.choice([f"{y:04d}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y:04d}", f"{m:02d}/{d + 12 if d < 17 else d:02d}/{y:04d}"])
        new, spans = pseudonymise(text, KEY)
        assert new != text and len(spans) == 1 and pseudonymise(new, KEY, -1)[0] == text == restore(new, spans, KEY)
    new, _ = pseudonymise("jösé.ñandú@x.example", KEY)
    assert new.endswith("@x.example") and not set("öéñú") & set(new) and len(new) == len("jösé.ñandú@x.example")
    for text in ("4111111111111112", "300.1.1.1", "31/02/1999", "GB82 WEST 1234 5698 7654 33", "000-12-3456", "1 2 3 4 5 6 7", "", "v 1.2.3"):
        assert pseudonymise(text, KEY) == (text, [])


def _plain(key, tweak, size, x):
    """The permutation as the operator's text states it: a balanced network of eight rounds, walked into the domain; P backwards of P forwards plus one."""
    half = math.isqrt(size - 1) + 1
    person = hashlib.blake2b(f"{tweak}|{size}".encode(), digest_size=16).digest()
    f = lambda i, v: int.from_bytes(hashlib.blake2b(b"%d|%d" % (i, v), key=key, person=person, digest_size=16).digest(), "big") % half

    def forth(v):
        left, right = v // half, v % half
        for i in range(8):
            left, right = right, (left + f(i, right)) % half
        return left * half + right

    table = {}
    for v in range(size):
        w = forth(v)
        while w >= size:
            w = forth(w)
        table[v] = w
    back = {w: v for v, w in table.items()}
    return back[(table[x] + 1) % size]


def test_permutation_equals_a_plain_version():
    for size in (2, 10, 97, 676):
        assert [Permutation(b"k", "t", size).shift(x, 1) for x in range(size)] == [_plain(b"k", "t", size, x) for x in range(size)]


def test_rows(spark):
    rows = [(1, LEAKS[0], "x"), (2, None, "x"), (3, "", "x"), (1, LEAKS[0], "x"), (4, "1 2 " * 20_000 + CARD, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = pseudonymise_documents(d, KEY)
    assert got.columns == ["doc_id", "text", "pii_spans"]
    by = [r.asDict(True) for r in got.collect()]
    assert [r["doc_id"] for r in by] == [1, 2, 3, 1, 4] and by[0] == by[3] and (by[1]["text"], by[2]["text"]) == (None, "") and by[1]["pii_spans"] == by[2]["pii_spans"] == []
    for r, (_, text, _) in zip(by, rows):
        assert r["text"] == pseudonymise(text, KEY)[0] and (not text or restore(r["text"], [(s["kind"], s["start"], s["length"]) for s in r["pii_spans"]], KEY) == text)
    assert CARD not in by[4]["text"] and got.where(F.col("doc_id") < 0).count() == pseudonymise_documents(d.limit(0), KEY).count() == 0
