"""Pseudonyms against a plain Feistel network, and texts that are hard on patterns."""

import datetime
import hashlib
import random
import re

import pytest

from lodestone.llm import pii

KEY = "k"


def stream(kind, i, other, bits):
    return hashlib.new(f"sha{bits}", f"{KEY}|{kind}|{i}|{other}".encode()).hexdigest()


def pair(left, right, a, b, kind):
    for i in range(1, 9):
        if i % 2:
            left = (left + int(stream(kind, i, right, 256)[:15], 16)) % a
        else:
            right = (right + int(stream(kind, i, left, 256)[:15], 16)) % b
    return left, right


def text(whole, kind, *alphabets):
    left, right = whole[: len(whole) // 2], whole[len(whole) // 2 :]
    for i in range(1, 9):
        drawn, moved = stream(kind, i, right, 512), ""
        for k, c in enumerate(left):
            by = int(drawn[k % 64 * 2 :][:2], 16)
            own = next((x for x in alphabets if c in x), None)
            moved += own[(own.index(c) + by) % len(own)] if own else c
        left, right = right, moved
    return left + right


def dressed(shape, new, kept):
    it = iter(new)
    return "".join(next(it) if re.match(kept, c) else c for c in shape)


def plain(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        head, top = m.rsplit(".", 1)
        return text(head, kind, pii.DIGITS, pii.LOWER, pii.UPPER) + "." + top
    if kind == "key":
        return m[:4] + text(m[4:], kind, pii.DIGITS, pii.UPPER)
    if kind == "secret":
        own = re.search(r"[A-Za-z0-9+/_.-]{8,}$", m)[0]
        return m[: len(m) - len(own)] + (text(own, kind, pii.HEX) if re.fullmatch("[0-9a-f]+", own) else text(own, kind, pii.DIGITS, pii.LOWER, pii.UPPER))
    if kind == "iban":
        bare = m.replace(" ", "")
        new = text(bare[4:], kind, pii.DIGITS, pii.UPPER)
        check = 98 - int("".join(str(int(c, 36)) for c in new + bare[:2] + "00")) % 97
        return dressed(m, f"{bare[:2]}{check:02}{new}", "[A-Z0-9]")
    if kind == "date":
        form = {"-": "%Y-%m-%d", "/": "%m/%d/%Y", ".": "%d.%m.%Y"}[re.search("[-/.]", m)[0]]
        start = datetime.date(1800, 1, 1)
        block, within = divmod((datetime.datetime.strptime(m, form).date() - start).days, 189 * 773)
        a, b = pair(within // 773, within % 773, 189, 773, kind)
        return (start + datetime.timedelta(block * 189 * 773 + a * 773 + b)).strftime(form)
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        a, b = pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, kind)
        return f"{a // 99 + 1 + (a // 99 + 1 >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"
    if kind == "phone":
        area, exchange, line = int(digits[-10:-7]) - 200, int(digits[-7:-4]) - 200, int(digits[-4:])
        if area < 0 or exchange < 0:
            return dressed(m, digits[:-10] + text(digits[-10:], kind, pii.DIGITS), "[0-9]")
        a, b = pair(area * 100 + exchange // 8, exchange % 8 * 10000 + line, 80000, 80000, kind)
        return dressed(m, f"{digits[:-10]}{a // 100 + 200}{a % 100 * 8 + b // 10000 + 200}{b % 10000:04}", "[0-9]")
    if kind == "card":
        body = digits[0] + text(digits[1:-1], kind, pii.DIGITS)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        return dressed(m, body + str(-total % 10), "[0-9]")
    a, b, c, d = map(int, m.split("."))
    x, y = pair(a * 256 + b, c * 256 + d, 65536, 65536, kind)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def valid_card(r, n):
    body = "".join(r.choice(pii.DIGITS) for _ in range(n - 1))
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def values(r):
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    yield "email", pick(pii.LOWER + pii.UPPER, 5) + f".{r.randrange(99)}+x@" + pick(pii.LOWER, 6) + ".example.org"
    yield "key", "AKIA" + pick(pii.UPPER + pii.DIGITS, 16)
    yield "secret", "token=" + pick(pii.LOWER + pii.UPPER + pii.DIGITS, r.randrange(8, 200))
    yield "secret", "password: " + pick(pii.HEX, 40)
    own = pick(pii.DIGITS, 18)
    yield "iban", f"DE{98 - int(own + '131400') % 97:02}{own}"
    yield "date", (datetime.date(1801, 1, 1) + datetime.timedelta(r.randrange(140_000))).strftime(r.choice(["%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"]))
    yield "ssn", f"{r.randrange(1, 600):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10000):04}"
    yield "phone", f"+1 ({r.randrange(100, 1000)}) {r.randrange(100, 1000)}-{r.randrange(10000):04}"
    yield "card", valid_card(r, r.choice([13, 15, 16, 19]))
    yield "ip", ".".join(str(r.randrange(256)) for _ in range(4))


def test_pseudonyms_are_those_of_a_plain_network(spark):
    r = random.Random(11)
    found = [v for _ in range(12) for v in values(r)]
    df = spark.createDataFrame([(k, f"so {v} it") for k, (_, v) in enumerate(found)], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.protect(df, KEY).collect()}
    for k, (kind, value) in enumerate(found):
        assert got[k].pii_found == [kind] and got[k]["text"] == f"so {plain(kind, value)} it", (kind, value)


def test_no_text_exhausts_the_stack(spark):
    """Long texts of each pattern's own letters, a megabyte where no values are found in them."""
    n = 1_000_000
    long = ["x@" + "a." * (n // 2), "a@" * (n // 2), "x@" + "a" * n, "x@" + "a-" * (n // 2) + ".com", "1." * (n // 2), "7" * n, "AB12" * (n // 4), "+" * n, "(" * n, "AKIA" * (n // 4), "token " * (n // 6), "password" + " " * n, "12/" * (n // 3), "1-" * (n // 100)]
    some = ["8.8.8.8 " * 500, "bob@example.com " * 200, "4111 1111 1111 1111 " * 50, "AB12 3456 " * 300, "2001-02-03 " * 300, "token=" + "x" * n]
    df = spark.createDataFrame(list(enumerate([*long, *some])), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.protect(df, KEY).collect()}
    assert all(got[k]["text"] == t and got[k].pii_found == [] for k, t in enumerate(long) if not t.endswith(".com"))
    assert [len(got[len(long) + k].pii_found) for k in range(6)] == [500, 200, 50, 0, 300, 1]


def test_mail_addresses_end_where_their_domain_does(spark):
    cases = {"at bob@x.example.com.": "bob@x.example.com", "bob@x.com2": "bob@x.com", "bob@x.com-": "bob@x.com", "bob@x.com..no": "bob@x.com", "bob@x": None, "bob@-..com": None}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {x.doc_id: x["text"] for x in pii.protect(df, KEY).collect()}
    for k, (whole, value) in enumerate(cases.items()):
        assert got[k] == (whole.replace(value, plain("email", value)) if value else whole)


@pytest.mark.parametrize("column", ["text", "body"])
def test_no_rows(spark, column):
    empty = spark.createDataFrame([], f"doc_id long, {column} string, p int, row int")
    out = pii.protect(empty, KEY, column)
    assert out.count() == 0 and out.columns == [*empty.columns, "pii_found"]
