"""Personal data: format-preserving pseudonyms by keyed Feistel networks.

Numbers and dates are validated (checksums, ranges, the calendar), permuted within their own format by a
network keyed with a secret, and completed by new check digits, so a pseudonym is as valid as what it
stands for, and equal values have equal pseudonyms in every document.  A network of ``ROUNDS`` rounds
adds to one half a hash of key, kind, round and other half, so it can be undone with the key.
All of it is projections of built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: What may be personal data, tried in this order at each place; all but secrets, keys and mail addresses is then validated.
#: Those of RUNS match a whole run of groups, however long; where it is no value as a whole, values are looked for within.
#: Repeated groups are possessive or have a bound, since others recurse once a repeat: a long text would exhaust the stack.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,30}\.[A-Za-z]{2,}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_.-]{8,}",
    "iban": r"\b(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2})[A-Z0-9]++\b(?: [A-Z0-9]++\b)*+",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?:[ -][0-9]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
}
#: A group with the separator before it, by kind, and how many groups a value has at most.
RUNS = {"iban": (r" ?[A-Z0-9]+", 34), "card": (r"[ -]?[0-9]+", 19)}


def _stream(key: str, kind: str, i: Column, other: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string")), bits)


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of [0, a) x [0, b), as struct of l and r."""
    def step(s: Column, i: Column) -> Column:
        drawn = lambda x: F.conv(F.substring(_stream(key, kind, i, x, 256), 1, 15), 16, 10).cast("long")
        odd = F.struct(((s["l"] + drawn(s["r"])) % a).alias("l"), s["r"].alias("r"))
        even = F.struct(s["l"].alias("l"), ((s["r"] + drawn(s["l"])) % b).alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_text(text: Column, key: str, kind: str, *alphabets: str) -> Column:
    """A keyed permutation of all strings with the letters of each of ``alphabets`` at the same places."""
    def moved(half: Column, stream: Column) -> Column:
        def letter(c: Column, i: Column, bound: Column) -> Column:
            by = F.conv(F.substr(bound, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for letters in reversed(alphabets):
                at = F.instr(F.lit(letters), c)
                out = F.when(at > 0, F.substr(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
            return out

        return F.when(F.length(half) == 0, half).otherwise(let(stream, lambda x: F.array_join(F.transform(F.split(half, ""), lambda c, i: letter(c, i, x)), "")))

    def step(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), moved(s["l"], _stream(key, kind, i, s["r"], 512)).alias("r"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.left(text, half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _number(text: Column, start: int, size: int) -> Column:
    return F.substring(text, start, size).cast("long")


def _dressed(shape: Column, new: Column, kept: str) -> Column:
    """``shape`` with the characters of ``new`` in the places of those in the class ``kept``."""
    def at(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        place = F.length(F.regexp_replace(F.left(shape, i), f"[^{kept}]", ""))
        return F.when(c.rlike(f"[{kept}]"), F.substr(new, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def luhn_sum(digits: Column) -> Column:
    """The sum that a valid number's digits have as a multiple of ten."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod97(text: Column) -> Column:
    """Of the number that ``text`` is when letters count from A = 10."""
    def add(rest: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), rest * 10 + c.cast("int")).otherwise(rest * 100 + letter) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


#: Four hundred years of the calendar, from 1800 on, are 189 x 773 days.
_CYCLE, _FROM = (189, 773), "1800-01-01"
_FORMATS = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}


def _date_of(m: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(m, F.lit(mark)), F.try_to_timestamp(m, F.lit(form)).cast("date")) for mark, form in _FORMATS.items()))


def _new_date(m: Column, key: str) -> Column:
    a, b = _CYCLE
    days = F.datediff(_date_of(m), F.lit(_FROM).cast("date")).cast("long")
    block, within = F.floor(days / (a * b)), F.pmod(days, F.lit(a * b))

    def shown(p: Column) -> Column:
        new = F.date_add(F.lit(_FROM).cast("date"), (block * (a * b) + p["l"] * b + p["r"]).cast("int"))
        return F.coalesce(*(F.when(F.contains(m, F.lit(mark)), F.date_format(new, form)) for mark, form in _FORMATS.items()))

    return let(permute_pair(F.floor(within / b), within % b, a, b, key, "date"), shown)


def _new_card(m: Column, key: str) -> Column:
    def digits(d: Column) -> Column:
        body = F.concat(F.left(d, F.lit(1)), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", DIGITS))
        return let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return let(let(_digits(m), digits), lambda new: _dressed(m, new, "0-9"))


def _new_ip(m: Column, key: str) -> Column:
    part = F.split(m, r"\.")
    octet = lambda k: F.element_at(part, k).cast("long")
    split = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return let(permute_pair(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip"), lambda p: F.concat_ws(".", split(p["l"]), split(p["r"])))


def _new_phone(m: Column, key: str) -> Column:
    """The last ten digits: area and exchange within 200 to 999, and four digits; others digit by digit."""
    def parts(d: Column) -> Column:
        head, own = F.left(d, F.length(d) - 10), F.right(d, F.lit(10))
        area, exchange, line = _number(own, 1, 3) - 200, _number(own, 4, 3) - 200, _number(own, 7, 4)

        def shown(p: Column) -> Column:
            upper, lower = p["l"], p["r"]
            return F.concat(head, (F.floor(upper / 100) + 200).cast("string"), (upper % 100 * 8 + F.floor(lower / 10000) + 200).cast("string"), F.lpad((lower % 10000).cast("string"), 4, "0"))

        pair = permute_pair(area * 100 + F.floor(exchange / 8), exchange % 8 * 10000 + line, 80000, 80000, key, "phone")
        return F.when((area >= 0) & (exchange >= 0), let(pair, shown)).otherwise(F.concat(head, permute_text(own, key, "phone", DIGITS)))

    return let(let(_digits(m), parts), lambda new: _dressed(m, new, "0-9"))


def _new_ssn(m: Column, key: str) -> Column:
    area, group, serial = _number(m, 1, 3), _number(m, 5, 2), _number(m, 8, 4)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)

    def shown(p: Column) -> Column:
        high = F.floor(p["l"] / 99) + 1
        return F.concat_ws("-", F.lpad((high + F.when(high >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return let(permute_pair(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), shown)


def _new_iban(m: Column, key: str) -> Column:
    def built(bare: Column) -> Column:
        country, own = F.left(bare, F.lit(2)), F.substr(bare, F.lit(5), F.length(bare))

        def checked(x: Column) -> Column:
            return F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x)

        return let(permute_text(own, key, "iban", DIGITS, UPPER), checked)

    return let(let(F.replace(m, F.lit(" ")), built), lambda new: _dressed(m, new, "A-Z0-9"))


def _new_email(m: Column, key: str) -> Column:
    top = F.concat(F.lit("."), F.substring_index(m, ".", -1))
    return F.concat(permute_text(F.left(m, F.length(m) - F.length(top)), key, "email", DIGITS, LOWER, UPPER), top)


def _new_secret(m: Column, key: str) -> Column:
    own = F.regexp_extract(m, r"[A-Za-z0-9+/_.-]{8,}$", 0)

    def built(v: Column) -> Column:
        new = F.when(v.rlike("^[0-9a-f]+$"), permute_text(v, key, "secret", HEX)).otherwise(permute_text(v, key, "secret", DIGITS, LOWER, UPPER))
        return F.concat(F.left(m, F.length(m) - F.length(v)), new)

    return let(own, built)


def _valid_run(kind: str, m: Column) -> Column:
    """Whether these groups are one value of a kind of RUNS."""
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1*$"))
    return let(F.replace(m, F.lit(" ")), lambda x: F.length(x).between(15, 34) & x.rlike("^[A-Z]{2}[0-9]{2}") & (mod97(F.concat(F.substr(x, F.lit(5), F.length(x)), F.left(x, F.lit(4)))) == 1))


def _valid(kind: str, m: Column) -> Column:
    whole = m.rlike(f"^(?:{PATTERNS[kind]})$")
    if kind in RUNS:
        return whole & _valid_run(kind, m)
    if kind == "ip":
        return whole & F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
    if kind == "ssn":
        return whole & ~m.rlike("^(000|666|9..)|-00-|-0000$")
    if kind == "date":
        return whole & _date_of(m).isNotNull()
    return whole


def _kind(m: Column, kinds: tuple[str, ...]) -> Column:
    """The first of ``kinds`` whose validation ``m`` passes, or null."""
    return F.coalesce(*(F.when(_valid(kind, m), kind) for kind in kinds))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of this kind, in its format."""
    new: dict[str, Callable[[Column, str], Column]] = {
        "email": _new_email,
        "key": lambda m, key: F.concat(F.left(m, F.lit(4)), permute_text(F.substr(m, F.lit(5), F.length(m)), key, "key", DIGITS, UPPER)),
        "secret": _new_secret,
        "iban": _new_iban,
        "date": _new_date,
        "ssn": _new_ssn,
        "phone": _new_phone,
        "card": _new_card,
        "ip": _new_ip,
    }
    return F.coalesce(*(F.when(kind == name, of(m, key)) for name, of in new.items()))


def _piece(old: Column, kind: Column | None = None, rest: bool = False) -> Column:
    """A piece of text: a value of a kind, or what a run holds besides values (``rest``), or not matched."""
    return F.struct(old.alias("old"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"), F.lit(rest).alias("rest"))


def _within(m: Column, kind: str) -> Column:
    """Pieces of a run of groups: from left to right the longest valid stretch from each group on, and what lies between.

    The fold over the stretches holds places only, so a long run costs no more than its groups.
    """
    group, most = RUNS[kind]

    def parts(g: Column) -> Column:
        stretch = lambda i, j: F.ltrim(F.array_join(F.slice(g, i, j - i + 1), ""), F.lit(" -"))

        def reach(i: Column) -> Column:
            ends = F.sequence(F.least(F.size(g), i + most - 1), i, F.lit(-1))
            return F.try_element_at(F.filter(ends, lambda j: _valid_run(kind, stretch(i, j))), F.lit(1))

        def step(s: Column, x: Column) -> Column:
            return F.when(x["i"] > s["last"], F.struct(x["j"].alias("last"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)

        def woven(c: Column) -> Column:
            def around(k: Column) -> Column:
                last, now = F.coalesce(F.get(c["j"], k - 1), F.lit(0)), F.get(c, k)
                between = F.array_join(F.slice(g, last + 1, F.coalesce(now["i"], F.size(g) + 1) - last - 1), "")
                mark = F.regexp_extract(F.element_at(g, now["i"]), "^[ -]", 0)
                found = F.array(_piece(F.concat(between, mark), rest=True), _piece(stretch(now["i"], now["j"]), F.lit(kind)))
                return F.when(now.isNull(), F.array(_piece(between, rest=True))).otherwise(found)

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(c)), around))

        far = F.filter(F.transform(g, lambda _, i: F.struct((i + 1).alias("i"), reach(i + 1).alias("j"))), lambda x: x["j"].isNotNull())
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))
        return let(F.aggregate(far, start, step, lambda s: s["out"]), woven)

    return let(F.regexp_extract_all(m, F.lit(group), F.lit(0)), parts)


def _woven(between: Column, values: Column) -> Column:
    """One array of the arrays ``between`` and, after each but the last, those of ``values``."""
    return F.flatten(F.zip_with(between, values, lambda b, v: F.when(v.isNull(), b).otherwise(F.concat(b, v))))


def _searched(text: Column, kinds: tuple[str, ...]) -> Column:
    """``text`` in pieces: values of ``kinds``, and all else."""
    def pieces(m: Column) -> Column:
        out = F.array(_piece(m, _kind(m, tuple(k for k in kinds if k not in RUNS))))
        for kind in RUNS:
            if kind in kinds:
                out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), _within(m, kind)).otherwise(out)
        return out

    pattern = "|".join(PATTERNS[k] for k in kinds)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.array(_piece(g)))
    return _woven(gaps, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pieces))


def _searched_again(p: Column, kinds: tuple[str, ...]) -> Column:
    """The pieces with what lies between values joined and searched for ``kinds``, where a run may have hidden some."""
    mark, own = "\x00\x01", "\x00\x02"
    shown = F.transform(p, lambda x: F.when(x["kind"].isNull(), F.replace(x["old"], F.lit("\x00"), F.lit(own))).otherwise(F.lit(mark)))
    between = F.transform(F.split(F.array_join(shown, ""), r"\x00\x01", -1), lambda x: _searched(F.replace(x, F.lit(own), F.lit("\x00")), kinds))
    values = F.transform(F.filter(p, lambda x: x["kind"].isNotNull()), lambda x: F.array(x))
    return F.when(F.exists(p, lambda x: x["rest"] & (x["old"] != "")), _woven(between, values)).otherwise(p)


def protect(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and, last, ``pii_found``: the kinds found, in order of place.

    Null and empty texts stay as they are, with null and no kinds.  Rows stand alone; equal rows stay equal.
    Values that fail validation, and all other text, stay as they are.  Runs of groups that are no value as a
    whole are searched for cards and account numbers at group borders, and what is left of them, with the
    text around, for all other kinds.
    A column ``pii_found`` in ``docs`` is replaced.
    """
    own = [c for c in docs.columns if c != "pii_found"]
    text = docs[text_col]
    # Every pattern needs one of these.
    some = text.rlike(r"[0-9][ .-]?[0-9]|@|AKIA|ASIA") | text.rlike("(?i)password|passwd|pwd|token|secret|api.?key")
    done = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), text.alias("text"), F.when(some, _searched(text, tuple(PATTERNS))).alias("p"))
    for gone in (("iban",), ("iban", "card")):
        done = done.select("row", "text", _searched_again(F.col("p"), tuple(k for k in PATTERNS if k not in gone)).alias("p"))
    shown = F.transform("p", lambda x: F.coalesce(pseudonym(x["old"], x["kind"], key), x["old"]))
    new = F.coalesce(F.array_join(shown, ""), F.col("text"))
    kinds = F.coalesce(F.filter(F.col("p.kind"), lambda k: k.isNotNull()), F.when(F.col("text").isNotNull(), F.array().cast("array<string>")))
    return done.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own), kinds.alias("pii_found"))
