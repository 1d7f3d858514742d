"""Format-preserving pseudonyms for validated numbers and dates, with SQL functions only.

A keyed Feistel network permutes each value within its format: card numbers keep
their length, separators and a valid check digit; telephone numbers their country
code; addresses of machines stay dotted quads; social security numbers stay valid
ones; bank account numbers (IBAN) keep country, letters and valid check digits; dates become dates of 1900 to 2099 in the
same notation; the name before the @ of an e-mail address keeps its letter and digit places.  The rounds
are keyed by HMAC-SHA-256.  The permutation
depends on the key and the value's kind alone, so equal values get equal
pseudonyms in every document, whatever separators they are written with.

Candidates are found by one regular expression; a text is cut into matches and
what lies between, and put together again.  Numbers beside each other, with one blank or
hyphen between, are one match, in which card numbers (the longest valid one from each place on), dates,
social security and telephone numbers that start and end at separators are looked for.  Only texts with a digit or an @ are
searched.  Defined results: null texts stay null; values that fail validation
stay as they are; repeated rows change alike; other columns are kept, whatever their names.  Where a permutation
of a larger set is walked until the value is a valid one, the walk has no end but that (after
WALKS steps it fails rather than return another value).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ROUNDS = 8
#: Steps of a walk through values that are not valid; at most 1 of 9 values is not, so the short walk all but always does.
WALKS = (24, 100_000)
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DATE = r"(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: What a run of numbers must leave to the next match: values with other characters in them than digits, blanks and hyphens.
_OTHER = rf"(?:{EMAIL}|{IP}|(?=[0-9-]*[./]){DATE}|(?=\d{{3}}(?:\.|[ -]\d{{3}}\.)\d){PHONE})(?![0-9A-Za-z])"
_NUMBER = r"\d++(?![A-Za-z])"
#: Numbers beside each other that together have the digits of a card number.
RUN = rf"(?=\d(?:[ -]?\d){{12}}){_NUMBER}(?:(?:-| (?!{_OTHER})){_NUMBER})*+"
_MOST = 19
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
FOUND = rf"(?<![0-9A-Za-z.+-])(?:{EMAIL}|{IBAN}|{IP}|{DATE}|{SSN}|{PHONE}|{RUN})(?![0-9A-Za-z])"
_FIRST_DAY, _DAYS = "1900-01-01", 73_049  # to the end of 2099


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, as lowercase hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda by: F.lit(bytearray(b ^ by for b in raw))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))), 256)


def walked(start: Column, valid: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """The first valid value from start on, step by step."""
    on = lambda x, steps: F.aggregate(F.when(valid(x), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(steps))), x, lambda v, _: F.when(valid(v), v).otherwise(step(v)))
    short, long = WALKS
    return _with(on(start, short), lambda x: _with(on(x, long), lambda y: F.when(valid(y), y).otherwise(F.raise_error(F.lit("a walk did not end")))))


def _noise(key: str, kind: str, step: Column, value: Column) -> Column:
    """A number of 60 bits from the key, the kind of value, the round and the other half."""
    return F.conv(F.substring(hmac(key, F.concat_ws("|", F.lit(kind), step.cast("string"), value.cast("string"))), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Alternating Feistel rounds over two numbers below their sizes: a struct (l, r)."""

    def step(s: Column, i: Column) -> Column:
        new_l = F.pmod(s["l"] + _noise(key, kind, i, s["r"]), left_size)
        new_r = F.pmod(s["r"] + _noise(key, kind, i, s["l"]), right_size)
        even = i % 2 == 0
        return F.struct(F.when(even, new_l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(new_r).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _with(value: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def digits(value: Column, key: str, kind: str) -> Column:
    """A permuted string of as many digits (2 to 30)."""
    half = F.floor(F.length(value) / 2).cast("int")
    rest = F.length(value) - half
    size = lambda n: F.pow(F.lit(10.0), n).cast("long")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, rest)
    pair = feistel(left, right, size(half), size(rest), key, kind)
    return _with(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), rest, F.lit("0"))))


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(template: Column, value: Column) -> Column:
    """The template with its digits replaced in order by those of value."""
    chars = F.transform(F.sequence(F.lit(1), F.length(template)), lambda i: F.when(F.substring(template, i, F.lit(1)).rlike("[0-9]"), F.substring(value, F.length(_only_digits(F.substring(template, F.lit(1), i))), F.lit(1))).otherwise(F.substring(template, i, F.lit(1))))
    return F.array_join(chars, "")


def _luhn_sum(value: Column, double_last: bool) -> Column:
    """Sum of the check rule over a digit string; double_last: whether the last digit counts twice."""
    n = F.length(value)

    def part(i: Column) -> Column:
        d = F.substring(value, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == (0 if double_last else 1), twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x)


def _valid_card(d: Column) -> Column:
    return F.length(d).between(13, _MOST) & (_luhn_sum(d, False) % 10 == 0)


def _card(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _with(digits(payload, key, "card"), lambda p: F.concat(p, F.pmod(10 - _luhn_sum(p, True) % 10, F.lit(10)).cast("string")))
        return F.when(_valid_card(d), _with(new, lambda v: _refill(m, v))).otherwise(m)

    return _with(_only_digits(m), changed)


def _phone(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        country = F.substring(d, F.lit(1), F.length(d) - 10)
        return _refill(m, F.concat(country, digits(F.substring(d, F.length(d) - 9, F.lit(10)), key, "phone")))

    return _with(_only_digits(m), changed)


def _valid_ssn(d: Column) -> Column:
    return ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def _ssn(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        again = lambda x: digits(x, key, "ssn")
        return F.when(_valid_ssn(d), _with(_with(again(d), lambda x: walked(x, _valid_ssn, again)), lambda v: _refill(m, v))).otherwise(m)

    return _with(_only_digits(m), changed)


def _mod97(value: Column) -> Column:
    """A string of digits and letters (A is 10) modulo 97."""

    def add(a: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def changed(x: Column) -> Column:
        country, own = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        valid = (_mod97(F.concat(own, F.substring(x, 1, 4))) == 1) & (F.length(_only_digits(own)) >= 2)

        def renewed(new: Column) -> Column:
            check = 98 - _mod97(F.concat(_refill(own, new), country, F.lit("00")))
            return _refill(m, F.concat(F.lpad(check.cast("string"), 2, "0"), new))

        return F.when(valid, _with(digits(_only_digits(own), key, "iban"), renewed)).otherwise(m)

    return _with(F.replace(m, F.lit(" "), F.lit("")), changed)


def _ip(m: Column, key: str) -> Column:
    def changed(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, "ip")
        dotted = _with(pair, lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))
        return F.when(F.array_max(o) <= 255, dotted).otherwise(m)

    return _with(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), changed)


def _day(n: Column, key: str) -> Column:
    """A day number below _DAYS permuted: 271 * 270 numbers, walked until the result is a day."""

    def once(x: Column) -> Column:
        return _with(feistel(F.floor(x / 270), x % 270, F.lit(271), F.lit(270), key, "date"), lambda p: p["l"] * 270 + p["r"])

    return _with(once(n), lambda x: walked(x, lambda y: y < _DAYS, once))


def _date(m: Column, key: str) -> Column:
    """Year first, or day first; where the day cannot be one, month first."""

    def changed(d: Column) -> Column:
        iso = m.rlike("^[0-9]{4}")
        text = lambda a, b, c: F.concat_ws("-", a, b, c)
        y, x = F.substring(d, 5, 4), text(F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
        day_first = text(y, F.substring(d, 3, 2), F.substring(d, 1, 2))
        month_first = text(y, F.substring(d, 1, 2), F.substring(d, 3, 2))
        is_day_first = F.try_to_date(day_first, "yyyy-MM-dd").isNotNull()
        value = F.try_to_date(F.when(iso, x).when(is_day_first, day_first).otherwise(month_first), "yyyy-MM-dd")
        number = F.datediff(value, F.lit(_FIRST_DAY).cast("date")).cast("long")
        form = lambda v: F.when(iso, F.date_format(v, "yyyyMMdd")).when(is_day_first, F.date_format(v, "ddMMyyyy")).otherwise(F.date_format(v, "MMddyyyy"))
        new = _with(F.date_add(F.lit(_FIRST_DAY).cast("date"), _day(number, key).cast("int")), form)
        return F.when(number.between(0, _DAYS - 1), _with(new, lambda v: _refill(m, v))).otherwise(m)

    return _with(_only_digits(m), changed)


def _shifted(part: Column, other: Column, step: Column, key: str) -> Column:
    """Each letter or digit moved within its kind by a byte of the keyed digest of the other half."""
    noise = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), step.cast("string"), other), 256)

    def moved(i: Column) -> Column:
        c, by = F.substring(part, i, F.lit(1)), F.conv(F.substring(noise, (i * 2 - 1) % 64, F.lit(2)), 16, 10).cast("int")
        place = lambda first, n: F.char((F.ascii(c) - ord(first) + by) % n + ord(first))
        return F.when(c.rlike("[0-9]"), place("0", 10)).when(c.rlike("[a-z]"), place("a", 26)).when(c.rlike("[A-Z]"), place("A", 26)).otherwise(c)

    return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(part))), moved), ""))


def _email(m: Column, key: str) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.floor(F.length(name) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(s["l"], s["r"], i, key)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(_shifted(s["r"], s["l"], i, key)).alias("r"))

    start = F.struct(F.substring(name, F.lit(1), half).alias("l"), F.substring(name, half + 1, F.length(name)).alias("r"))
    return _with(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda p: F.concat(p["l"], p["r"], F.lit("@"), domain))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate value, or the value itself where it does not validate."""
    whole = lambda p: m.rlike(f"^{p}$")
    return F.when(m.contains("@"), _email(m, key)).when(m.rlike("^[A-Z]"), _iban(m, key)).when(whole(IP), _ip(m, key)).when(whole(DATE), _date(m, key)).when(whole(SSN), _ssn(m, key)).when(whole(PHONE), _phone(m, key)).otherwise(_card(m, key))


def _pieces(m: Column) -> Column:
    """A match cut into threes: what lies ahead, a value, the separator behind it."""

    def cut(parts: Column) -> Column:  # numbers, each with the separator behind it
        size = F.size(parts)
        joined = lambda i, n: F.array_join(F.slice(parts, i, n), "")

        def taken(i: Column) -> Column:
            """How many numbers a value that starts at number i has, or 0."""
            cards = F.filter(F.sequence(F.least(size - i + 1, F.lit(_MOST)), F.lit(1)), lambda n: _with(_only_digits(joined(i, n)), lambda d: F.when(F.length(d) <= _MOST, _valid_card(d)).otherwise(F.lit(False))))
            after_blank = (i == 1) | F.endswith(F.element_at(parts, F.greatest(i - 1, F.lit(1))), F.lit(" "))
            other = F.when(after_blank & joined(i, F.lit(3)).rlike(rf"^(?:{DATE}|{SSN}|{PHONE})(?![0-9A-Za-z])"), 3).otherwise(0)
            return F.coalesce(F.try_element_at(cards, F.lit(1)), other)

        found = F.filter(F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("i"), taken(i).alias("n"))), lambda x: x["n"] > 0)
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))

        def add(s: Column, x: Column) -> Column:
            value = joined(x["i"], x["n"])
            three = F.array(joined(s["next"], x["i"] - s["next"]), F.regexp_replace(value, "[ -]$", ""), F.regexp_extract(value, "[ -]$", 0))
            return F.when(x["i"] < s["next"], s).otherwise(F.struct((x["i"] + x["n"]).alias("next"), F.concat(s["out"], three).alias("out")))

        return F.aggregate(found, start, add, lambda s: F.concat(s["out"], F.array(joined(s["next"], size))))

    is_run = m.rlike("^[0-9 -]+$") & ~m.rlike(f"^(?:{DATE}|{SSN}|{PHONE})$")
    return F.when(is_run, _with(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), cut)).otherwise(F.array(F.lit(""), m, F.lit("")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the values in text replaced, and n_replaced, the number of values that changed (n_replaced_ where docs has such a column)."""
    held, new, whole, n, told = C.fresh(docs, "held_values", "new_values", "new_text", "n_changed", "n_replaced")
    searched = F.col("text").rlike("[0-9@]")
    values = F.when(searched, F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)))
    rows = docs.withColumn(held, F.when(F.size(values) > 0, F.transform(values, _pieces)))
    rows = rows.withColumn(new, F.transform(held, lambda m: F.transform(m, lambda x, i: F.when(i % 3 == 1, pseudonym(x, key)).otherwise(x))))
    between = F.split("text", FOUND, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.concat(F.transform(new, lambda m: F.array_join(m, "")), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = F.size(F.filter(F.zip_with(F.flatten(held), F.flatten(new), lambda a, b: a != b), lambda x: x))
    out = rows.withColumn(whole, F.when(F.col(new).isNotNull(), joined).otherwise(F.col("text"))).withColumn(n, F.when(F.col(new).isNotNull(), changed).otherwise(0))
    keep = [F.col(whole).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*keep, F.col(n).cast("int").alias(told))
