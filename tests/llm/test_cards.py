"""Card numbers next to other numbers, found without the operator's own expression."""

from __future__ import annotations

import pytest

from corvane.llm import pseudonyms

from .test_operators import feistel, luhn

CARD = "4111111111111111"


def changed(number):
    new = feistel(number[:-1], "key", "card")
    return new + str((10 - luhn(new + "0")) % 10)


def spaced(number):
    return " ".join(number[i : i + 4] for i in range(0, 16, 4))


def phone():
    p = feistel("7435553824", "key", "phone")
    return f"{p[:3]}-{p[3:6]}-{p[6:]}"


CASES = [
    (f"{spaced(CARD)} 123", f"{spaced(changed(CARD))} 123", 1),
    (f"{CARD} 12/27", f"{changed(CARD)} 12/27", 1),
    (f"12 {CARD}", f"12 {changed(CARD)}", 1),
    (f"1234 {spaced(CARD)}", f"1234 {spaced(changed(CARD))}", 1),
    (f"pay {CARD} 5500005555555559 now", f"pay {changed(CARD)} {changed('5500005555555559')} now", 2),
    (f"{CARD} 743-555-3824", f"{changed(CARD)} {phone()}", 2),
    (f"12 {CARD} 12abc", f"12 {changed(CARD)} 12abc", 1),
    ("4111111111111112 12 7", "4111111111111112 12 7", 0),
]


def test_cards_beside_short_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = pseudonyms.pseudonymise(df, "key").orderBy("doc_id").collect()
    assert [(r["text"], r["n_replaced"]) for r in got] == [(new, n) for _, new, n in CASES]


@pytest.mark.parametrize("after", ["10.0.0.25", "31.12.1999", "743.555.3824"])
def test_values_behind_a_card_are_not_swallowed(spark, after):
    df = spark.createDataFrame([(1, f"{CARD} {after}")], "doc_id long, text string")
    row = pseudonyms.pseudonymise(df, "key").first()
    assert row["text"].startswith(changed(CARD) + " ") and after not in row["text"] and row["n_replaced"] == 2


def test_long_runs_of_numbers(spark):
    t = " ".join(["7"] * 3000)
    row = pseudonyms.pseudonymise(spark.createDataFrame([(1, f"a{t} 8")], "doc_id long, text string"), "key").first()
    assert row["text"] is not None


def iban(country, own):
    number = "".join(str(int(c, 36)) for c in own + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{own}"


def test_bank_accounts_keep_country_letters_and_check_digits(spark):
    own = ["WEST12345698765432", "370400440532013000", "20041010050500013M02606"]
    good = [iban(c, o) for c, o in zip(("GB", "DE", "FR"), own, strict=True)]
    bad = good[0][:2] + f"{(int(good[0][2:4]) + 1) % 100:02d}" + good[0][4:]
    df = spark.createDataFrame([(i, f"pay to {t} now") for i, t in enumerate([*good, bad])], "doc_id long, text string")
    got = [r["text"][7:-4] for r in pseudonyms.pseudonymise(df, "key").orderBy("doc_id").collect()]
    assert got[3] == bad
    for old, new, o in zip(good, got, own, strict=False):
        digits = "".join(filter(str.isdigit, o))
        fill = iter(feistel(digits, "key", "iban"))
        assert new == iban(old[:2], "".join(next(fill) if c.isdigit() else c for c in o)) != old


def test_other_columns_survive_whatever_their_names(spark):
    names = ["n_replaced", "__values", "__new", "__text", "__n", "held_values", "new_text"]
    df = spark.createDataFrame([(1, "mail jo@ex.org", *range(7))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    row = pseudonyms.pseudonymise(df, "key").first()
    assert [row[n] for n in names] == list(range(7)) and row["n_replaced_"] == 1 and "jo@" not in row["text"]


def test_a_walk_ends_at_a_valid_value_only(spark):
    from pyspark.sql import functions as F

    step = lambda x: (x * 5 + 3) % 1024  # noqa: E731  a permutation of 1,024 numbers
    got = spark.range(0, 8).select("id", pseudonyms.walked(step(F.col("id")), lambda x: x < 8, step).alias("x")).collect()
    for i, x in got:
        y = step(i)
        while y >= 8:
            y = step(y)
        assert x == y
    assert len({r["x"] for r in got}) == 8
