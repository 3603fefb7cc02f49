"""Amounts, currencies and dates as they are printed, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currencies that are recognised, and signs of some.
CURRENCIES = ("EUR", "USD", "GBP", "CHF", "JPY", "CAD", "AUD", "NZD", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF")
SIGNS = (("€", "EUR"), ("$", "USD"), ("£", "GBP"), ("¥", "JPY"))

#: A code point that is no character, for the places where plain texts are cut.
CUT = "\uffff"

DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./](?:\d{4}|\d{2})?"
#: A figure with two decimals or grouped thousands, with its sign or parentheses.
FIGURE = r"(?<![\p{L}\p{N}.,])(?:\(\s?)?[-+]?\s?(?:\d{1,3}(?:[.,' ]\d{3})+(?:[.,]\d{2})?|\d+[.,]\d{2})(?:\s?\)|-)?(?![\p{L}\p{N}]|[.,]\d)"


def plain(text: Column) -> Column:
    """Print variants of minus, blank and apostrophe as their ASCII signs, and another character for ``CUT``; the length stays."""
    return F.translate(text, f"\u2212\u2013\u2011\u00a0\u202f\u2007\u2019{CUT}", "---   '\ufffd")


def parts(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern, in a plain text; a split by a pattern would compile it for each row."""
    return F.split(F.regexp_replace(text, pattern, CUT), CUT, -1)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is named."""
    # a fold over nothing: an element taken out of an array would ask for the type of all that is inside, for each row anew
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed once a row: a later filter on them is not rewritten into what they are made of."""
    names = [c for c in rows.columns if c not in columns]
    return rows.select(*names, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_made")).select(*names, "_made.*")


def amount(raw: Column) -> Column:
    """A printed amount in whole cents; null without a digit.

    The last separator is the decimal sign, unless it is the only kind and three digits
    follow: then it groups thousands. Negative by a sign before or behind, or parentheses.
    """

    def read(s: Column) -> Column:
        negative = s.rlike(r"^\(.*\)$") | s.startswith("-") | s.rlike(r"-\s*$")
        return once(F.regexp_replace(s, r"[^0-9.,]", ""), lambda digits: F.when(digits.rlike("[0-9]"), F.when(negative, -1).otherwise(1) * once(F.regexp_extract(digits, r"[.,]([0-9]*)$", 1), lambda tail: cents(digits, tail))))

    def cents(digits: Column, tail: Column) -> Column:
        whole = ~digits.rlike("[.,]") | (~(digits.contains(".") & digits.contains(",")) & (F.length(tail) == 3))
        plain_digits = F.translate(digits, ".,", "")
        number = F.when(whole, plain_digits).otherwise(F.concat(F.left(plain_digits, F.length(plain_digits) - F.length(tail)), F.lit("."), tail))
        rounded = F.floor(F.regexp_replace(number, r"\.$", "").try_cast("decimal(30,6)") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("long")
        # whole numbers and two decimals, which most figures are, need no decimal arithmetic
        short = F.length(plain_digits) <= 15
        return F.when(short & whole, plain_digits.cast("long") * 100).when(short & (F.length(tail) == 2), plain_digits.cast("long")).otherwise(rounded)

    return once(F.trim(raw), read)


def currency(text: Column) -> Column:
    """The first recognised code, else the first sign in the order of ``SIGNS`` that occurs; null without either."""

    def read(t: Column) -> Column:
        codes = F.filter(F.regexp_extract_all(t, F.lit(r"(?<![\p{L}\p{N}])([A-Z]{3})(?![\p{L}\p{N}])"), F.lit(1)), lambda c: c.isin(*CURRENCIES))
        return F.coalesce(F.try_element_at(codes, F.lit(1)), *[F.when(t.contains(mark), code) for mark, code in SIGNS])

    return once(text, read)


def date(token: Column, month_first: Column | bool = False, year: Column | int | None = None, month: Column | int = 6) -> Column:
    """A printed date, null if it is none.

    A date without a full year takes century or year from the document's date ``year`` and
    ``month`` (and none without it); in January and February a date of November or December
    is of the year before, and the other way round.
    """
    month_first = month_first if isinstance(month_first, Column) else F.lit(month_first)
    anchor = F.lit(year).cast("int") if not isinstance(year, Column) else year
    near = F.lit(month) if not isinstance(month, Column) else month

    def read(t: Column) -> Column:
        at = lambda i: F.regexp_extract(t, r"^(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})?$", i)
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}\z"), t).otherwise(once(F.struct(at(1).try_cast("int").alias("a"), at(2).try_cast("int").alias("b"), at(3).alias("y")), day))

    def day(x: Column) -> Column:
        d, m, printed = F.when(month_first, x["b"]).otherwise(x["a"]), F.when(month_first, x["a"]).otherwise(x["b"]), x["y"]
        rolled = F.when((near <= 2) & (m >= 11), anchor - 1).when((near >= 11) & (m <= 2), anchor + 1).otherwise(anchor)
        y = F.when(F.length(printed) == 4, printed.try_cast("int")).when(F.length(printed) == 2, F.floor(anchor / 100) * 100 + printed.try_cast("int")).otherwise(rolled).cast("int")
        return F.when(x["a"].isNotNull(), F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), m.cast("string"), F.lit("-"), d.cast("string")))

    # a cast reads the same days as the pattern yyyy-MM-dd, without a formatter
    return once(token, read).try_cast("date")


def first_full_date(text: Column) -> Column:
    """The first date with a full year, as printed; the anchor of shorter ones."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)", 1), F.lit(""))


def cut(text: Column) -> Column:
    """A plain text cut at its figures, found in one pass: what is before the first, that figure, what is behind it, the next figure, and so on."""
    return F.split(F.regexp_replace(text, f"({FIGURE})", f"{CUT}$1{CUT}"), CUT, -1)


def figures(text: Column) -> Column:
    """All figures of a text from which the dates have been blanked."""
    return F.regexp_extract_all(without_dates(text), F.lit(f"({FIGURE})"), F.lit(1))


def without_dates(text: Column) -> Column:
    """The text with a blank for each date."""
    return F.regexp_replace(text, rf"(?<![\d.])(?:{DATE})(?![\d])", " ")


def first_date(text: Column) -> Column:
    """The first printed date of a text; empty without one."""
    return F.regexp_extract(text, rf"(?<![\d.])({DATE})(?!\d)", 1)


def last_amount(text: Column) -> Column:
    """The last figure of a text in cents."""
    return amount(F.try_element_at(figures(text), F.lit(-1)))


def last_integer(text: Column) -> Column:
    """The last whole number that stands beside a currency sign or code, in cents; a minus counts if it touches it, parentheses in any case."""
    codes = "|".join(CURRENCIES)
    number = r"(?:\(\s*)?-?(?<![\d.,])\d+(?![\d]|[.,]\d)"
    before = rf"(?:[€$£¥]\s*|(?<![\p{{L}}\p{{N}}])(?:{codes})\s+)({number}(?:\s*\)|-)?)"
    behind = rf"({number}(?:\s*\)|-)?)\s*(?:[€$£¥]|(?<=\s)(?:{codes})(?![\p{{L}}\p{{N}}]))"
    found = F.regexp_extract_all(without_dates(text), F.lit(f"{before}|{behind}"), F.lit(0))
    return amount(F.regexp_extract(F.try_element_at(found, F.lit(-1)), rf"({number}(?:\s*\)|-)?)", 1))


def total(text: Column) -> Column:
    """The printed total of a line: its last figure, else its last whole number beside a currency."""
    return F.coalesce(last_amount(text), last_integer(text))


def percent(text: Column) -> Column:
    """The first percentage of a text."""
    return F.regexp_replace(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)\s*%", 1), ",", ".").try_cast("double")
