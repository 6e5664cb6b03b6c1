"""Amounts, dates and flags: column in, column out."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES, DATE_FORMATS, EXPENSE_TYPES, FLOW_SIGNS, MONEY


# White space as Unicode has it.
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
         "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.btrim(text, F.lit(WHITE))


def parse_amount(text: Column) -> Column:
    """Money from text such as ``1,234.50`` or a rupee amount; null when it is none."""
    bare = strip(F.translate(strip(text), ",₹", ""))
    return F.when(~bare.isin("", "-", "nan", "None"), bare.try_cast(MONEY))


def parse_date(text: Column) -> Column:
    """The first of the accepted layouts that fits; null when none does.

    A text is only handed to layouts of its own shape: a failed parse costs an exception.
    """
    bare = strip(text)
    iso, dashes, slashes, us_slashes, month_dash, month_blank = DATE_FORMATS
    return (
        F.when(bare.rlike(r"^\d{4}-"), F.try_to_date(bare, iso))
        .when(bare.rlike(r"^\d{1,2}-\d"), F.try_to_date(bare, dashes))
        .when(bare.rlike(r"^\d{1,2}/\d"),
              F.coalesce(F.try_to_date(bare, slashes), F.try_to_date(bare, us_slashes)))
        .when(bare.rlike(r"^\d{1,2}-\D"), F.try_to_date(bare, month_dash))
        .when(bare.rlike(r"^\d{1,2}\s"),
              F.try_to_date(F.regexp_replace(bare, r"\s+", " "), month_blank)))


def signed_amount(has_amount: Column, amount: Column, debit: Column, credit: Column) -> Column:
    """The amount column where the layout has one, otherwise credit less debit."""
    zero = F.lit(0).cast(MONEY)
    spread = F.coalesce(credit, zero) - F.coalesce(debit, zero)
    return F.when(has_amount, F.coalesce(amount, zero)).otherwise(spread).cast(MONEY)


def is_outflow(amount: Column) -> Column:
    return amount < 0


def outflow_cents(amount: Column) -> Column:
    """Magnitude of an outflow in whole cents."""
    return (-amount * 100).cast("bigint")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def date_key(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def default_currency(currency: Column) -> Column:
    return F.coalesce(currency, F.lit("INR"))


def valid_category(category: Column) -> Column:
    """Null for a value outside the list."""
    return F.when(category.isin(*CATEGORIES), category)


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def category_key(category: Column) -> Column:
    """Serving key of a category; unknown and missing ones get the key of ``other``."""
    keys = {name: key for key, name in enumerate(CATEGORIES)}
    return F.coalesce(_lookup(keys, category), F.lit(keys["other"]))


def expense_category(kind: Column, otherwise: Column) -> Column:
    return F.coalesce(_lookup(EXPENSE_TYPES, kind), otherwise)


def flow_sign(kind: Column) -> Column:
    """+1 or -1 for a transaction type; unknown types are taken as spending."""
    return F.coalesce(_lookup(FLOW_SIGNS, F.lower(strip(kind))), F.lit(-1))


def is_income(flow: Column) -> Column:
    text = F.coalesce(F.lower(strip(flow)), F.lit(""))
    return text.contains("income") | text.isin("credit", "in", "+")


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    first, *rest = cases
    chain = reduce(lambda c, case: c.when(*case), rest, F.when(*first))
    return chain.otherwise(otherwise)
