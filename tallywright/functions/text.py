"""Redaction, rule categories, tokens and composed texts: all native expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORY_RULES, PII_RULES
from .values import first_match


def _apart(value: Column) -> Column:
    """``value``, worked out by a step of the plan of its own. Dozens of searches fused with the steps around
    them make one method that Java's compiler leaves alone as too long, five times slower; Spark
    doesn't fuse a lambda."""
    return F.get(F.transform(F.array(value), lambda v: v), 0)


def redact(text: Column, rules=PII_RULES) -> Column:
    """Replace personal data by ``<LABEL>``, one rule after the other.

    (?U) makes \\b, \\d and \\s follow Unicode. Every rule needs a digit or an @, so
    other texts skip the seven patterns.
    """
    masked = reduce(
        lambda t, rule: F.regexp_replace(t, "(?U)" + rule[1], f"<{rule[0]}>"), rules, text)
    return F.when(text.rlike(r"(?U)[@\d]"), masked).otherwise(text)


def categorize(description: Column, rules=CATEGORY_RULES) -> Column:
    """Category of the first keyword group found anywhere in the lower-cased text."""
    low = _apart(F.lower(description))
    cases = [(reduce(Column.__or__, [low.contains(word) for word in words]), F.lit(name))
             for name, words in rules]
    return first_match(cases, F.lit("other"))


def categorize_missing(category: Column, description: Column, rules=CATEGORY_RULES) -> Column:
    return F.coalesce(category, categorize(description, rules))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(0))


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda part: part != "")


def joined(parts: list[Column], otherwise: str = "transaction") -> Column:
    """The non-empty parts with blanks between; ``otherwise`` when there are none."""
    text = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")
    return F.when(text == "", F.lit(otherwise)).otherwise(text)


def index_line(day: Column, description: Column, amount: Column, category: Column) -> Column:
    """``date | description | amount | category``, the text a transaction is found by."""
    return F.concat_ws(" | ", day.cast("string"), F.coalesce(description, F.lit("")),
                       plain_number(amount), F.coalesce(category, F.lit("other")))


def plain_number(amount: Column) -> Column:
    """A money amount as a float prints it: no trailing zeros, at least one decimal."""
    text = amount.cast("decimal(18,2)").cast("string")
    return F.when(text.endswith("0"), F.left(text, F.length(text) - 1)).otherwise(text)


def whole(number: Column) -> Column:
    """Rounded half to even, as text."""
    return F.rint(number).cast("bigint").cast("string")


def grouped(number: Column) -> Column:
    """Rounded half to even, with thousands separators."""
    return F.format_number(F.rint(number).cast("bigint"), 0)
