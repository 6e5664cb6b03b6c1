"""Public transaction data sets as pseudo-statements: one account-like key and one month.

Each loader reads an all-text CSV, so nothing is inferred, and keeps the groups large
enough to be compared within. Header names are looked at on the driver, rows never.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import categorize, joined, redact
from ..functions.values import (default_currency, expense_category, flow_sign, is_income,
                                is_outflow, strip, year_month)
from ..operators.skew import keep_groups
from ..schema import ACCOUNT_NAMES, MONEY, NAME_PROBES, NOTE_NAMES

_TIMESTAMPS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy",
               "M/d/yyyy H:mm")
_DAY_FIRST = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm",
              "d-M-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy", "d-MMM-yyyy",
              "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _day(text: Column, layouts: tuple[str, ...]) -> Column:
    bare = strip(text)
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)).cast("date") for f in layouts])


def _two_digit_year(day: Column) -> Column:
    """Years 69 to 99 belong to the last century."""
    return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)


def _number(text: Column) -> Column:
    return strip(text).try_cast("double")


def _finish(rows: DataFrame, group: list[Column], min_all: int, min_outflows: int) -> DataFrame:
    """source_file = the group's key; only groups with enough rows stay."""
    named = rows.select(
        F.concat_ws("/", *group).alias("source_file"), "txn_date", "description", "amount",
        default_currency(F.lit(None).cast("string")).alias("currency"), "category",
        is_outflow(F.col("amount")).alias("is_outflow"))
    counted = F.col("is_outflow") if min_outflows else F.lit(True)
    return keep_groups(named, ["source_file"], counted, min_outflows or min_all)


def cards_by_city(cards: DataFrame) -> DataFrame:
    """Card spending: Date (d-MMM-yy), City, Card Type, Exp Type, Amount; (city, month)
    with at least 5 rows. All rows are spending, in whole units."""
    text = F.concat(F.col("Exp Type"), F.lit(" spend "), F.col("Card Type"), F.lit(" card "),
                    F.col("City"))
    rows = cards.select(
        "City", _two_digit_year(F.try_to_date("Date", "d-MMM-yy")).alias("txn_date"),
        redact(text).alias("description"),
        (-F.abs(_number(F.col("Amount")).cast("bigint"))).cast(MONEY).alias("amount"),
        F.col("Exp Type").alias("kind"))
    rows = rows.where(F.col("txn_date").isNotNull() & F.col("amount").isNotNull())
    rows = rows.withColumn(
        "category", expense_category(F.col("kind"), categorize(F.col("description"))))
    return _finish(rows, [F.col("City"), year_month(F.col("txn_date"))], 5, 0)


def household_daily(ledger: DataFrame) -> DataFrame:
    """Household ledger: Date (day first), Mode, Category, Subcategory, Note, Amount,
    Income/Expense; (mode, month) with at least 5 outflows."""
    income = F.lower(strip(F.coalesce(F.col("`Income/Expense`"), F.lit("")))) == "income"
    size = F.abs(_number(F.col("Amount"))).cast(MONEY)
    text = joined([F.col("Category"), F.col("Subcategory"), F.col("Note")])
    rows = ledger.select(
        "Mode", _day(F.col("Date"), _DAY_FIRST).alias("txn_date"),
        redact(text).alias("description"),
        F.when(income, size).otherwise(-size).cast(MONEY).alias("amount"),
        income.alias("income"))
    rows = rows.where(F.col("txn_date").isNotNull() & F.col("amount").isNotNull()
                      & F.col("Mode").isNotNull())
    rows = rows.withColumn("category", F.when(F.col("income"), F.lit("income"))
                           .otherwise(categorize(F.col("description"))))
    return _finish(rows, [F.col("Mode"), year_month(F.col("txn_date"))], 0, 5)


def _first_with(columns: list[str], probe: str) -> str | None:
    return next((c for c in columns if any(part in c for part in NAME_PROBES[probe])), None)


def _cell(frame: DataFrame, name: str | None) -> Column:
    """A column by its tidied name; null when the layout has none."""
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")


def generic_bank(bank: DataFrame) -> DataFrame:
    """Bank export whose columns are found by name: date, amount, type, description and
    account; (account, month) with at least 5 outflows. Empty when the layout has no date
    or no amount."""
    tidy = bank.toDF(*[c.strip().lower().replace(" ", "_") for c in bank.columns])
    names = tidy.columns
    day, amount = _first_with(names, "bank_day"), _first_with(names, "bank_amount")
    kind, detail = _first_with(names, "bank_kind"), _first_with(names, "bank_detail")
    account = next((c for c in ACCOUNT_NAMES if c in names), None)
    found = F.lit(bool(day and amount))
    raw = F.substring(_cell(tidy, detail), 1, 100)
    rows = tidy.where(found).select(
        _cell(tidy, account).alias("account"),
        _day(_cell(tidy, day), _TIMESTAMPS).alias("txn_date"),
        F.coalesce(redact(F.when((raw != "") & (F.lower(raw) != "nan"), raw)),
                   F.lit("transaction")).alias("description"),
        (F.abs(_number(_cell(tidy, amount))).cast(MONEY) * flow_sign(_cell(tidy, kind)))
        .cast(MONEY).alias("amount"))
    rows = rows.where(F.col("txn_date").isNotNull() & F.col("amount").isNotNull())
    if account:
        rows = rows.where(F.col("account").isNotNull())
    rows = rows.withColumn("category", categorize(F.col("description")))
    return _finish(rows, [F.col("account"), year_month(F.col("txn_date"))], 0, 5)


def personal_finance(money: DataFrame, run_date: str) -> DataFrame:
    """Personal ledger: amount, income/expense flag, category and notes found by name;
    a month with at least 3 outflows. Without a date column all rows form one group dated
    ``run_date``."""
    tidy = money.toDF(*[c.strip().lower() for c in money.columns])
    names = tidy.columns
    day, amount = _first_with(names, "ledger_day"), _first_with(names, "ledger_amount")
    flow = _first_with(names, "ledger_flow")
    notes = [c for c in NOTE_NAMES if c in names]
    income = is_income(_cell(tidy, flow)) if flow else F.lit(False)
    size = F.abs(_number(_cell(tidy, amount))).cast(MONEY)
    text = joined([_cell(tidy, _first_with(names, "ledger_category")), *[_cell(tidy, n) for n in notes]],
                  otherwise="")
    when = _day(_cell(tidy, day), _DAY_FIRST) if day else F.to_date(F.lit(run_date))
    rows = tidy.where(F.lit(bool(amount))).select(
        when.alias("txn_date"),
        F.when(text == "", F.lit("transaction")).otherwise(redact(F.substring(strip(text), 1, 100)))
        .alias("description"),
        F.when(income, size).otherwise(-size).cast(MONEY).alias("amount"),
        income.alias("income"))
    rows = rows.where(F.col("txn_date").isNotNull() & F.col("amount").isNotNull())
    rows = rows.withColumn("category", F.when(F.col("income"), F.lit("income"))
                           .otherwise(categorize(F.col("description"))))
    month = year_month(F.col("txn_date")) if day else F.lit("unknown")
    return _finish(rows, [month], 0, 3)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Statements of several loaders in one frame."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
