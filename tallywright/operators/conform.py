"""Bronze text rows to typed transactions, rejects kept apart."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import categorize, categorize_missing, redact
from ..functions.values import default_currency, is_outflow, parse_amount, parse_date, strip
from ..functions.values import signed_amount
from ..schema import COLUMN_ALIASES


def conform_columns(bronze: DataFrame, names=tuple(COLUMN_ALIASES)) -> DataFrame:
    """Adds the cell of each logical column as ``raw_<name>``, null where there is none."""
    return bronze.withColumns(
        {f"raw_{name}": F.get("cells", F.col(f"places.{name}") - 1) for name in names})


def _typed(bronze: DataFrame) -> DataFrame:
    """Transactions with ``blank`` (no date: no transaction, and no error either) and
    ``reason`` (null for a good row).

    The typed values come out of a one-row inline: a filter on them stays above it, and
    dates and amounts are parsed once and not again in each filter.
    """
    cell = {name: F.get("cells", F.col(f"places.{name}") - 1) for name in COLUMN_ALIASES}
    amount = signed_amount(F.col("places.amount") > 0, parse_amount(cell["amount"]),
                           parse_amount(cell["debit"]), parse_amount(cell["credit"]))
    values = F.struct(
        parse_date(cell["date"]).alias("txn_date"),
        strip(F.coalesce(cell["description"], F.lit(""))).alias("description"),
        amount.alias("amount"), parse_amount(cell["balance"]).alias("balance"),
        default_currency(F.lit(None).cast("string")).alias("currency"),
        (F.col("places.date") > 0).alias("has_date"),
        (F.col("places.description") > 0).alias("has_description"),
        (F.coalesce(cell["date"], F.lit("")) == "").alias("no_date"),
        (F.size("cells") > F.size("columns")).alias("too_long"))
    rows = bronze.withColumn("values", values).select(
        "source_file", "row_idx", F.inline(F.array("values")))
    layout = F.col("has_date") & F.col("has_description")
    reason = (F.when(~layout, "missing date or description column")
              .when(F.col("too_long"), "more cells than columns")
              .when(F.col("txn_date").isNull(), "unrecognized date"))
    return rows.withColumns({"blank": layout & F.col("no_date"), "reason": reason})


def conform(bronze: DataFrame) -> DataFrame:
    """source_file, row_idx, txn_date, description, amount, balance, currency of good rows."""
    rows = _typed(bronze)
    return rows.where(~F.col("blank") & F.col("reason").isNull()).select(
        "source_file", "row_idx", "txn_date", "description", "amount", "balance", "currency")


def rejects(bronze: DataFrame) -> DataFrame:
    """source_file, row_idx, reason of the rows that could not be conformed. A layout
    without the required columns gives one line for each of its rows."""
    rows = _typed(bronze)
    return (rows.where(~F.col("blank") & F.col("reason").isNotNull())
            .select("source_file", "row_idx", "reason"))


def enrich(transactions: DataFrame) -> DataFrame:
    """Redact first, so that nothing later sees personal data; then category and flag."""
    clean = transactions.withColumn("description", redact(F.col("description")))
    return clean.withColumns({"category": categorize(F.col("description")),
                              "is_outflow": is_outflow(F.col("amount"))})


def dedup_silver(transactions: DataFrame) -> DataFrame:
    """One row for each (date, description, amount, source): the first of the file.

    A plain aggregation, so copies are folded before the shuffle however many there are.
    """
    keys = ["txn_date", "description", "amount", "source_file"]
    rest = [c for c in transactions.columns if c not in (*keys, "row_idx")]
    first = F.min_by(F.struct(*rest), F.col("row_idx"))
    return (transactions.groupBy(*keys).agg(F.min("row_idx").alias("row_idx"),
                                            first.alias("_first"))
            .select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c)
                      for c in transactions.columns]))


def fill_categories(transactions: DataFrame) -> DataFrame:
    """Keep a category that is there, find the others by rule."""
    return transactions.withColumn(
        "category", categorize_missing(F.col("category"), F.col("description")))
