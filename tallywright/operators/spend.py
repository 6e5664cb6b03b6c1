"""Totals, breakdowns, shares and searches over transactions."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ANY_CATEGORY = (None, "", "all", "any", "total", "everything")  # fixed values


def outflows(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("amount") < 0)


def inflow() -> Column:
    return F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0))


def outflow() -> Column:
    return F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0))


def statement_totals(transactions: DataFrame, key: str = "source_file") -> DataFrame:
    """Per statement: total_inflow, total_outflow (positive), net, transaction_count."""
    return transactions.groupBy(key).agg(
        inflow().alias("total_inflow"), outflow().alias("total_outflow"),
        F.sum("amount").alias("net"), F.count(F.lit(1)).alias("transaction_count"))


def statement_period(transactions: DataFrame, key: str = "source_file") -> DataFrame:
    return transactions.groupBy(key).agg(F.min("txn_date").alias("period_start"),
                                         F.max("txn_date").alias("period_end"))


def spend_by_category(transactions: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Total outflow per category, without a category under ``other``; inflows do not count."""
    named = outflows(transactions).withColumn(
        "category", F.coalesce(F.col("category"), F.lit("other")))
    return named.groupBy(*(scope or []), "category").agg(F.sum(-F.col("amount")).alias("total"))


def sort_spend(totals: DataFrame) -> DataFrame:
    """Highest total first."""
    return totals.orderBy(F.desc("total"), "category")


def top_categories(totals: DataFrame, k: int) -> DataFrame:
    return sort_spend(totals).limit(k)


def total_spend(transactions: DataFrame, category: str | None = None,
                since: str | None = None, until: str | None = None) -> DataFrame:
    """One row: total and count of the outflows of a category and date range (both ends in)."""
    rows = outflows(transactions)
    if category not in _ANY_CATEGORY:
        rows = rows.where(F.coalesce(F.col("category"), F.lit("other")) == category)
    if since:
        rows = rows.where(F.col("txn_date") >= F.to_date(F.lit(since)))
    if until:
        rows = rows.where(F.col("txn_date") <= F.to_date(F.lit(until)))
    return rows.agg(F.coalesce(F.sum(-F.col("amount")), F.lit(0)).alias("total"),
                    F.count(F.lit(1)).alias("count"))


def share_of_total(totals: DataFrame, scope: list[str]) -> DataFrame:
    """``share`` of each category in its scope's total. ``totals`` is already aggregated:
    a scope has at most one row per category."""
    whole = F.sum("total").over(Window.partitionBy(*scope))
    return totals.withColumn("share", F.col("total").cast("double") / whole.cast("double"))


def share_of_max(totals: DataFrame, scope: list[str]) -> DataFrame:
    top = F.max("total").over(Window.partitionBy(*scope))
    return totals.withColumn("ratio", F.col("total").cast("double") / top.cast("double"))


def transactions_view(transactions: DataFrame, category: str | None = None,
                      by: str = "date", direction: int = 1) -> DataFrame:
    """Rows of one category (or all), by date or amount, either way."""
    if category:
        transactions = transactions.where(F.col("category") == category)
    column = F.col("txn_date" if by == "date" else "amount")
    return transactions.orderBy(column.asc() if direction > 0 else column.desc(),
                                "source_file", "row_idx")


def matches_keywords(description: Column, keywords: str) -> Column:
    """Any word of ``keywords`` inside the lower-cased description; no words match all."""
    low = F.lower(description)
    found = F.lit(True)
    for n, term in enumerate(re.findall(r"[a-z0-9]+", keywords.lower())):
        found = low.contains(term) if n == 0 else found | low.contains(term)
    return found


def search_keywords(transactions: DataFrame, keywords: str = "") -> DataFrame:
    return transactions.where(matches_keywords(F.col("description"), keywords))


def search_hits(transactions: DataFrame, keywords: str, limit: int,
                order: list[str]) -> DataFrame:
    """The first ``limit`` hits, each with the ``count`` of all hits.

    The count is a scalar subquery and the head a top-k, so neither gathers the hits.
    """
    hits = search_keywords(transactions, keywords)
    counted = hits.agg(F.count(F.lit(1)).alias("count")).scalar()
    return hits.orderBy(*order).limit(limit).withColumn("count", counted)

