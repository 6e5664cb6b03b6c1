"""Rule anomalies: unusually large charges and repeated charges; merging with model hits.

An anomaly is a row (scope, type, severity, message, transactions). Equal members of a
repeated charge are kept once with their number of ``copies``, so the list of one anomaly
is bounded by the distinct dates of the charge and nothing is lost.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grouped, whole
from ..functions.values import outflow_cents
from .quantiles import with_percentile
from .skew import anti_join

LARGE_FLOOR = 100_000  # cents; smaller charges are never called large
COLUMNS = ("type", "severity", "message", "transactions")


def scope_keys(scope: str | None) -> list[str]:
    """One statement at a time, or (None) all rows as one statement."""
    return [scope] if scope else []


def member(copies: Column) -> Column:
    return F.struct(
        F.col("txn_date").alias("date"), "description", "amount",
        F.coalesce(F.col("category"), F.lit("other")).alias("category"),
        copies.cast("bigint").alias("copies"))


def outflow_magnitudes(transactions: DataFrame) -> DataFrame:
    """Outflows with their magnitude in cents."""
    return (transactions.where(F.col("amount") < 0)
            .withColumn("cents", outflow_cents(F.col("amount"))))


def large_transactions(transactions: DataFrame, scope: str | None = "source_file") -> DataFrame:
    """Charges above 4 medians of their statement and above the floor; at least 3 outflows."""
    keys = scope_keys(scope)
    rows = with_percentile(outflow_magnitudes(transactions), keys, "cents", 0.5, "median",
                           {"outflows": "n"})
    cents, median = F.col("cents"), F.col("median")
    hits = rows.where((F.col("outflows") >= 3) & (median > 0) & (cents > 4 * median)
                      & (cents > LARGE_FLOOR))
    # Fixed value: the message's words.
    message = F.concat(F.lit("Unusually large charge of "), grouped(cents / 100), F.lit(" (~"),
                       whole(cents / median), F.lit("x your typical spend)"))
    return hits.select(
        *keys, F.lit("large_transaction").alias("type"),
        F.when(cents > 8 * median, "high").otherwise("medium").alias("severity"),
        message.alias("message"), F.array(member(F.lit(1))).alias("transactions"))


def duplicate_groups(transactions: DataFrame, scope: str | None = "source_file") -> DataFrame:
    """Equal (description, amount) at least twice: n and the members.

    Copies are counted first (map side), so a group of any size reaches one task only as
    one row per distinct date.
    """
    keys = [*scope_keys(scope), "description", "amount"]
    dated = (transactions.where(F.col("amount") < 0)
             .groupBy(*keys, "category", "txn_date").agg(F.count(F.lit(1)).alias("copies")))
    return (dated.groupBy(*keys)
            .agg(F.sum("copies").alias("n"),
                 F.sort_array(F.collect_list(member(F.col("copies")))).alias("transactions"))
            .where(F.col("n") >= 2))


def duplicates(transactions: DataFrame, scope: str | None = "source_file") -> DataFrame:
    cents = outflow_cents(F.col("amount"))
    # Fixed value: the message's words.
    message = F.concat(F.col("n").cast("string"), F.lit(" identical charges of "),
                       grouped(cents / 100), F.lit(" for '"), F.coalesce("description", F.lit("")), F.lit("'"))
    return duplicate_groups(transactions, scope).select(
        *scope_keys(scope), F.lit("possible_duplicate").alias("type"),
        F.when(cents > LARGE_FLOOR, "high").otherwise("medium").alias("severity"),
        message.alias("message"), "transactions")


def detect(transactions: DataFrame, scope: str | None = "source_file") -> DataFrame:
    """Both rules. Run it on rows before dedup, which would take the repeats away."""
    return large_transactions(transactions, scope).unionByName(
        duplicates(transactions, scope))


def members(anomalies: DataFrame) -> DataFrame:
    """One row for each distinct member of each anomaly."""
    rest = [c for c in anomalies.columns if c != "transactions"]
    return anomalies.select(*rest, F.explode("transactions").alias("t")).select(*rest, "t.*")


def without_rule_hits(model_hits: DataFrame, rule_hits: DataFrame,
                      scope: str | None = "source_file") -> DataFrame:
    """Model hits none of whose members is in a rule anomaly of the same scope. A model hit
    has one member, so this is an anti join on that member."""
    keys = [*scope_keys(scope), "date", "description", "amount"]
    first = F.get("transactions", 0)
    keyed = model_hits.withColumns({k: first[k] for k in keys[-3:]})
    return anti_join(keyed, members(rule_hits), keys).select(*model_hits.columns)


def combine(rule_hits: DataFrame, model_hits: DataFrame,
            scope: str | None = "source_file") -> DataFrame:
    return rule_hits.unionByName(without_rule_hits(model_hits, rule_hits, scope))


def count_by_type(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
