"""Star schema: date and category dimensions, fact rows, and reading them back."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import grouped
from ..functions.values import category_key, date_key, default_currency, valid_category
from ..schema import CATEGORIES, DIM_CATEGORY, MONEY
from .skew import HOT_ROWS, positions
from .spend import outflow, top_categories


def distinct_dates(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("txn_date").isNotNull()).select("txn_date").distinct()


def distinct_categories(transactions: DataFrame) -> DataFrame:
    return transactions.select("category").distinct()


def dim_date(transactions: DataFrame) -> DataFrame:
    day = F.col("txn_date")
    return distinct_dates(transactions).select(
        date_key(day).alias("date_key"), day.alias("full_date"), F.year(day).alias("year"),
        F.month(day).alias("month"), F.dayofmonth(day).alias("day"),
        F.date_format(day, "MMMM").alias("month_name"), F.date_format(day, "EEEE").alias("weekday"))


def dim_category_ranked(transactions: DataFrame) -> DataFrame:
    """Batch keys: 1-based place in the alphabet among all categories in use, null first. One
    task ranks the distinct categories, of which there are few whatever the rows."""
    rank = F.dense_rank().over(Window.orderBy("category"))
    return distinct_categories(transactions).select(
        rank.alias("category_key"), F.col("category").alias("category_name"))


def dim_category_fixed(spark: SparkSession) -> DataFrame:
    """Serving keys: place in the fixed list."""
    return spark.createDataFrame(list(enumerate(CATEGORIES)), DIM_CATEGORY)


def with_surrogate_key(transactions: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Left join on the category name, null as a name of its own. Whether the dimension is small
    enough to broadcast is for Spark to see; a frequent category is split by the skew join."""
    return transactions.join(
        dim_category, F.col("category").eqNullSafe(F.col("category_name")), "left")


def fact_transaction(transactions: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Batch fact rows; txn_id is a hash of what makes the row, so reruns give the same id."""
    rows = with_surrogate_key(transactions, dim_category).withColumn(
        "date_key", date_key(F.col("txn_date")))
    made_of = F.concat_ws("|", F.col("date_key").cast("string"), "description",
                          F.col("amount").cast("string"), "source_file")
    return rows.select(
        F.sha2(made_of, 256).alias("txn_id"), "date_key", "category_key", "description",
        F.round("amount", 2).cast(MONEY).alias("amount"), "is_outflow",
        default_currency(F.lit(None).cast("string")).alias("currency"), "source_file")


def row_in_source(transactions: DataFrame, order: list[str],
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds idx (0-based place in the source) and txn_id ``source:idx``."""
    numbered = positions(transactions, ["source_file"], order, "idx", hot_rows)
    return numbered.withColumn(
        "txn_id", F.concat_ws(":", "source_file", F.col("idx").cast("string")))


def fact_serving(transactions: DataFrame, order: list[str],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Serving fact rows: txn_id ``source:idx``, fixed category keys."""
    return row_in_source(transactions, order, hot_rows).select(
        "txn_id", date_key(F.col("txn_date")).alias("date_key"),
        category_key(F.col("category")).alias("category_key"), "description", "amount",
        (F.col("amount") < 0).alias("is_outflow"), "currency", "source_file")


def join_dims(fact: DataFrame, dates: DataFrame, categories: DataFrame) -> DataFrame:
    """Fact with its date (inner) and category (left). Dimensions are tables whose size Spark
    knows: it broadcasts them while they are small, and otherwise splits frequent keys."""
    return fact.join(dates, "date_key").join(categories, "category_key", "left")


def monthly_category_spend(fact: DataFrame, dates: DataFrame, categories: DataFrame) -> DataFrame:
    """year, month, category_name, total_spend, txn_count; the count includes inflows.

    Facts are summed per key before they meet the dimensions."""
    folded = fact.groupBy("date_key", "category_key").agg(
        outflow().alias("spend"), F.count(F.lit(1)).alias("n"))
    return (join_dims(folded, dates, categories).groupBy("year", "month", "category_name")
            .agg(F.sum("spend").alias("total_spend"), F.sum("n").alias("txn_count")))


def read_back(fact: DataFrame, dates: DataFrame, categories: DataFrame) -> DataFrame:
    """Transactions from the star, a category outside the list as null."""
    return join_dims(fact, dates, categories).select(
        F.col("full_date").alias("txn_date"), "description", "amount",
        valid_category(F.col("category_name")).alias("category"),
        default_currency(F.col("currency")).alias("currency"), "txn_id", "source_file")


def store_order(rows: DataFrame) -> DataFrame:
    """By date, then txn_id as text."""
    return rows.orderBy("txn_date", "txn_id")


def weekly_digest(totals: DataFrame, anomalies: DataFrame, k: int = 8) -> DataFrame:
    """Report lines (line_no, text): anomaly count with its first message, then the largest
    categories. ``totals`` has one row per category; the first anomaly is an aggregate."""
    first = F.min_by("message", F.struct(F.col("type") != "large_transaction", "message"))
    head = anomalies.agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    # The words of the report's lines.
    found = F.concat(F.lit("Found "), F.col("n").cast("string"),
                     F.when(F.col("n") == 1, " anomaly.").otherwise(" anomalies."),
                     F.coalesce(F.concat(F.lit(" "), F.col("first")), F.lit("")))
    place = F.row_number().over(Window.orderBy(F.desc("total"), "category"))
    lines = top_categories(totals, k).select(
        (place + 1).alias("line_no"),
        F.concat(F.lit("  - "), "category", F.lit(": "), grouped(F.col("total"))).alias("text"))
    spend_any = totals.agg(F.when(F.count(F.lit(1)) > 0, "Spend by category:")
                           .otherwise("No transactions on record yet.").alias("text"))
    return (head.select(F.lit(0).alias("line_no"), found.alias("text"))
            .unionByName(spend_any.select(F.lit(1).alias("line_no"), "text"))
            .unionByName(lines))
