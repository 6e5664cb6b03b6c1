"""Twelve features of an outflow, amounts seen relative to their own statement."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.values import category_key
from ..schema import FEATURES
from .anomaly import outflow_magnitudes, scope_keys
from .quantiles import percentile_by, with_percentile

_MOMENTS = {"mean": "mean", "std": "std", "outflows": "n"}


def statement_stats(transactions: DataFrame, scope: str | None = "source_file") -> DataFrame:
    """Median, mean and population deviation of the outflow magnitude; 0 deviation for one
    outflow. All in currency units."""
    stats = percentile_by(outflow_magnitudes(transactions), scope_keys(scope), "cents", 0.5,
                          "median", _MOMENTS)
    return stats.select(*scope_keys(scope), (F.col("median") / 100).alias("median"),
                        (F.col("mean") / 100).alias("mean"), (F.col("std") / 100).alias("std"),
                        "outflows")


def with_stats(transactions: DataFrame, scope: str | None = "source_file") -> DataFrame:
    """Every outflow next to the statistics of its statement (in cents)."""
    return with_percentile(outflow_magnitudes(transactions), scope_keys(scope), "cents", 0.5,
                           "median", _MOMENTS)


def _or_one(number: Column) -> Column:
    return F.when(number == 0, F.lit(1.0)).otherwise(number)


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def feature_columns() -> dict[str, Column]:
    """Expressions over the rows of ``with_stats``."""
    units = F.col("cents") / 100
    day, text = F.col("txn_date"), F.coalesce(F.col("description"), F.lit(""))
    of_month = F.dayofmonth(day)
    return {
        "log_amount": F.log1p(units),
        "amount_to_median_ratio": units / _or_one(F.col("median") / 100),
        "amount_zscore": (units - F.col("mean") / 100) / _or_one(F.col("std") / 100),
        "is_round_amount": _flag((F.col("cents") != 0) & (F.col("cents") % 10_000 == 0)),
        "day_of_week": F.weekday(day).cast("double"),
        "day_of_month": of_month.cast("double"),
        "is_weekend": _flag(F.weekday(day) >= 5),
        "is_month_boundary": _flag((of_month <= 3) | (of_month >= 27)),
        "desc_length": F.length(text).cast("double"),
        "desc_word_count": F.size(words(text)).cast("double"),
        "desc_has_digits": _flag(text.rlike(r"(?U)\d")),
        "category_code": category_key(F.col("category")).cast("double"),
    }


def feature_matrix(transactions: DataFrame, scope: str | None = "source_file",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the twelve features, one row per outflow."""
    made = feature_columns()
    return with_stats(transactions, scope).select(
        *keep, *[made[name].alias(name) for name in FEATURES])
