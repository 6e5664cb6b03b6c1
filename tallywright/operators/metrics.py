"""Time-window figures over events (ts, key, value)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentile_by

# Default upper bounds of a duration histogram, in seconds.
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5,
                   10.0)
_MICRO = 1_000_000


def rate_by_key(events: DataFrame, key: str, minutes: int = 5, slide: int = 1) -> DataFrame:
    """window_start, window_end, key, n, rate per second in sliding windows.

    Events are counted per slide first; only those counts are copied into the windows they
    lie in, so a busy key costs one row per slide and not one per event and window.
    """
    step = F.expr(f"interval {slide} minutes")
    slots = (events.groupBy(F.window("ts", f"{slide} minutes").alias("slot"), key)
             .agg(F.count(F.lit(1)).alias("c")))
    start = F.col("slot.start")
    spread = slots.select(
        key, "c", F.explode(F.sequence(
            start - F.expr(f"interval {minutes - slide} minutes"), start, step))
        .alias("window_start"))
    counted = spread.groupBy("window_start", key).agg(F.sum("c").alias("n"))
    return counted.select(
        "window_start",
        (F.col("window_start") + F.expr(f"interval {minutes} minutes")).alias("window_end"),
        key, "n", (F.col("n") / F.lit(60.0 * minutes)).alias("rate"))


def percentile_by_key(events: DataFrame, key: str, window: str = "5 minutes",
                      p: float = 0.95) -> DataFrame:
    """window_start, key, and the exact percentile of value (resolved to a millionth)."""
    rows = events.select(F.window("ts", window)["start"].alias("window_start"), key,
                         F.round(F.col("value") * _MICRO).cast("bigint").alias("micro"))
    rows = rows.where(F.col("micro").isNotNull())
    found = percentile_by(rows, ["window_start", key], "micro", p, "micro")
    return found.select("window_start", key, (F.col("micro") / _MICRO).alias("value"))


def counter_totals(events: DataFrame, label: str) -> DataFrame:
    return events.groupBy(label).agg(F.count(F.lit(1)).alias("total"))


def counter_series(events: DataFrame, label: str, window: str = "1 hour") -> DataFrame:
    """The counter over time: events are folded per window, then summed up per label."""
    slots = (events.groupBy(label, F.window("ts", window)["start"].alias("window_start"))
             .agg(F.count(F.lit(1)).alias("n")))
    upto = (Window.partitionBy(label).orderBy("window_start")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return slots.withColumn("total", F.sum("n").over(upto))


def duration_histogram(events: DataFrame, value: str = "value",
                       bounds: tuple[float, ...] = DURATION_BOUNDS) -> DataFrame:
    """le, cumulative count for each bound and for no bound; one pass, one row per bucket."""
    counts = events.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}")
                          for i, b in enumerate(bounds)],
                        F.count(value).alias("all"))

    def bucket(le: str, n: Column) -> Column:
        return F.struct(F.lit(le).alias("le"), n.alias("count"))

    buckets = [bucket(f"{b:g}", F.col(f"b{i}")) for i, b in enumerate(bounds)]
    return counts.select(F.inline(F.array(*buckets, bucket("+Inf", F.col("all")))))
