"""Work on groups of which one may hold a large part of all rows.

A group of at most ``HOT_ROWS`` rows may be sorted or buffered by a single task. Groups
above that are split: their keys are found first, by a count that is folded map side. There
are at most ``rows / HOT_ROWS`` of them, so the keys (and one row of figures for each) can be
broadcast, and their rows stay where they were read. Without a hot group the plan is the
ordinary one.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

HOT_ROWS = 1_000_000
_LOW_BITS = (1 << 33) - 1


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of the groups with more than ``hot_rows`` rows (counted with map-side combine)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.where(F.col("_rows") > hot_rows).select(*keys)


def find_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys, for broadcast; None when there are none. Runs the count."""
    found = hot_groups(df, keys, hot_rows).collect()  # at most rows / hot_rows keys
    if not found:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(found, df.select(*keys).schema))


def split_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS):
    """(rows of ordinary groups, rows of hot groups or None); neither side is shuffled."""
    hot = find_hot(df, keys, hot_rows)
    if hot is None:
        return df, None
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def same(left: list[Column], right: list[Column]) -> Column:
    """All pairs equal, null as one value."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_other_{i}") for i, k in enumerate(keys)]


def _meets(keys: list[str]) -> Column:
    return same([F.col(k) for k in keys], [F.col(f"_other_{i}") for i in range(len(keys))])


def anti_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner, null keys compared as equal. The right side is
    folded to its distinct keys, so a hot key of the left is split by the skew join."""
    return left.join(right.select(*_renamed(keys)).distinct(), _meets(keys), "left_anti")


def keep_groups(df: DataFrame, keys: list[str], counted, at_least: int) -> DataFrame:
    """Rows of the groups in which at least ``at_least`` rows meet ``counted``. Groups are
    counted map side first; their rows then meet one row per group, in parts where one is hot."""
    big = df.groupBy(*keys).agg(F.count_if(counted).alias("_kept")).where(F.col("_kept") >= at_least)
    return df.join(big.select(*_renamed(keys)), _meets(keys), "left_semi")


def _positions_by_range(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Sort the whole frame once; a row's position is its place in its range plus what
    the same group holds in earlier ranges. Ranges cut through groups, so none is too big."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that tie follow a hash of their content; rows equal in all would all land in one range,
    # and their read position keeps them apart
    tied = df.withColumns({"_hash": F.xxhash64(*df.columns), "_tie": F.monotonically_increasing_id()})
    order = [*[F.col(k) for k in keys], *order, F.col("_hash"), F.col("_tie")]
    ranges = cut(tied.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_hash", "_tie"))
    at = F.monotonically_increasing_id()
    placed = ranges.withColumn("_at", at).withColumns({
        "_range": F.shiftright("_at", 33).cast("int"),
        "_place": F.col("_at").bitwiseAND(F.lit(_LOW_BITS)),
    }).drop("_at")
    # one row for each range and each group in it: at most ranges + hot groups
    runs = placed.groupBy(*keys, "_range").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*keys).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (placed.join(F.broadcast(runs), [*keys, "_range"])
            .withColumn(name, F.col("_place") - F.col("_first") + F.col("_before"))
            .drop("_range", "_place", "_first", "_before"))


def positions(df: DataFrame, keys: list[str], order: list[str], name: str,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """``name`` = 0-based position of a row in its group (in the whole frame without keys)."""
    by = [F.col(o) for o in order]
    if not keys:
        return _positions_by_range(df, [], by, name)
    window = Window.partitionBy(*keys).orderBy(*by)
    number = (F.row_number().over(window) - 1).cast("long")
    ordinary, hot = split_hot(df, keys, hot_rows)
    ordinary = ordinary.withColumn(name, number)
    if hot is None:
        return ordinary
    return ordinary.unionByName(_positions_by_range(hot, keys, by, name))


def running_total(df: DataFrame, key: str, position: str, value: str, name: str,
                  block: int = 65_536) -> DataFrame:
    """Sum of ``value`` up to each row, in order of a dense 0-based ``position``.

    Each group is cut into blocks of positions; a block is summed by one task and
    started with the total of the blocks before it.
    """
    rows = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("long"))
    totals = rows.groupBy(key, "_block").agg(F.sum(value).alias("_total"))
    earlier = (Window.partitionBy(key).orderBy("_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("_before", F.sum("_total").over(earlier)).drop("_total")
    inside = (Window.partitionBy(key, "_block").orderBy(position)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = rows.withColumn("_inside", F.sum(value).over(inside))
    return (summed.join(totals, [key, "_block"])
            .withColumn(name, F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0)))
            .drop("_block", "_inside", "_before"))
