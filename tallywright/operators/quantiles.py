"""Exact percentiles of whole numbers, in groups of any size, without a job ahead of time.

Equal values are counted first, map side. Their high bits make bins; a group's counts by bin say in
which one or two bins its wanted ranks lie, and only the values in those bins are looked at one by
one. A bin has at most 2^20 different values and a span of 2^40 at most 2^20 bins, so that is what
a task holds of a group, however many rows it has. All steps read the one shuffle of the counts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BIN_BITS = 20
_BIG = "decimal(38,0)"
#: What can be had beside a percentile: number of values, mean, population deviation.
FIGURES = ("n", "mean", "std")


def _group(keys: list[str]) -> Column:
    """The group as one value that is never null, so that it joins and shuffles as it is. Without
    keys all rows are one group."""
    return F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def _bin_of(bins: Column, rank: Column) -> Column:
    """(bin, values in earlier bins) of the rank, from ascending (bin, count) pairs."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"),
                     F.lit(0).cast("long").alias("base"))
    return F.aggregate(bins, start, lambda s, b: F.struct(
        (s["seen"] + b["c"]).alias("seen"),
        F.when(s["bin"].isNull() & (s["seen"] + b["c"] > rank), b["bin"]).otherwise(s["bin"]).alias("bin"),
        F.when(s["bin"].isNull(), s["seen"]).otherwise(s["base"]).alias("base")))


def _value_at(values: Column, rank: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
    return F.aggregate(values, start, lambda s, x: F.struct(
        (s["seen"] + x["c"]).alias("seen"),
        F.when(s["v"].isNull() & (s["seen"] + x["c"] > rank), x["v"]).otherwise(s["v"]).alias("v")))["v"]


def _deviation(n: Column, s1: Column, s2: Column) -> Column:
    """From whole sums: squares are taken around the mean's floor, so nothing cancels."""
    floor = F.floor(s1 / n).cast(_BIG)
    around = s2 - (s1 * 2 * floor).cast(_BIG) + (n * floor * floor).cast(_BIG)
    off = (s1 - n * floor).cast("double") / n
    return F.sqrt(F.greatest(around.cast("double") / n - off * off, F.lit(0.0)))


def percentile_by(df: DataFrame, keys: list[str], value: str, p: float, name: str,
                  figures: dict[str, str] | None = None, bits: int = _BIN_BITS) -> DataFrame:
    """One row for each group: the exact percentile (linear between ranks) and ``figures``, a
    name for each of ``FIGURES`` that is wanted. Null values don't count; a group without a value
    has no row."""
    figures = figures or {}
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(_group(keys).alias("_k"), F.col(value).cast("long").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")).withColumn("_bin", F.shiftright("_v", bits)))
    big = F.col("_v").cast(_BIG)
    sums = {"_s1": F.sum((big * F.col("_c")).cast(_BIG)), "_s2": F.sum((big * big * F.col("_c")).cast(_BIG))}
    wanted = {"mean": ["_s1"], "std": ["_s1", "_s2"]}
    needed = sorted({s for f in figures.values() for s in wanted.get(f, [])})
    bins = counts.groupBy("_k", "_bin").agg(F.sum("_c").alias("_c"), *[sums[s].alias(s) for s in needed])
    groups = bins.groupBy("_k").agg(
        F.sum("_c").alias("_n"),
        F.sort_array(F.collect_list(F.struct(F.col("_bin").alias("bin"), F.col("_c").alias("c")))).alias("_bins"),
        *[F.sum(s).cast(_BIG).alias(s) for s in needed])
    place = F.lit(p) * (F.col("_n") - 1)
    groups = groups.withColumns({"_low": _bin_of(F.col("_bins"), F.floor(place)),
                                 "_high": _bin_of(F.col("_bins"), F.ceil(place))})
    # One row for each bin that is looked into, with what is known of its group.
    known = ["_n", *needed]
    targets = groups.select("_k", *known, "_low", "_high",
                            F.explode(F.array_distinct(F.array("_low.bin", "_high.bin"))).alias("_bin"))
    inside = counts.groupBy("_k", "_bin").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_c").alias("c")))).alias("_values"))

    def found_in(bin_, rank):
        return F.when(F.col("_bin") == F.col(bin_)["bin"], _value_at(F.col("_values"), rank - F.col(bin_)["base"]))

    ends = inside.join(targets, ["_k", "_bin"]).withColumns(
        {"_lowest": found_in("_low", F.floor(place)), "_highest": found_in("_high", F.ceil(place))})
    found = ends.groupBy("_k", *known).agg(F.max("_lowest").alias("_lowest"), F.max("_highest").alias("_highest"))
    part = place - F.floor(place)
    made = {"n": F.col("_n"), "mean": F.col("_s1").cast("double") / F.col("_n"),
            "std": _deviation(F.col("_n"), F.col("_s1"), F.col("_s2")) if "_s2" in needed else F.lit(None)}
    return found.select(
        *[F.col("_k")[k].alias(k) for k in keys], ((1 - part) * F.col("_lowest") + part * F.col("_highest")).alias(name),
        *[made[f].alias(alias) for alias, f in figures.items()])


def with_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str,
                    figures: dict[str, str], bits: int = _BIN_BITS) -> DataFrame:
    """The same figures next to every row. A group's rows meet its one row of figures, which
    Spark broadcasts if all of them are small; otherwise the skew join splits a hot group.

    Without keys the whole frame is one group and the figures are scalar subqueries.
    """
    found = percentile_by(df, keys, value, p, name, figures, bits)
    if not keys:
        return df.withColumns({a: found.select(a).scalar() for a in (name, *figures)})
    figures_of = found.select(_group(keys).alias("_k"), name, *figures)
    return df.withColumn("_k", _group(keys)).join(figures_of, "_k", "left").drop("_k")
