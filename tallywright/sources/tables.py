"""Writing tables so that a rerun changes nothing, on plain Parquet folders.

Tables that rows are replaced in are kept as snapshots (``snapshots``).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORIES, DIM_CATEGORY
from . import snapshots


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, with the columns of all its files; None when nothing is there. A table that
    is there and can't be read is an error."""
    if not exists(spark, path):
        return None
    if exists(spark, f"{path}/_manifest"):
        return snapshots.read(spark, path)
    return spark.read.option("mergeSchema", True).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly when the files give fewer scan tasks than there are cores.

    Such an input is small (fewer than cores x one split), so the shuffle is too; a large
    table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_gold(folder: str, dim_date: DataFrame, dim_category: DataFrame,
               fact: DataFrame) -> None:
    overwrite(dim_date, f"{folder}/dim_date")
    overwrite(dim_category, f"{folder}/dim_category")
    overwrite(fact, f"{folder}/fact_transaction")


def publish(tables: dict[str, DataFrame], target, mode: str = "overwrite") -> None:
    """Copy tables out from the executors. ``target(name)`` gives the format and options of
    a table's destination, e.g. ``("parquet", {"path": ...})`` or ``("jdbc", {...})``."""
    for name, table in tables.items():
        kind, options = target(name)
        table.write.format(kind).options(**options).mode(mode).save()


def replace_by_key(df: DataFrame, path: str, key: str, buckets: int | None = None) -> None:
    """Put the rows of ``df`` in place of all rows with the same keys (null is a key too), in one
    step that readers see whole or not at all. No rows: no change."""
    snapshots.replace_by_key(df, path, key, buckets)


def replace_by_source(fact: DataFrame, path: str, buckets: int | None = None) -> None:
    """Load statements: the rows of each source in ``fact`` replace what it had before."""
    replace_by_key(fact, path, "source_file", buckets)


def last_per_key(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key. An aggregation: copies of a hot key fold map side."""
    rest = [c for c in records.columns if c != key]
    last = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(key, "_last.*").select(*records.columns)


def upsert(store: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """The store with the last record of each incoming key put in."""
    incoming = last_per_key(records, key, order).drop(order)
    return store.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def upsert_vectors(records: DataFrame, path: str, order: str, buckets: int | None = None) -> None:
    """Insert or replace by ``id``; of equal ids in one batch the last wins."""
    replace_by_key(last_per_key(records, "id", order).drop(order), path, "id", buckets)


def not_matched(target: DataFrame | None, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key the target lacks, each key once."""
    fresh = source.dropDuplicates([key])
    return fresh if target is None else fresh.join(target.select(key), key, "left_anti")


def merge_dim_date(dates: DataFrame, path: str) -> None:
    append(not_matched(read_table(dates.sparkSession, path), dates, "date_key"), path)


def seed_dim_category(spark: SparkSession, path: str) -> None:
    rows = spark.createDataFrame(list(enumerate(CATEGORIES)), DIM_CATEGORY)
    append(not_matched(read_table(spark, path), rows, "category_key").coalesce(1), path)


def row_count(table: DataFrame) -> DataFrame:
    """One row: how many rows a load left behind."""
    return table.agg(F.count(F.lit(1)).alias("n"))
