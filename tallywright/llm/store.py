"""Tables written to the shared folder and read back: lineage and plan start anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright import session

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: Spark's usual 10,000 rows to a batch make tens of megabytes, which JVM and
    Python each hold for every task, outside the heap; and rows that are themselves megabytes, as
    index segments are, need a bound in bytes. A session with another setting keeps it."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(4 << 20))


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """`df` as a table. Spark removes a shuffle's files when the driver's garbage collector finds
    its plan; `release` has it look now, where the files are large and more are to come."""
    path = session.scratch(df.sparkSession, name)
    df.write.parquet(path)
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(rows: DataFrame, content: list[str] | Column, share: Column, most: int, also: list[str] = (), apart: bool = False, low: float = 0.0) -> DataFrame:
    """A sample of `rows`: those whose point in 0..1, a hash of `content` (columns, or the hash; without nulls that many
    rows share), lies in `low` and `share` upwards. Rows equal in `content` and `also` are drawn
    once, and at most `most` rows are drawn in all, or (`apart`) of each value of `also`: the
    bound holds whatever is repeated how often."""
    names = rows.columns
    point = F.pmod(F.col("__hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    hashed = F.xxhash64(*content) if isinstance(content, list) else content
    some = rows.withColumn("__hash", hashed).where((point >= low) & (point < low + share)).dropDuplicates(["__hash", *also])
    if not apart:
        return some.orderBy("__hash", *also).limit(most).select(names)
    seat = F.row_number().over(Window.partitionBy(*also).orderBy("__hash"))
    return some.withColumn("__seat", seat).where(F.col("__seat") <= most).select(names)


def hashed(docs: DataFrame, labels: DataFrame | None, label: str) -> DataFrame:
    """hash (of the text) and label of labelled rows: `docs` with a label, or joined with
    labels(doc_id, label). Hashes are joined, not texts."""
    text = F.xxhash64("text").alias("hash")
    kept = docs.where("text is not null")
    rows = kept.select(text, label) if labels is None else kept.select("doc_id", text).join(labels.select("doc_id", label), "doc_id")
    return rows.where(F.col(label).isNotNull()).select("hash", F.col(label).cast("int").alias(label))


def texts_of(docs: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """text and label of the `chosen` rows (hash, label), a sample of bounded size, which is sent to
    where the texts are."""
    chosen = stored(chosen, "sample")
    found = docs.where("text is not null").select("text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), "hash")
    return found.dropDuplicates(["hash", label]).select("text", label)
