"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of `documents`.
The near-duplicate and the decontamination stages decide on rows, not on ids: they give each row an
id by its file and place and drop it at their end, so documents without an id, or that share one,
are each decided on. Line deduplication cuts rows equal in id and text alike; the copies go in the
next stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm import language, line_dedup, packing, parity_join, positional_index
from tallywright.llm.queries import fold, tokenizer
from tallywright.llm.store import small_batches, stored

#: No SQL states a fitted language model; the stages are tested against brute force.
ORACLE_SQL = None


ROW = "__row"


def _rows(docs: DataFrame) -> DataFrame:
    """`docs` with a row id that is the same each time it is read, however the files are split: the
    file's place among the files and the row's in its file. Documents that are not read from files
    are written down first."""
    try:
        placed = docs.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    except AnalysisException:
        return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    place = F.row_number().over(Window.orderBy("__file")).cast("bigint")
    files = stored(placed.select("__file").distinct().withColumn("__place", place), "files")
    return placed.join(files, "__file").withColumn(ROW, F.shiftleft("__place", 40) + F.col("__at")).select(*docs.columns, ROW)


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c != ROW]
    return parity_join.only(rows, stored(gone.select(ROW), "decisions"), "left_anti", on=ROW).select(names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the language its text is predicted to be in; `und` goes."""
    small_batches(spark, 250)
    crf = language.fit(docs.where(fold(3) != 1))
    named = language.predict(docs, crf, docs.columns, ("__lang", "__score")).where(F.col("__lang") != language.UNKNOWN)
    return named.withColumn("lang", F.col("__lang")).select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; a document left without text goes."""
    small_batches(spark, 250)
    left = line_dedup.dedup(docs, removed="__removed").where((F.col("__removed") == 0) | F.col("text").rlike("\\S"))
    return left.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of five-word shingles, at 0.8 or more, the least id stays (a row
    without an id only where no row has one)."""
    small_batches(spark, 250)
    rows = _rows(docs)
    grouped = stored(parity_join.classes(_by_row(rows), n_words=5, percent=80).select(F.col("doc_id").alias(ROW), "component_id"), "near-duplicates")
    # A component's id is its least row: with another row in it there is something to decide.
    several = grouped.where(F.col(ROW) != F.col("component_id")).select("component_id").distinct()
    members = stored(grouped.join(several, "component_id", "left_semi").join(rows.select(ROW, "doc_id"), ROW), "near-duplicates")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).getField(ROW).alias("__least"))
    return _without(rows, members.join(least, "component_id").where(F.col(ROW) != F.col("__least")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that passages of the benchmark contaminate go."""
    small_batches(spark, 250)
    rows = _rows(docs)
    found = positional_index.decontaminate(_by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.where("contaminated").select(F.col("doc_id").alias(ROW)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, and their places in the sequences."""
    small_batches(spark, 250)
    packed = packing.pack(docs, tokenizer(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
