"""Repeated runs of lines: winnowing over line hashes.

Lines are compared by their words (white space apart, A-Z as a-z); lines without words are
skipped over. A window is a shortest run of lines with at least `min_words` words, forwards from
a line or backwards from one. Every window's least line hash (rightmost on ties) is a fingerprint,
so two copies of a run of `min_words` words always share one. Fingerprint positions are joined;
windows around shared fingerprints then carry a match both ways as far as it holds, and the lines
of every copy but the first are cut.

A line goes if and only if it lies in a run of at least `min_words` words that equals a run that
starts earlier, by (doc_id, text hash, line), without overlapping it.

Defined cases: a null text stays null, an empty one empty; null ids sort first; rows equal in
doc_id and text are one document and are cut alike; an empty table gives an empty one; other
columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright import session
from tallywright.llm import text as X

MIN_WORDS = 50
_MARKS = "doc_id bigint, doc_key bigint, first int, last int, content bigint, print bigint, leads boolean"


def line_table(data: np.ndarray, bounds: np.ndarray):
    """Lines with words: their numbers in the row, hashes, word counts, and the rows' bounds."""
    starts, ends, at = X.words(data, bounds)
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, bounds[:-1])[X.rows_of(at)]
    row = X.rows_of(at)
    opens = np.ones(len(starts), bool)
    opens[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(opens)
    b = np.append(a[1:], len(starts))
    sums = X.running(X.word_hashes(data, starts, ends))
    return number[a], X.span_hash(sums, a, b), b - a, np.searchsorted(a, at)


def windows(hashes: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, min_words: int):
    """Starts and ends of the distinct windows, their contents' hashes, fingerprint positions."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    row = X.rows_of(bounds)
    i = np.arange(len(hashes))
    to = np.searchsorted(total, total[i] + min_words)
    ahead = np.flatnonzero(to <= bounds[1:][row])
    since = np.searchsorted(total, total[i + 1] - min_words, "right") - 1
    behind = np.flatnonzero(since >= bounds[:-1][row])
    both = np.unique(np.stack([np.append(ahead, since[behind]), np.append(to[ahead], behind + 1)], 1), axis=0)
    a, b = both[:, 0], both[:, 1]
    at, least = a.copy(), hashes[a]
    step, live = 1, np.arange(len(a))
    while len(live := live[a[live] + step < b[live]]):
        h = hashes[a[live] + step]
        won = live[h <= least[live]]
        least[won], at[won] = hashes[a[won] + step], a[won] + step
        step += 1
    return a, b, X.span_hash(X.running(hashes), a, b), at


def _marks(min_words: int):
    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                number, hashes, sizes, at = line_table(data, bounds)
                if not len(hashes):
                    continue
                a, b, content, print_at = windows(hashes, sizes, at, min_words)
                leads = np.zeros(len(a), bool)
                leads[np.unique(print_at, return_index=True)[1]] = True
                of = pa.array(X.rows_of(at)[a])
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).take(of), rows.column(1).take(of), pa.array(number[a].astype(np.int32)), pa.array(number[b - 1].astype(np.int32)),
                    pa.array(content.view(np.int64)), pa.array(hashes[print_at].view(np.int64)), pa.array(leads)],
                    names=["doc_id", "doc_key", "first", "last", "content", "print", "leads"])

    return run


def marks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every window: its document, first and last line, content hash and fingerprint (`leads`
    on one window of each fingerprint position). Written once."""
    spark = docs.sparkSession
    path = session.scratch(spark, "line-marks")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key().alias("doc_key"), "text").where("text is not null")
    keyed.mapInArrow(_marks(min_words), _MARKS).write.parquet(path)
    return spark.read.parquet(path)


def _key():
    return F.xxhash64("doc_id", "text")


def repeats(marked: DataFrame) -> DataFrame:
    """doc_key, first, last of the later copies of repeated windows."""
    # Repeated rows are one document, whatever number of them there is.
    prints = marked.where("leads").select("print", "doc_key", "first")
    shared = prints.groupBy("print").agg(F.min("doc_key").alias("a"), F.max("doc_key").alias("b"), F.min("first").alias("c"), F.max("first").alias("d"))
    shared = shared.where("a <> b or c <> d").select("print")
    near = marked.join(shared, "print", "left_semi")
    firsts = near.groupBy("content").agg(F.min(F.struct("doc_id", "doc_key", "first", "last")).alias("one"), F.max(F.struct("doc_id", "doc_key", "first")).alias("other"))
    firsts = firsts.where("one.doc_key <> other.doc_key or one.first <> other.first").select(
        "content", F.col("one.doc_key").alias("one_key"), F.col("one.first").alias("one_first"), F.col("one.last").alias("one_last"))
    return (near.join(firsts, "content")
            .where("doc_key <> one_key or first > one_last").select("doc_key", "first", "last"))


def _cut(texts, spans):
    import pandas as pd

    out = []
    for t, s in zip(texts, spans, strict=True):
        if t is None or s is None:
            out.append(None)
            continue
        lines = t.split("\n")
        gone = np.zeros(len(lines) + 1, np.int64)
        for x in s:
            gone[x["first"]] += 1
            gone[x["last"] + 1] -= 1
        gone = np.cumsum(gone)
        out.append("\n".join(x for x, g in zip(lines, gone, strict=False) if not g))
    return pd.Series(out, dtype=object)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "lines_removed") -> DataFrame:
    """`docs` with the text of later repeated runs cut, and how many lines went (`removed`)."""
    spans = repeats(marks(docs, min_words)).distinct().groupBy("doc_key").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    # A filter on what was cut, pushed below it, would have every text cut twice, by twice the Python workers.
    cut = F.pandas_udf(_cut, "string").asNondeterministic()
    keyed = docs.withColumn("__key", _key())
    joined = keyed.join(spans.withColumnRenamed("doc_key", "__other").hint("shuffle_hash"), F.col("__key") == F.col("__other"), "left")
    hit = F.col("__spans").isNotNull()
    left = joined.withColumn("__cut", cut(F.when(hit, F.col("text")), F.col("__spans")))
    lines = lambda c: F.length(F.col(c)) - F.length(F.replace(F.col(c), F.lit("\n"))) + 1
    gone = F.when(hit, F.when(F.col("__cut") == "", lines("text")).otherwise(lines("text") - lines("__cut"))).otherwise(0)
    return (left.withColumn(removed, gone.cast("bigint")).withColumn("text", F.coalesce("__cut", "text"))
            .drop("__key", "__other", "__spans", "__cut"))
