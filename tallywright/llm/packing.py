"""Token packing by vector best-fit.

A document becomes its token ids and one end id; only documents over the sequence length are cut.
Items and bins are vectors (tokens, documents, attention cost = length squared), and an item goes
to the bin that fits it under every capacity and has the best weighted measure: the least residual
norm after placing, or the largest dot product of item and residual. All three components follow
from an item's length, so items of one length are alike: the plan is made for the histogram of
lengths (at most `max_tokens` rows, whatever the input), placing many alike items into many alike
bins at a time, longest first. Spark counts the lengths, numbers the items of each length, and
looks every item's place up by (length, number).

Defined cases: a null text is an empty one, which is its end id alone; repeated rows are packed
each; null ids stay null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright import session
from tallywright.llm import text as X
from tallywright.llm import tokens

MAX_TOKENS = 2048


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece. The
    tokenizer file is one whose words end at white space and which drops white space."""

    def run(batches):
        words = tokens.words_of(tokenizer)
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text", tokens.SLICE_BYTES):
                ids, at = words.encode(data, bounds)
                at = at + np.arange(len(at))
                all_ids = np.full(at[-1], end_id, np.int32)
                body = np.ones(at[-1], bool)
                body[at[1:] - 1] = False
                all_ids[body] = ids
                count = -(-np.diff(at) // max_tokens)
                row = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * max_tokens
                length = np.minimum(np.diff(at)[row] - start, max_tokens)
                a = at[:-1][row] + start
                raw = memoryview(all_ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * x:4 * (x + n)]) for x, n in zip(a.tolist(), length.tolist(), strict=True)]
                out = [rows.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(X.ragged(all_ids, np.append(a, at[-1])))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


@dataclass
class Capacity:
    tokens: int = MAX_TOKENS
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    measure: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of alike bins, [(length, copies)]) of every kind of bin."""
    if capacity.measure not in ("norm", "dot"):
        raise ValueError(f"measure {capacity.measure!r}: norm or dot")
    full, weight = capacity.vector(), np.array(capacity.weights)
    left = np.zeros((64, 3))
    many = np.zeros(64, np.int64)
    holds: list[tuple] = []  # (copies of the last length, length, what was there before)

    def add(residual, count, what):
        nonlocal left, many
        if len(holds) == len(many):
            left, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([many, np.zeros_like(many)])
        left[len(holds)], many[len(holds)] = residual, count
        holds.append(what)

    for length in sorted(histogram, reverse=True):
        n, item = histogram[length], np.array([length, 1.0, float(length) ** 2])
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens fits no empty bin")
        while n:
            live = np.flatnonzero((many[:len(holds)] > 0) & (left[:len(holds)] >= item).all(1))
            if len(live):
                after = (left[live] - item) / full
                score = (weight * after**2).sum(1) if capacity.measure == "norm" else -(weight * (item / full) * (left[live] / full)).sum(1)
                g = live[score.argmin()]
                residual, bins, before = left[g].copy(), many[g], holds[g]
            else:
                g, residual, bins, before = None, full.copy(), n, None
            # By residual norm a bin just placed in stays the best while it fits; by dot product
            # its alikes, with more room, come first.
            fit = int((residual // item).min()) if capacity.measure == "norm" else 1
            whole = min(bins, n // fit)
            if whole:
                add(residual - fit * item, whole, (fit, length, before))
            rest = n - whole * fit
            part = whole < bins and 0 < rest < fit
            if part:
                add(residual - rest * item, 1, (rest, length, before))
            if g is not None:
                many[g] -= whole + part
            n = 0 if part else rest
    out = []
    for count, what in zip(many, holds, strict=False):
        if count:
            inside = []
            while what is not None:
                inside.append((what[1], what[0]))
                what = what[2]
            out.append((int(count), inside[::-1]))
    return out


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: ranges of item numbers (their starts), the ranges' first bins, offsets in them."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for count, inside in bins:
        offset = 0
        for length, copies in inside:
            for _ in range(copies):
                found.setdefault(length, []).append((count, base, offset))
                offset += length
        base += count
    out = {}
    for length, ranges in found.items():
        r = np.array(ranges, np.int64)
        out[length] = (np.concatenate([[0], np.cumsum(r[:, 0])[:-1]]), r[:, 1], r[:, 2])
    return out


def numbered(rows: DataFrame, by: str, per_part: int = 4_000) -> DataFrame:
    """`rows` with item_number, 0.. within each value of `by`: counted in hashed parts that are
    numbered apart, so a value that most rows have is dealt over many tasks."""
    others = [c for c in rows.columns]
    parts = max(1, -(-rows.count() // per_part))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*others), F.lit(parts)))
    before = (dealt.groupBy(by, "__part").agg(F.count("*").alias("n"))
              .withColumn("__before", F.sum("n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
              .select(F.col(by).alias("__by"), F.col("__part").alias("__p"), F.coalesce("__before", F.lit(0)).alias("__before")))
    own = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*others)) - 1
    return (dealt.withColumn("__own", own).join(before, (F.col(by) == F.col("__by")) & (F.col("__part") == F.col("__p")))
            .withColumn("item_number", F.col("__own") + F.col("__before")).drop("__part", "__own", "__by", "__p", "__before"))


def place(cut: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """`cut` pieces (a table that reads the same each time) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = cut.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity or Capacity())))
    names = cut.columns

    def seat(batches):
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(len(names)).to_numpy()
            bin_, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                some = np.flatnonzero(length == n)
                starts, first, at = shared.value[int(n)]
                k = np.searchsorted(starts, number[some], "right") - 1
                bin_[some], offset[some] = first[k] + number[some] - starts[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(bin_), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return numbered(cut, "length").select(*names, "item_number").mapInArrow(seat, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity | None = None, with_ids: bool = True) -> DataFrame:
    """Every piece of every document and its place; with ids, `sequences` can write them out."""
    capacity = capacity or Capacity()
    spark = docs.sparkSession
    path = session.scratch(spark, "pieces")
    pieces(docs, tokenizer, capacity.tokens, with_ids=with_ids).write.parquet(path)
    return place(spark.read.parquet(path), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, of bounded length each."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("all"))
    return rows.select("sequence_id", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"), F.transform("all", lambda x: x["doc_id"]).alias("doc_ids"))
