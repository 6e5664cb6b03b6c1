"""Token packing by best-fit decreasing into windows.

A document becomes its token ids and one end id. Documents longer than a window are first cut into
full windows; what is left of them, and the shorter documents, are items that go, longest first,
into the tightest open window that still holds them, or open a new one. A segment tree over the
remaining capacities 0 .. window counts the open windows and finds the tightest one in a walk up
and down it.

Items of one length are alike, so the plan is made for the histogram of lengths, which has at most
`window` rows whatever the input, and fills many alike windows at a time, with the result of
placing item by item. Spark cuts and counts the items; the task that cuts an item also numbers it
among its task's items of that length, and adding the numbers of the tasks before it gives its
number in all, from which the plan gives its place. No rows are sorted for it, and no key gathers
the items of a length.

The windows that best fit leaves partly empty are few, and the last ones opened are the emptiest.
`finish` cuts the items of the emptiest ones to close the gaps of the fullest, and the last of
them at powers of two, where a sequence needs no padding.

Defined cases: a null text is an empty one, which is its end id alone; repeated rows, and equal
lengths, are items each, in the order of their tasks and rows; null ids stay null; an empty table
gives no pieces; a text of any length is cut whole; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright import session
from tallywright.llm import text as X
from tallywright.llm import tokens
from tallywright.llm.store import stored

WINDOW = 4096


class Tightest:
    """Open windows by remaining capacity: a segment tree of counts above lists of alike windows."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: dict[int, list] = {}

    def _change(self, capacity: int, windows: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += windows
            at >>= 1

    def put(self, capacity: int, windows: int, what) -> None:
        """Open `windows` alike windows with that capacity left."""
        if windows and capacity:
            self.held.setdefault(capacity, []).append((windows, what))
            self._change(capacity, windows)

    def find(self, length: int) -> int | None:
        """The least capacity of at least `length` that an open window has."""
        at = length + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                at += not self.count[at]
        return at - self.leaves

    def take(self, capacity: int) -> tuple:
        windows, what = self.held[capacity].pop()
        self._change(capacity, -windows)
        return windows, what

    def rest(self) -> list[tuple[int, int, int]]:
        """(capacity, windows, first window) of all that are open."""
        return [(c, n, what) for c, groups in self.held.items() for n, what in groups]


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], Tightest, int]:
    """Per length, in order of the items' numbers: (items, windows, first window, offset, items a
    window) of every range of them; the open windows; and how many windows there are."""
    tree, ranges, opened = Tightest(window), {}, 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"an item of {length} tokens fits no window of {window}")
        n, mine = int(histogram[length]), ranges.setdefault(length, [])
        while n:
            capacity = tree.find(length)
            if capacity is None:
                fit = window // length
                capacity, windows, first = window, -(-n // fit), opened
                opened += windows
            else:
                # A window just placed in stays the tightest for as long as it holds another one.
                windows, first = tree.take(capacity)
                fit = capacity // length
            whole = min(windows, n // fit)
            rest = n - whole * fit if whole < windows else 0
            offset = window - capacity
            if whole:
                mine.append((whole * fit, whole, first, offset, fit))
                tree.put(capacity - fit * length, whole, first)
            if rest:
                mine.append((rest, 1, first + whole, offset, rest))
                tree.put(capacity - rest * length, 1, first + whole)
            tree.put(capacity, windows - whole - bool(rest), first + whole + bool(rest))
            n -= whole * fit + rest
    return ranges, tree, opened


def finish(tree: Tightest, opened: int, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which open windows are emptied, and where their tokens go when laid end to end.

    Of the windows with a gap of at least `least`, in order of their gaps, as many are emptied as it
    takes to fill the gaps of the others; at most a window of tokens is left, which is cut at powers
    of two. Emptied: (first window, windows, tokens each, place of the first token). Targets:
    (place of the first token, tokens each, windows, first window, offset).
    """
    groups = sorted((g for g in tree.rest() if g[0] >= least), reverse=True)
    gaps, poured, emptied, filled = sum(c * n for c, n, _ in groups), 0, [], []
    for capacity, n, first in groups:
        some = max(0, min(n, -(-(gaps - poured) // window)))
        if some:
            emptied.append((first, some, window - capacity, poured))
            poured += some * (window - capacity)
            gaps -= some * capacity
        if some < n:
            filled.append((capacity, n - some, first + some))
    targets, at = [], 0
    for capacity, n, first in filled:
        targets.append((at, capacity, n, first, window - capacity))
        at += capacity * n
    left = poured - at
    for bit in reversed(range(window.bit_length())):
        if left >> bit & 1:
            targets.append((at, 1 << bit, 1, opened, 0))
            at, opened = at + (1 << bit), opened + 1
    return np.array(sorted(emptied), np.int64).reshape(-1, 4), np.array(targets, np.int64).reshape(-1, 5)


class Places:
    """Where the item of a given length and number goes, whole or in cuts."""

    def __init__(self, histogram: dict[int, int], window: int, least: int):
        ranges, tree, opened = plan(histogram, window)
        self.ranges = {}
        for length, found in ranges.items():
            r = np.array(found, np.int64)
            self.ranges[length] = (np.cumsum(r[:, 0]) - r[:, 0], r)
        self.emptied, self.targets = finish(tree, opened, window, least)

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window and offset of each item, and its place among the tokens that are poured, or -1."""
        bin_, offset, poured = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.full(len(length), -1)
        for n in np.unique(length):
            some = np.flatnonzero(length == n)
            starts, r = self.ranges[int(n)]
            k = np.searchsorted(starts, number[some], "right") - 1
            nth = number[some] - starts[k]
            bin_[some], offset[some] = r[k, 2] + nth // r[k, 4], r[k, 3] + nth % r[k, 4] * n
        if len(self.emptied):
            e = self.emptied[np.maximum(np.searchsorted(self.emptied[:, 0], bin_, "right") - 1, 0)]
            gone = (bin_ >= e[:, 0]) & (bin_ < e[:, 0] + e[:, 1])
            poured[gone] = (e[:, 3] + (bin_ - e[:, 0]) * e[:, 2] + offset)[gone]
        return bin_, offset, poured

    def cut(self, poured: int, length: int) -> list[tuple[int, int, int, int]]:
        """(tokens before, tokens, window, offset) of the cuts of an item that is poured."""
        out, done = [], 0
        while done < length:
            base, size, _, first, offset = self.targets[np.searchsorted(self.targets[:, 0], poured + done, "right") - 1].tolist()
            nth, into = divmod(poured + done - base, size)
            take = min(length - done, size - into)
            out.append((done, take, first + nth, offset + into))
            done += take
        return out


_KEY = ["part", "length", "number"]


def items(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and ids (little-endian, 2 or 4 bytes each) of
    every full window and rest, with its task and its number among the task's items of its length."""

    def run(batches):
        words = tokens.words_of(tokenizer)
        part = TaskContext.get().partitionId()
        counted = np.zeros(window + 1, np.int64)
        narrow = words.tokenizer.get_vocab_size() <= 1 << 16 and 0 <= end_id < 1 << 16
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text", tokens.SLICE_BYTES):
                ids, at = words.encode(data, bounds)
                at = at + np.arange(len(at))
                every = np.full(at[-1], end_id, "<u4")
                body = np.ones(at[-1], bool)
                body[at[1:] - 1] = False
                every[body] = ids
                size = np.diff(at)
                count = -(-size // window)
                row = np.repeat(np.arange(len(count)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(size[row] - start, window)
                first = at[:-1][row] + start
                raw = memoryview(every).cast("B")
                crc = [zlib.crc32(raw[4 * x:4 * (x + n)]) for x, n in zip(first.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order])
                number = np.empty(len(length), np.int64)
                number[order] = counted[length[order]] + np.arange(len(order)) - run_start
                counted += np.bincount(length, minlength=window + 1)
                kept = every.astype("<u2") if narrow else every
                ends = np.append(first, at[-1]) * kept.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row]),
                                                  pa.array(np.full(len(row), part), pa.int32()), pa.array(number), blobs],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "ids"])

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, number bigint, ids binary"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def place(cut: DataFrame, window: int = WINDOW, least_cut: int = 16, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of the
    stored `items` and, if asked for, its ids."""
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(histogram, window, least_cut)
    # At most `window` lengths, each with the ranges of a bounded number of kinds of windows.
    shared = cut.sparkSession.sparkContext.broadcast(places)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = cut.drop("ids").join(counts.select("length", "part", earlier.alias("before")), ["length", "part"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"]

    def seat(batches):
        for batch in batches:
            column = {n: batch.column(i).to_numpy() for i, n in enumerate([*names, "before"]) if n in ("length", "number", "before")}
            found = shared.value.find(column["length"], column["number"] + column["before"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *map(pa.array, found)], names=[*names, "sequence_id", "offset", "poured"])

    placed = numbered.select(*names, "before").mapInArrow(seat, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, number bigint, sequence_id bigint, offset bigint, poured bigint")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    if with_ids:
        out, types = [*out, "ids"], types + ", ids binary"
    whole = placed.where("poured < 0")
    if with_ids:
        whole = whole.join(cut.select(*_KEY, "ids"), _KEY)
    if not len(places.emptied):
        return whole.select(out)

    def cuts(batches):
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                width = len(r["ids"]) // r["length"]
                for before, n, bin_, offset in shared.value.cut(r["poured"], r["length"]):
                    ids = np.frombuffer(r["ids"], f"<u{width}", n, before * width)
                    made.append(r | {"start": r["start"] + before, "length": n, "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                                     "sequence_id": bin_, "offset": offset, "ids": ids.tobytes()})
            yield pa.RecordBatch.from_pydict({k: pa.array([m[k] for m in made], pa.binary() if k == "ids" else pa.int64()) for k in out})

    # Written first: few as a rule, so that they go to the ids instead of the ids to them.
    poured = stored(placed.where("poured >= 0"), "poured")
    some = poured.join(cut.select(*_KEY, "ids"), _KEY)
    return whole.select(out).unionByName(some.select(*names[:5], "poured", "ids").mapInArrow(cuts, types))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, least_cut: int = 16, with_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place; with ids, `sequences` can write them out."""
    spark = docs.sparkSession
    path = session.scratch(spark, "items")
    items(docs, tokenizer, window, end_id).write.parquet(path)
    return place(spark.read.parquet(path), window, least_cut, with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, of at most a window each."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "start", "length", "doc_id", "ids"))).alias("all"))

    def join(batches):
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(x["ids"], f"<u{len(x['ids']) // x['length']}").astype(np.int32) for x in r]) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2)], names=["sequence_id", "ids", "doc_ids"])

    return rows.select("sequence_id", "all", F.transform("all", lambda x: x["doc_id"]).alias("doc_ids")).mapInArrow(join, "sequence_id bigint, ids array<int>, doc_ids array<bigint>")
