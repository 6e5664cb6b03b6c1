"""Document log-likelihood by a gated recurrent model over corpus-wide word counts.

Counts of every token of the training documents are gathered by one aggregation and written down.
The `head`, the commonest words up to a fixed number, travels to all tasks; words beyond it are
looked up by a join on their hash, so nothing that grows with the vocabulary is broadcast.

The model (see `gru`) learns from every training document. Documents are dealt by a hash of id and
text into parts of a few million tokens, and the parts into rounds. A round's parts are learned
side by side, each from the weights of the round before, and the round's weights are the mean of
the parts', by their tokens. So the weights do not depend on how the rows are partitioned, a task
holds one part, and what comes to the driver is the weights, once a round.

The model gives the next token's class and, for the commonest words, the word; a word of a tail
class (by a hash of its last bytes) has the add-one share of its count among the class's words.
Scores are log10.

Defined cases: null and empty texts are the end token alone; repeated rows are scored each;
without training documents all counts are 0 and the model is its uniform start; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import text as X
from tallywright.llm.gru import Gru
from tallywright.llm.store import drawn, stored

TAILS = 64
END = np.uint64(0x454E44)  # the end token's place among word hashes
HEAD_WORDS = 1 << 18
MERGE_ROWS = 400_000
SCORED_TOKENS = 3_000_000
PART_TOKENS = 4_000_000
ROUNDS = 4
#: Tasks of a round; one takes several parts in turn where there are more.
PART_TASKS = 1024
SLOT_WEIGHTS = 8192
LANES = 256


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of the rows' tokens, ends included, and the rows' bounds."""
    starts, ends, at = X.words(data, bounds)
    sums = X.running(X.BYTES[data])
    out = at + np.arange(len(at))
    h, tail = np.full(out[-1], END), np.zeros(out[-1], np.int16)
    word = np.ones(out[-1], bool)
    word[out[1:] - 1] = False
    h[word] = X.span_hash(sums, starts, ends)
    tail[word] = (X.span_hash(sums, np.maximum(starts, ends - 3), ends) >> np.uint64(58)).astype(np.int16)
    return h, tail, out


def _counted(batches):
    held: list[tuple] = []

    def merged():
        h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        tail = np.zeros(len(h), np.int16)
        tail[at] = np.concatenate([x[1] for x in held])
        return h, tail, np.bincount(at, np.concatenate([x[2] for x in held])).astype(np.int64)

    def out(h, tail, n):
        for i in range(0, len(h), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(tail[s]), pa.array(n[s])], names=["token", "tail", "n"])

    for batch in batches:
        for _, data, bounds in X.slices(batch, "text"):
            h, tail, _ = tokens(data, bounds)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, tail[first], n))
            if sum(len(x[0]) for x in held) > 2 * MERGE_ROWS:
                held[:] = [merged()]
                if len(held[0][0]) > MERGE_ROWS:
                    yield from out(*held.pop())
    if held:
        yield from out(*merged())


def count_tokens(train: DataFrame) -> DataFrame:
    """token (hash), tail, n of the whole training text; written down."""
    rows = train.select("text").mapInArrow(_counted, "token bigint, tail smallint, n bigint")
    return stored(rows.groupBy("token").agg(F.first("tail").alias("tail"), F.sum("n").alias("n")), "token-counts")


@dataclass
class Model:
    total: int  # training tokens
    distinct: int
    head: np.ndarray  # sorted hashes
    head_counts: np.ndarray
    head_symbols: np.ndarray  # the symbol of a head word, -1: its tail class
    least: int  # words with this count and more are head words
    tail_sizes: np.ndarray  # per tail class: counts + distinct words + 1
    gru: Gru
    end: int
    learned: int = 0  # tokens the weights learned from

    def finder(self) -> np.ndarray:
        """Where the head words of each value of a hash's leading bits begin."""
        return np.searchsorted(self.head, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))

    def symbols(self, h: np.ndarray, tail: np.ndarray, finder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of tokens, and their counts (-1: beyond the head)."""
        last = len(self.head) - 1
        at = np.minimum(finder[h >> np.uint64(46)], last)
        short = np.flatnonzero(self.head[at] < h)
        while len(short):
            short = short[at[short] < last]
            at[short] += 1
            short = short[self.head[at[short]] < h[short]]
        known = self.head[at] == h
        symbol = np.where(known, self.head_symbols[at], -1)
        return np.where(symbol >= 0, symbol, self.gru.words + tail), np.where(known, self.head_counts[at], -1)


def _sampled(shared):
    def run(batches):
        finder = shared.value.finder()
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                h, tail, at = tokens(data, bounds)
                yield pa.RecordBatch.from_arrays([X.ragged(shared.value.symbols(h, tail, finder)[0].astype(np.int32), at)], names=["symbols"])

    return run


def _width(gru: Gru) -> type:
    return np.int16 if len(gru.class_of) < 1 << 15 else np.int32


def _encoded(shared):
    """mark, text -> mark, symbols: the tokens' symbols as bytes."""

    def run(batches):
        m, finder = shared.value, shared.value.finder()
        kind = _width(m.gru)
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                h, tail, at = tokens(data, bounds)
                symbol = m.symbols(h, tail, finder)[0].astype(kind)
                ends = pa.py_buffer((at * symbol.itemsize).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends, pa.py_buffer(symbol)])], names=["mark", "symbols"])

    return run


def _learned(shared, end: int, since: float, until: float):
    """part, symbols in the order of parts -> the sum over the parts of tokens x weights, in slots."""

    def learn(texts: list[bytes]) -> tuple[int, np.ndarray]:
        gru = copy.deepcopy(shared.value)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]) // np.dtype(_width(gru)).itemsize
        symbols = np.frombuffer(b"".join(texts), _width(gru)).astype(np.int64)
        # No more lanes than keep about as long as the longest text: a few lanes alone step at the same price.
        lanes = len(symbols) // max(int(np.diff(bounds).max()), 4096)
        gru.train(symbols, bounds, end, 1, most_lanes=min(LANES, max(16, lanes)), since=since, until=until)
        return len(symbols), len(symbols) * gru.weights()

    def run(batches):
        part, texts, total, sums = None, [], 0, 0.0
        for batch in batches:
            for p, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and texts:
                    n, weights = learn(texts)
                    total, sums, texts = total + n, sums + weights, []
                part = p
                texts.append(symbols)
        if texts:
            n, weights = learn(texts)
            total, sums = total + n, sums + weights
        if total:
            slots = [sums[i:i + SLOT_WEIGHTS].tobytes() for i in range(0, len(sums), SLOT_WEIGHTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slots), dtype=np.int32)), pa.array(np.full(len(slots), total)), pa.array(slots, pa.binary())],
                                             names=["slot", "tokens", "weights"])

    return run


def _mean(rows: pa.Table) -> pa.Table:
    total = sum(rows.column("tokens").to_pylist())
    # In one order, whichever task came first.
    sums = sum(np.frombuffer(w, np.float64) for w in sorted(rows.column("weights").to_pylist()))
    return pa.table({"slot": rows.column("slot").slice(0, 1), "tokens": pa.array([total]), "weights": pa.array([(sums / total).tobytes()], pa.binary())})


def learn(train: DataFrame, model: Model) -> None:
    """The weights of the model, after each training document once."""
    context = train.sparkSession.sparkContext
    parts = max(1, round(model.total / PART_TOKENS))
    rounds = min(ROUNDS, parts)
    rows = train.select(F.xxhash64("doc_id", "text").alias("mark"), "text").mapInArrow(_encoded(context.broadcast(model)), "mark bigint, symbols binary")
    rows = stored(rows.withColumn("part", F.pmod("mark", F.lit(parts)).cast("int")), "training-symbols")
    schema = "slot int, tokens bigint, weights binary"
    for r in range(rounds):
        tasks = min(-(-(parts - r) // rounds), PART_TASKS)
        dealt = rows.where(F.col("part") % rounds == r).repartitionById(tasks, (F.floor(F.col("part") / rounds) % tasks).cast("int"))
        run = _learned(context.broadcast(model.gru), model.end, r / rounds, (r + 1) / rounds)
        sums = dealt.sortWithinPartitions("part", "mark").select("part", "symbols").mapInArrow(run, schema)
        got = sorted(sums.groupBy("slot").applyInArrow(_mean, schema).collect())
        if got:
            model.learned += got[0]["tokens"]
            model.gru.take(np.concatenate([np.frombuffer(g["weights"], np.float64) for g in got]))


def fit(train: DataFrame, counts: DataFrame, words: int = 2048, block: int = 64, hidden: int = 24, sample_docs: int = 0, epochs: int = 2) -> Model:
    """The head, the tail classes and the model, which learns from every training document. Ahead of
    that it may be started, in `epochs` on the driver, on at most `sample_docs` of them chosen by a
    hash of id and text (repeated rows are drawn once)."""
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"] or 0, size["v"]
    # The least count of a head word: counts by sixteenths of a power of two, commonest first.
    step = F.floor(F.log2("n") * 16)
    least, room = 1, HEAD_WORDS
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("low")).orderBy(F.desc("s")).collect():
        room -= r["k"]
        if room < 0:
            break
        least = r["low"]
    else:
        least = 1
    got = counts.where((F.col("n") >= least) | (F.col("token") == int(END))).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    h, n = got.column("token").to_numpy().view(np.uint64).copy(), got.column("n").to_numpy().astype(np.int64)
    tail = got.column("tail").to_numpy()
    if END not in h:
        h, n, tail = np.append(h, END), np.append(n, 0), np.append(tail, 0)
    first = np.concatenate([np.flatnonzero(h == END), np.flatnonzero(h != END)])[:words]
    symbol = np.full(len(h), -1, np.int64)
    symbol[first] = np.arange(len(first))
    all_tails = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    chosen = first[n[first] > 0]
    mass = np.array([all_tails.get(t, (0, 0)) for t in range(TAILS)], np.int64)
    np.subtract.at(mass, tail[chosen], np.stack([n[chosen], np.ones(len(chosen), np.int64)], 1))
    gru = Gru(np.concatenate([n[first], mass[:, 0]]).astype(float), len(first), block, hidden)
    order = np.argsort(h, kind="stable")
    model = Model(total, distinct, h[order], n[order], symbol[order], least, mass.sum(1) + 1, gru, 0)
    if sample_docs:
        _start(train, model, sample_docs, epochs)
    if total:
        learn(train, model)
    return model


def _start(train: DataFrame, model: Model, sample_docs: int, epochs: int) -> None:
    shared = train.sparkSession.sparkContext.broadcast(model)
    texts = max(1, model.head_counts[model.head == END][0])
    named = train.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = drawn(named, ["doc_id", "text"], F.lit(min(1.0, sample_docs / texts)), sample_docs).select("text")
    rows = some.mapInArrow(_sampled(shared), "symbols array<int>").collect()
    rows = sorted((r["symbols"] for r in rows), key=lambda s: (len(s), s))
    if rows:
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        model.gru.train(np.concatenate([np.array(r, np.int64) for r in rows]), bounds, model.end, epochs)


def _scored(shared):
    names = ["doc_id", "n_tokens", "known", "base", "model", "beyond"]

    def run(batches):
        m, finder = shared.value, shared.value.finder()
        tail_log = np.log10(m.tail_sizes)
        whole = np.log10(m.total + m.distinct + 1)
        held: list[tuple] = []

        def out():
            symbols = np.concatenate([x[1] for x in held])
            size = np.concatenate([x[2] for x in held])
            bounds = np.concatenate([[0], np.cumsum(size)])
            model = m.gru.score(symbols, bounds, m.end) / np.log(10) + np.concatenate([x[5] for x in held])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in held]), pa.array(size), pa.array(np.concatenate([x[3] for x in held])),
                                              pa.array(np.concatenate([x[4] for x in held])), pa.array(model), pa.concat_arrays([x[6] for x in held])], names=names)
            held.clear()

        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                h, tail, at = tokens(data, bounds)
                symbol, n = m.symbols(h, tail, finder)
                beyond = n < 0
                share = np.where(beyond, 0.0, np.log10(np.maximum(n, 0) + 1.0))
                rare = symbol >= m.gru.words
                inside = np.where(rare, share - tail_log[np.minimum(np.maximum(symbol - m.gru.words, 0), TAILS - 1)], 0.0)
                far = np.concatenate([[0], np.cumsum(beyond)])[at]
                held.append((rows.column(0), symbol.astype(np.int32), np.diff(at), X.row_sums(n > 0, at), X.row_sums(share, at) - np.diff(at) * whole,
                             X.row_sums(inside, at), X.ragged(h[beyond].view(np.int64), far)))
                if sum(len(x[1]) for x in held) > SCORED_TOKENS:
                    yield from out()
        if held:
            yield from out()

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _scored(shared), "doc_id bigint, n_tokens bigint, known bigint, base double, model double, beyond array<bigint>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored-documents")
    # Rare words are in few documents each; their counts come by a join on the hash.
    far = rows.select("row", F.explode("beyond").alias("token")).join(counts.where(F.col("n") < model.least), "token")
    per = far.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("plus"))
    plus: Column = F.coalesce("plus", F.lit(0.0))
    return rows.drop("beyond").join(per, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + plus).alias("base_score"), (F.col("model") + plus).alias("score"))
