"""Language of every word and document: a linear-chain conditional random field.

A word is a maximal run of letters. Its features are affixes (first and last 1 to 4 bytes), byte
trigrams and the word itself (the learned lexicon), hashed into one weight table; transitions
between the languages of neighbouring words are learned with them. Forward-backward gives each
word's marginal in code-switched text, and a document takes the language with the largest sum.

Defined cases: a null, empty or letterless text is `und` with score 0; ties go to the language
that sorts first; repeated rows are repeated in the output; other columns are not read. Without
any labelled row every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm import text as X
from tallywright.llm.store import drawn

BUCKETS = 1 << 16
UNKNOWN = "und"
_TABLES = {"prefix": 1, "suffix": 2, "gram": 3, "word": 4}


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    steps: np.ndarray  # languages x languages, log scale
    first: np.ndarray


def _bucket(h: np.ndarray, table: int) -> np.ndarray:
    return (X.mix(h ^ np.uint64(0xA0761D6478BD642F * table % (1 << 64))) >> np.uint64(48)).astype(np.int64)


def affixes(sums, starts, ends) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, which words have them), one per affix length, and the whole word."""
    size = ends - starts
    for n in range(1, 5):
        has = np.flatnonzero(size > n)
        yield _bucket(X.span_hash(sums, starts[has], starts[has] + n), _TABLES["prefix"]), has
        yield _bucket(X.span_hash(sums, ends[has] - n, ends[has]), _TABLES["suffix"]), has
    yield _bucket(X.span_hash(sums, starts, ends), _TABLES["word"]), np.arange(len(starts))


def trigrams(sums, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams inside words, and the words' bounds among them."""
    count = np.maximum(ends - starts - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(starts - bounds[:-1], count) + np.arange(bounds[-1])
    return _bucket(X.span_hash(sums, at, at + 3), _TABLES["gram"]), bounds


def emissions(weights: np.ndarray, data, starts, ends) -> np.ndarray:
    """Words x languages: the summed weights of a word's features (trigrams averaged)."""
    sums = X.running(X.BYTES[data])
    out = np.zeros((len(starts), weights.shape[1]))
    for bucket, has in affixes(sums, starts, ends):
        out[has] += weights[bucket]
    gram, bounds = trigrams(sums, starts, ends)
    n = np.maximum(np.diff(bounds), 1)
    return out + X.row_sums(weights[gram], bounds) / n[:, None]


def marginals(crf: Crf, emitted: np.ndarray, fresh: np.ndarray, lanes: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over a run of sequences laid end to end; `fresh` marks their first words.
    Returns the words' marginals, and the forward and backward messages, each up to a factor.

    The run is cut into lanes that step together. A first pass finds what each lane does to any
    incoming state, those are chained, and a second pass then has exact states in every lane.
    """
    n, k = emitted.shape
    if not n or not k:
        return emitted, emitted, emitted
    lanes = max(1, min(lanes, n // 8))
    size = -(-n // lanes)
    e = np.ones((lanes * size, k))
    e[:n] = np.exp(emitted - emitted.max(1, keepdims=True))
    new = np.zeros(lanes * size, bool)
    new[:n] = fresh
    new[n:] = True
    e, new = e.reshape(lanes, size, k), new.reshape(lanes, size)
    move = np.exp(crf.steps - crf.steps.max())
    begin = np.exp(crf.first - crf.first.max())

    def forward(state, t):  # state: lanes x rows x k
        state = np.where(new[:, t, None, None], state.sum(-1, keepdims=True) * begin, state @ move) * e[:, t, None, :]
        return state / np.maximum(state.sum((1, 2), keepdims=True), 1e-300)

    def backward(state, t):  # the message into word t - 1 from word t on
        state = state * e[:, t, None, :]
        return_ = np.where(new[:, t, None, None], (state * begin).sum(-1, keepdims=True), state @ move.T)
        return return_ / np.maximum(return_.sum((1, 2), keepdims=True), 1e-300)

    def chained(step, order, lane_order):
        whole = np.broadcast_to(np.eye(k), (lanes, k, k))
        for t in order:
            whole = step(whole, t)
        into = np.empty((lanes, 1, k))
        state = np.full((1, k), 1.0 / k)
        for lane in lane_order:
            into[lane] = state
            state = state @ whole[lane]
            state = state / state.sum()
        return into

    ahead = np.empty((lanes, size, k))
    state = chained(forward, range(size), range(lanes))
    for t in range(size):
        state = forward(state, t)
        ahead[:, t] = state[:, 0]
    behind = np.empty((lanes, size, k))
    state = chained(backward, range(size - 1, -1, -1), range(lanes - 1, -1, -1))
    for t in range(size - 1, -1, -1):
        behind[:, t] = state[:, 0]
        state = backward(state, t)
    ahead, behind = ahead.reshape(-1, k)[:n], behind.reshape(-1, k)[:n]
    p = ahead * behind
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300), ahead, behind


def _expected_moves(crf: Crf, emitted, fresh, ahead, behind) -> np.ndarray:
    """Expected counts of the transitions inside sequences."""
    into = np.exp(emitted - emitted.max(1, keepdims=True)) * behind
    pair = ahead[:-1, :, None] * np.exp(crf.steps)[None] * into[1:, None, :]
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return pair[~fresh[1:]].sum(0)


def fit_sequences(languages: list[str], runs: list[tuple[int, bytes]], epochs: int = 6, seed: int = 11) -> Crf:
    """Fit on (language, text of a few words) runs: each training sequence strings a few runs of
    any languages together, so that switches are seen and learned."""
    k = len(languages)
    rng = np.random.default_rng(seed)
    crf = Crf(languages, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not runs:
        return crf
    order = rng.permutation(len(runs))
    batches = np.array_split(order, max(1, len(order) // 500))
    square, square_steps = np.full((BUCKETS, k), 1e-2), np.full((k, k), 1.0)
    prepared = []
    for batch in batches:
        texts = [runs[i][1] for i in batch]
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, ends, at = X.words(data, bounds, X.LETTER)
        truth = np.repeat([runs[i][0] for i in batch], np.diff(at))
        if not len(truth):
            continue
        fresh = np.zeros(len(starts), bool)
        fresh[np.unique(np.minimum(at[:-1:3], len(starts) - 1))] = True  # about three runs to a sequence
        fresh[0] = True
        prepared.append((data, starts, ends, truth, fresh))
    for _ in range(epochs):
        for data, starts, ends, truth, fresh in prepared:
            emitted = emissions(crf.weights, data, starts, ends)
            p, ahead, behind = marginals(crf, emitted, fresh)
            left = np.eye(k)[truth] - p
            grad = np.zeros((BUCKETS, k))
            sums = X.running(X.BYTES[data])
            gram, bounds = trigrams(sums, starts, ends)
            n = np.maximum(np.diff(bounds), 1)
            for c in range(k):
                for bucket, has in affixes(sums, starts, ends):
                    grad[:, c] += np.bincount(bucket, left[has, c], BUCKETS)
                grad[:, c] += np.bincount(gram, np.repeat(left[:, c] / n, np.diff(bounds)), BUCKETS)
            square += grad * grad
            crf.weights += 0.25 * grad / np.sqrt(square)
            seen = np.zeros((k, k))
            inner = ~fresh[1:]
            np.add.at(seen, (truth[:-1][inner], truth[1:][inner]), 1.0)
            step = (seen - _expected_moves(crf, emitted, fresh, ahead, behind)) / max(1, inner.sum()) * 100
            square_steps += step * step
            crf.steps += 0.2 * step / np.sqrt(square_steps)
    return crf


def _runs(pieces: int, words_each: int):
    """Text -> up to `pieces` runs of words from all over the text."""

    def cut(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                starts, ends, at = X.words(data, bounds, X.LETTER)
                lang, out = rows.column("lang").to_pylist(), []
                for r in range(rows.num_rows):
                    n = int(at[r + 1] - at[r])
                    for i in range(min(pieces, -(-n // words_each))):
                        a = at[r] + (n * i) // pieces if n > pieces * words_each else at[r] + i * words_each
                        b = min(a + words_each, at[r + 1])
                        out.append((lang[r], data[starts[a]:ends[b - 1]].tobytes()))
                if out:
                    yield pa.RecordBatch.from_pydict({"lang": [x[0] for x in out], "run": pa.array([x[1] for x in out], pa.binary())})

    return cut


def fit(docs: DataFrame, per_language: int = 400, pieces: int = 6, words_each: int = 16) -> Crf:
    """Fit on a bounded sample of labelled documents (text, non-null lang): at most `per_language`
    different documents of each language, chosen by a hash of the text, give at most `pieces` runs of
    `words_each` words from all over them. The driver holds that sample and the weights only."""
    labelled = docs.select("text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Crf([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / counts[lang]))).otherwise(share)
    some = drawn(labelled, ["text"], share, per_language, ["lang"], apart=True).select("text", "lang")
    rows = some.mapInArrow(_runs(pieces, words_each), "lang string, run binary").collect()
    known = {lang: i for i, lang in enumerate(languages)}
    runs = sorted((known[r["lang"]], bytes(r["run"])) for r in rows)
    return fit_sequences(languages, runs)


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _judge(crf: Crf, data, bounds):
    """Language and score of each row, and the words' spans and marginals."""
    starts, ends, at = X.words(data, bounds, X.LETTER)
    emitted = emissions(crf.weights, data, starts, ends)
    fresh = np.zeros(len(starts), bool)
    fresh[at[:-1][at[:-1] < at[1:]]] = True
    p, _, _ = marginals(crf, emitted, fresh)
    total = X.row_sums(p, at)
    n = np.diff(at)
    plain = np.concatenate([[0], np.cumsum(X.LETTER[data] & (data < 0x80))])
    lettered = plain[bounds[1:]] > plain[bounds[:-1]]
    for r in np.flatnonzero(~lettered & (n > 0)):
        lettered[r] = _has_letter(data[bounds[r]:bounds[r + 1]].tobytes())
    if not crf.languages:
        lettered[:] = False
        return [UNKNOWN] * len(n), np.zeros(len(n)), (starts, ends, at, p)
    best = total.argmax(1)
    score = np.where(lettered, total[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
    return [crf.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.clip(score, 0, 1), (starts, ends, at, p)


def predict(docs: DataFrame, crf: Crf, keep: list[str] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns of each row, and the language and score under `names`; text is read, and
    nothing else has a say."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    keep = list(keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    source = "text" if "text" in keep else "__text"

    def label(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, source):
                lang, score, _ = _judge(shared.value, data, bounds)
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(score)], names=[*keep, *names])

    return (docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("__text"))).mapInArrow(label, schema)


def label_words(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, position, word, lang, p of every word: the labels of code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def label(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                _, _, (starts, ends, at, p) = _judge(shared.value, data, bounds)
                row = X.rows_of(at)
                best = p.argmax(1) if p.shape[1] else np.zeros(len(p), int)
                names = shared.value.languages or [UNKNOWN]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - at[:-1][row]),
                    pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)], pa.string()),
                    pa.array([names[b] for b in best], pa.string()),
                    pa.array(p[np.arange(len(p)), best] if p.shape[1] else np.zeros(len(p)))],
                    names=["doc_id", "position", "word", "lang", "p"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("position", T.LongType()), T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(label, schema)
