"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector, ordered thresholds. x marks which
of the chosen features (words and their first 4 to 8 bytes, by hash, A-Z as a-z) a text has. They
are chosen by how far the mean grade of the texts that have them lies from the overall mean, in
standard errors.

Defined cases: null, empty and wordless texts have no features and get the thresholds' own
probabilities; repeated rows score alike; one grade in training is predicted everywhere, none
gives grade 0; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright import session
from tallywright.llm import text as X
from tallywright.llm.store import drawn, hashed, texts_of


@dataclass
class Model:
    grades: list[int]
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and their rows, with repeats."""
    starts, ends, at = X.words(data, bounds, X.LETTER)
    sums, row = X.running(X.BYTES[data]), X.rows_of(at)
    found, of = [X.span_hash(sums, starts, ends)], [row]
    for n in range(4, 9):
        has = np.flatnonzero(ends - starts > n)
        found.append(X.mix(X.span_hash(sums, starts[has], starts[has] + n) ^ np.uint64(n)))
        of.append(row[has])
    return np.concatenate(found), np.concatenate(of)


def _word_sets():
    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                h, row = features(data, bounds)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([rows.column(1), X.ragged(h[new].view(np.int64), np.searchsorted(row[new], np.arange(len(bounds))))], names=["grade", "words"])

    return run


def choose(texts: DataFrame, most: int, least_texts: int) -> np.ndarray:
    """The features of texts(grade number, weight, words) whose texts' mean grade lies furthest
    out, at most `most` (sorted), each in at least `least_texts` texts."""
    whole = texts.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("grade")).alias("g"), F.sum(F.col("weight") * F.col("grade") ** 2).alias("s")).first()
    if not whole["w"]:
        return np.zeros(0, np.uint64)
    mean = whole["g"] / whole["w"]
    spread = max(whole["s"] / whole["w"] - mean**2, 1e-12)
    per = texts.select("grade", "weight", F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("grade")).alias("g"))
    score = F.abs(F.col("g") / F.col("w") - mean) * F.sqrt(F.col("n") / F.lit(spread))
    best = per.where(F.col("n") >= least_texts).withColumn("score", score).where("score > 4").orderBy(F.desc("score"), "word").limit(most)
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64))


def fit_rows(grades: list[int], chosen: np.ndarray, words: np.ndarray, rows: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = 400) -> Model:
    """Fit on texts' chosen features (flat, with their text's number), grade numbers and weights."""
    k = len(grades)
    weight = weight / weight.mean()
    at = np.searchsorted(chosen, words)
    share = np.cumsum([weight[grade == g].sum() for g in range(k)])[:-1] / weight.sum()
    raw = np.log(share / (1 - share)) if k > 1 else np.zeros(0)
    # Thresholds as a first one and the logarithms of the steps up from it keep their order.
    theta = np.concatenate([raw[:1], np.log(np.maximum(np.diff(raw), 1e-3))])
    w = np.zeros(len(chosen))
    first, second = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))

    def thresholds(t):
        return t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]) if len(t) else t

    for step in range(1, steps + 1 if k > 1 else 0):
        eta = np.bincount(rows, w[at], len(grade))
        cut = np.concatenate([[-np.inf], thresholds(theta), [np.inf]])
        up, low = (1 / (1 + np.exp(-np.clip(cut[grade + j] - eta, -30, 30))) for j in (1, 0))
        up, low = np.where(grade == k - 1, 1.0, up), np.where(grade == 0, 0.0, low)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up), low * (1 - low)
        d_eta = weight * -(d_up - d_low) / p
        g_w = np.bincount(at, d_eta[rows], len(w)) / len(grade) - 1e-4 * w
        g_cut = np.array([(weight * (np.where(grade == j, d_up, 0) - np.where(grade == j + 1, d_low, 0)) / p).sum() for j in range(k - 1)]) / len(grade)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(theta[1:])])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, theta = w + move[:len(w)], theta + move[len(w):]
    return Model(grades, chosen, w, thresholds(theta))


def fit(docs: DataFrame, labels: DataFrame | None = None, per_grade: int = 6000, most: int = 512, least_texts: int = 8) -> Model:
    """Fit on docs(text, grade), or docs(doc_id, text) and labels(doc_id, grade): at most `per_grade`
    different texts of each grade, chosen by a hash of the text; copies of a text count once. The
    driver holds at most `most` features of each."""
    rows = hashed(docs, labels, "grade")
    per = rows.groupBy("grade").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).collect()
    counts = {r["grade"]: r["n"] for r in per}
    grades = sorted(counts)
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    different = {r["grade"]: r["texts"] for r in per}
    share, number = F.lit(0.0), F.lit(0)
    for i, g in enumerate(grades):
        share = F.when(F.col("grade") == g, F.lit(min(1.0, per_grade / different[g]))).otherwise(share)
        number = F.when(F.col("grade") == g, F.lit(i)).otherwise(number)
    some = texts_of(docs, drawn(rows, F.col("hash"), share, per_grade, ["grade"], apart=True), "grade")
    found = some.withColumn("grade", number).mapInArrow(_word_sets(), "grade int, words array<bigint>")
    sampled = session.cut(found.withColumn("content", F.xxhash64("words")).dropDuplicates(["grade", "content"]).drop("content"))
    have = {r["grade"]: r["n"] for r in sampled.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(0.0)
    for i, g in enumerate(grades):
        weight = F.when(F.col("grade") == i, F.lit(counts[g] / max(1, have.get(i, 0)))).otherwise(weight)
    texts = sampled.withColumn("weight", weight)
    chosen = choose(texts, most, least_texts)
    listed = F.array(*[F.lit(x) for x in chosen.view(np.int64).tolist()]).cast("array<bigint>")
    got = texts.select("grade", "weight", F.array_intersect("words", listed).alias("words")).collect()
    words = np.array([x for r in got for x in r["words"]], np.int64).view(np.uint64)
    return fit_rows(grades, chosen, words, np.repeat(np.arange(len(got)), [len(r["words"]) for r in got]), np.array([r["grade"] for r in got], np.int64), np.array([r["weight"] for r in got], float))


def predict(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns; grade (likeliest), expected_severity, p_above (any grade above the least)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("grade", T.IntegerType()), T.StructField("expected_severity", T.DoubleType()), T.StructField("p_above", T.DoubleType())])

    def run(batches):
        m = shared.value
        value = np.array(m.grades, float)
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "__text"):
                h, row = features(data, bounds)
                spot = np.minimum(np.searchsorted(m.features, h), max(len(m.features) - 1, 0))
                has = np.flatnonzero(m.features[spot] == h) if len(m.features) else np.zeros(0, int)
                pair = np.unique(row[has] * max(1, len(m.features)) + spot[has])
                eta = np.bincount(pair // max(1, len(m.features)), m.weights[pair % max(1, len(m.features))] if len(pair) else None, rows.num_rows)
                below = 1 / (1 + np.exp(-np.clip(m.thresholds[None] - eta[:, None], -500, 500)))
                p = np.diff(np.concatenate([np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(np.array(m.grades, np.int32)[p.argmax(1)]), pa.array(p @ value), pa.array(1 - p[:, 0])],
                                                 names=[*keep, "grade", "expected_severity", "p_above"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)
