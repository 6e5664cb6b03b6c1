"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in blocks with either dictionary. The difference of the two compressed
sizes over the text's size (plus a constant that shrinks short texts towards no evidence) is one
number. A curve that only rises, fitted to labelled texts that the dictionaries have not seen (the
pooled-adjacent-violators blocks, joined by lines), turns it into the probability of label 1.

Defined cases: null and empty texts have difference 0 and the score of no evidence; repeated rows
score alike; with only one label among the training rows every text scores that label's share;
without any, 0.5; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm import text as X
from tallywright.llm.store import drawn, hashed, texts_of

BLOCK_BYTES = 1024
DICTIONARY_BYTES = 1 << 16
SHRINK_BYTES = 200


@dataclass
class Model:
    good: bytes
    bad: bytes
    at: tuple[float, ...]  # the curve's knots
    share: tuple[float, ...]
    level: int = 3


def _compressors(model: Model):
    import zstandard

    out = []
    for raw in (model.good, model.bad):
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        if known:
            known.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False, write_checksum=False))
    return out


def differences(compressors, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / (bytes + a constant), per row."""
    good, bad = compressors
    raw = memoryview(np.ascontiguousarray(data))
    out = np.zeros(len(bounds) - 1)
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        d = 0
        for i in range(a, b, BLOCK_BYTES):
            block = raw[i:min(i + BLOCK_BYTES, b)]
            d += len(bad.compress(block)) - len(good.compress(block))
        out[r] = d / (b - a + SHRINK_BYTES)
    return out


def _blocks(per_text: int):
    """label, text -> label and up to per_text blocks from all over the text."""

    def run(batches):
        for batch in batches:
            for rows, data, bounds in X.slices(batch, "text"):
                label, out = rows.column(1).to_pylist(), []
                for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    n = -(-int(b - a) // BLOCK_BYTES)
                    for i in range(min(n, per_text)):
                        at = a + (n * i // min(n, per_text)) * BLOCK_BYTES
                        out.append((label[r], data[at:min(at + BLOCK_BYTES, b)].tobytes()))
                if out:
                    yield pa.RecordBatch.from_pydict({"label": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([x[1] for x in out], pa.binary())})

    return run


def dictionary(blocks: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; too little text for one is taken as it is."""
    import zstandard

    blocks = sorted(set(blocks))
    size = max(256, min(size, sum(map(len, blocks)) // 8))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


def curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Knots of the rising curve nearest to the labels in squared error. Every block's share has
    a half of a text added to either side, so that none is 0 or 1, and the curve rises strictly."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # texts, sum of labels, sum of x
    for xi, yi in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1, yi, xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = [sx / n for n, _, sx in blocks]
    share = np.maximum.accumulate([(sy + 0.5) / (n + 1) for n, sy, _ in blocks]).tolist()
    wide = max(float(x.std()), 1e-9) * 3
    at = [min(float(x.min()), at[0]) - wide, *at, max(float(x.max()), at[-1]) + wide]
    return tuple(at), (share[0] / 2, *share, (1 + share[-1]) / 2)


def _differences(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        compressors = _compressors(shared.value)
        for batch in batches:
            for part, data, bounds in X.slices(batch, "__text"):
                d = differences(compressors, data, bounds)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(d), pa.array(np.interp(d, shared.value.at, shared.value.share))],
                                                 names=[*keep, "difference", "score"])

    return rows.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame | None = None, per_label: int = 1500, for_curve: int = 4000, per_text: int = 6) -> Model:
    """Fit on docs(text, label 0/1), or docs(doc_id, text) and labels(doc_id, label). Bounded samples,
    chosen by a hash of the text: at most `per_label` different texts of each label give blocks to the
    dictionaries, and at most `for_curve` other texts, in their natural proportion, give the curve."""
    rows = hashed(docs, labels, "label").where("label in (0, 1)")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = 0.5 if not total else float(next(iter(counts)))
        return Model(b"", b"", (0.0,), (share,))
    # The dictionaries' texts lie below a half, the curve's above it.
    share = F.when(F.col("label") == 1, min(0.5, per_label / counts[1])).otherwise(min(0.5, per_label / counts[0]))
    some = texts_of(docs, drawn(rows, F.col("hash"), share, per_label, ["label"], apart=True), "label")
    got = some.mapInArrow(_blocks(per_text), "label int, block binary").collect()
    sides = [dictionary([bytes(r["block"]) for r in got if r["label"] == k]) for k in (1, 0)]
    model = Model(*sides, (-1.0, 1.0), (0.0, 1.0))
    some = texts_of(docs, drawn(rows, F.col("hash"), F.lit(min(0.5, for_curve / total)), for_curve, ["label"], low=0.5), "label")
    seen = _differences(some, model, ["label"]).collect()
    y = np.array([r["label"] for r in seen], float)
    if len(set(y)) == 2:
        model.at, model.share = curve(np.array([r["difference"] for r in seen]), y)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns, difference and score (0 to 1) of every text."""
    return _differences(docs, model, list(keep))
