"""Hard negatives for contrastive training, mined by rotated one-bit codes.

Vectors become whole numbers and are turned by a fixed random rotation (signs and Hadamard steps).
A row's code is the signs of its turned components, stored with its alignment: the row's inner
product with its code as a unit vector. What the code leaves over is coded the same way, up to
`LEVELS` times, each level with its alignment and the norm of what is left. For a query whose
turned components are rounded to eight bits, popcounts of code and bit planes give the inner
product with every code; alignments turn those into an estimate, and by Cauchy-Schwarz the error is
at most the norm left over times the query's, plus what the rounding can add. So every score lies
in a known interval. Level by level, rows whose interval cannot reach the result are dropped; the
rows that remain are scored in whole numbers, so results are exact.

The index (codes, alignments, vectors) is written once, in blocks of one bucket of labels and of
bounded size; a large label has many blocks. Positives are sought in the blocks of the anchor's
label; then the anchors, with the bands their positives give, meet all blocks for negatives.
Every block returns at most the wanted number per anchor and band, and those are merged.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no
part; shorter vectors count as padded with zeros; components are held within 2**26 on either side;
rows with the anchor's id are none of its others; rows that repeat an id are rows each, and an
anchor row that does is mined each time; ties go to the smaller id; fewer rows than wanted give
fewer; a positive of negative score has no negatives; an empty table gives none; other columns are
not read. Labels are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.store import stored

LEVELS = 5
BLOCK_ROWS = 32_768
ANCHOR_ROWS = 4_096
BUCKETS = 64
_LIMIT = 1 << 26
_KIND = {2: np.int16, 4: np.int32, 8: np.int64}


class Rotation:
    """Fixed random rotations, one on top of another, of vectors padded to a power of two, at
    least 64."""

    def __init__(self, width: int, levels: int = LEVELS, seed: int = 11):
        self.size = 64
        while self.size < width:
            self.size *= 2
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (levels, 3, self.size))
        self.unit = 1 / np.sqrt(self.size)

    def padded(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.size))
        out[:, :rows.shape[1]] = rows
        return out

    def turn(self, rows: np.ndarray, level: int) -> np.ndarray:
        for signs in self.signs[level]:
            rows = rows * signs
            half = 1
            while half < self.size:
                pairs = rows.reshape(len(rows), -1, 2, half)
                rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), self.size)
                half *= 2
            rows *= self.unit
        return rows


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


def encode(rows: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, levels, words) and, as float32, per level the alignment and what is left, the
    latter rounded up. What a level leaves is turned again before it is coded."""
    left, levels = rotation.padded(rows), len(rotation.signs)
    codes = np.empty((len(rows), levels, rotation.size // 64), np.uint64)
    facts = np.empty((len(rows), levels, 2), np.float32)
    for k in range(levels):
        left = rotation.turn(left, k)
        up = left >= 0
        codes[:, k] = _bits(up)
        facts[:, k, 0] = np.abs(left).sum(1) * rotation.unit
        left -= np.where(up, rotation.unit, -rotation.unit) * facts[:, k, :1].astype(np.float64)
        facts[:, k, 1] = np.nextafter(np.sqrt((left**2).sum(1)).astype(np.float32), np.float32(np.inf))
    return codes, facts


class Query:
    """A vector as each level turns it, rounded to eight bits a component."""

    def __init__(self, vector: np.ndarray, rotation: Rotation):
        turned = rotation.padded(vector[None].astype(np.float64))
        self.norm = float(np.sqrt((turned**2).sum()))
        self.unit, self.size, self.levels = rotation.unit, rotation.size, []
        for k in range(len(rotation.signs)):
            turned = rotation.turn(turned, k)
            low, high = float(turned.min()), float(turned.max())
            step = (high - low) / 255 or 1.0
            fine = np.clip(np.rint((turned[0] - low) / step), 0, 255).astype(np.int64)
            off = float(np.abs(turned[0] - low - step * fine).sum())
            planes = np.stack([_bits((fine >> b & 1).astype(bool)) for b in range(8)])
            self.levels.append((planes, low, step, int(fine.sum()), off))


class Block:
    """Rows of the index, by label and id."""

    def __init__(self, ids, labels, vectors, codes, facts):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.codes = np.ascontiguousarray(codes[order].transpose(1, 0, 2))
        self.facts = np.ascontiguousarray(facts[order].transpose(1, 2, 0)).astype(np.float64)
        self.ones = np.bitwise_count(self.codes).sum(2, dtype=np.int64)
        top = int(np.abs(self.vectors).max(initial=0))
        # Products that a double holds are summed as doubles, which is the same and faster.
        self.scored = self.vectors.astype(np.float64) if top**2 * max(1, vectors.shape[1]) < 1 << 53 else None
        self.rows_scored = 0

    def same(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def scores(self, query: np.ndarray, some: np.ndarray) -> np.ndarray:
        self.rows_scored += len(some)
        if self.scored is not None and int(np.abs(query).max(initial=0)) * int(np.abs(self.vectors[some]).max(initial=0)) * len(query) < 1 << 53:
            return (self.scored[some] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[some] @ query

    def levels(self, query: Query, some: np.ndarray):
        """Level by level the intervals of the scores of the rows `some`, which the caller may
        thin out: send the places that stay."""
        estimate, rounding = np.zeros(len(some)), np.zeros(len(some))
        weights = (1 << np.arange(8)).astype(np.float32)
        guard = 1e-9 * query.norm
        for codes, facts, ones, (planes, base, step, total, off) in zip(self.codes, self.facts, self.ones, query.levels, strict=True):
            whole = len(some) == len(self.ids)
            mine = codes if whole else codes[some]
            hits = np.zeros(len(some))
            for word in range(mine.shape[1]):
                hits += np.bitwise_count(mine[:, word][:, None] & planes[:, word]).astype(np.float32) @ weights
            align, left = (facts[0], facts[1]) if whole else (facts[0][some], facts[1][some])
            with_code = base * (2.0 * (ones if whole else ones[some]) - query.size) + step * (2 * hits - total)
            estimate = estimate + align * query.unit * with_code
            rounding = rounding + align * query.unit * off
            error = rounding + left * query.norm + guard * (align + left) + 1e-6
            stays = yield some, estimate - error, estimate + error
            some, estimate, rounding = some[stays], estimate[stays], rounding[stays]

    def best(self, query: np.ndarray, coded: Query, some: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best of the rows `some`."""
        walk, stays = self.levels(coded, some), None
        for _ in range(len(self.codes)):
            if len(some) <= 2 * k:
                break
            some, low, high = walk.send(stays) if stays is not None else next(walk)
            stays = high >= np.partition(low, len(low) - k)[len(low) - k] if len(some) > k else np.ones(len(some), bool)
            some = some[stays]
        score = self.scores(query, some)
        first = np.lexsort((self.ids[some], -score))[:k]
        return some[first], score[first]

    def best_within(self, query: np.ndarray, coded: Query, some: np.ndarray, bands: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per band, places and scores of the k best of the rows `some` with low <= score <= high."""
        floors = [low for low, _ in bands]
        open_ = [i for i, (low, high) in enumerate(bands) if low <= high]
        none = np.zeros(0, np.int64)
        if not open_ or not len(some):
            return [(none, none)] * len(bands)

        def reach(low, high):
            out = np.zeros(len(low), bool)
            for i in open_:
                out |= (low <= bands[i][1]) & (high >= floors[i])
            return out

        walk, stays, low, high = self.levels(coded, some), None, None, None
        for _ in range(len(self.codes)):
            some, low, high = walk.send(stays) if stays is not None else next(walk)
            for i in open_:
                sure = low[(low >= bands[i][0]) & (high <= bands[i][1])]
                if len(sure) >= k:
                    floors[i] = max(floors[i], int(np.floor(np.partition(sure, len(sure) - k)[len(sure) - k])))
            stays = reach(low, high)
            some, low, high = some[stays], low[stays], high[stays]
            if not stays.any():
                return [(none, none)] * len(bands)
            if len(some) <= 4 * k:
                break
        found, score = none, none
        order = np.argsort(-(low + high), kind="stable")
        while len(order):
            # The likeliest first: what they score may rule out the rest.
            now, order = order[:64 * k], order[64 * k:]
            found, score = np.append(found, some[now]), np.append(score, self.scores(query, some[now]))
            for i in open_:
                inside = score[(score >= bands[i][0]) & (score <= bands[i][1])]
                if len(inside) >= k:
                    floors[i] = max(floors[i], int(np.partition(inside, len(inside) - k)[len(inside) - k]))
            order = order[reach(low[order], high[order])]
        out = []
        for low_, high_ in bands:
            inside = np.flatnonzero((score >= low_) & (score <= high_))
            first = inside[np.lexsort((self.ids[found[inside]], -score[inside]))[:k]]
            out.append((found[first], score[first]))
        return out


def _lists(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    bounds = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]].astype(np.int64)
    size = np.diff(bounds)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], size)] = flat
    return out


def _blobs(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1)
    each = rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * each).astype(np.int32)), pa.py_buffer(rows)])


def _from_blobs(column, kind, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


class Shape:
    """What the index needs to be read: vector width, bytes a component, blocks by bucket."""

    def __init__(self, width: int, item: int, counts: dict[int, int], block_rows: int):
        self.width, self.item, self.rotation = width, item, Rotation(width)
        self.blocks = [max(1, -(-counts.get(b, 0) // block_rows)) for b in range(BUCKETS)]
        self.base = [sum(self.blocks[:b]) for b in range(BUCKETS)]

    def pick(self, values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int") + 1)

    def vectors(self, column) -> np.ndarray:
        return _from_blobs(column, _KIND[self.item], (self.width,)).astype(np.int64)

    def block(self, t: pa.Table) -> Block:
        words = self.rotation.size // 64
        return Block(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), self.vectors(t.column("vector")),
                     _from_blobs(t.column("codes"), np.uint64, (LEVELS, words)), _from_blobs(t.column("facts"), np.float32, (LEVELS, 2)))


def index(vectors: DataFrame, scale: float = 256.0) -> tuple[DataFrame, Shape]:
    """The written index of vectors(vec_id, label, embedding): row, vec_id, label, block, vector,
    codes, facts."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.lit(scale) * x.cast("double")), F.lit(_LIMIT)), F.lit(-_LIMIT)))
    used = vectors.where("vec_id is not null and label is not null and embedding is not null").where(fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"))
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    # At most one row a bucket.
    facts = used.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"),
                                                     F.max(F.array_max(F.transform("vector", F.abs))).alias("top")).collect()
    width = max((r["width"] for r in facts), default=0) or 1
    top = max((r["top"] or 0 for r in facts), default=0)
    n = sum(r["n"] for r in facts)
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    shape = Shape(width, 2 if top < 1 << 15 else 4, {r["bucket"]: r["n"] for r in facts}, min(BLOCK_ROWS, max(1024, n // (2 * spread))))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = _lists(batch.column(3), shape.width)
                codes, left = encode(rows, shape.rotation)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _blobs(rows.astype(_KIND[shape.item])), _blobs(codes), _blobs(left)],
                                                 names=["row", "vec_id", "label", "vector", "codes", "facts"])

    rows = used.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "vector")
    coded = rows.mapInArrow(run, "row bigint, vec_id bigint, label bigint, vector binary, codes binary, facts binary")
    block = shape.pick(shape.base) + F.pmod(F.xxhash64("row"), shape.pick(shape.blocks)).cast("int")
    return stored(coded.withColumn("block", block), "codes"), shape


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor
    row and each of its best `positives` others of its label, the best `negatives` rows of other
    labels whose score lies between the percentages of the positive's."""
    rows, shape = index(vectors, scale)
    anchors = rows.where(is_anchor).select("row", "vec_id", "label", "vector")
    asked = max(1, -(-anchors.count() // ANCHOR_ROWS))
    mine_ = F.pmod(F.xxhash64("row"), F.lit(asked)).cast("int").alias("asked")
    each = F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("asked")
    candidates = rows.select("vec_id", "label", "vector", "codes", "facts", "block", each).groupBy("asked", "block")
    first_block = shape.pick(shape.base)
    own = F.explode(F.sequence(first_block, first_block + shape.pick(shape.blocks) - 1)).alias("block")
    low, high = percent

    def others(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"row": [], "positive_id": [], "positive_score": []}
        if left.num_rows and right.num_rows:
            block = shape.block(right)
            for row, vec_id, label, vector in zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist(), left.column("label").to_pylist(), shape.vectors(left.column("vector")), strict=True):
                some = np.arange(*block.same(label).indices(len(block.ids)))
                some = some[block.ids[some] != vec_id]
                at, score = block.best(vector, Query(vector, shape.rotation), some, positives)
                out["row"] += [row] * len(at)
                out["positive_id"] += block.ids[at].tolist()
                out["positive_score"] += score.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = anchors.select("*", mine_, own).groupBy("asked", "block").cogroup(candidates).applyInArrow(others, "row bigint, positive_id bigint, positive_score bigint")
    seat = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("nth", seat).where(F.col("nth") <= positives).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))
    known = stored(anchors.join(best, "row"), "anchors")

    def hard(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("row", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        out: dict[str, list] = {n: [] for n in names}
        if left.num_rows and right.num_rows:
            block = shape.block(right)
            every = np.arange(len(block.ids))
            for row, vec_id, label, vector, pairs in zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist(), left.column("label").to_pylist(), shape.vectors(left.column("vector")), left.column("positives").to_pylist(), strict=True):
                bands = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in pairs]
                same = block.same(label)
                some = np.concatenate([every[:same.start], every[same.stop:]])
                some = some[block.ids[some] != vec_id]
                for pair, (at, score) in zip(pairs, block.best_within(vector, Query(vector, shape.rotation), some, bands, negatives), strict=True):
                    for name, value in zip(names[:5], (row, pair["nth"], vec_id, pair["positive_id"], pair["positive_score"]), strict=True):
                        out[name] += [value] * len(at)
                    out["negative_id"] += block.ids[at].tolist()
                    out["negative_score"] += score.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    everywhere = F.explode(F.sequence(F.lit(0), F.lit(sum(shape.blocks) - 1))).alias("block")
    pairs = known.select("*", mine_, everywhere).groupBy("asked", "block").cogroup(candidates).applyInArrow(
        hard, "row bigint, nth bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
