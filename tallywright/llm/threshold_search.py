"""Exact top-k inner products by the threshold algorithm.

Candidates lie in hashed blocks of bounded size, each with one list per dimension sorted by
component. A query walks all its lists at once, downwards where its own component is positive and
upwards where it is negative, and scores every row it meets in full. The components at the depth
reached bound the score of any row not met yet; the walk ends when that bound cannot reach the
k-th best score. A block's best k per query are merged to the best k of all.

Queries come in hashed blocks too, and every block of queries meets every block of candidates: a
stated query set against all rows.

Defined cases: rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part; a shorter vector counts as padded with zeros; ties go to the smaller id;
a query is not its own candidate, and rows that repeat an id are candidates each; fewer than k
candidates give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_ROWS = 8192
QUERY_ROWS = 2048
_OUT = "query_id bigint, vec_id bigint, score bigint"


class Lists:
    """One block: rows, and per dimension the rows in descending order of the component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        exact = np.abs(rows).max(initial=0) ** 2 * rows.shape[1] < 1 << 24
        self.rows = np.ascontiguousarray(rows[order], np.float32 if exact else np.float64)
        self.down = np.argsort(-self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(self.rows.T, self.down, 1).astype(np.float64)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows whose id is not `own`."""
        n = len(self.ids)
        up, low = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        spot, score = np.zeros(0, np.int64), np.zeros(0)
        exact = np.abs(query).max(initial=0) * np.abs(self.rows).max(initial=0) * len(query) < 1 << 24
        q = query.astype(self.rows.dtype if exact else np.float64)
        depth = 0
        while depth < n:
            to = min(n, max(16, depth * 4))
            before = seen.copy()
            seen[self.down[up, depth:to]] = True
            seen[self.down[low, n - to:n - depth]] = True
            if not len(up) and not len(low):
                seen[depth:to] = True
            new = np.flatnonzero(seen & ~before)
            got = (self.rows @ q)[new] if len(new) * 2 > n else self.rows[new] @ q
            mine = self.ids[new] != own
            spot, score = np.append(spot, new[mine]), np.append(score, got[mine].astype(np.float64))
            if len(spot) > k:
                # Rows are in order of id, so a lower place breaks a tie.
                keep = np.lexsort((spot, -score))[:k] if len(spot) < 4 * k else self._first(spot, score, k)
                spot, score = spot[keep], score[keep]
            depth = to
            if len(spot) == k:
                bound = query[up] @ self.values[up, to - 1] + query[low] @ self.values[low, n - to]
                if score.min() > bound:
                    break
            if seen.all():
                break
        order = np.lexsort((spot, -score))
        return self.ids[spot[order]], score[order].astype(np.int64)

    @staticmethod
    def _first(spot, score, k):
        least = -np.partition(-score, k - 1)[k - 1]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((spot[some], -score[some]))[:k]]


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    lists = table.column("vector").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py():].astype(np.float64)
    out = np.zeros((len(ids), width))
    row = np.repeat(np.arange(len(ids)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat[:len(row)]
    return ids, out


def top_k(vectors: DataFrame, is_query, k: int, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, embedding) that `is_query`
    marks, against all; components become floor(scale * x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    used = vectors.where("vec_id is not null and embedding is not null").where(fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vector"))
    sizes = used.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("vector")).alias("width")).first()
    width = sizes["width"] or 0
    many, asked = max(1, -(-sizes["n"] // CANDIDATE_ROWS)), max(1, -(-sizes["q"] // QUERY_ROWS))
    spread = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = used.withColumn("block", spread(many, 1)).withColumn("asked", every(asked))
    queries = used.where(is_query).withColumn("asked", spread(asked, 2)).withColumn("block", every(many))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            lists = Lists(*_matrix(right, width))
            for own, query in zip(*_matrix(left, width), strict=True):
                ids, score = lists.best(query, own, k)
                out[0].append(np.full(len(ids), own))
                out[1].append(ids)
                out[2].append(score)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), flat, strict=True)})

    found = queries.groupBy("asked", "block").cogroup(rows.groupBy("asked", "block")).applyInArrow(meet, _OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
