"""Nearest neighbours by low-dimensional stable projections and a kd-tree.

Gaussian (2-stable) projections turn a vector into m numbers; the squared distance of two projections, over
the squared distance of the vectors, has the chi-square distribution with m degrees of freedom. Each block of
rows is indexed by a kd-tree over its projections. A query takes the block's rows one after the other in the
order of projected distance, verifies them in the original space, and stops at projected distance r once a row
as near as the k-th best so far (distance d) would with probability `sure` have come before:
chi2_m(r^2 / d^2) >= sure.

Queries are a stated set against all rows, in blocks: rows stay where they were read, query vectors go to
them in groups of a fixed size, and each block returns its k best for a query.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import read, stage, trimmed

#: Projections; probability of the stopping test; rows of a block; rows of a leaf; rows verified between two tests.
#: More projections stop earlier on vectors that lie about equally far from each other (README has figures).
PROJECTIONS, SURE, BLOCK_ROWS, LEAF_ROWS, STEP = 32, 0.93, 16_384, 256, 32
#: Values of query vectors that are sent to the tasks at once (32 MB as doubles).
QUERY_VALUES = 4_000_000
FOUND = "query_id long, vec_id long, score double"


def chi2_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees of freedom <= x) = p, by bisection on the incomplete gamma series."""
    def cdf(x: float) -> float:
        a, y = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= y / n
            total += term
        return total * math.exp(-y + a * math.log(y) - math.lgamma(a))

    low, high = 1e-9, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projections(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Index:
    """A kd-tree over the projections of a block; equal vectors are held once, with their k + 1 smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, matrix: np.ndarray, k: int, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0  # -0.0 becomes 0.0
        rows = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")  # ids ascend within each distinct vector
        begin = np.searchsorted(which[by], np.arange(len(first)))
        place = np.arange(len(by)) - begin[which[by]]
        kept = place <= k  # a query is one of them at most, so k others are enough
        self.member_ids, self.member_of = ids[by][kept], which[by][kept]
        self.k = k
        self.points = vectors[first] @ matrix
        self.order = np.arange(len(first))
        self.nodes: list[tuple] = []  # (low, high corner, left, right) or (low, high corner, begin, -end)
        self._build(0, len(first), leaf)
        # Rows lie in the order of the leaves, so a leaf is a slice.
        self.begin = np.searchsorted(self.member_of, self.order)
        self.count = np.searchsorted(self.member_of, self.order, side="right") - self.begin
        self.vectors, self.points = vectors[first][self.order], self.points[self.order]

    def _build(self, a: int, b: int, leaf: int) -> int:
        at = len(self.nodes)
        part = self.points[self.order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        self.nodes.append(())
        if b - a <= leaf or not (high > low).any():
            self.nodes[at] = (low, high, a, -b)
            return at
        axis, mid = int(np.argmax(high - low)), (a + b) // 2
        self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid - a)]
        left = self._build(a, mid, leaf)
        right = self._build(mid, b, leaf)
        self.nodes[at] = (low, high, left, right)
        return at

    def search(self, query_id: int, query: np.ndarray, projected: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the k nearest found, and how many vectors were verified.

        Boxes are opened in the order of their projected distance. Rows of opened leaves wait until no closed
        box is nearer than they are; so they come in the order of their projected distance, STEP at a time.
        """
        heap, seen = [(0.0, 0)], 0
        best_d, best_id = np.zeros(0), np.zeros(0, np.int64)
        wait_r, wait_row = np.zeros(0), np.zeros(0, np.int64)
        done = lambda r: len(best_d) >= self.k and r > best_d[-1] ** 2 * quantile
        while heap or len(wait_r):
            bound = heap[0][0] if heap else np.inf
            ready = wait_r <= bound
            if ready.any():
                order = np.argsort(wait_r[ready], kind="stable")
                near, rows = wait_r[ready][order], wait_row[ready][order]
                wait_r, wait_row = wait_r[~ready], wait_row[~ready]
                for a in range(0, len(rows), STEP):
                    if done(near[a]):
                        return best_id, best_d, seen
                    best_id, best_d = self._verified(query_id, query, rows[a : a + STEP], best_id, best_d)
                    seen += len(rows[a : a + STEP])
                continue
            if done(bound):
                break
            _, at = heapq.heappop(heap)
            _, _, a, b = self.nodes[at]
            if b >= 0:
                for child in (a, b):
                    low, high = self.nodes[child][:2]
                    gap = np.maximum(0, np.maximum(low - projected, projected - high))
                    heapq.heappush(heap, (float(gap @ gap), child))
                continue
            apart = self.points[a:-b] - projected
            wait_r, wait_row = np.concatenate([wait_r, np.einsum("ij,ij->i", apart, apart)]), np.concatenate([wait_row, np.arange(a, -b)])
        return best_id, best_d, seen

    def _verified(self, query_id: int, query: np.ndarray, rows: np.ndarray, best_id: np.ndarray, best_d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those so far and of rows."""
        diff = self.vectors[rows] - query
        dist = np.sqrt(np.sum(diff * diff, axis=1))
        if len(best_d) >= self.k:
            rows, dist = rows[dist <= best_d[-1]], dist[dist <= best_d[-1]]
            if not len(rows):
                return best_id, best_d
        n = self.count[rows]
        members = np.repeat(self.begin[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        ids, d = self.member_ids[members], np.repeat(dist, n)
        other = ids != query_id
        best_id, best_d = np.concatenate([best_id, ids[other]]), np.concatenate([best_d, d[other]])
        top = np.lexsort((best_id, best_d))[: self.k]
        return best_id[top], best_d[top]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of the rows that take part: vector and id not null, vector not empty or zero, all components finite."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, m: int = PROJECTIONS, sure: float = SURE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest rows by Euclidean distance of every row for which is_query(id column) holds: query_id, rank, vec_id, score.

    Rows with the query's own id aren't candidates; equal distances go to the smaller id. Rows that repeat an
    id and vector count once for a query. Vectors that are null, empty, zero or hold null, NaN or infinite
    components, and null ids, take no part. A vector of another length than a query's is no candidate of
    it. Fewer than k other rows: all of them. An empty table gives an empty result. Other columns are ignored.

    Every row is indexed, where it was read. Queries travel in groups of QUERY_VALUES values at most, so
    what is broadcast has a fixed size; groups follow each other.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    queries = stage(rows.where(is_query(F.col("id"))).distinct(), "ann-queries")
    lengths = {r["d"]: r["n"] for r in queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    found = None
    for dim, n in sorted(lengths.items()):
        groups = -(-n * dim // QUERY_VALUES)
        for g in range(groups):
            mine = queries.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(groups)) == g)).toArrow()
            if mine.num_rows:
                part = _against(rows.where(F.size("v") == dim), mine, dim, k, m, sure, block_rows)
                found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _against(rows: DataFrame, mine: pa.Table, dim: int, k: int, m: int, sure: float, block_rows: int) -> DataFrame:
    matrix, quantile = projections(dim, m), chi2_quantile(sure, m)
    ids = mine.column("id").to_numpy()
    vectors = _matrix(mine.column("v").combine_chunks())
    sent = rows.sparkSession.sparkContext.broadcast((ids, vectors, matrix))

    def run(batches):
        q_ids, q_vectors, matrix = sent.value
        q_points = q_vectors @ matrix

        def answer(held_ids, held):
            index = Index(np.concatenate(held_ids), np.concatenate(held), matrix, k)
            who, what, how = [], [], []
            for i in range(len(q_ids)):
                near, dist, _ = index.search(q_ids[i], q_vectors[i], q_points[i], quantile)
                who.append(np.full(len(near), q_ids[i]))
                what.append(near)
                how.append(dist)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((who, pa.int64()), (what, pa.int64()), (how, pa.float64()))], names=["query_id", "vec_id", "score"])

        held_ids, held, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                held_ids.append(part.column(0).to_numpy())
                held.append(_matrix(part.column(1)))
                n += part.num_rows
                if n >= block_rows:
                    yield answer(held_ids, held)
                    held_ids, held, n = [], [], 0
        if n:
            yield answer(held_ids, held)

    return rows.mapInArrow(trimmed(run), T.StructType.fromDDL(FOUND))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)
