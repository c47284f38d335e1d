"""Nearest neighbours, sparse search and rank fusion.

Dense scoring runs in Arrow batches: one matrix product for a batch of rows and a block of
queries, of which only the best k rows of the task go on. So a shuffle moves k rows for each
task and query, however large the table is, and the plan ends in a top-k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.vectors import check_sparse, check_vector, metric_name, unit

#: Queries that are sent to every task at once, by the bytes of their vectors.
QUERY_BYTES = 64 << 20
#: Pairs of a query and a row that a task scores at a time, and hits that it holds before it passes them on.
CELLS, HELD_HITS = 1 << 20, 1 << 19


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 0))


def top_rows(key: np.ndarray, order: pa.Array, k: int) -> np.ndarray:
    """Places of the ``k`` least keys, ties by ``order``, in order."""
    top = np.arange(len(key))
    if len(top) > k:
        top = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
    return top[np.lexsort((order.take(pa.array(top)).to_numpy(zero_copy_only=False), key[top]))[:k]]


class Nearest:
    """The best ``k`` rows of each query among the batches of a task, in memory that neither the number of queries nor that of
    rows raises beyond ``CELLS`` and ``HELD_HITS``. Under cosine rows have unit length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, metric: str, k: int):
        self.ids, self.q, self.metric, self.k = ids, queries, metric, k
        self.cut = np.full(len(queries), np.inf, np.float32)  # the k-th key found so far
        self.held: list[tuple] = []
        self.n = 0

    def _block(self, m: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``j``, row, key) of all that may be among the best; the least keys are the best."""
        q, cut, k = self.q[j], self.cut[j].astype(np.float64), self.k
        far, slack = q @ m.T, 0.0
        if self.metric == "euclidean":  # squares, which cancellation makes inexact by less than the slack
            a, b = (q * q).sum(1), (m * m).sum(1)
            far = a[:, None] + b[None] - 2 * far
            slack = 4e-16 * (m.shape[1] + 16) * (np.sqrt(a) + np.sqrt(b.max())) ** 2 + 1e-70
            cut = cut * cut * (1 + 1e-6) + slack
        else:
            if self.metric == "cosine":
                np.clip(far, -1.0, 1.0, out=far)
            far = (-far).astype(np.float32)
        ok = far <= cut[:, None]
        if len(m) > k and np.count_nonzero(ok) > 2 * k * len(j):
            kth = np.partition(far, k - 1, axis=1)[:, k - 1].astype(np.float64)
            kth = np.where(np.isnan(kth), np.inf, kth)
            if self.metric == "euclidean":
                kth = (np.maximum(kth, 0) + slack) * (1 + 1e-6) + slack
            ok &= far <= kth[:, None]
        at, row = np.nonzero(ok)
        if self.metric != "euclidean":
            return at, row, far[at, row]
        key, step = np.empty(len(at), np.float32), max(1, CELLS // m.shape[1])
        for lo in range(0, len(at), step):  # from the differences: no cancellation
            key[lo : lo + step] = np.sqrt(((m[row[lo : lo + step]] - q[at[lo : lo + step]]) ** 2).sum(1))
        return at, row, key

    def add(self, m: np.ndarray, id: pa.Array, slot: pa.Array, which: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Rows for all queries, or for those at the places ``which``."""
        which = np.arange(len(self.q)) if which is None else which
        rows = min(len(m), 1 << 14)
        for first in range(0, len(m), max(1, rows)):
            part, step = m[first : first + rows], max(1, CELLS // rows)
            for lo in range(0, len(which), step):
                j = which[lo : lo + step]
                at, row, key = self._block(part, j)
                if len(at):
                    take = pa.array(row + first)
                    self.held.append((j[at], key, id.take(take), slot.take(take)))
                    self.n += len(at)
                if self.n > HELD_HITS:
                    yield from self.best()

    def best(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Keep the best; pass them on at the end, or if they are many."""
        if not self.held:
            return
        j, key = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        id, slot = (pa.concat_arrays([x[i] for x in self.held]) for i in (2, 3))
        place = np.empty(len(j), np.int64)
        place[pc.sort_indices(slot, null_placement="at_start").to_numpy()] = np.arange(len(j))
        o = np.lexsort((place, key, j))
        sorted_j = j[o]
        nth = np.arange(len(o)) - np.searchsorted(sorted_j, sorted_j)
        full = nth == self.k - 1
        self.cut[sorted_j[full]] = np.minimum(self.cut[sorted_j[full]], key[o[full]])
        o = o[nth < self.k]
        take = pa.array(o)
        self.held, self.n = [(j[o], key[o], id.take(take), slot.take(take))], len(o)
        if last or self.n > HELD_HITS // 2:
            j, key, id, slot = self.held[0]
            self.held, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[j]), id, slot, pa.array(key if self.metric == "euclidean" else -key)], names=["qid", "id", "slot", "score"])


def _best(queries, metric: str, k: int, unit_rows: bool):
    """Rows (id, order, vector): (qid, id, order, score) of the best k of each task and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(*queries, metric, k)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(2))
                if not unit_rows:
                    n = np.sqrt((m * m).sum(1, keepdims=True))
                    m = m / np.where(n > 0, n, 1)
                yield from near.add(m, b.column(0), b.column(1))
        yield from near.best(True)

    return run


def ranking(metric: str) -> list[Column]:
    """Better score first, then the stable order of rows."""
    return [F.col("score").asc() if metric == "euclidean" else F.col("score").desc(), F.col("slot").asc()]


def _prepared(queries: Sequence[Sequence[float]], metric: str) -> np.ndarray:
    q = [check_vector(v, len(queries[0])) for v in queries]
    return np.stack([unit(v) if metric == "cosine" else v for v in q]).astype(np.float64)


def knn(df: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", id: str = "id", vector: str = "vector", slot: str | None = None, normalized: bool = False) -> DataFrame:
    """(id, slot, score) of the ``k`` rows nearest to ``query``, exactly, in order.

    ``slot`` is the column that settles ties (the id by default). Rows with a null vector are left
    out. Under cosine, rows are brought to unit length unless ``normalized`` says they are.
    """
    metric = metric_name(metric)
    if k < 1:
        raise InvalidArgument("limit must be at least 1")
    return batch_knn(df, [query], k, metric, id, vector, slot, normalized).orderBy(*ranking(metric)).limit(k).drop("qid")


def batch_knn(df: DataFrame, queries: Sequence[Sequence[float]], k: int = 10, metric: str = "cosine", id: str = "id", vector: str = "vector", slot: str | None = None, normalized: bool = False, qids: Sequence[int] | None = None) -> DataFrame:
    """(qid, id, slot, score, rank): the ``k`` nearest of each query, which are checked to fit a task."""
    metric = metric_name(metric)
    if k < 1:
        raise InvalidArgument("limit must be at least 1")
    q = _prepared(queries, metric)
    if q.nbytes > QUERY_BYTES:
        raise InvalidArgument("too many queries for one batch; search them in several")
    ids = np.asarray(qids if qids is not None else range(len(q)), np.int64)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(slot or id).alias("slot"), F.col(vector).alias("vector"))
    kinds = dict(rows.dtypes)
    near = rows.mapInArrow(_best((ids, q), metric, k, normalized or metric != "cosine"), f"qid bigint, id {kinds['id']}, slot {kinds['slot']}, score float")
    w = Window.partitionBy("qid").orderBy(*ranking(metric))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", qid: str = "id", id: str = "id", vector: str = "vector", normalized: bool = False) -> DataFrame:
    """(qid, id, slot, score, rank): the ``k`` rows nearest to each row of ``queries``, against all of ``rows``.

    Queries come in blocks of at most ``QUERY_BYTES``, by hash of their id; a block is sent to every task, and the rows are
    read once for each. Queries without an id or vector are left out.
    """
    asked = queries.where(F.col(qid).isNotNull() & F.col(vector).isNotNull()).select(F.col(qid).alias("q"), F.col(vector).alias("v"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-2 * n * size * 8 // QUERY_BYTES))  # half full on average
    out = None
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").toArrow()
        for lo in range(0, got.num_rows, max(1, QUERY_BYTES // max(1, 8 * size))):
            some = got.slice(lo, max(1, QUERY_BYTES // max(1, 8 * size)))
            one = batch_knn(rows, some["v"].to_pylist(), k, metric, id, vector, normalized=normalized, qids=some["q"].to_pylist())
            out = one if out is None else out.unionByName(one)
    return out if out is not None else batch_knn(rows, [[1.0]], k, metric, id, vector, normalized=normalized).limit(0)


def sparse_search(df: DataFrame, query: dict, k: int | None = 10, id: str = "id", sparse: str = "sparse") -> DataFrame:
    """(id, score) by dot product with a sparse vector, where it isn't 0; then by id, bytewise.

    The query is a literal map, so a row is scored where it is read, without a join.
    """
    s = check_sparse(query)
    if k is not None and k < 1:
        raise InvalidArgument("limit must be at least 1")
    if not s["indices"]:
        return df.select(F.col(id).alias("id"), F.lit(0.0).cast("float").alias("score")).limit(0)
    weights = F.create_map(*[x for i, v in zip(s["indices"], s["values"]) for x in (F.lit(i).cast("bigint"), F.lit(v).cast("double"))])
    ix, vals = F.col(f"{sparse}.indices"), F.col(f"{sparse}.values")
    parts = F.zip_with(ix, vals, lambda i, x: F.coalesce(F.try_element_at(weights, i), F.lit(0.0)) * x.cast("double"))
    hit = df.where(F.col(sparse).isNotNull() & F.arrays_overlap(ix, F.array(*[F.lit(i).cast("bigint") for i in s["indices"]])))
    out = hit.select(F.col(id).alias("id"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).cast("float").alias("score")).where(F.col("score") != 0)
    out = out.orderBy(F.col("score").desc(), "id")
    return out if k is None else out.limit(k)


def fetch_size(k: int) -> int:
    """Rows that each lane of a fusion contributes."""
    return max(4 * k, 100)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 10, alpha: float = 0.5, rrf_k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of two lanes (id, rank), ranks from 1: (id, score, dense_rank)."""
    alpha = min(1.0, max(0.0, alpha))
    d = dense.select("id", F.col("rank").alias("dense_rank"))
    s = sparse.select("id", F.col("rank").alias("sparse_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    out = d.join(s, "id", "full").withColumn("score", (part(alpha, "dense_rank") + part(1 - alpha, "sparse_rank")).cast("float"))
    return out.orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), "id").limit(k).select("id", "score", "dense_rank")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df``, already cut to a few rows, with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(df: DataFrame, dense: Sequence[float] | None, sparse: dict | None, k: int = 10, alpha: float = 0.5, rrf_k: float = 60.0, metric: str = "cosine", id: str = "id", vector: str = "vector", sparse_column: str = "sparse", slot: str | None = None, normalized: bool = False) -> DataFrame:
    """(id, score) of dense and sparse search fused; of one lane alone, that lane's own result."""
    if k < 1:
        raise InvalidArgument("limit must be at least 1")
    if sparse is not None:
        check_sparse(sparse)
    if dense is None and sparse is None:
        raise InvalidArgument("a hybrid query needs a dense or a sparse lane")
    metric = metric_name(metric)
    if sparse is None:
        return knn(df, dense, k, metric, id, vector, slot, normalized).select("id", "score")
    if dense is None:
        return sparse_search(df, sparse, k, id, sparse_column)
    n = fetch_size(k)
    a = ranked(knn(df, dense, n, metric, id, vector, slot, normalized), *ranking(metric))
    b = ranked(sparse_search(df, sparse, n, id, sparse_column), F.col("score").desc(), F.col("id").asc())
    return fuse(a, b, k, alpha, rrf_k).select("id", "score")
