"""Approximate search over an inverted file of cells, with exact search as its fallback."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import metric_name, unit
from .search import Nearest, _matrix, knn

#: Bound of the rows the cells are fitted on: those of least hash.
TRAIN_ROWS = 100_000
#: Up to so many rows search is exact.
SMALL = 256


def fit_cells(df: DataFrame, cells: int = 64, vector: str = "vector", rounds: int = 15, rows: int = TRAIN_ROWS) -> np.ndarray:
    """(cells x dimension) centroids by Lloyd's algorithm on a bounded sample."""
    got = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(rows).toArrow()["v"].combine_chunks()
    if not len(got):
        return np.zeros((0, 0))
    x = _matrix(got)
    c = x[np.random.default_rng(7).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        new = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


def assign(df: DataFrame, centroids: np.ndarray, vector: str = "vector", out: str = "cell") -> DataFrame:
    """``df`` with the nearest cell of each row; write it partitioned by ``out`` and
    searches prune whole cells. Null vectors have a null cell."""

    @F.pandas_udf(T.IntegerType())
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        half = (centroids**2).sum(1)[None]
        for s in batches:
            ok = s.notna()
            res = pd.Series([None] * len(s), dtype="Int32")
            if ok.any():
                res[ok.to_numpy()] = (half - 2 * np.stack(s[ok]).astype(np.float64) @ centroids.T).argmin(1).astype(np.int32)
            yield res

    return df.withColumn(out, cell(vector))


def ivf_search(celled: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int = 10, probes: int = 8, metric: str = "cosine", id: str = "id", vector: str = "vector", slot: str | None = None, cell: str = "cell", normalized: bool = False) -> DataFrame:
    """(id, slot, score) of the nearest rows among the ``probes`` cells nearest to the query. A table of
    at most ``SMALL`` rows, or cells that hold fewer than ``k`` rows, are searched exactly."""
    q = np.asarray(unit(query) if metric_name(metric) == "cosine" else query, np.float64)
    near = np.argsort(((centroids - q) ** 2).sum(1), kind="stable")[:probes]
    part = celled.where(F.col(cell).isin([int(x) for x in near]))
    if celled.limit(SMALL + 1).count() <= SMALL or part.limit(k).count() < k:
        part = celled
    return knn(part, query, k, metric, id, vector, slot, normalized)


def ivf_batch(celled: DataFrame, centroids: np.ndarray, queries: Sequence[Sequence[float]], k: int = 10, probes: int = 8, metric: str = "cosine", id: str = "id", vector: str = "vector", cell: str = "cell", qids: Sequence[int] | None = None) -> DataFrame:
    """(qid, id, score, rank) of the nearest rows in each query's ``probes`` nearest cells, in one pass. A table of at most
    ``SMALL`` rows is searched exactly."""
    metric = metric_name(metric)
    q = np.stack([unit(v) if metric == "cosine" else v for v in queries]).astype(np.float64)
    ids = np.asarray(qids if qids is not None else range(len(q)), np.int64)
    far = (centroids**2).sum(1)[None] - 2 * q @ centroids.T
    open_ = np.zeros(far.shape, bool)
    np.put_along_axis(open_, np.argsort(far, 1, kind="stable")[:, :probes], True, 1)
    if celled.limit(SMALL + 1).count() <= SMALL:
        open_[:] = True
    rows = celled.where(F.col(vector).isNotNull() & F.col(cell).isin([int(c) for c in np.flatnonzero(open_.any(0))])).select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.col(cell).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(ids, q, metric, k)
        for b in batches:
            if not b.num_rows:
                continue
            m, at = _matrix(b.column(1)), b.column(2).to_numpy()
            if metric == "cosine":
                n = np.sqrt((m * m).sum(1, keepdims=True))
                m = m / np.where(n > 0, n, 1)
            for c in np.unique(at):
                here = np.flatnonzero(at == c)
                id = b.column(0).take(pa.array(here))
                yield from near.add(m[here], id, id, np.flatnonzero(open_[:, c]))
        yield from near.best(True)

    kind = dict(rows.dtypes)["id"]
    near = rows.mapInArrow(run, f"qid bigint, id {kind}, slot {kind}, score float").drop("slot")
    w = Window.partitionBy("qid").orderBy(F.col("score").asc() if metric == "euclidean" else F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall) of results (qid, id) against the exact ones."""
    hits = found.join(truth, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("n"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / k).alias("recall"))
