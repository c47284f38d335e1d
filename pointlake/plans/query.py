"""Builders of queries on a collection. ``to_df`` gives the lazy plan, ``run`` the hits."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.filters import Filter, as_filter
from ..functions.vectors import check_sparse, check_vector, unit
from ..operators import search as ops

#: Hits that are joined back to their rows by broadcast; beyond, Spark chooses.
BROADCAST_HITS = 10_000


@dataclass
class Hit:
    id: str
    score: float
    payload: Any = None
    vector: list[float] | None = None


def _limit(k: int) -> int:
    if not isinstance(k, int) or k < 1:
        raise InvalidArgument("limit must be at least 1")
    return k


class _Query:
    def __init__(self, collection):
        self.collection = collection
        self._k, self._filter, self._payload, self._vector = 10, Filter(), True, False

    def limit(self, k: int):
        self._k = k
        return self

    def filter(self, spec: Filter | dict | None):
        self._filter = as_filter(spec)
        return self

    def with_payload(self, on: bool):
        self._payload = on
        return self

    def with_vector(self, on: bool):
        self._vector = on
        return self

    def _rows(self) -> DataFrame:
        return self.collection.matching(self._filter)

    def _projected(self, top: DataFrame, order: list) -> DataFrame:
        """Top hits with the columns asked for; wide columns are read for the hits alone."""
        extra = [x for x, on in (("payload", self._payload), ("vector", self._vector)) if on]
        if not extra:
            return top.orderBy(*order)
        top = F.broadcast(top) if self._k <= BROADCAST_HITS else top
        return self.collection.live().select("id", *extra).join(top, "id").orderBy(*order)

    def run(self) -> list[Hit]:
        return [Hit(r["id"], r["score"], json.loads(r["payload"]) if self._payload and r["payload"] is not None else None, list(r["vector"]) if self._vector else None) for r in self.to_df().collect()]


class VectorQuery(_Query):
    def __init__(self, collection, vector: Sequence[float]):
        super().__init__(collection)
        self._query, self._ef = vector, None

    def ef_search(self, ef: int | None):
        """Checked for its range; exact search has no use for it."""
        self._ef = ef
        return self

    def check(self) -> Any:
        self._filter.validate()
        _limit(self._k)
        q = check_vector(self._query, self.collection.dimension)
        if self._ef is not None and not 1 <= self._ef <= 4096:
            raise InvalidArgument("ef_search lies between 1 and 4096")
        if self.collection.metric == "cosine":
            unit(q)
        return q

    def top(self) -> DataFrame:
        self.collection.refresh()
        return ops.knn(self._rows(), self.check(), self._k, self.collection.metric, slot="slot", normalized=True)

    def to_df(self) -> DataFrame:
        return self._projected(self.top(), ops.ranking(self.collection.metric)).drop("slot")


class SparseQuery(_Query):
    def __init__(self, collection, sparse: dict):
        super().__init__(collection)
        self._sparse = sparse

    def to_df(self) -> DataFrame:
        _limit(self._k)
        return self._projected(ops.sparse_search(self._rows(), self._sparse, self._k), [F.col("score").desc(), F.col("id")])


class HybridQuery(_Query):
    def __init__(self, collection):
        super().__init__(collection)
        self._dense = self._sparse = self._text = None
        self._alpha, self._rrf = 0.5, 60.0

    def dense(self, v: Sequence[float]):
        self._dense = v
        return self

    def sparse(self, s: dict):
        self._sparse = s
        return self

    def text(self, t: str):
        self._text = t
        return self

    def alpha(self, a: float):
        self._alpha = a
        return self

    def rrf_k(self, k: float):
        self._rrf = k
        return self

    def to_df(self) -> DataFrame:
        c = self.collection
        _limit(self._k)
        if self._text is not None:
            c.refresh()
            v = c.embed(self._text)
            if not any(v):
                return c.live().select("id", F.lit(0.0).cast("float").alias("score"), *[x for x, on in (("payload", self._payload), ("vector", self._vector)) if on]).limit(0)
            self._dense, self._sparse = v, {"indices": [i for i, x in enumerate(v) if x], "values": [x for x in v if x]}
        check_sparse(self._sparse)
        if self._dense is None and self._sparse is None:
            raise InvalidArgument("a hybrid query needs a dense or a sparse lane")
        if self._dense is None:
            q = SparseQuery(c, self._sparse)
        elif self._sparse is None:
            q = VectorQuery(c, self._dense)
        else:
            n = ops.fetch_size(self._k)
            d = VectorQuery(c, self._dense).limit(n).filter(self._filter).top()
            s = ops.sparse_search(self._rows(), self._sparse, n)
            top = ops.fuse(ops.ranked(d, *ops.ranking(c.metric)), ops.ranked(s, F.col("score").desc(), F.col("id").asc()), self._k, self._alpha, self._rrf)
            return self._projected(top, [F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("id")]).drop("dense_rank")
        return q.limit(self._k).filter(self._filter).with_payload(self._payload).with_vector(self._vector).to_df()
