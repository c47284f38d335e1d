"""Databases of named collections, with the operations of an embedded store."""

from __future__ import annotations

import json
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AlreadyExists, Closed, CollectionNotFound, InvalidArgument, UnsupportedProvider
from ..functions.filters import Filter, as_filter
from ..functions.vectors import check_sparse, check_vector, metric_name, unit
from ..functions.vectors import normalize as normalize_column
from ..operators import search as ops
from ..operators.lexical import Embedder, Lexical, available_providers, build_provider
from ..sources import store as st
from .query import Hit, HybridQuery, SparseQuery, VectorQuery, _limit

MAX_DIMENSION, MAX_PAYLOAD, MAX_ID, MAX_NAME = 65536, 16 << 20, 512, 255
#: Rows written since the last checkpoint whose ids (of at most ``MAX_ID`` bytes) are broadcast.
DELTA_ROWS = 50_000
#: Components of vectors that a task embeds at a time.
EMBEDDED = 1 << 20


@dataclass
class Point:
    id: str
    vector: Sequence[float]
    payload: Any = None
    sparse: dict | None = None


@dataclass
class ScrollPage:
    points: list[Point]
    next_cursor: str | None


def _check_id(x: Any) -> str:
    if not isinstance(x, str) or not 1 <= len(x.encode()) <= MAX_ID:
        raise InvalidArgument("an id has 1 to 512 bytes")
    return x


def _check_name(x: Any) -> str:
    if not isinstance(x, str) or not 1 <= len(x.encode()) <= MAX_NAME or x != x.strip() or any(ch in x for ch in "/\\\0"):
        raise InvalidArgument(f"{x!r} can't be a name")
    return x


def _payload(p: Any, reserved: bool = False) -> str | None:
    if p is None:
        return None
    if isinstance(p, dict) and not reserved and any(k.startswith("_") for k in p):
        raise InvalidArgument("payload keys that begin with _ are reserved")
    try:
        out = json.dumps(p, ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise InvalidArgument(f"the payload isn't JSON: {e}") from e
    if len(out.encode()) > MAX_PAYLOAD:
        raise InvalidArgument("the payload is larger than 16 MiB")
    return out


def _sparse_of(v: np.ndarray) -> dict | None:
    ix = np.flatnonzero(v)
    return {"indices": ix.tolist(), "values": v[ix].tolist()} if len(ix) else None


def _placed(v: Sequence[float], dimension: int) -> np.ndarray:
    """An embedding as it is stored: a text without known terms gets the first axis."""
    a = np.asarray(v, np.float32)
    if not a.any():
        a = np.zeros(dimension, np.float32)
        a[0] = 1
    return a


def _embedded(emb: Any, dimension: int, cosine: bool):
    """Rows (id, slot, payload, text): the first three, with the vector and the sparse lane of the text."""
    many = getattr(emb, "embed_batch", None) or (lambda ts: [emb.embed(t) for t in ts])
    step = max(1, EMBEDDED // dimension)

    def vectors(texts: list[str]) -> np.ndarray:
        if not isinstance(emb, Lexical):
            return np.stack([unit(v) if cosine else v for v in (_placed(x, dimension) for x in many(texts))]).astype(np.float32)
        m = emb.matrix(texts).astype(np.float32)
        m[~m.any(1), 0] = 1
        return m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                m = vectors(b.column(3).to_pylist())
                at, ix = np.nonzero(m)
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(m)))]).astype(np.int32)
                lane = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, ix.astype(np.int64)), pa.ListArray.from_arrays(ends, m[at, ix])], ["indices", "values"])
                dense = pa.ListArray.from_arrays(np.arange(0, m.size + 1, dimension, dtype=np.int32), m.reshape(-1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), dense, lane], names=["id", "slot", "payload", "vector", "sparse"])

    return run


class Collection:
    def __init__(self, db: Database, key: str):
        self._db, self._key, self._mutex = db, key, threading.RLock()

    @property
    def _entry(self) -> dict:
        self._db._open()
        e = self._db._store.manifest["collections"].get(self._key)
        if e is None:
            raise CollectionNotFound("the collection was deleted")
        return e

    name = property(lambda self: self._entry["name"])
    dimension = property(lambda self: self._entry["config"]["dimension"])
    metric = property(lambda self: self._entry["config"]["metric"])

    def _raw(self) -> DataFrame:
        return self._db._store.scan(self._entry["parts"])

    def live(self) -> DataFrame:
        """The latest row of each id that isn't deleted, with the columns of declared indexes.

        Sealed parts have one row an id. Only what was written since is grouped by id, and takes the place of the
        sealed rows of its ids; these are never shuffled while the ids are few. A whole part holds every row that was live
        when it was written, so none before it counts, and one part whose ids are distinct isn't grouped."""
        e = self._entry
        parts = e["parts"][max((i for i, p in enumerate(e["parts"]) if p.get("whole")), default=0) :]
        sealed = [p for p in parts if p.get("sealed") or p.get("whole")] or (parts if e.get("sealed") and len(parts) <= 1 else [])
        later = [p for p in parts if p not in sealed]
        columns = ["id", "slot", "vector", "sparse", "payload", *st.index_columns(e["indexes"])]
        base = self._db._store.scan(sealed, e["indexes"]).where("not deleted").select(*columns)
        if not later:
            return base
        rows = self._db._store.scan(later, e["indexes"])
        rest = [c for c in columns if c != "id"]
        if len(later) == 1 and later[0].get("distinct"):
            latest = rows.where("not deleted").select(*columns)
        else:
            latest = rows.groupBy("id").agg(F.max_by(F.struct("deleted", *rest), "ver").alias("r")).where("not r.deleted").select("id", *[F.col(f"r.`{c}`") for c in rest])
        if not sealed:
            return latest
        ids = rows.select("id").distinct()
        ids = F.broadcast(ids) if sum(p["rows"] for p in later) <= DELTA_ROWS else ids
        return base.join(ids, "id", "left_anti").unionByName(latest)

    def matching(self, f: Filter) -> DataFrame:
        """Live rows that satisfy a filter; declared indexes let the scan skip row groups."""
        rows = self.live()
        if f.is_empty():
            return rows
        bounds = f.prune(self._entry["indexes"])
        return (rows if bounds is None else rows.where(bounds)).where(f.compile(F.col("payload")))

    def __len__(self) -> int:
        if self._db._store.manifest["collections"].get(self._key) is None:
            return 0
        return self.live().count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def _next(self, n: int) -> int:
        e = self._entry
        first = e["next"]
        e["next"] += n
        return first

    def _row(self, p: Point, reserved: bool = False) -> dict:
        _check_id(p.id)
        v = check_vector(p.vector, self.dimension)
        payload = _payload(p.payload, reserved)
        sparse = check_sparse(p.sparse)
        if sparse is not None and self._entry["config"]["provider"] and not reserved:
            raise InvalidArgument("a text collection makes its own sparse lane")
        if self.metric == "cosine":
            v = unit(v)
        return {"id": p.id, "vector": v.tolist(), "sparse": sparse, "payload": payload, "deleted": False}

    def _append(self, rows: list[dict]) -> None:
        if not rows:
            return
        with self._mutex:
            first = self._next(len(rows))
            for i, r in enumerate(rows):
                r["ver"] = first + i
                r["slot"] = None if r["deleted"] else first + i
            e = self._entry
            e["parts"] = [*e["parts"], self._db._store.add_rows(self._key, rows)]
            e["sealed"] = False
            e["slots"] += sum(not r["deleted"] for r in rows)
            self._db._store.commit()

    def upsert(self, point: Point | str, vector: Sequence[float] | None = None, payload: Any = None, sparse: dict | None = None) -> None:
        self.upsert_points([point if isinstance(point, Point) else Point(point, vector, payload, sparse)])

    def upsert_points(self, points: Sequence[Point]) -> None:
        """All points are checked before any is kept; of equal ids the last stays."""
        self._db._store.guard()
        self._append([self._row(p) for p in points])

    def upsert_batch(self, ids: Sequence[str], vectors: Any, payloads: Sequence[Any] | None = None) -> None:
        if len(ids) != len(vectors) or payloads is not None and len(payloads) != len(ids):
            raise InvalidArgument("ids, vectors and payloads differ in length")
        self.upsert_points([Point(i, v, p) for i, v, p in zip(ids, vectors, payloads or [None] * len(ids))])

    def upsert_df(self, df: DataFrame, order_by: str | list[str] = "id") -> None:
        """Rows (id, vector, payload, sparse; the last two may be missing) in the order of ``order_by``,
        checked and written by the executors."""
        self._db._store.guard()
        have = set(df.columns)
        rows = df.select(
            F.col("id").cast("string").alias("id"),
            F.col("vector").cast("array<float>").alias("vector"),
            (F.col("payload") if "payload" in have else F.lit(None)).cast("string").alias("payload"),
            (F.col("sparse") if "sparse" in have else F.lit(None)).cast(st.SPARSE).alias("sparse"),
            F.struct(*([order_by] if isinstance(order_by, str) else order_by)).alias("_o"),
        )
        size = F.octet_length("id")
        bad = F.col("id").isNull() | (size < 1) | (size > MAX_ID) | F.coalesce(F.size("vector") != self.dimension, F.lit(True))
        least, most = F.array_min("vector"), F.array_max("vector")  # NaN is the greatest of all
        bad = bad | F.coalesce(F.array_contains("vector", F.lit(float("nan")).cast("float")), F.lit(True)) | (least == float("-inf")) | (most == float("inf")) | F.coalesce(F.octet_length("payload") > MAX_PAYLOAD, F.lit(False))
        if self.metric == "cosine":
            bad = bad | ((least == 0) & (most == 0))
        if not rows.where(bad).isEmpty():
            raise InvalidArgument("some rows have a wrong id, vector or payload")
        rows = rows.orderBy("_o").drop("_o")
        if self.metric == "cosine":  # after the sort, whose sampling would do it once more
            rows = rows.withColumn("vector", normalize_column(F.col("vector")))
        with self._mutex:
            self._append_frame(rows)

    def upsert_text_df(self, df: DataFrame, order_by: str | list[str] = "id") -> None:
        """Texts (id, text) in the order of ``order_by``, checked and written by the executors. They lie on the first axis
        until the next search, or :meth:`refit`, fits the provider and embeds them."""
        self._db._store.guard()
        self._embedder()
        rows = df.select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(F.col("text").cast("string").alias("_text"))).alias("payload"), F.col("text").isNull().alias("_none"), F.struct(*([order_by] if isinstance(order_by, str) else order_by)).alias("_o"))
        size = F.octet_length("id")
        if not rows.where(F.col("id").isNull() | (size < 1) | (size > MAX_ID) | F.col("_none") | (F.octet_length("payload") > MAX_PAYLOAD)).isEmpty():
            raise InvalidArgument("some rows have a wrong id or text")
        axis = F.array(*[F.lit(float(i == 0)).cast("float") for i in range(self.dimension)])
        with self._mutex:
            self._append_frame(rows.orderBy("_o").select("id", "payload", axis.alias("vector"), F.lit(None).cast(st.SPARSE).alias("sparse")))
            self._entry["dirty"] = True
            self._db._store.commit()

    def _append_frame(self, ordered: DataFrame) -> None:
        """Rows in order; places rise along the sorted partitions, with gaps between them."""
        e = self._entry
        out = ordered.withColumn("ver", F.monotonically_increasing_id() + F.lit(e["next"])).withColumns({"slot": F.col("ver"), "deleted": F.lit(False)})
        part = self._db._store.add_frame(self._key, out, e["indexes"])
        top, ids = self._db._store.scan([part]).agg(F.max("ver"), F.count_distinct("id")).first()
        if top is not None:
            part["distinct"] = ids == part["rows"]
            e["next"] = top + 1
            e["slots"] += part["rows"]
            e["parts"], e["sealed"] = [*e["parts"], part], False
            self._db._store.commit()

    def delete(self, id: str) -> bool:
        return self.delete_batch([id]) == 1

    def delete_batch(self, ids: Sequence[str]) -> int:
        """How many existed; a repeated id counts once."""
        self._db._store.guard()
        asked = self._db.spark.createDataFrame(pd.DataFrame({"id": sorted(set(ids))}), "id string")
        have = [r[0] for r in self.live().select("id").join(asked, "id").collect()]  # of the ids at hand
        self._append([{"id": x, "vector": None, "sparse": None, "payload": None, "deleted": True} for x in have])
        return len(have)

    def delete_where(self, spec: Filter | dict) -> int:
        """As :meth:`delete_batch` for all that match, without leaving the executors."""
        self._db._store.guard()
        gone = self.matching(as_filter(spec))
        with self._mutex:
            e = self._entry
            rows = gone.select("id", F.lit(None).cast("bigint").alias("slot"), (F.lit(e["next"]) + F.monotonically_increasing_id()).alias("ver"), F.lit(True).alias("deleted"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(st.SPARSE).alias("sparse"), F.lit(None).cast("string").alias("payload"))
            part = self._db._store.add_frame(self._key, rows)
            if part["rows"]:
                e["next"] = self._db._store.scan([part]).agg(F.max("ver")).first()[0] + 1
                e["parts"], e["sealed"] = [*e["parts"], part], False
                self._db._store.commit()
            return part["rows"]

    @staticmethod
    def _point(r) -> Point:
        s = r["sparse"]
        return Point(r["id"], list(r["vector"]), json.loads(r["payload"]) if r["payload"] is not None else None, {"indices": list(s["indices"]), "values": list(s["values"])} if s else None)

    def get(self, id: str) -> Point | None:
        r = self.live().where(F.col("id") == id).first()
        return self._point(r) if r else None

    def query(self, vector: Sequence[float]) -> VectorQuery:
        return VectorQuery(self, vector)

    def search(self, vector: Sequence[float], limit: int = 10, filter: Filter | dict | None = None, ef_search: int | None = None, with_payload: bool = True, with_vector: bool = False) -> list[Hit]:
        return self.query(vector).limit(limit).filter(filter).ef_search(ef_search).with_payload(with_payload).with_vector(with_vector).run()

    def search_batch(self, vectors: Sequence[Sequence[float]], limit: int = 10, filter: Filter | dict | None = None) -> DataFrame:
        """(qid, id, score, rank) for all queries in one pass over the rows."""
        self.refresh()
        f = as_filter(filter)
        for v in vectors:
            VectorQuery(self, v).limit(limit).filter(f).check()
        rows = self.matching(f)
        return ops.batch_knn(rows, vectors, limit, self.metric, slot="slot", normalized=True).drop("slot")

    def search_sparse(self, sparse: dict, limit: int = 10) -> list[Hit]:
        return SparseQuery(self, sparse).limit(limit).run()

    def hybrid_query(self) -> HybridQuery:
        return HybridQuery(self)

    def hybrid_search(self, dense=None, sparse=None, text=None, alpha: float = 0.5, rrf_k: float = 60.0, limit: int = 10, filter: Filter | dict | None = None) -> list[Hit]:
        q = self.hybrid_query().alpha(alpha).rrf_k(rrf_k).limit(limit).filter(filter)
        q._dense, q._sparse, q._text = dense, sparse, text
        return q.run()

    def scroll(self, after: str | None = None, limit: int = 100, filter: Filter | dict | None = None) -> ScrollPage:
        """A page in stable order after the row ``after``, or the place it last had."""
        _limit(limit)
        f = as_filter(filter)
        rows = self.matching(f)
        if after is not None:
            at = self._raw().where((F.col("id") == after) & F.col("slot").isNotNull()).agg(F.max("slot")).first()[0]
            rows = rows.where(F.col("slot") > at) if at is not None else rows
        got = rows.orderBy("slot").limit(limit + 1).collect()
        page = [self._point(r) for r in got[:limit]]
        return ScrollPage(page, page[-1].id if len(got) > limit else None)

    def stats(self) -> dict[str, Any]:
        e, n = self._entry, len(self)
        return {"name": e["name"], "dimension": self.dimension, "len": n, "tombstones": e["slots"] - n, "auto_embed": bool(e["config"]["provider"]), "metric": self.metric, "payload_indexes": dict(e["indexes"])}

    def create_payload_index(self, key: str, kind: str) -> None:
        """A typed column ``pidx_<key>_<kind>``, written with every part from the next one on, and by which filters skip
        row groups."""
        if kind not in st.INDEX_KINDS or not key or key.startswith("_") or "." in key or "'" in key:
            raise InvalidArgument(f"no index {kind!r} on {key!r}")
        if (old := self._entry["indexes"].get(key)) not in (None, kind):
            raise InvalidArgument(f"{key!r} has an index of kind {old}")
        self._entry["indexes"][key] = kind
        self._db._store.commit()

    # text

    def _embedder(self) -> Embedder:
        name = self._entry["config"]["provider"]
        if not name:
            raise UnsupportedProvider("the collection embeds no text")
        return self._db._embedder(self._key, name, self.dimension)

    def embed(self, text: str) -> list[float]:
        return [float(x) for x in self._embedder().embed(text)]

    def upsert_text(self, id: str, text: str, payload: dict | None = None) -> None:
        self.upsert_text_batch([(id, text, payload)])

    def upsert_text_batch(self, items: Sequence[tuple]) -> None:
        self._db._store.guard()
        emb, rows = self._embedder(), []
        for id, text, *rest in items:
            _check_id(id)
            payload = rest[0] if rest else None
            if payload is not None and not isinstance(payload, dict):
                raise InvalidArgument("the payload of a text is an object")
            _payload(payload)
        for id, text, *rest in items:
            if hasattr(emb, "add_document"):
                emb.add_document(text)
            v = _placed(emb.embed(text), self.dimension)
            rows.append(self._row(Point(id, v, {**((rest[0] if rest else None) or {}), "_text": text}, _sparse_of(v)), reserved=True))
        self._append(rows)
        self._entry["dirty"] = True
        self._db._store.commit()

    def refresh(self) -> None:
        """Fit again if texts were added since."""
        if self._entry.get("dirty") and not self._db._store.read_only:
            self.refit()

    def refit(self) -> None:
        """Fit the provider to all live texts and embed them anew; they move to the end of the order, without a sort: their
        places are all raised by as much."""
        emb, e = self._embedder(), self._entry
        with self._mutex:
            live, parts = self.live().withColumn("text", F.try_variant_get(F.try_parse_json("payload"), "$['_text']", "string")), e["parts"]
            e["dirty"] = False
            known = F.col("text").isNotNull()
            n, texts, lo, hi = live.agg(F.count("*"), F.count("text"), F.min(F.when(known, F.col("slot"))), F.max(F.when(known, F.col("slot")))).first()
            if not texts:
                self._db._store.commit()
                return
            up = self._next(hi - lo + 1) - lo
        rows = live.where(known)
        if isinstance(emb, Embedder):
            emb.fit(rows.select("text"))
        elif hasattr(emb, "fit"):  # a user's object takes a list
            emb.fit([r["text"] for r in rows.orderBy("slot").select("text").toLocalIterator()])
        placed = rows.select("id", (F.col("slot") + F.lit(up)).alias("slot"), "payload", "text").mapInArrow(_embedded(emb, self.dimension, self.metric == "cosine"), "id string, slot bigint, payload string, vector array<float>, sparse struct<indices:array<bigint>,values:array<float>>")
        if texts < n:  # what has no text keeps its place
            placed = placed.unionByName(live.where(~known).select(*placed.columns))
        if hasattr(emb, "export_state"):
            state = emb.export_state()
            e["vocab"] = state.decode() if isinstance(state, bytes) else state
        part = self._db._store.add_frame(self._key, placed.withColumns({"ver": F.col("slot"), "deleted": F.lit(False)}), e["indexes"]) | {"whole": True}
        with self._mutex:
            e["slots"] += texts
            e["parts"], e["sealed"] = [*parts, part, *e["parts"][len(parts) :]], False
            self._db._store.commit()

    def search_text(self, query: str, limit: int = 10) -> list[Hit]:
        self.refresh()
        v = self.embed(query)
        return self.search(v, limit) if any(v) else []

    def reindex(self) -> None:
        """Seal the rows; search is exact, so there is no graph to rebuild."""
        self._seal(False)

    def _seal(self, drop: bool) -> None:
        e = self._entry
        if e.get("sealed"):
            return
        rows = self.live()
        if drop:
            rows, e["slots"] = self._renumbered(rows)
            e["next"] = e["slots"]
        keep = rows.select("id", "slot", F.col("slot").alias("ver"), F.lit(False).alias("deleted"), "vector", "sparse", "payload")
        if not drop:  # the places that deleted rows had stay known to cursors
            dead = self._raw().where("slot is not null").groupBy("id").agg(F.max("slot").alias("slot")).join(rows.select("id"), "id", "left_anti")
            keep = keep.unionByName(dead.select("id", "slot", F.col("slot").alias("ver"), F.lit(True).alias("deleted"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(st.SPARSE).alias("sparse"), F.lit(None).cast("string").alias("payload")))
        part = self._db._store.add_frame(self._key, keep.repartitionByRange("slot").sortWithinPartitions("slot"), e["indexes"]) | {"sealed": True}
        e["parts"], e["sealed"] = [part] if part["rows"] else [], True

    def _renumbered(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """(rows with places 0, 1, ... in their order, how many). Places are counted by runs of 65,536, so a task
        orders no more than those."""
        run = F.shiftright("slot", 16)
        counts = rows.groupBy(run.alias("run")).count().orderBy("run").toPandas()  # a number for each 65,536 places
        before = counts["count"].cumsum() - counts["count"]
        first = self._db.spark.createDataFrame(pd.DataFrame({"run": counts["run"].astype("int64"), "first": before.astype("int64")}), "run bigint, first bigint")
        nth = F.row_number().over(Window.partitionBy("run").orderBy("slot")) - 1
        out = rows.withColumn("run", run).join(first, "run").withColumn("slot", F.col("first") + nth)
        return out.drop("run", "first"), int(counts["count"].sum())


class Database:
    """Open with :meth:`open` or :meth:`memory`."""

    def __init__(self, spark: SparkSession, store: st.Store, auto_vacuum: float = 0.25, scratch: str | None = None):
        self.spark, self._store, self._closed, self.auto_vacuum, self._scratch = spark, store, False, auto_vacuum, scratch
        self._embedders: dict[str, Any] = {}
        self._registered: dict[str, Any] = {}

    @staticmethod
    def open(spark: SparkSession, path: str, read_only: bool = False, durability: str = "normal", compression: str = "lz4", auto_vacuum: float = 0.25) -> Database:
        if durability not in ("full", "normal", "off"):
            raise InvalidArgument("durability is full, normal or off")
        return Database(spark, st.Store(spark, path, read_only, durability == "full", compression), auto_vacuum)

    @staticmethod
    def memory(spark: SparkSession) -> Database:
        """A database of this session, in the shared folder or, where none is set, a temporary one."""
        base = spark.conf.get("spark.checkpoint.dir", None)
        base = base.removeprefix("file://") if base else tempfile.mkdtemp(prefix="pointlake-")
        return Database(spark, st.Store(spark, f"{base}/memory-{uuid.uuid4().hex}", durable=False), scratch=base)

    @staticmethod
    def deserialize(spark: SparkSession, data: bytes, path: str) -> Database:
        st.unpack(data, path)
        return Database.open(spark, path)

    def _open(self) -> None:
        if self._closed:
            raise Closed("the database is closed")

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if not self._closed:
            if not self._store.read_only:
                self.checkpoint()
            self._store.close()
            self._closed = True

    @property
    def _collections(self) -> dict:
        self._open()
        return self._store.manifest["collections"]

    def _find(self, name: str) -> str | None:
        return next((k for k, c in self._collections.items() if c["name"] == name), None)

    def create_collection(self, name: str, dimension: int, metric: str = "cosine", quantization_bits: int | None = 8, embedding_provider: str | None = None, hnsw: dict | None = None, payload_indexes: dict[str, str] | None = None) -> Collection:
        self._open()
        self._store.guard()
        _check_name(name)
        if not isinstance(dimension, int) or not 1 <= dimension <= MAX_DIMENSION:
            raise InvalidArgument("a dimension lies between 1 and 65536")
        metric = metric_name(metric)
        if quantization_bits not in (None, 0, 1, 2, 4, 8):
            raise InvalidArgument("quantization takes 0, 1, 2, 4 or 8 bits")
        if embedding_provider and embedding_provider not in self._registered:
            build_provider(embedding_provider, dimension)
        if self._find(name) or name in self._store.manifest["aliases"]:
            raise AlreadyExists(f"there is a collection or alias {name!r}")
        graph = {"m": 16, "ef_construction": 200, "ef_search": 100} | (hnsw or {})
        if not (4 <= graph["m"] <= 64 and 8 <= graph["ef_construction"] <= 2048 and 1 <= graph["ef_search"] <= 4096):
            raise InvalidArgument("graph options out of range")
        key = uuid.uuid4().hex[:16]
        self._collections[key] = {"name": name, "config": {"dimension": dimension, "metric": metric, "quantization_bits": quantization_bits, "provider": embedding_provider, "hnsw": graph}, "parts": [], "next": 0, "slots": 0, "indexes": {}, "sealed": True, "dirty": False, "vocab": None}
        out = Collection(self, key)
        for k, kind in (payload_indexes or {}).items():
            out.create_payload_index(k, kind)
        self._store.commit()
        return out

    def collection(self, name: str) -> Collection:
        key = self._find(name) or self._store.manifest["aliases"].get(name)
        if key is None or key not in self._collections:
            raise CollectionNotFound(f"no collection {name!r}")
        return Collection(self, key)

    def delete_collection(self, name: str) -> None:
        if (key := self._find(name)) is None:
            raise CollectionNotFound(f"no collection {name!r}")
        self._store.guard()
        del self._collections[key]
        m = self._store.manifest
        m["aliases"] = {a: k for a, k in m["aliases"].items() if k != key}
        self._embedders.pop(key, None)
        self._store.commit()

    def rename_collection(self, old: str, new: str) -> None:
        _check_name(new)
        if (key := self._find(old)) is None:
            raise CollectionNotFound(f"no collection {old!r}")
        if self._find(new) or new in self._store.manifest["aliases"]:
            raise AlreadyExists(f"there is a collection or alias {new!r}")
        self._collections[key]["name"] = new
        self._store.commit()

    def create_alias(self, alias: str, target: str) -> None:
        _check_name(alias)
        if (key := self._find(target)) is None:
            raise CollectionNotFound(f"no collection {target!r}")
        if self._find(alias) or alias in self._store.manifest["aliases"]:
            raise AlreadyExists(f"there is a collection or alias {alias!r}")
        self._store.manifest["aliases"][alias] = key
        self._store.commit()

    def delete_alias(self, alias: str) -> None:
        if self._store.manifest["aliases"].pop(alias, None) is None:
            raise CollectionNotFound(f"no alias {alias!r}")
        self._store.commit()

    def aliases(self) -> list[tuple[str, str]]:
        return sorted((a, self._collections[k]["name"]) for a, k in self._store.manifest["aliases"].items())

    def list_collections(self) -> list[str]:
        return sorted(c["name"] for c in self._collections.values())

    def info(self) -> dict[str, Any]:
        m = self._store.manifest
        return {"uuid": m["uuid"], "version": m["version"], "collections": self.list_collections(), "aliases": dict(self.aliases()), "read_only": self._store.read_only}

    def register_embedder(self, name: str, embedder: Any) -> None:
        if name in available_providers() or name.startswith("fastembed:") or name in self._registered:
            raise AlreadyExists(f"there is a provider {name!r}")
        if not callable(getattr(embedder, "embed", None)) or not isinstance(getattr(embedder, "dimension", None), int) or embedder.dimension < 1:
            raise InvalidArgument("a provider has embed() and a whole dimension of at least 1")
        self._registered[name] = embedder

    def _embedder(self, key: str, name: str, dimension: int) -> Any:
        if key not in self._embedders:
            state = self._collections[key].get("vocab")
            if name in self._registered:
                out = self._registered[name]
                if state and hasattr(out, "import_state"):
                    out.import_state(state.encode())
            else:
                try:
                    out = build_provider(name, dimension)
                except UnsupportedProvider as e:
                    raise UnsupportedProvider(f"{name!r}; there are {', '.join([*available_providers(), *sorted(self._registered)])}") from e
                if state:
                    out.import_state(state.encode())
            self._embedders[key] = out
        return self._embedders[key]

    def checkpoint(self) -> None:
        """Seal every changed collection; untouched ones keep their files."""
        self._open()
        self._store.guard()
        changed = False
        for key, e in list(self._collections.items()):
            if not e["sealed"]:
                c = Collection(self, key)
                n = len(c)
                c._seal(e["slots"] > 0 and (e["slots"] - n) / e["slots"] >= self.auto_vacuum and not e["config"]["provider"])
                changed = True
        if changed:
            self._store.commit()
            self._store.drop_unnamed()

    def vacuum(self) -> None:
        """Drop what deleted and replaced rows left behind."""
        self._open()
        self._store.guard()
        for key, e in list(self._collections.items()):
            c = Collection(self, key)
            if e["slots"] > len(c):
                e["sealed"] = False
            c._seal(True)
        self._store.commit()
        self._store.drop_unnamed()

    def snapshot(self, path: str) -> None:
        """A compact copy in a new folder with an identity of its own."""
        if os.path.exists(path):
            raise AlreadyExists(f"{path} exists")
        copy = st.Store(self.spark, path, compression=self._store.compression)
        try:
            for key, e in self._collections.items():
                rows = Collection(self, key).live().select("id", "slot", F.col("slot").alias("ver"), F.lit(False).alias("deleted"), "vector", "sparse", "payload")
                part = copy.add_frame(key, rows, e["indexes"]) | {"sealed": True}
                copy.manifest["collections"][key] = {**e, "parts": [part] if part["rows"] else [], "slots": part["rows"], "sealed": True}
            copy.manifest["aliases"] = dict(self._store.manifest["aliases"])
            copy.commit()
        finally:
            copy.close()

    def serialize(self) -> bytes:
        if not self._store.read_only:
            self.checkpoint()
        return self._store.serialize()


def index_column(key: str, kind: str) -> Column:
    """The column of a declared index in :meth:`Collection.live`."""
    return F.col(st.index_name(key, kind))
