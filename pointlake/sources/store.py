"""Collections on disk: Parquet parts and one manifest that is swapped atomically.

A commit writes its part first and names it in a new manifest last, so a part that no
manifest names does not exist, and an interrupted commit leaves nothing behind. Parts are
written once and never changed.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import uuid
import zipfile
import zlib
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, Corrupt, IoError, Locked, ReadOnly, UnsupportedFormatVersion

FORMAT = 1
SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])
SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("ver", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("sparse", SPARSE),
        T.StructField("payload", T.StringType()),
    ]
)
_ARROW = pa.schema([("id", pa.string()), ("slot", pa.int64()), ("ver", pa.int64()), ("deleted", pa.bool_()), ("vector", pa.list_(pa.float32())), ("sparse", pa.struct([("indices", pa.list_(pa.int64())), ("values", pa.list_(pa.float32()))])), ("payload", pa.string())])


INDEX_KINDS = {"keyword": "string", "integer": "bigint", "float": "double"}


def index_name(key: str, kind: str) -> str:
    return f"pidx_{key}_{kind}"


def index_columns(indexes: dict[str, str]) -> dict[str, Column]:
    """Typed columns of declared indexes, from the payload."""
    of = lambda key: F.try_variant_get(F.try_parse_json("payload"), f"$['{key}']", "variant")
    return {index_name(k, kind): F.try_variant_get(of(k), "$", INDEX_KINDS[kind]) for k, kind in indexes.items()}


class Store:
    """A folder with a manifest. ``durable`` flushes every commit to disk."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, durable: bool = False, compression: str = "lz4", ignore_lock: bool = False):
        self.spark, self.root, self.read_only, self.durable, self.compression = spark, os.path.abspath(root), read_only, durable, compression
        self._lock = None
        if not read_only:
            os.makedirs(self.root, exist_ok=True)
            if not ignore_lock:
                try:
                    fd = os.open(self._path("LOCK"), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                except FileExistsError as e:
                    raise Locked(f"{self.root} is open elsewhere") from e
                os.write(fd, str(os.getpid()).encode())
                os.close(fd)
                self._lock = self._path("LOCK")
        try:
            self.manifest = self._load()
        except Exception:
            self.close()
            raise

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _load(self) -> dict[str, Any]:
        try:
            with open(self._path("MANIFEST.json")) as f:
                m = json.load(f)
        except FileNotFoundError as e:
            if self.read_only:
                raise IoError(f"no database in {self.root}") from e
            return {"version": FORMAT, "uuid": uuid.uuid4().hex, "collections": {}, "aliases": {}}
        except ValueError as e:
            raise Corrupt(f"the manifest in {self.root} can't be read") from e
        if m.get("version") != FORMAT:
            raise UnsupportedFormatVersion(f"format {m.get('version')}")
        return m

    def commit(self) -> None:
        """The manifest as it is in memory becomes the one on disk."""
        if self.read_only:
            raise ReadOnly("the database is open for reading only")
        tmp = self._path(f".manifest-{uuid.uuid4().hex}")
        with open(tmp, "w") as f:
            json.dump(self.manifest, f)
            if self.durable:
                f.flush()
                os.fsync(f.fileno())
        os.replace(tmp, self._path("MANIFEST.json"))

    def guard(self) -> None:
        if self.read_only:
            raise ReadOnly("the database is open for reading only")

    def add_rows(self, coll: str, rows: list[dict]) -> dict:
        """A part of rows at hand."""
        self.guard()
        name = f"{coll}-{uuid.uuid4().hex}.parquet"
        pq.write_table(pa.Table.from_pylist(rows, _ARROW), self._path(name), compression=self.compression)
        if self.durable:
            with open(self._path(name), "rb") as f:
                os.fsync(f.fileno())
        return {"path": name, "rows": len(rows)}

    def add_frame(self, coll: str, df: DataFrame, indexes: dict[str, str] | None = None) -> dict:
        """A part that executors write, with the typed columns of ``indexes``."""
        self.guard()
        name = f"{coll}-{uuid.uuid4().hex}.parquet"
        df = df.select(*SCHEMA.names).withColumns(index_columns(indexes or {}))
        df.write.option("compression", self.compression).parquet("file://" + self._path(name))
        return {"path": name, "rows": self.spark.read.parquet("file://" + self._path(name)).count(), "indexes": dict(indexes or {})}

    def scan(self, parts: list[dict], indexes: dict[str, str] | None = None) -> DataFrame:
        """Rows of parts, with the typed columns of ``indexes``: as written, where a part has them."""
        indexes = indexes or {}
        by: dict[tuple, list[str]] = {}
        for p in parts:
            by.setdefault(tuple(sorted(set(p.get("indexes", {}).items()) & set(indexes.items()))), []).append("file://" + self._path(p["path"]))
        out = None
        for have, paths in by.items():
            fields = [T.StructField(index_name(k, kind), T._parse_datatype_string(INDEX_KINDS[kind])) for k, kind in have]
            rows = self.spark.read.schema(T.StructType([*SCHEMA.fields, *fields])).parquet(*paths)
            rows = rows.withColumns(index_columns({k: v for k, v in indexes.items() if (k, v) not in have}))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], SCHEMA).withColumns(index_columns(indexes))

    def drop_unnamed(self) -> int:
        """Delete parts that the manifest no longer names."""
        named = {p["path"] for c in self.manifest["collections"].values() for p in c["parts"]}
        gone = [x for x in os.listdir(self.root) if x.endswith(".parquet") and x not in named]
        for x in gone:
            path = self._path(x)
            shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        return len(gone)

    def close(self) -> None:
        if self._lock and os.path.exists(self._lock):
            os.remove(self._lock)
        self._lock = None

    def files(self) -> list[str]:
        out = []
        for folder, _, names in os.walk(self.root):
            out += [os.path.relpath(os.path.join(folder, n), self.root) for n in names if n != "LOCK" and not n.endswith(".crc")]
        return sorted(out)

    def serialize(self) -> bytes:
        """The whole database as one zip archive."""
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for f in self.files():
                z.write(self._path(f), f)
        return buf.getvalue()


def unpack(data: bytes, root: str) -> None:
    if os.path.exists(os.path.join(root, "MANIFEST.json")):
        raise AlreadyExists(f"{root} holds a database")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in z.namelist():
                if n.startswith("/") or ".." in n.split("/"):
                    raise Corrupt("the archive names files outside its folder")
            z.extractall(root)
    except zipfile.BadZipFile as e:
        raise Corrupt("no archive of a database") from e


def inspect(root: str) -> dict[str, Any]:
    """Manifest, row counts and files of a database folder, without a session."""
    with open(os.path.join(root, "MANIFEST.json")) as f:
        m = json.load(f)
    out = {"version": m["version"], "uuid": m["uuid"], "aliases": m["aliases"], "collections": []}
    for key, c in m["collections"].items():
        out["collections"].append({"name": c["name"], "key": key, "config": c["config"], "rows": sum(p["rows"] for p in c["parts"]), "parts": [p["path"] for p in c["parts"]]})
    return out


def verify(root: str) -> list[str]:
    """What is wrong with a database folder; an empty list for nothing."""
    try:
        m = json.load(open(os.path.join(root, "MANIFEST.json")))
    except (OSError, ValueError) as e:
        return [f"manifest: {e}"]
    found = [] if m.get("version") == FORMAT else [f"format {m.get('version')} is unknown"]
    for c in m.get("collections", {}).values():
        for p in c["parts"]:
            path = os.path.join(root, p["path"])
            files = [os.path.join(path, x) for x in os.listdir(path) if x.endswith(".parquet")] if os.path.isdir(path) else [path]
            try:
                n = 0
                for f in files:
                    meta = pq.ParquetFile(f)
                    n += meta.metadata.num_rows
                    for g in range(meta.num_row_groups):
                        meta.read_row_group(g)
                if n != p["rows"]:
                    found.append(f"{p['path']}: {n} rows instead of {p['rows']}")
            except (OSError, pa.ArrowException) as e:
                found.append(f"{p['path']}: {e}")
    for a, target in m.get("aliases", {}).items():
        if target not in m["collections"]:
            found.append(f"alias {a} has no collection")
    return found


def checksum(path: str) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read())
