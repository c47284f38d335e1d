"""What the operators share: the shared folder, materialised tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: A side of a join is broadcast explicitly only up to this many bytes.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one is made only where the session names none."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        folder = "file://" + tempfile.mkdtemp(prefix="pointlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession) -> None:
    """Delete every table that this application materialised. Results not yet read may need them."""
    delete(spark, f"{shared_folder(spark)}/pointlake/{spark.sparkContext.applicationId}")


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at the
    files, which outlive any executor. :func:`discard` deletes them."""
    path = f"{shared_folder(spark)}/pointlake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted size permits; unmarked otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df``, whatever its extra columns are."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def c(name: str) -> Column:
    """The column of that exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of whole texts of about ``limit``
    bytes. A longer text is a run of its own; a null one counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.large_string())
    kind = np.int32 if pa.types.is_string(arr.type) else np.int64
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if arr.null_count:  # a null slot may cover bytes
        lengths = np.diff(offs)
        if lengths[arr.is_null().to_numpy(zero_copy_only=False)].any():
            yield from text_chunks(arr.fill_null(""), limit)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_MULT = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts, found and hashed without a loop over words.

    A word is a maximal run of ASCII letters, digits and bytes from 0x80 on, letters
    in lower case. Its hash is a polynomial over its bytes mod 2**64, taken as a
    difference of prefix sums and divided by the power at its start.

    With ``whitespace_only`` a word is a run without white space; with ``marks`` a run of
    other visible bytes is a word too.
    """

    def __init__(self, whitespace_only: bool = False, marks: bool = False):
        self.kinds = None
        lut = np.zeros(256, np.uint8)
        for b in range(256):
            ch = chr(b)
            if b >= 0x80 or (ch.isalnum() if not whitespace_only else b > 32 and b != 127):
                lut[b] = ord(ch.lower()) if b < 0x80 else b
        if marks:
            kinds = (lut != 0).astype(np.uint8)
            for b in range(33, 127):
                if not lut[b]:
                    kinds[b], lut[b] = 2, b
            self.kinds = kinds
        self.lut = lut
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK_BYTES + 4096)
            inv = pow(_MULT, -1, 1 << 64)
            for name, base in (("pw", _MULT), ("inv", inv)):
                v = np.full(self.size, np.uint64(base))
                v[0] = 1
                setattr(self, name, np.multiply.accumulate(v))

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        """(hash, start byte, end byte) of each word, and where each text's words start."""
        n = len(data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z, z, np.zeros(len(offs), np.int64)
        self._grow(n)
        low = self.lut[data]
        is_w = low != 0
        first = offs[:-1][offs[:-1] < n]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = is_w[:-1]
        before[first] = False
        turn = np.zeros(n, bool)  # where another kind of word begins
        if self.kinds is not None:
            kind = self.kinds[data]
            turn[1:] = is_w[1:] & is_w[:-1] & (kind[1:] != kind[:-1])
        start = np.flatnonzero(is_w & (~before | turn))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = is_w[1:]
        after[first[first > 0] - 1] = False
        after[:-1] &= ~turn[1:]
        end = np.flatnonzero(is_w & ~after) + 1
        acc = np.empty(n + 1, np.uint64)
        acc[0] = 0
        np.cumsum(low * self.pw[:n], out=acc[1:])
        h = mix((acc[end] - acc[start]) * self.inv[start] + (end - start).astype(np.uint64))
        self.acc = acc
        return h, start, end, np.searchsorted(start, offs)

    def stems(self, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of words of the last call."""
        stop = np.minimum(start + size, end)
        return mix((self.acc[stop] - self.acc[start]) * self.inv[start] + np.uint64(1 << 32))
