"""Language-model scoring by context-tree weighting over binary-decomposed bytes
(Willems, Shtarkov and Tjalkens, 1995).

A byte is eight binary decisions, each with a context tree of its own over the ``DEPTH``
bytes before it. A node holds Krichevsky-Trofimov counts; its weighted probability mixes
its own estimate, at one half, with the product of its children's. From the counts of the
whole corpus follows, top down, the mixture that predicts the next bit.

1. Grams (context and next byte) are counted over all texts: partial counts in each task,
   then one grouped sum.
2. Grams are ranged by the two latest bytes of context, so a task has whole subtrees below
   depth 2. It reports its nodes at depth 2; depths 1 and 0, at most 256 * 256 nodes, are
   finished on the driver.
3. The same tasks then price each gram, and write the prices in order of the gram to the
   shared folder. Scoring tasks map those files into memory and look up the grams of
   their texts, so no table is copied into an executor's heap.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import c, documents, materialise, shared_folder, text_chunks

#: Bytes of context; seven would fit a 64-bit number with the byte itself.
DEPTH = 6
#: Grams in a task of the tree, and in a task's count before it is passed on.
TASK_GRAMS, HELD_GRAMS, BATCH = 2_000_000, 1_500_000, 1 << 16
_TAIL = np.uint64(8 * (DEPTH - 2) + 8)


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte: the byte before it, ..., the ``DEPTH``-th before it, and the byte
    itself, from high to low. Before a text are zeros."""
    nth = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    key = data.astype(np.uint64)
    for d in range(1, DEPTH + 1):
        back = np.zeros(len(data), np.uint64)
        back[d:] = data[:-d] if d < len(data) else 0
        back[nth < d] = 0
        key |= back << np.uint64(8 * (DEPTH - d) + 8)
    return key


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> int:
        k, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        held[:] = [(k, np.bincount(at, np.concatenate([x for _, x in held])).astype(np.int64))]
        return len(k)

    def passed() -> Iterator[pa.RecordBatch]:
        k, n = held.pop()
        for lo in range(0, len(k), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + BATCH].view(np.int64)), pa.array(n[lo : lo + BATCH])], names=["gram", "n"])

    for b in batches:
        for _, _, data, offs in text_chunks(b.column(0), 2 << 20):
            if len(data):
                held.append(np.unique(grams(data, offs), return_counts=True))
            if sum(len(x) for x, _ in held) > HELD_GRAMS and merge() > HELD_GRAMS // 2:
                yield from passed()
    if held:
        merge()
        yield from passed()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    low = np.ones_like(y)
    for j in range(8):
        low *= x + j
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z / 1260)) / y - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth: ``ids`` (context, then binary node), counts, log of the weighted
    probability, and what the own estimate weighs against the children."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.ids, self.n0, self.n1 = ids, n0, n1
        own = log_kt(n0, n1)
        if below is None:
            self.log_pw, self.weight = own, np.ones(len(ids))
        else:
            self.log_pw = np.logaddexp(own, below) - np.log(2)
            self.weight = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        self.p1 = (n1 + 0.5) / (n0 + n1 + 1.0)

    def parent(self) -> tuple[Level, np.ndarray]:
        """(level above, place of each node's parent in it)."""
        up = (self.ids >> np.uint64(16) << np.uint64(8)) | (self.ids & np.uint64(255))
        ids, at = np.unique(up, return_inverse=True)
        return Level(ids, np.bincount(at, self.n0), np.bincount(at, self.n1), np.bincount(at, self.log_pw)), at


def leaves(key: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """(nodes of the greatest depth, node of each gram's bit, the bits); the last two have
    eight columns."""
    x = (key & np.uint64(255))[:, None]
    k = np.arange(8, dtype=np.uint64)[None, :]
    node = (key >> np.uint64(8) << np.uint64(8))[:, None] | (np.uint64(1) << k) | (x >> (np.uint64(8) - k))
    bit = (x >> (np.uint64(7) - k)) & np.uint64(1)
    ids, at = np.unique(node.reshape(-1), return_inverse=True)
    each = np.repeat(n.astype(np.float64), 8)
    ones = bit.reshape(-1).astype(bool)
    return Level(ids, np.bincount(at, each * ~ones, len(ids)), np.bincount(at, each * ones, len(ids)), None), at.reshape(-1, 8), bit


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.concatenate([k for k, _ in got])
    order = np.argsort(key)
    return key[order], np.concatenate([n for _, n in got])[order]


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth 2, named as their parents of depth 1."""
    key, n = _rows(batches)
    if len(key):
        level = leaves(key, n)[0]
        for _ in range(DEPTH - 2):
            level, _ = level.parent()
        up = (level.ids >> np.uint64(16) << np.uint64(8)) | (level.ids & np.uint64(255))
        yield pa.RecordBatch.from_arrays([pa.array(up.view(np.int64)), pa.array(level.n0), pa.array(level.n1), pa.array(level.log_pw)], names=["id", "n0", "n1", "below"])


def prices(key: np.ndarray, n: np.ndarray, one: Level, root: Level, root_of: np.ndarray) -> np.ndarray:
    """Bits that each gram's byte costs after its context."""
    leaf, at, bit = leaves(key, n)
    up, level, places = [], leaf, np.arange(len(leaf.ids))
    for _ in range(DEPTH - 2):
        level, to = level.parent()
        places = to[places]
        up.append((level, places))
    in_one = np.searchsorted(one.ids, (level.ids >> np.uint64(16) << np.uint64(8)) | (level.ids & np.uint64(255)))[places]
    q = leaf.p1
    for above, where in [*up, (one, in_one), (root, root_of[in_one])]:
        w = above.weight[where]
        q = w * above.p1[where] + (1 - w) * q
    p = np.where(bit.astype(bool), q[at], 1 - q[at])
    return -np.log2(p).sum(1)


def _priced(folder: str, one: Level, root: Level, root_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _rows(batches)
        if len(key):
            cost = np.empty(len(key), np.float32)
            cut = np.append(np.flatnonzero(np.append(True, np.diff(key >> _TAIL) > 0)), len(key))
            lo = 0
            while lo < len(key):  # whole subtrees at a time
                hi = int(cut[max(np.searchsorted(cut, lo + TASK_GRAMS // 4, "right") - 1, np.searchsorted(cut, lo, "right"))])
                cost[lo:hi] = prices(key[lo:hi], n[lo:hi], one, root, root_of)
                lo = hi
            name = f"{folder}/{uuid.uuid4().hex}"  # of this attempt; only what ends is listed
            np.save(f"{name}.key.npy", key)
            np.save(f"{name}.cost.npy", cost)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(key[:1].view(np.int64))], names=["name", "least"])

    return run


class Prices:
    """The files of prices, mapped into memory."""

    def __init__(self, files: list[tuple[str, int]]):
        files = sorted(files, key=lambda x: x[1] % (1 << 64))
        self.least = np.array([x % (1 << 64) for _, x in files], np.uint64)
        self.parts = [(np.load(f"{x}.key.npy", mmap_mode="r"), np.load(f"{x}.cost.npy", mmap_mode="r")) for x, _ in files]

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Prices of grams in order, all of which were counted."""
        out = np.empty(len(key))
        at = np.append(np.searchsorted(key, self.least), len(key))
        for (k, cost), lo, hi in zip(self.parts, at[:-1], at[1:]):
            if lo < hi:
                out[lo:hi] = cost[np.searchsorted(k, key[lo:hi])]
        return out


def _scored(files: list[tuple[str, int]], rest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        price = Prices(files)
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(0), 2 << 20):
                total = np.zeros(len(data) + 1)
                if len(data):
                    key, at = np.unique(grams(data, offs), return_inverse=True)
                    np.cumsum(price(key)[at], out=total[1:])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(total[offs[1:]] - total[offs[:-1]])], names=[rest, "n_bytes", "bits"])

    return run


def model(spark: SparkSession, docs: DataFrame) -> list[tuple[str, int]]:
    """Files of prices (name, least gram) of the context trees of all texts of ``docs``."""
    base = shared_folder(spark)
    folder = base.removeprefix("file://").removeprefix("file:") + f"/pointlake/{uuid.uuid4().hex}-prices"
    if "://" in folder:
        raise ValueError("the folder in spark.checkpoint.dir must be mounted on the executors")
    os.makedirs(folder)
    counted = docs.select(c("text")).where(c("text").isNotNull()).mapInArrow(_count, "gram bigint, n bigint")
    counted = counted.repartition("gram").groupBy("gram").agg(F.sum("n").alias("n"))  # tasks have summed already: no second sum before the shuffle
    counted = materialise(spark, counted, "grams")
    tasks = max(1, -(-counted.count() // TASK_GRAMS), spark.sparkContext.defaultParallelism)
    ranged = counted.repartitionByRange(tasks, F.shiftrightunsigned("gram", int(_TAIL)))
    top = ranged.mapInArrow(_upper, "id bigint, n0 double, n1 double, below double").groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).orderBy("id").toArrow()
    one = Level(top["id"].to_numpy().view(np.uint64), *(top[x].to_numpy() for x in ("n0", "n1", "below")))
    if not len(one.ids):
        return []
    root, root_of = one.parent()
    listed = materialise(spark, ranged.mapInArrow(_priced(folder, one, root, root_of), "name string, least bigint"), "prices")
    return [(r[0], r[1]) for r in listed.collect()]  # a row for each task


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row of ``docs``, under the model of all
    its texts.

    A null or empty text has 0 bytes and bits, and null bits per byte. Repeated rows count as
    often as they come and score alike; ids may be null. Texts of any length are scored whole, from their first byte. A table without text gives such
    rows only, an empty one none; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    files = model(spark, docs)
    out = docs.select(c("text"), c("doc_id")).mapInArrow(_scored(files, "doc_id"), f"doc_id {kind}, n_bytes bigint, bits double")
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))


def op6_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, documents(spark, sf_dir))
