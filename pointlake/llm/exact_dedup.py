"""Exact deduplication over an extendible-hash index on shared files.

1. Every text gets a 64-bit hash. Rows and bytes are counted by hash over the whole table,
   combined before the shuffle, and summed by the cells that the high bits of a hash name.
2. The driver grows the directory of the index from those sums: an overfull bucket
   splits, and the directory doubles whenever a bucket as deep as it splits. There are cells enough
   for every split: ``SPARE_BITS`` more bits than the table has buckets. Runs of
   neighbouring buckets form the key range of an owner. The directory is written to
   the shared folder.
3. Rows are sent to their owner. An owner task reads its range in the order of the
   hash, so it holds one chain at a time: the distinct texts that share a hash.
   Each row is compared with the chain byte by byte.
4. A hash whose rows alone overfill a bucket is dealt to several owners by the partition that a row
   comes from. The few texts that are first with their owner are then chained once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, documents, fresh, materialise, small

BUCKET_BYTES = 32 << 20
OWNER_BYTES = 64 << 20
#: Buckets grow beyond ``BUCKET_BYTES`` once there are so many of them, so the directory can be broadcast.
BUCKETS = 1 << 18
SPARE_BITS = 5


def build_directory(rows_bytes: np.ndarray, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, np.ndarray, np.ndarray]:
    """(global depth, bucket of each directory entry, local depth of each bucket).

    ``rows_bytes`` has the bytes of each cell, a power of two of them. A bucket over
    ``bucket_bytes`` splits on its next bit until it fits or is a single cell, where
    its entries form an overflow chain.
    """
    bits = int(len(rows_bytes)).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(rows_bytes.astype(np.int64))])
    depth, directory, local = 0, np.zeros(1, np.int64), [0]
    todo = [0]
    first = {0: 0}  # bucket -> its first cell
    while todo:
        b = todo.pop()
        width = 1 << (bits - local[b])
        if width == 1 or total[first[b] + width] - total[first[b]] <= bucket_bytes:
            continue
        if local[b] == depth:  # the directory doubles: every entry becomes two
            directory, depth = np.repeat(directory, 2), depth + 1
        local[b] += 1
        new = len(local)
        local.append(local[b])
        first[new] = first[b] + width // 2
        at, span = first[new] >> (bits - depth), 1 << (depth - local[b])
        directory[at : at + span] = new
        todo += [b, new]
    return depth, directory, np.array(local)


def owners_of(directory: np.ndarray, depth: int, cells: np.ndarray, owner_bytes: int = OWNER_BYTES, least: int = 1) -> np.ndarray:
    """Owner of each cell: whole buckets in order, cut where a share of bytes is full."""
    per = len(cells) >> depth
    load = cells.reshape(-1, per).sum(1)
    total = int(load.sum())
    share = max(1, min(owner_bytes, -(-total // max(1, least))))
    change = np.concatenate([[0], np.flatnonzero(np.diff(directory)) + 1])  # a bucket is a run of entries
    before = np.concatenate([[0], np.cumsum(np.add.reduceat(load, change))])[:-1]
    owner = np.repeat(before // share, np.diff(np.append(change, len(directory))))
    return np.repeat(np.unique(owner, return_inverse=True)[1], per)


def cell_bits(total: int, bucket_bytes: int) -> int:
    """High bits of a hash that tell enough cells apart for a table of ``total`` bytes."""
    return max(1, -(-total // max(1, bucket_bytes))).bit_length() + SPARE_BITS


def _chains(h: str, text: str, row: str, keep: str, dup: str, nth: str):
    """Rows sorted by (hash, id): append the id that each row repeats, or null, whether it repeats one, and its
    place in its chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []  # of the current hash: (length, text, id), in order of arrival
        for b in batches:
            names = b.schema.names
            hs = b.column(names.index(h)).to_numpy(zero_copy_only=False)
            texts, ids = b.column(names.index(text)), b.column(names.index(row))
            n = len(hs)
            lead = np.empty(n, bool)
            if n:
                lead[0] = hs[0] != at
                lead[1:] = hs[1:] != hs[:-1]
            single = lead & np.append(lead[1:], False)  # alone in its chain, for sure
            first_of: list = [None] * n
            again, place = np.zeros(n, bool), np.zeros(n, np.int32)
            for i in np.flatnonzero(~single):
                t = texts[i].as_buffer()
                if lead[i]:
                    chain = []
                for k, (size, seen, first) in enumerate(chain):
                    if size == t.size and seen.equals(t):
                        again[i], first_of[i], place[i] = True, first, k
                        break
                else:
                    place[i] = len(chain)
                    chain.append((t.size, pa.py_buffer(t.to_pybytes()), ids[i].as_py()))
            if n:
                at = hs[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first_of, ids.type), pa.array(again), pa.array(place)], names=[*names, keep, dup, nth])

    return run


def _chained(rows: DataFrame, kind: T.DataType, h: str, text: str, key: str, names: tuple[str, str, str]) -> DataFrame:
    """``rows``, already with their owner, in order and judged."""
    ordered = rows.sortWithinPartitions(c(h), c(key).asc_nulls_last())
    schema = T.StructType([*ordered.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (kind, T.BooleanType(), T.IntegerType())))])
    return ordered.mapInArrow(_chains(h, text, key, *names), schema)


def _judged(spark: SparkSession, docs: DataFrame, text: str, key: str, bucket_bytes: int, owner_bytes: int):
    """(rows judged by their owner, names of the columns hash, owner, split, first id, repeats, place in chain,
    whether any hash is split)."""
    h, cell, own, split, keep, dup, nth, parts, base, x = names = fresh(docs, "h", "cell", "owner", "split", "kept", "dup", "nth", "parts", "base", "x")
    rows = docs.where(c(text).isNotNull()).withColumn(h, F.xxhash64(c(text)))
    sized = materialise(spark, rows.groupBy(c(h).alias("h")).agg(F.sum(F.octet_length(c(text)) + 64).alias("bytes")), "hashes")
    total = int(sized.agg(F.sum("bytes")).first()[0] or 0)
    bucket_bytes = max(bucket_bytes, -(-total // BUCKETS))
    owner_bytes = max(owner_bytes, bucket_bytes)
    bits = min(64, cell_bits(total, bucket_bytes))
    # hashes that alone overfill a bucket: at most total / bucket_bytes <= BUCKETS of them
    hot = sized.where(F.col("bytes") > bucket_bytes).orderBy("h").toArrow()
    counted = sized.where(F.col("bytes") <= bucket_bytes).groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.sum("bytes").alias("bytes")).toArrow()
    cells = np.zeros(1 << bits, np.int64)
    cells[counted["cell"].to_numpy()] = counted["bytes"].to_numpy()
    depth, directory, local = build_directory(cells, bucket_bytes)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = owners_of(directory, depth, cells, owner_bytes, least)[:: len(cells) >> depth]
    index = spark.createDataFrame(pa.table({"cell": np.arange(len(directory)), "bucket": directory, "depth": local[directory].astype(np.int32), "owner": owner.astype(np.int32)}))
    index = materialise(spark, index.coalesce(1), "directory")
    # as many entries as the table has buckets, rounded up; never over a few times BUCKETS
    route = F.broadcast(index.select(F.col("cell").alias(cell), F.col("owner").alias(own)))
    rows = rows.withColumn(cell, F.shiftrightunsigned(c(h), 64 - depth) if depth else F.lit(0).cast("bigint")).join(route, cell).drop(cell)
    owners = int(owner.max()) + 1
    if hot.num_rows:
        n = -(-hot["bytes"].to_numpy() // bucket_bytes)
        apart = spark.createDataFrame(pa.table({x: hot["h"], parts: n, base: owners + np.cumsum(n) - n}))
        rows = rows.join(F.broadcast(apart), c(h) == c(x), "left").withColumn(split, c(parts).isNotNull())
        rows = rows.withColumn(own, F.coalesce(c(base) + F.pmod(F.spark_partition_id(), c(parts)), c(own)).cast("int")).drop(x, parts, base)
        owners += int(n.sum())
    else:
        rows = rows.withColumn(split, F.lit(False))
    out = _chained(rows.repartitionById(owners, c(own)), docs.schema[key].dataType, h, text, key, (keep, dup, nth))
    return out, names[:1] + names[2:7], bool(hot.num_rows)


def duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """(doc_id, dup_of): each row whose text equals, byte for byte, that of a row before it
    in the order of ``key`` (null last), with the first such row's key.

    A null text is equal to nothing; empty texts equal each other; texts of any length are compared whole. Of rows that tie in
    ``key`` one is the first, and repeated rows give repeated results. An empty table gives
    an empty one; further columns are ignored.
    """
    docs = docs.select(c(key), c(text))
    out, (h, own, split, keep, dup, nth), hot = _judged(spark, docs, text, key, bucket_bytes, owner_bytes)
    done = out.where(c(dup) & ~c(split)).select(c(key).alias("doc_id"), c(keep).alias("dup_of"))
    if not hot:
        return done
    lead = F.when(~c(dup), c(text)).alias("text")  # a text for each owner and text of a split hash; ids for the rest
    out = materialise(spark, out.where(c(dup) | c(split)).select(c(key).alias("id"), lead, c(h).alias("h"), c(own).alias("own"), c(split).alias("split"), c(keep).alias("first"), c(dup).alias("dup"), c(nth).alias("nth")), "judged")
    heads = out.where("split and not dup").select("id", "text", "h", "own", "nth").repartition("h")
    heads = materialise(spark, _chained(heads, docs.schema[key].dataType, "h", "text", "id", ("first", "again", "nth2")).drop("text", "nth2"), "heads")
    to = heads.select(F.col("h").alias("h2"), F.col("own").alias("own2"), F.col("nth").alias("nth2"), F.when(F.col("again"), F.col("first")).otherwise(F.col("id")).alias("whole"))
    moved = out.where("split and dup").join(small(to, 64), (F.col("h") == F.col("h2")) & (F.col("own") == F.col("own2")) & (F.col("nth") == F.col("nth2")))
    parts = [out.where("dup and not split").select("id", "first"), heads.where("again").select("id", "first"), moved.select("id", "whole")]
    return reduce(DataFrame.union, parts).toDF("doc_id", "dup_of")


def deduplicate(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """The rows that :func:`duplicates` doesn't report, with all their columns.

    Rows with a null text all stay, and exactly one of each set of equal texts does. Columns may have any names;
    ids that are null or tie, empty texts and tables are treated as there.
    """
    out, (h, _, split, _, dup, _), hot = _judged(spark, docs, text, key, bucket_bytes, owner_bytes)
    columns = [c(x) for x in docs.columns]
    kept = out.where(~c(dup) & ~c(split)).select(*columns)
    if hot:
        heads = out.where(~c(dup) & c(split)).select(*columns, c(h)).repartition(c(h))
        kept = kept.unionByName(_chained(heads, docs.schema[key].dataType, h, text, key, tuple(fresh(heads, "kept", "dup", "nth"))).where(~c(fresh(heads, "dup")[0])).select(*columns))
    return kept.unionByName(docs.where(c(text).isNull()))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark, documents(spark, sf_dir))


SQL = """
SELECT doc_id, first AS dup_of FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS first, row_number() OVER w AS nth
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST))
WHERE nth > 1"""
