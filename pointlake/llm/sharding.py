"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key goes to one of ``n`` shards with no ring table; from ``n`` to ``n + 1``
shards a share of 1 / (n + 1) of the keys moves, all of them to the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, documents

SHARDS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; each pass advances only the keys that still jump."""
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        step = 2147483648.0 / ((key >> np.uint64(33)).astype(np.float64) + 1.0)
        j = ((out[live] + 1) * step).astype(np.int64)
        on = j < shards
        live, key = live[on], key[on]
        out[live] = j[on]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Column form, for a bigint key without nulls."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf(T.LongType())
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return jump(key)


def stable_key(df: DataFrame, key: str) -> Column:
    """Integers are their own key; any other type is hashed; null counts as key 0."""
    kind = df.schema[key].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    k = c(key).cast("bigint") if whole else F.when(c(key).isNotNull(), F.xxhash64(c(key)))
    return F.coalesce(k, F.lit(0).cast("bigint"))


def assign_shards(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``df`` with its shard as column ``out``; no shuffle.

    A null key goes where key 0 goes. Repeated keys share a shard. Texts are not read;
    an empty table gives an empty one. A column already named ``out`` is an error.
    """
    if out.lower() in {x.lower() for x in df.columns}:
        raise ValueError(f"the table has a column {out} already")
    return df.withColumn(out, shard_of(stable_key(df, key), shards))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, and its shard once one more is appended."""
    d = documents(spark, sf_dir).select("doc_id")
    d = assign_shards(assign_shards(d), SHARDS + 1, out="shard_after")
    return d.withColumn("moved", F.col("shard") != F.col("shard_after"))


_JUMP = """
  {name} AS (
    SELECT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k, -1::BIGINT AS b, 0::BIGINT AS j
    FROM (SELECT DISTINCT doc_id FROM documents)
    UNION ALL
    SELECT doc_id, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1.0)))::BIGINT
    FROM (SELECT doc_id, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM {name} WHERE j < {n})
  )"""

SQL = (
    "WITH RECURSIVE" + _JUMP.format(name="a", n=SHARDS) + "," + _JUMP.format(name="b", n=SHARDS + 1) + f"""
SELECT d.doc_id, x.s AS shard, y.s AS shard_after, x.s <> y.s AS moved
FROM documents d
JOIN (SELECT doc_id, max(j) FILTER (j < {SHARDS}) AS s FROM a GROUP BY 1) x ON x.doc_id IS NOT DISTINCT FROM d.doc_id
JOIN (SELECT doc_id, max(j) FILTER (j < {SHARDS + 1}) AS s FROM b GROUP BY 1) y ON y.doc_id IS NOT DISTINCT FROM d.doc_id"""
)
