"""Table semantics: latest versions, deletions, pages, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_view(versions: DataFrame, id: str, ver: str, deleted: Column | None = None) -> DataFrame:
    """The latest version of each id, without those whose latest one is a deletion. Partial maxima
    are taken before the one shuffle."""
    rest = [c for c in versions.columns if c != id]
    v = versions.withColumn("_dead", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False))
    return v.groupBy(id).agg(F.max_by(F.struct(*rest, "_dead"), F.col(ver)).alias("_r")).where("not _r._dead").select(id, *[F.col(f"_r.{c}") for c in rest])


def without(rows: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    """``rows`` whose id isn't among ``gone``."""
    return rows.join(gone.select(id), id, "left_anti")


def page(rows: DataFrame, slot: str, after: int | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in order, and one more that tells whether others follow."""
    return (rows if after is None else rows.where(F.col(slot) > after)).orderBy(slot).limit(limit + 1)


def stats(versions: DataFrame, id: str, ver: str, deleted: Column) -> DataFrame:
    """One row (len, tombstones): live rows, and places of rows that are none."""
    last = versions.groupBy(id).agg(F.max_by(F.coalesce(deleted, F.lit(False)), F.col(ver)).alias("dead"), F.count(F.when(~F.coalesce(deleted, F.lit(False)), 1)).alias("slots"))
    alive = F.sum(F.when(~F.col("dead"), 1).otherwise(0))
    return last.agg(alive.alias("len"), (F.sum("slots") - alive).alias("tombstones"))
