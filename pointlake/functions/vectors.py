"""Vector arithmetic as Catalyst expressions, and checks of vectors on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidArgument

METRICS = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot": "dot", "dotproduct": "dot", "dot_product": "dot"}


def metric_name(metric: str) -> str:
    if (m := METRICS.get(str(metric).lower())) is None:
        raise InvalidArgument(f"unknown metric {metric!r}")
    return m


def lit_vector(v: Sequence[float], kind: str = "double") -> Column:
    return F.array(*[F.lit(float(x)).cast(kind) for x in v])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """For vectors of unit length."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def normalize(a: Column) -> Column:
    """Of unit length; a zero vector is unchanged."""
    return bound(norm(a), lambda n: F.when(n == 0, a.cast("array<float>")).otherwise(F.transform(a, lambda x: (x.cast("double") / n).cast("float"))))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value found once, where ``f`` uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(a, lambda x: x * s)


def argmin(a: Column) -> Column:
    """Struct of the first place of the least component (from 0) and its value; null for none."""
    return F.when(F.size(a) > 0, F.struct((F.array_position(a, F.array_min(a)) - 1).alias("index"), F.array_min(a).alias("value")))


def int8_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda acc, x: acc + x)


def sparse_from_dense(a: Column) -> Column:
    """Struct of the places and values of the components that aren't zero; null if all are."""
    e = F.filter(F.transform(a, lambda x, i: F.struct(i.cast("bigint").alias("i"), x.cast("float").alias("x"))), lambda s: s["x"] != 0)
    return F.when(F.size(e) > 0, F.struct(F.transform(e, lambda s: s["i"]).alias("indices"), F.transform(e, lambda s: s["x"]).alias("values")))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse structs."""
    m = F.map_from_arrays(b["indices"], b["values"])
    return _total(F.zip_with(a["indices"], a["values"], lambda i, x: F.coalesce(F.try_element_at(m, i).cast("double"), F.lit(0.0)) * x.cast("double")))


def unit(v: Sequence[float]) -> np.ndarray:
    """float32 of unit length, by way of a double norm."""
    a = np.asarray(v, np.float32).astype(np.float64)
    n = math.sqrt(float(a @ a))
    if n == 0:
        raise InvalidArgument("a zero vector has no direction under the cosine metric")
    return (a / n).astype(np.float32)


def check_vector(v: Sequence[float], dimension: int) -> np.ndarray:
    a = np.asarray(v, np.float32)
    if a.ndim != 1 or len(a) != dimension:
        raise DimensionMismatch(f"expected {dimension} components, got {a.size}")
    if not np.isfinite(a).all():
        raise InvalidArgument("vector components must be finite")
    return a


def check_sparse(s: dict | None) -> dict | None:
    if s is None:
        return None
    ix, vals = list(s.get("indices", [])), [float(x) for x in s.get("values", [])]
    if len(ix) != len(vals):
        raise InvalidArgument("sparse indices and values differ in length")
    if any(not isinstance(i, int) or not 0 <= i < 1 << 32 for i in ix) or any(b <= a for a, b in zip(ix, ix[1:])):
        raise InvalidArgument("sparse indices must rise strictly and fit 32 bits")
    if not all(map(math.isfinite, vals)):
        raise InvalidArgument("sparse values must be finite")
    return {"indices": ix, "values": [float(np.float32(x)) for x in vals]}
