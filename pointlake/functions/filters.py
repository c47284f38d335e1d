"""Payload filters: builders, the JSON form, and their compilation to one Catalyst predicate.

Every leaf is a boolean that is never null, so negation has two values: a point without the
key satisfies ``must_not``. JSON types are respected: a number never equals a string.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument


def _key(key: Any) -> str:
    if not isinstance(key, str) or not key:
        raise InvalidArgument("a condition needs a key")
    if "." in key:
        raise InvalidArgument(f"nested path {key!r} isn't supported")
    return key


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


@dataclass(frozen=True)
class Condition:
    """One leaf, or a nested filter. ``kind``: eq, in, range, exists, nested."""

    kind: str
    key: str = ""
    value: Any = None

    @staticmethod
    def eq(key: str, value: str | int | bool) -> Condition:
        return Condition("eq", key, _match(value))

    @staticmethod
    def in_(key: str, values: list) -> Condition:
        return Condition("in", key, tuple(_match(v) for v in values))

    @staticmethod
    def range(key: str, gt=None, gte=None, lt=None, lte=None) -> Condition:
        return Condition("range", key, tuple((op, float(v)) for op, v in (("gt", gt), ("gte", gte), ("lt", lt), ("lte", lte)) if v is not None))

    @staticmethod
    def exists(key: str) -> Condition:
        return Condition("exists", key)

    @staticmethod
    def nested(inner: Filter) -> Condition:
        return Condition("nested", value=inner)


@dataclass
class Filter:
    must: list[Condition] = field(default_factory=list)
    should: list[Condition] = field(default_factory=list)
    must_not: list[Condition] = field(default_factory=list)

    @staticmethod
    def from_json(spec: dict) -> Filter:
        if not isinstance(spec, dict):
            raise InvalidArgument("a filter is an object")
        out = Filter()
        for clause, items in spec.items():
            if clause not in ("must", "should", "must_not"):
                raise InvalidArgument(f"unknown clause {clause!r}")
            if not isinstance(items, list):
                raise InvalidArgument(f"{clause} is a list of conditions")
            getattr(out, clause).extend(_condition(x) for x in items)
        return out

    def validate(self) -> None:
        for x in (*self.must, *self.should, *self.must_not):
            x.value.validate() if x.kind == "nested" else _key(x.key)

    def is_empty(self) -> bool:
        return not (self.must or self.should or self.must_not)

    def compile(self, payload: Column, variant: bool = False) -> Column:
        """Predicate on a JSON string column, or with ``variant`` a variant column."""
        self.validate()
        return self._compile(payload if variant else F.try_parse_json(payload))

    def prune(self, indexes: dict[str, str]) -> Column | None:
        """What every match satisfies in the typed columns of declared indexes (``pidx_<key>_<kind>``), for the scan to
        skip by; the filter itself is still to be applied. None if the indexes say nothing."""
        parts = [p for x in self.must if (p := _bounds(x, indexes)) is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _compile(self, v: Column) -> Column:
        parts = [_leaf(x, v) for x in self.must] + [~_leaf(x, v) for x in self.must_not]
        if self.should:
            parts.append(reduce(lambda a, b: a | b, [_leaf(x, v) for x in self.should]))
        return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def _match(value: Any) -> str | int | bool:
    if isinstance(value, (bool, str)):
        return value
    if isinstance(value, int) and -(1 << 63) <= value < 1 << 63:
        return value
    raise InvalidArgument(f"{value!r} is no keyword, integer or boolean to match")


def _condition(spec: Any) -> Condition:
    if not isinstance(spec, dict):
        raise InvalidArgument("a condition is an object")
    if any(x in spec for x in ("must", "should", "must_not")):
        return Condition.nested(Filter.from_json(spec))
    if geo := next((x for x in spec if x.startswith("geo")), None):
        raise InvalidArgument(f"{geo} isn't supported")
    key = _key(spec.get("key"))
    if "match" in spec:
        m = spec["match"]
        if isinstance(m, dict) and "value" in m:
            return Condition.eq(key, m["value"])
        if isinstance(m, dict) and isinstance(m.get("any"), list):
            return Condition.in_(key, m["any"])
        raise InvalidArgument("match takes a value or a list any")
    if "range" in spec:
        r = spec["range"]
        if not isinstance(r, dict) or set(r) - {"gt", "gte", "lt", "lte"}:
            raise InvalidArgument("range takes gt, gte, lt and lte")
        if any(x is not None and (isinstance(x, bool) or not isinstance(x, (int, float))) for x in r.values()):
            raise InvalidArgument("a bound is a number")
        return Condition.range(key, **r)
    if "exists" in spec or "is_empty" in spec:  # whatever their value
        return Condition.exists(key)
    raise InvalidArgument(f"no known test of {key!r}")


def _typed(v: Column, key: str) -> tuple[Column, Column]:
    f = F.try_variant_get(v, _path(key), "variant")
    return f, F.coalesce(F.schema_of_variant(f), F.lit(""))


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _equal(f: Column, kind: Column, value: str | int | bool) -> Column:
    if isinstance(value, bool):
        test = (kind == "BOOLEAN") & (F.try_variant_get(f, "$", "boolean") == F.lit(value))
    elif isinstance(value, str):
        test = (kind == "STRING") & (F.try_variant_get(f, "$", "string") == F.lit(value))
    elif abs(value) < 1 << 53:
        test = _number(kind) & (F.try_variant_get(f, "$", "double") == F.lit(float(value)))
    else:
        test = _number(kind) & (F.try_variant_get(f, "$", "decimal(38,0)") == F.lit(value).cast("decimal(38,0)"))
    return F.coalesce(test, F.lit(False))


def _leaf(x: Condition, v: Column) -> Column:
    if x.kind == "nested":
        return x.value._compile(v)
    f, kind = _typed(v, x.key)
    if x.kind == "exists":
        return f.isNotNull()
    if x.kind == "eq":
        return _equal(f, kind, x.value)
    if x.kind == "in":
        return reduce(lambda a, b: a | b, [_equal(f, kind, m) for m in x.value], F.lit(False))
    n = F.try_variant_get(f, "$", "double")
    ops = {"gt": lambda b: n > b, "gte": lambda b: n >= b, "lt": lambda b: n < b, "lte": lambda b: n <= b}
    return F.coalesce(reduce(lambda a, b: a & b, [ops[op](F.lit(b)) for op, b in x.value], _number(kind)), F.lit(False))


def _bounds(x: Condition, indexes: dict[str, str]) -> Column | None:
    if x.kind == "nested":
        return x.value.prune(indexes)
    if (kind := indexes.get(x.key)) is None:
        return None
    col = F.col(f"`pidx_{x.key}_{kind}`")
    if x.kind == "exists":
        return None
    if x.kind == "range":
        if kind == "keyword" or not x.value:
            return None
        # an integer column holds a fraction without its digits, and nothing for what is too large
        low, high = (-1, 1) if kind == "integer" else (0, 0)
        side = {"gt": lambda b: col >= b + low, "gte": lambda b: col >= b + low, "lt": lambda b: col <= b + high, "lte": lambda b: col <= b + high}
        held = reduce(lambda a, b: a & b, [side[op](b) for op, b in x.value])
        return held | col.isNull() if kind == "integer" else held
    values = [x.value] if x.kind == "eq" else list(x.value)
    if kind == "keyword":
        return col.isin(values) if values and all(isinstance(v, str) for v in values) else None
    if not values or not all(isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 53 for v in values):
        return None
    if kind == "float":
        return col.isin([float(v) for v in values])
    return (col >= min(values) - 1) & (col <= max(values) + 1)


def as_filter(spec: Filter | dict | None) -> Filter:
    if spec is None:
        return Filter()
    return spec if isinstance(spec, Filter) else Filter.from_json(spec)
