"""Quantization codecs: scalar of 8, 4, 2 and 1 bits, binary, and product."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .vectors import bound


class Codec(ABC):
    """Vectors to bytes and back."""

    @abstractmethod
    def fit(self, df: DataFrame, vector: str = "vector") -> Codec: ...

    @abstractmethod
    def encode(self, v: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def decode(self, codes: np.ndarray, dimension: int) -> np.ndarray: ...

    @abstractmethod
    def params(self) -> dict: ...

    def serialize_params(self) -> bytes:
        return json.dumps(self.params()).encode()

    def memory_usage(self, count: int, dimension: int) -> int:
        return count * self.encode(np.zeros((1, dimension), np.float32)).shape[1]

    def compression_ratio(self, dimension: int) -> float:
        return 4.0 * dimension / max(1, self.memory_usage(1, dimension))

    def quality_loss(self, v: np.ndarray) -> float:
        """Mean squared error of the round trip."""
        d = self.decode(self.encode(v), v.shape[1]) - v
        return float((d.astype(np.float64) ** 2).mean()) if v.size else 0.0


class ScalarCodec(Codec):
    def __init__(self, bits: int = 8, low: float = 0.0, high: float = 0.0):
        if bits not in (8, 4, 2, 1):
            raise InvalidArgument("bits must be 8, 4, 2 or 1")
        self.bits, self.low, self.high = bits, np.float32(low), np.float32(high)

    @property
    def scale(self) -> np.float32:
        return np.float32((self.high - self.low) / np.float32((1 << self.bits) - 1))

    def fit(self, df: DataFrame, vector: str = "vector") -> ScalarCodec:
        r = df.agg(F.min(F.array_min(vector)), F.max(F.array_max(vector))).first()
        self.low, self.high = np.float32(r[0] or 0), np.float32(r[1] or 0)
        return self

    def codes(self, v: np.ndarray) -> np.ndarray:
        v, s, top = np.asarray(v, np.float32), self.scale, (1 << self.bits) - 1
        if self.bits == 1:
            return (v >= np.float32((self.low + self.high) / np.float32(2))).astype(np.uint8)
        if s == 0:
            return np.zeros(v.shape, np.uint8)
        x = (v - self.low) * np.float32(1 / s) if self.bits == 8 else (v - self.low) / s
        return np.clip(np.sign(x) * np.floor(np.abs(x) + np.float32(0.5)), 0, top).astype(np.uint8)

    def encode(self, v: np.ndarray) -> np.ndarray:
        q = self.codes(v)
        if self.bits == 8:
            return q
        if self.bits == 1:
            return np.packbits(q, axis=-1, bitorder="little")
        per = 8 // self.bits
        q = np.pad(q, [(0, 0)] * (q.ndim - 1) + [(0, -q.shape[-1] % per)]).reshape(*q.shape[:-1], -1, per)
        return (q.astype(np.uint16) << (np.arange(per, dtype=np.uint16) * self.bits)).sum(-1).astype(np.uint8)

    def decode(self, codes: np.ndarray, dimension: int) -> np.ndarray:
        codes = np.asarray(codes, np.uint8)
        if self.bits == 1:
            return np.where(np.unpackbits(codes, axis=-1, bitorder="little")[..., :dimension] > 0, self.high, self.low)
        if self.bits < 8:
            per = 8 // self.bits
            codes = (codes[..., None] >> (np.arange(per, dtype=np.uint8) * self.bits)) & ((1 << self.bits) - 1)
            codes = codes.reshape(*codes.shape[:-2], -1)[..., :dimension]
        return self.low + codes.astype(np.float32) * self.scale

    def similarity(self, a: np.ndarray, b: np.ndarray, dimension: int) -> np.ndarray:
        """Cosine of a vector and codes (or of codes and codes), once decoded; 0 for a zero."""
        x, y = (self.decode(z, dimension) if z.dtype == np.uint8 else z for z in (a, b))
        n = np.linalg.norm(x, axis=-1) * np.linalg.norm(y, axis=-1)
        return np.where(n > 0, (x * y).sum(-1) / np.where(n > 0, n, 1), 0.0)

    def params(self) -> dict:
        return {"type": "sq", "bits": self.bits, "low": float(self.low), "high": float(self.high)}


class BinaryCodec(Codec):
    def __init__(self, threshold: float = 0.0):
        self.threshold = np.float32(threshold)

    def fit(self, df: DataFrame, vector: str = "vector") -> BinaryCodec:
        """The upper median of all components, exactly. Counts by value are halved until one value
        is left, so no task ever sorts or holds them all."""
        counts = df.select(F.explode(vector).alias("v")).groupBy(F.col("v").cast("double").alias("x")).agg(F.count("*").alias("n")).persist()
        total, lo, hi = counts.agg(F.sum("n"), F.min("x"), F.max("x")).first()
        x = F.col("x")
        while total and lo < hi:
            mid = (lo + hi) / 2
            below, under, over = counts.agg(F.sum(F.when(x <= mid, F.col("n"))), F.max(F.when(x <= mid, x)), F.min(F.when(x > mid, x))).first()
            lo, hi = (lo, under) if (below or 0) > total // 2 else (over, hi)
        counts.unpersist()
        self.threshold = np.float32(lo or 0.0)
        return self

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.packbits(np.asarray(v, np.float32) > self.threshold, axis=-1, bitorder="little")

    def decode(self, codes: np.ndarray, dimension: int) -> np.ndarray:
        return np.where(np.unpackbits(codes, axis=-1, bitorder="little")[..., :dimension] > 0, 1.0, -1.0).astype(np.float32)

    def similarity(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        d = np.asarray(query).shape[-1]
        return 1 - np.bitwise_count(self.encode(query) ^ codes).sum(-1) / d

    @staticmethod
    def code_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 - np.bitwise_count(a ^ b).sum(-1) / (8 * np.asarray(a).shape[-1])

    def params(self) -> dict:
        return {"type": "binary", "threshold": float(self.threshold)}


class ProductCodec(Codec):
    """``parts`` codebooks of ``k`` centroids. They are fitted on ``rows`` rows at most, those
    of least hash, by k-means++ with a fixed seed."""

    def __init__(self, parts: int = 8, k: int = 256, rows: int = 10_000, seed: int = 42):
        self.parts, self.k, self.rows, self.seed, self.books = parts, k, rows, seed, None

    def fit(self, df: DataFrame, vector: str = "vector") -> ProductCodec:
        sample = df.select(vector).orderBy(F.xxhash64(vector)).limit(self.rows).toArrow()[vector].to_pylist()
        return self.train(np.array(sample, np.float32))

    def train(self, v: np.ndarray) -> ProductCodec:
        if not len(v) or v.shape[1] % self.parts:
            raise InvalidArgument("product quantization needs rows, and a dimension its parts divide")
        rng = np.random.default_rng(self.seed)
        self.books = []
        for x in np.split(v.astype(np.float64), self.parts, axis=1):
            c = x[[rng.integers(len(x))]]
            d = ((x - c[0]) ** 2).sum(1)
            while len(c) < min(self.k, len(x)) and d.sum() > 0:
                c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
                d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
            for _ in range(100):
                near = self._near(x, c)
                n = np.bincount(near, minlength=len(c))
                new = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
                new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
                if np.allclose(new, c, atol=1e-7):
                    break
                c = new
            self.books.append(c.astype(np.float32))
        return self

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.stack([self._near(x, c) for x, c in zip(np.split(np.asarray(v, np.float32), self.parts, axis=1), self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, dimension: int) -> np.ndarray:
        out = np.concatenate([c[codes[:, j]] for j, c in enumerate(self.books)], 1)
        return np.pad(out, [(0, 0), (0, max(0, dimension - out.shape[1]))])

    def memory_usage(self, count: int, dimension: int) -> int:
        return count * self.parts

    def params(self) -> dict:
        return {"type": "pq", "books": [c.tolist() for c in self.books or []]}


def deserialize_params(data: bytes) -> Codec:
    p = json.loads(data)
    if p.get("type") == "sq":
        return ScalarCodec(p["bits"], p["low"], p["high"])
    if p.get("type") == "binary":
        return BinaryCodec(p["threshold"])
    if p.get("type") == "pq":
        out = ProductCodec(len(p["books"]))
        out.books = [np.array(c, np.float32) for c in p["books"]]
        return out
    raise InvalidArgument("unknown codec")


def sq_codes(vector: Column, low: Column, high: Column, bits: int) -> Column:
    """Codes of ``bits`` bits as array<int>, in double arithmetic; of one bit, whether the middle is reached."""
    lo, hi = low.cast("double"), high.cast("double")
    if bits == 1:
        return F.transform(vector, lambda x: (x.cast("double") >= (lo + hi) / 2).cast("int"))
    top = float((1 << bits) - 1)
    s = (hi - lo) / top
    return F.transform(vector, lambda x: F.when(s == 0, 0).otherwise(F.least(F.greatest(F.round((x.cast("double") - lo) / s), F.lit(0.0)), F.lit(top))).cast("int"))


def sq_decode(codes: Column, low: Column, high: Column, bits: int) -> Column:
    lo, hi = low.cast("double"), high.cast("double")
    return F.transform(codes, lambda q: F.when(q > 0, hi).otherwise(lo) if bits == 1 else lo + q * ((hi - lo) / float((1 << bits) - 1)))


def binary_codes(vector: Column, threshold: float) -> Column:
    """Whether each component is over the threshold, as array<int>."""
    return F.transform(vector, lambda x: (x > F.lit(float(threshold)).cast("float")).cast("int"))


def pack(codes: Column, bits: int) -> Column:
    """Codes as bytes (array<int>), the first code in the lowest bits; a last byte may be filled in part."""
    per = 8 // bits

    def whole(c: Column) -> Column:
        at = lambda k, j: F.coalesce(F.try_element_at(c, (k * per + j + 1).cast("int")), F.lit(0))
        bytes_ = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(c) / per).cast("int") - 1, F.lit(0)))
        packed = F.transform(bytes_, lambda k: sum((at(k, j) * (1 << (bits * j)) for j in range(1, per)), at(k, 0)))
        return F.when(F.size(c) == 0, F.array().cast("array<int>")).otherwise(packed)

    return bound(codes, whole)


def unpack(packed: Column, bits: int, dimension: int) -> Column:
    """The codes that :func:`pack` packed."""
    per, mask = 8 // bits, (1 << bits) - 1
    one = lambda b: F.array(*[F.shiftright(b, bits * j).bitwiseAND(F.lit(mask)) for j in range(per)])
    return F.slice(F.flatten(F.transform(packed, one)), 1, dimension)


def hamming_similarity(a: Column, b: Column, dimension: int) -> Column:
    """Share of equal bits of two packed binary vectors."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - apart / F.lit(float(dimension))


def asymmetric_cosine(query: Column, codes: Column, low: Column, high: Column, bits: int) -> Column:
    """Cosine of a plain vector and of codes once decoded; 0 for a zero."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    def cosine(v: Column) -> Column:
        n = F.sqrt(total(query, query)) * F.sqrt(total(v, v))
        return F.when(n > 0, total(query, v) / n).otherwise(F.lit(0.0))

    return bound(sq_decode(codes, low, high, bits), cosine)


def sq8_codes(vector: Column, low: Column, high: Column) -> Column:
    """Codes of 8 bits as array<int>, in double arithmetic."""
    s = (high.cast("double") - low.cast("double")) / 255
    return F.transform(vector, lambda x: F.when(s == 0, 0).otherwise(F.least(F.greatest(F.round((x.cast("double") - low.cast("double")) / s), F.lit(0.0)), F.lit(255.0))).cast("int"))


def sq8_decode(codes: Column, low: Column, high: Column) -> Column:
    s = (high.cast("double") - low.cast("double")) / 255
    return F.transform(codes, lambda q: low.cast("double") + q * s)
