"""Cropped and edited copies of pictures by local descriptors.

1. Pictures with equal pixels collapse to the one of least id.
2. Corners (Harris and Stephens) are found at several scales, wherever they are the largest
   around. A corner is turned by its intensity centroid, and 256 comparisons of blurred
   pixels around it give its bits (Rublee and others, 2011).
3. ``TABLES`` hash tables hold ``KEY_BITS`` of the bits each. Two corners of different pictures match if they share a key of
   some table and at most ``HAMMING`` of 64 further bits differ. Every such match counts, however many pictures share a pattern.
   So that matches, which are many, never leave memory, pictures are dealt into groups of about ``GROUP_CORNERS``
   corners, and one task joins two groups, ``BUDGET`` pairs of corners at a time; of the matches it keeps those
   of pictures that have ``INLIERS`` or more in common.
4. Two pictures are copies if ``INLIERS`` corners of either agree on one turn, scale and
   shift, up to ``RESIDUAL`` pixels.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, materialise, small
from .minhash_dedup import components

SCALES = (1.0, 0.7071, 0.5)
RADIUS, DISC, TURNS = 13, 11, 30
TABLES, KEY_BITS, HAMMING = 4, 24, 10
INLIERS, RESIDUAL, TURN_ERROR = 4, 1.5, 0.25
#: Corners of a group, and pairs of corners (or of pictures) that a task looks at together.
GROUP_CORNERS, BUDGET = 150_000, 4_000_000
#: Up to so many matches of two pictures are judged together with those of others.
MATCHES = 256
#: Least corner response, as a share of the picture's largest and absolutely.
SHARE, LEAST = 0.02, 20.0

_rng = np.random.default_rng(7)
_PAIRS = _rng.normal(0, 5.2, (4096, 2, 2))
_PAIRS = _PAIRS[(np.hypot(_PAIRS[..., 0], _PAIRS[..., 1]) <= RADIUS - 0.5).all(1)]
_PAIRS = _PAIRS[np.hypot(*(_PAIRS[:, 0] - _PAIRS[:, 1]).T) > 2][:256]
_ANGLES = 2 * np.pi * np.arange(TURNS) / TURNS
#: turns x tests x 2 points x (dx, dy)
_TESTS = np.rint(np.stack([_PAIRS @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) for t in _ANGLES])).astype(np.int64)
_DX, _DY = (v.reshape(-1) for v in np.meshgrid(np.arange(-DISC, DISC + 1), np.arange(-DISC, DISC + 1)))
_DX, _DY = (v[_DX**2 + _DY**2 <= DISC**2] for v in (_DX, _DY))
_ORDER = _rng.permutation(256)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PNG (8 bits, not interlaced), PGM or PPM file; None for anything else."""
    try:
        return _decode(data) if data else None
    except (ValueError, IndexError, KeyError, TypeError, OverflowError, struct.error, zlib.error):
        return None


def _decode(data: bytes) -> np.ndarray | None:
    if data[:2] in (b"P5", b"P6"):
        head = data.split(None, 4)
        w, h, k = int(head[1]), int(head[2]), 3 if data[:2] == b"P6" else 1
        if int(head[3]) != 255 or w < 1 or h < 1:
            return None
        at = data.index(b"255", 3 + len(head[1]) + len(head[2])) + 4
        px = np.frombuffer(data, np.uint8, w * h * k, at).reshape(h, w, k)
        return _grey(px)
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, palette, meta = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            meta = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if meta is None:
        return None
    w, h, depth, colour, _, _, lace = meta
    if depth != 8 or lace or not w or not h or colour == 3 and palette is None:
        return None
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    size = h * (1 + w * k)
    # deflate makes at most 1032 bytes of one: a header that declares more is false, and nothing is inflated for it
    if size > 1032 * (len(body) + 16):
        return None
    rows = np.frombuffer(zlib.decompressobj().decompress(body, size + 1), np.uint8).reshape(h, 1 + w * k)
    out = np.zeros((h + 1, w * k), np.uint8)
    for y in range(h):
        kind, line, up = rows[y, 0], rows[y, 1:].copy(), out[y]
        if kind == 2:
            line += up
        elif kind == 1:
            line = np.add.accumulate(line.reshape(w, k), 0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            for x in range(w * k):
                a, b, d = int(line[x - k]) if x >= k else 0, int(up[x]), int(up[x - k]) if x >= k else 0
                if kind == 3:
                    p = (a + b) // 2
                else:
                    g = a + b - d
                    p = min((abs(g - a), 0, a), (abs(g - b), 1, b), (abs(g - d), 2, d))[2]
                line[x] = (int(line[x]) + p) & 255
        elif kind:
            return None
        out[y + 1] = line
    px = out[1:].reshape(h, w, k)
    return _grey(palette[px[..., 0]] if colour == 3 else px[..., : 3 if k > 2 else 1])


def _grey(px: np.ndarray) -> np.ndarray:
    return px[..., 0] if px.shape[2] == 1 else np.rint(px @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _smooth(a: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        p = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in range(3)], mode="edge")
        n = a.shape[axis]
        s = [np.take(p, range(j, j + n), axis) for j in range(5)]
        a = (s[0] + s[4] + 4 * (s[1] + s[3]) + 6 * s[2]) / np.float32(16)
    return a


def _largest(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (1, 2):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(3)], constant_values=-np.inf)
        n = a.shape[axis]
        a = np.max([np.take(p, range(j, j + n), axis) for j in range(2 * r + 1)], 0)
    return a


def _resized(a: np.ndarray, s: float) -> np.ndarray:
    if s == 1:
        return a
    for axis in (1, 2):
        n = a.shape[axis]
        at = np.clip((np.arange(int(n * s)) + 0.5) / s - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), n - 2)
        f = (at - lo).astype(np.float32).reshape([-1 if k == axis else 1 for k in range(3)])
        a = np.take(a, lo, axis) * (1 - f) + np.take(a, lo + 1, axis) * f
    return a


def corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(picture, place, bits) of each corner of pictures of one size. ``place`` packs x, y, turn and
    scale; the bits are 256 booleans."""
    whole, out = images.astype(np.float32), []
    for level, s in enumerate(SCALES):
        if min(whole.shape[1:]) * s < 2 * RADIUS + 4:
            continue
        a = _smooth(_resized(whole, s))
        gx, gy = np.zeros_like(a), np.zeros_like(a)
        gx[:, :, 1:-1], gy[:, 1:-1] = (a[:, :, 2:] - a[:, :, :-2]) / 2, (a[:, 2:] - a[:, :-2]) / 2
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        top = r.max((1, 2), keepdims=True)
        ok = (r == _largest(r, 3)) & (r > np.maximum(SHARE * top, LEAST))
        m = RADIUS + 1
        ok[:, :m] = ok[:, -m:] = ok[:, :, :m] = ok[:, :, -m:] = False
        i, y, x = np.nonzero(ok)
        if not len(i):
            continue
        v = a[i[:, None], y[:, None] + _DY, x[:, None] + _DX]
        turn = np.rint(np.arctan2(v @ _DY.astype(np.float32), v @ _DX.astype(np.float32)) * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
        t = _TESTS[turn]
        p = a[i[:, None, None], y[:, None, None] + t[..., 1], x[:, None, None] + t[..., 0]]
        full = [np.clip(np.rint((q + 0.5) / s - 0.5), 0, 65535).astype(np.int64) for q in (x, y)]
        out.append((i, full[0] << 24 | full[1] << 8 | turn << 2 | level, p[..., 0] < p[..., 1]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 256), bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _word(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, picture file): a row for each corner: its place, its keys, two to a number, and what is compared."""
    for b in batches:
        ids = b.column(0).to_numpy()
        by: dict[tuple[int, int], list] = {}
        for i, data in zip(ids, b.column(1)):
            px = decode(data.as_py())
            if px is not None:
                by.setdefault(px.shape, []).append((i, px))
        for same in by.values():
            for k in range(0, len(same), 64):
                some = same[k : k + 64]
                at, place, bits = corners(np.stack([p for _, p in some]))
                name = np.array([i for i, _ in some])[at]
                keys = [_word(bits[:, _ORDER[j * KEY_BITS : (j + 1) * KEY_BITS]]) for j in range(TABLES)]
                check = bits[:, _ORDER[TABLES * KEY_BITS : TABLES * KEY_BITS + 64]]
                check = np.ascontiguousarray(np.packbits(check, 1)).view(np.int64)[:, 0]
                cols = [name, place, *(keys[j] << KEY_BITS | keys[j + 1] for j in range(0, TABLES, 2)), check]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["id", "place", "k", "l", "bits"])


class Corners:
    """Corners in order of their pictures; by table, their keys and the order of these."""

    def __init__(self, ids: np.ndarray, place: np.ndarray, keys: np.ndarray, bits: np.ndarray):
        self.ids, self.place, self.keys, self.bits = ids, place, keys, bits
        self.first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        self.at = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(ids))))
        self.order = [np.argsort(k, kind="stable") for k in keys]
        self.ordered = [k[o] for k, o in zip(keys, self.order)]

    @classmethod
    def of(cls, rows: np.ndarray) -> Corners:
        """From (id, place, k, l, bits)."""
        keys = np.stack([rows[2 + j // 2] >> (KEY_BITS * (1 - j % 2)) & ((1 << KEY_BITS) - 1) for j in range(TABLES)])
        return cls(rows[0], rows[1], keys, rows[4].view(np.uint64))

    def halves(self) -> list[Corners]:
        cut = self.first[len(self.first) // 2]
        return [Corners(self.ids[x], self.place[x], self.keys[:, x], self.bits[x]) for x in (slice(None, cut), slice(cut, None))]


def _matches(a: Corners, b: Corners, rows: slice, lo: np.ndarray, n: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(corner of ``a``, of ``b``) of each match of the ``rows`` of ``a``, once. ``lo`` and ``n`` have by table where the corners of ``b`` of
    equal key begin and how many there are. With ``own`` both are of one group, and the first picture has the lesser id."""
    out = []
    for t in range(TABLES):
        m = n[t, rows]
        x = np.repeat(np.arange(rows.start, rows.stop), m)
        y = b.order[t][np.arange(len(x)) - np.repeat(np.cumsum(m) - m - lo[t, rows], m)]
        ok = np.flatnonzero(np.bitwise_count(a.bits[x] ^ b.bits[y]) <= HAMMING)
        x, y = x[ok], y[ok]
        ok = a.ids[x] < b.ids[y] if own else np.ones(len(x), bool)
        for u in range(t):  # counted there
            ok &= a.keys[u][x] != b.keys[u][y]
        out.append((x[ok], y[ok]))
    return tuple(np.concatenate(z) for z in zip(*out))


def joined(a: Corners, b: Corners, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of two pictures, the lesser first; first row of each pair and the number of rows; places that match, as rows of two)
    of all pictures of ``a`` and ``b`` with ``INLIERS`` matches or more."""
    if not len(a.ids) or not len(b.ids):
        return
    lo = np.stack([np.searchsorted(b.ordered[t], a.keys[t]) for t in range(TABLES)])
    n = np.stack([np.searchsorted(b.ordered[t], a.keys[t], "right") for t in range(TABLES)]) - lo
    cost, many = np.append(0, np.cumsum(np.add.reduceat(n.sum(0), a.first))), len(b.first)
    ends, p = np.append(a.first, len(a.ids)), 0
    while p < len(a.first):
        q = min(int(np.searchsorted(cost, cost[p] + BUDGET, "right")) - 1, p + max(1, BUDGET // many))
        if q <= p:
            q = p + 1
            if many > 1:  # one picture, too much alone: against half the others at a time
                one = slice(ends[p], ends[q])
                one = Corners(a.ids[one], a.place[one], a.keys[:, one], a.bits[one])
                for half in b.halves():
                    yield from joined(one, half, own)
                p = q
                continue
        x, y = _matches(a, b, slice(int(ends[p]), int(ends[q])), lo, n, own)
        pair = (a.at[x] - p) * many + b.at[y]
        ok = np.flatnonzero(np.bincount(pair, minlength=1)[pair] >= INLIERS)
        ok = ok[np.argsort(pair[ok], kind="stable")]
        if len(ok):
            x, y, pair = x[ok], y[ok], pair[ok]
            ids, places = np.stack([a.ids[x], b.ids[y]], 1), np.stack([a.place[x], b.place[y]], 1)
            swap = ids[:, 0] > ids[:, 1]
            ids[swap], places[swap] = ids[swap, ::-1], places[swap, ::-1]
            cut = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair))
            yield ids[cut[:-1]], cut, places
        p = q


def _geometry(pairs: np.ndarray):
    """(x, y, growth, turn) of pairs of places; the last axis of x and y is the picture."""
    turn, size = (pairs >> 2 & 63) * (2 * np.pi / TURNS), 1 / np.array(SCALES)[pairs & 3]
    return (pairs >> 24).astype(float), (pairs >> 8 & 0xFFFF).astype(float), size[..., 1] / size[..., 0], turn[..., 1] - turn[..., 0]


def agree_all(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`agree`, of an array (pictures, matches, 2); (0, 0, 0) for too few."""
    x, y, grow, by = _geometry(pairs)
    ca, sa, lg = grow * np.cos(by), grow * np.sin(by), np.log2(grow)
    dx, dy = (v[:, None, :] - v[:, :, None] for v in (x[..., 0], y[..., 0]))
    ex, ey = (v[:, None, :] - v[:, :, None] for v in (x[..., 1], y[..., 1]))
    ca, sa = ca[:, :, None], sa[:, :, None]
    on = np.hypot(ca * dx - sa * dy - ex, sa * dx + ca * dy - ey) <= RESIDUAL * np.maximum(1.0, grow)[:, :, None]
    on &= np.abs((by[:, None, :] - by[:, :, None] + np.pi) % (2 * np.pi) - np.pi) < TURN_ERROR
    on &= np.abs(lg[:, None, :] - lg[:, :, None]) < 0.6
    out = np.zeros(len(pairs), np.int64), np.zeros(len(pairs)), np.zeros(len(pairs))
    some = np.flatnonzero(on.sum(2).max(1) >= INLIERS)
    if not len(some):
        return out
    on = on[some].astype(np.float32)
    n = np.full(on.shape[:2], np.inf)
    for side in (0, 1):  # corners of one place count once
        spot = pairs[some, :, side] >> 8
        earlier = (spot[:, :, None] == spot[:, None, :]) & np.triu(np.ones((spot.shape[1],) * 2, bool), 1)
        n = np.minimum(n, (on * (on @ earlier.astype(np.float32) == 0)).sum(2))
    k = n.argmax(1)
    rows = np.arange(len(some))
    ok = n[rows, k] >= INLIERS
    some, k, rows = some[ok], k[ok], rows[ok]
    out[0][some], out[1][some], out[2][some] = n[rows, k], grow[some, k], np.degrees(by[some, k]) % 360
    return out


def agree(pairs: np.ndarray) -> tuple[int, float, float] | None:
    """(corners that agree, scale, turn) for an array of pairs of places; None for too few."""
    x, y, turn, size = pairs >> 24, pairs >> 8 & 0xFFFF, (pairs >> 2 & 63) * (2 * np.pi / TURNS), 1 / np.array(SCALES)[pairs & 3]
    grow, by = size[:, 1] / size[:, 0], turn[:, 1] - turn[:, 0]
    best, most = None, min(len(np.unique(pairs[:, j] >> 8)) for j in (0, 1))
    for k in range(len(pairs)):
        ca, sa = grow[k] * np.cos(by[k]), grow[k] * np.sin(by[k])
        dx, dy = x[:, 0] - x[k, 0], y[:, 0] - y[k, 0]
        off = np.hypot(ca * dx - sa * dy + x[k, 1] - x[:, 1], sa * dx + ca * dy + y[k, 1] - y[:, 1])
        near = np.abs((by - by[k] + np.pi) % (2 * np.pi) - np.pi) < TURN_ERROR
        on = near & (off <= RESIDUAL * max(1.0, grow[k])) & (np.abs(np.log2(grow / grow[k])) < 0.6)
        n = min(len(np.unique(pairs[on, j] >> 8)) for j in (0, 1))
        if n >= INLIERS and (best is None or n > best[0]):
            best = (n, float(grow[k]), float(np.degrees(by[k]) % 360))
            if n == most:
                break
    return best


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair of groups, group, id, place, k, l, bits), in order: the copies among the pictures of each two groups."""

    def found(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts, 1)
        groups = np.unique(rows[1])
        sides = [Corners.of(rows[2:, rows[1] == g]) for g in groups]
        # a pair of one group has that only; of two, one may have no corners
        own = of_one(int(rows[0, 0]))
        if own or len(sides) == 2:
            for ids, cut, places in joined(sides[0], sides[-1], own):
                n = np.diff(cut)
                for m in np.unique(n).tolist():
                    at = np.flatnonzero(n == m)
                    step = max(1, 500_000 // (m * m))
                    for k in range(0, len(at), step):
                        some = at[k : k + step]
                        pairs = places[cut[some][:, None] + np.arange(m)]
                        if m <= MATCHES:
                            count, scale, turn = agree_all(pairs)
                        else:
                            count, scale, turn = (np.array(x) for x in zip(*(agree(p) or (0, 0.0, 0.0) for p in pairs)))
                        if (ok := count > 0).any():
                            some = some[ok]
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some, 1], ids[some, 0], count[ok], scale[ok], turn[ok])], names=["image_id", "copy_of", "inliers", "scale", "turn"])

    def of_one(pair: int) -> bool:
        """Whether a pair, numbered as in :func:`copies`, is of one group."""
        hi = (math.isqrt(8 * pair + 1) - 1) // 2
        return pair == hi * (hi + 1) // 2 + hi

    held: list[np.ndarray] = []
    for b in batches:
        new = np.stack([x.to_numpy() for x in b.columns])
        for part in np.split(new, np.flatnonzero(np.diff(new[0])) + 1, 1):
            if held and part.shape[1] and held[0][0, 0] != part[0, 0]:
                yield from found(held)
                held = []
            if part.shape[1]:
                held.append(part)
    if held:
        yield from found(held)


def copies(spark: SparkSession, pictures: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """(image_id, copy_of, inliers, scale, turn): pictures and an earlier one (by id) each was cropped
    or edited from, or the other way round. ``inliers`` is null for files that are equal, which
    name the first of them only.

    Rows with a null id, and files that are null, empty or in no known format, have no copies. A picture
    without corners equals itself only. Ids may be of any type with an order. Pictures of any size are read whole. Of repeated ids with unequal files any counts, equal rows count once. An empty
    table gives an empty one; further columns are ignored.
    """
    kind = pictures.schema[key].dataType
    if not isinstance(kind, T.IntegralType):  # keys of any other type are numbered in their order
        numbers = materialise(spark, pictures.where(c(key).isNotNull()).select(c(key).alias("name")).distinct().orderBy("name").withColumn("n", F.monotonically_increasing_id()), "numbers")
        found = copies(spark, pictures.select(c(key).alias("name"), c(image).alias("image")).join(numbers, "name").select(F.col("n").alias("image_id"), "image"))
        of = lambda x: numbers.select(F.col("n").alias(x), F.col("name").alias(f"name_{x}"))
        found = found.join(of("image_id"), "image_id").join(of("copy_of"), "copy_of")
        return found.select(F.col("name_image_id").alias("image_id"), F.col("name_copy_of").alias("copy_of"), "inliers", "scale", "turn")
    rows = pictures.where(c(key).isNotNull() & c(image).isNotNull()).select(c(key).cast("bigint").alias("id"), c(image).alias("image"))
    same = materialise(spark, rows.select("id", F.sha2("image", 256).alias("h")), "hashes")
    first = same.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    equal = same.join(first.where("n > 1"), "h").where("id <> first").select(F.col("id").alias("image_id"), F.col("first").alias("copy_of")).distinct()
    equal = equal.withColumns({"inliers": F.lit(None).cast("bigint"), "scale": F.lit(1.0), "turn": F.lit(0.0)})
    rest = rows.join(small(equal.select(F.col("image_id").alias("id")), 8), "id", "left_anti")
    table = materialise(spark, rest.mapInArrow(_described, "id bigint, place bigint, k bigint, l bigint, bits bigint"), "corners")
    groups = max(1, -(-table.count() // GROUP_CORNERS))
    table = table.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("bigint"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("other")
    table = table.select("*", other).select((F.expr("greatest(g, other) * (greatest(g, other) + 1) div 2") + F.least("g", "other")).alias("pair"), "g", "id", "place", "k", "l", "bits")
    table = table.repartitionById(groups * (groups + 1) // 2, F.col("pair").cast("int")).sortWithinPartitions("pair", "g", "id", "place")
    found = table.mapInArrow(_copies, "image_id bigint, copy_of bigint, inliers bigint, scale double, turn double")
    return found.unionByName(equal)


def classes(spark: SparkSession, pictures: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """(image_id, class_id, links): each picture once, the least id of those that copies join it to, and of how many rows of :func:`copies` it
    is part. A picture without copies is a class of its own, and so is one without a readable file. Null ids have no row."""
    found = materialise(spark, copies(spark, pictures, key, image).select("image_id", "copy_of"), "copies")
    root = components(spark, found.select(F.col("image_id").alias("a"), F.col("copy_of").alias("b")))
    links = found.select(F.explode(F.array("image_id", "copy_of")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    every = pictures.where(c(key).isNotNull()).select(c(key).alias("id")).distinct()
    out = every.join(root, "id", "left").join(links, "id", "left")
    return out.select(F.col("id").alias("image_id"), F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def pgm(px: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (px.shape[1], px.shape[0]) + px.astype(np.uint8).tobytes()


def render(v: np.ndarray, cell: int = 8) -> np.ndarray:
    """A picture of a vector: eight rows (for one of 64, of eight cells each) of its components' ranks, with soft edges."""
    grey = np.pad(v.argsort().argsort() * (255 / max(1, len(v) - 1)), (0, -len(v) % 8)).reshape(8, -1)
    px = np.kron(grey, np.ones((cell, cell), np.float32))[None].astype(np.float32)
    return np.rint(_smooth(px)[0])


def edited(px: np.ndarray, k: int) -> np.ndarray:
    """``px`` cropped at the side that ``k`` names, turned a quarter for odd ``k``, and with less contrast."""
    h, w = px.shape
    part = px[(k % 5) * h // 40 : h - (k % 3) * h // 40, (k % 7) * w // 56 :]
    return np.rint(np.rot90(part, k % 2) * 0.8 + 30)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, files = [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            px = render(np.array(v, np.float32))
            ids += [i, -1 - i]
            files += [pgm(px), pgm(edited(px, i))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], names=["image_id", "image"])


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so every embedding is drawn twice: as a picture (of its id) and
    as a cropped, turned and edited copy (the id's complement, so that no picture is near its copy in any order). All pictures are searched together;
    each comes with its class of copies, as many copies make far more pairs."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    return classes(spark, e.repartition("vec_id").mapInArrow(_rendered, "image_id bigint, image binary"))
