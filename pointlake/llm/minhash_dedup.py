"""Near-duplicate search: one-permutation MinHash with optimal densification.

* Each text's word 3-shingles are hashed once; the high bits of a hash name one of
  ``BINS`` bins, which keeps the least rest. An empty bin copies the bin that its own
  sequence of universal hashes meets first (Shrivastava, 2017), so all bins count.
* Equal signatures collapse to their least id. The others fall into ``BANDS`` buckets.
* A bucket of n first proposes n - 1 edges, a star around its least id. Edges are verified
  with whole signatures.
* Where a centre doesn't match some members, these may still match others of their bucket. Up to ``CLOSE`` members
  are compared within a task. A larger bucket is split into overlapping ones, in which stars are drawn again: its
  members fall into a bucket for each bin that they don't all share. Two signatures that agree in ``THRESHOLD`` of
  their bins share such a bin until they share all that are needed, so no link is lost; sets of members that
  come about more than once are kept once. What is still larger after ``SPLITS`` splits is compared within a task.
* Groups are the connected components of the verified edges (large-star, small-star).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, c, documents, fresh, materialise, mix, small, text_chunks

SHINGLE = 3
BINS = 128
BANDS = 32
THRESHOLD = 0.55
#: Members of a bucket that are compared within a task, and how often a larger one is split.
CLOSE, SPLITS = 16_384, 3
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: Words, data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``k`` words; of all words, where a text has fewer."""
    h, _, _, at = words(data, offs)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    m = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    if len(h) == 0:
        return doc, h
    acc = h * m[0]
    for j in range(1, k):
        acc[:-j] += h[j:] * m[j] if j < len(h) else 0
    pos = np.arange(len(h)) - at[:-1][doc]
    whole = pos + k <= n[doc]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([sum(int(h[at[d] + j]) * int(m[j]) for j in range(n[d])) + int(n[d]) & 0xFFFFFFFFFFFFFFFF for d in short], np.uint64)
        return np.concatenate([doc[whole], short]), mix(np.concatenate([acc[whole], extra]))
    return doc[whole], mix(acc[whole])


def densified(least: np.ndarray) -> np.ndarray:
    """Fill the empty bins of signatures that have at least one full bin."""
    bins = least.shape[1]
    row, col = np.nonzero(least == _EMPTY)
    out, turn = least.copy(), 0
    while len(row):
        turn += 1
        probe = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)
        found = least[row, probe[col]]
        ok = found != _EMPTY
        out[row[ok], col[ok]] = found[ok]
        row, col = row[~ok], col[~ok]
    return out


def signatures(words: Words, data: np.ndarray, offs: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(text, 16-bit signature) of the texts that have words."""
    doc, h = shingles(words, data, offs)
    has, row = np.unique(doc, return_inverse=True)
    if not len(has):
        return has, np.zeros((0, bins), np.uint16)
    shift = np.uint64(65 - int(bins).bit_length())
    least = np.full(len(has) * bins, _EMPTY)
    np.minimum.at(least, row * bins + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    return has, (mix(densified(least.reshape(-1, bins))) >> np.uint64(48)).astype(np.uint16)


def _sign(key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi, data, offs in text_chunks(texts):
                has, sig = signatures(words, data, offs)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(has)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "sig"])

    return run


def _hashed(part: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of the last axis of ``part``, from ``seed`` on."""
    h = np.broadcast_to(seed, part.shape[:-1])
    for j in range(part.shape[-1]):
        h = mix(h + part[..., j] + np.uint64(0x9E3779B97F4A7C15))
    return h


def _bands(bands: int):
    """(bucket, id) for each band of each signature; the bucket modulo ``bands`` is the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column(1))
            rows = sig.shape[1] // bands
            nth = np.arange(bands, dtype=np.uint64)
            h = _hashed(sig[:, : rows * bands].reshape(len(sig), bands, rows).astype(np.uint64), mix(nth + np.uint64(1)))
            h = h - h % np.uint64(bands) + nth
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), bands))], names=["bucket", "id"])

    return run


def _split(bands: int):
    """Rows (bucket, id, signature, ok, shared): a row for each bin that the bucket's members don't all share, with
    those they do, as 16 bytes of bits. Null stands for the bins of the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                sig, bucket = _matrix(b.column(2)), b.column(0).to_numpy().view(np.uint64)
                bins = np.arange(sig.shape[1])
                shared = bins[None] // (sig.shape[1] // bands) == (bucket % np.uint64(bands)).astype(np.int64)[:, None]
                known = b.column(4).is_valid().to_numpy(zero_copy_only=False)
                if known.any():
                    shared[known] = np.unpackbits(np.frombuffer(b"".join(b.column(4).drop_null().to_pylist()), np.uint8).reshape(-1, sig.shape[1] // 8), 1).astype(bool)
                i, j = np.nonzero(~shared)
                h = _hashed(sig[i, j, None].astype(np.uint64), mix(bucket[i] + mix(j.astype(np.uint64))))
                now = np.packbits(shared, 1)[i]
                now[np.arange(len(i)), j // 8] |= (128 >> j % 8).astype(np.uint8)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(1).take(take), b.column(3).take(take), pa.array([x.tobytes() for x in now], pa.binary())], names=["bucket", "id", "ok", "shared"])

    return run


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), -1)


def _agree(threshold: float):
    """Keep the pairs whose signatures agree; ``ok`` says which do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same >= threshold)], names=["id", "centre", "ok"])

    return run


def _links(sigs: np.ndarray, joined: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that join all rows of ``sigs`` whose pairs agree; those in ``joined`` are joined already.

    A row that isn't in ``joined`` is compared with every row outside its component, so each pair of rows
    either is verified or lies in one component."""
    part, out = np.arange(len(sigs)), []
    part[joined] = -1
    for i in np.flatnonzero(~joined).tolist():
        other = np.flatnonzero(part != part[i])
        for lo in range(0, len(other), 4096):
            some = other[lo : lo + 4096]
            hits = some[np.count_nonzero(sigs[some] == sigs[i], 1) / sigs.shape[1] >= threshold]
            for j in hits.tolist():
                if part[j] != part[i]:
                    out.append((i, j))
                    part[part == part[j]] = part[i]
    return out


def _more_links(threshold: float):
    """Rows (bucket, id, signature, joined to the centre) in order: the edges that close each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            links = np.array(_links(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), threshold), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids[links[:, 0]]), pa.array(ids[links[:, 1]])], names=["a", "b"])

        at, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            bucket, ids, sigs, joined = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)), b.column(3).to_numpy(zero_copy_only=False)
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if held and bucket[lo] != at:
                    yield closed()
                    held = []
                at = bucket[lo]
                held.append((ids[lo:hi], sigs[lo:hi], joined[lo:hi]))
        if held:
            yield closed()

    return run


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b), root being the least id of its
    component. Alternates large-star and small-star; each round is a written table, and
    the loop ends when a round changes nothing."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # neighbours in both directions
            e = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        else:  # from each node to its smaller neighbours
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = e.join(m, "a")
        if large:
            out = e.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = e.select(F.col("b").alias("a"), F.col("m").alias("b")).union(e.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = materialise(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        e = materialise(spark, star(star(e, True), False), "round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, dup_of): every document that isn't the least id of its group, and that id.

    Two documents are linked when their signatures put the Jaccard similarity of their
    3-shingles at ``threshold`` or more; groups are closed under links. A document is its
    id, which may be of any type with an order: repeated rows of an id count once (with the least signature), and rows
    with a null id, or with a null, empty or wordless text, are in no group. A text of fewer
    than three words has one shingle, and a text of any length is signed whole. An empty table gives an empty one; further columns
    are ignored.
    """
    kind = docs.schema[key].dataType
    signed = docs.where(c(key).isNotNull() & c(text).isNotNull()).select(c(key), c(text)).mapInArrow(_sign(key, text), f"id {kind.simpleString()}, sig binary")
    if isinstance(kind, T.IntegralType):
        return _grouped(spark, signed.withColumn("id", F.col("id").cast("bigint")), bands, threshold).select(F.col("id").cast(kind).alias("doc_id"), F.col("root").cast(kind).alias("dup_of"))
    # keys of any other type are numbered in their order
    signed = materialise(spark, signed, "signed")
    numbers = materialise(spark, signed.select(F.col("id").alias("name")).distinct().orderBy("name").withColumn("n", F.monotonically_increasing_id()), "numbers")
    out = _grouped(spark, signed.join(numbers, F.col("id") == F.col("name")).select(F.col("n").alias("id"), "sig"), bands, threshold)
    of = lambda x: numbers.select(F.col("name").alias(x), F.col("n").alias(f"n_{x}"))
    return out.join(of("doc_id"), F.col("id") == F.col("n_doc_id")).join(of("dup_of"), F.col("root") == F.col("n_dup_of")).select("doc_id", "dup_of")


def _grouped(spark: SparkSession, signed: DataFrame, bands: int, threshold: float, close: int | None = None) -> DataFrame:
    """(id, root) of the rows (id, signature) that aren't the least of their group."""
    close = CLOSE if close is None else close
    signed = materialise(spark, signed, "signatures")
    # a minimum is combined before the shuffle, and joins split a hot key's rows: no group
    # of copies, however large, is ever one row or one task
    first = materialise(spark, signed.groupBy("sig").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    edges = signed.join(first.where("n > 1").select("sig", F.col("id").alias("b")), "sig").select(F.col("id").alias("a"), "b")
    sigs = first.select("id", "sig")
    one = sigs.groupBy("id").agg(F.min("sig").alias("sig"))
    members, shared = sigs.mapInArrow(_bands(bands), "bucket bigint, id bigint"), []
    for left in range(SPLITS, -1, -1):
        centres = members.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n"), *[F.first(x).alias(x) for x in shared]).where("n > 1")
        stars = materialise(spark, members.select("bucket", "id").join(centres.select("bucket", "centre"), "bucket").where("id <> centre"), "stars")
        both = stars.select("id", "centre").distinct().join(one, "id").join(one.select(F.col("id").alias("centre"), F.col("sig").alias("sig2")), "centre").select("id", "centre", "sig", "sig2")
        tried = materialise(spark, both.mapInArrow(_agree(threshold), "id bigint, centre bigint, ok boolean"), "tried")
        edges = edges.union(tried.where("ok").select("id", "centre"))
        # what its centre doesn't match is compared with the rest of its bucket, matched members too
        judged = materialise(spark, stars.join(tried, ["id", "centre"]).select("bucket", "id", "ok"), "judged")
        open_ = materialise(spark, centres.join(judged.where("not ok").select("bucket").distinct(), "bucket"), "open")
        if open_.isEmpty():
            break
        both = judged.union(open_.select("bucket", F.col("centre").alias("id"), F.lit(True).alias("ok")))
        few = both.join(open_.where(F.col("n") <= close).select("bucket") if left else open_.select("bucket"), "bucket").join(one, "id")
        few = few.select("bucket", "id", "sig", "ok").repartition("bucket").sortWithinPartitions("bucket", "id")
        edges = edges.union(materialise(spark, few.mapInArrow(_more_links(threshold), "a bigint, b bigint"), "links"))
        large = open_.where(F.col("n") > close).select("bucket", *(shared or [F.lit(None).cast("binary").alias("shared")]))
        if not left or large.isEmpty():
            break
        many = both.join(large, "bucket").join(one, "id").select("bucket", "id", "sig", "ok", "shared")
        parts = materialise(spark, many.mapInArrow(_split(bands), "bucket bigint, id bigint, ok boolean, shared binary"), "parts")
        # a part in which all match the centre of the whole bucket has nothing to add
        sets = parts.groupBy("bucket").agg(F.count("*").alias("size"), F.bool_and("ok").alias("done"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("which"), F.first("shared").alias("shared")).where("size > 1 and not done")
        halves = [F.conv(F.hex(F.substring("shared", k, 8)), 16, -10).cast("bigint") for k in (1, 9)]
        kept = sets.groupBy("size", "which").agg(F.min("bucket").alias("bucket"), *[F.bit_or(x).alias(f"s{k}") for k, x in enumerate(halves)])
        kept = kept.select("bucket", F.unhex(F.concat(*[F.lpad(F.hex(f"s{k}"), 16, "0") for k in (0, 1)])).alias("shared"))
        members, shared = materialise(spark, parts.drop("shared").join(kept, "bucket").select("bucket", "id", "shared"), "members"), ["shared"]
    return components(spark, edges)


def keep_one(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` doesn't report, all columns kept, whatever their names.
    Rows with a null id or a null, empty or wordless text stay, as do repeated rows of an id that stays."""
    (g,) = fresh(docs, "gone")
    gone = near_duplicates(spark, docs, text, key, bands, threshold).select(F.col("doc_id").alias(g))
    return docs.join(small(materialise(spark, gone, "gone"), 16), c(key) == c(g), "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir))
