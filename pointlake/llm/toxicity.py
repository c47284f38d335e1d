"""Toxicity by compression distance between two zstandard dictionaries.

1. All labelled documents are dealt into ``PARTS`` parts by hash. Of near copies of a class the one of least hash speaks for all.
2. They give two raw-content dictionaries. Both begin with the same ordinary
   text, so whatever both classes share compresses alike; each ends with the pieces of words
   whose presence is significant for its class, filled up with ordinary text. (The
   library's own trainer spends both dictionaries on what the classes share.) A piece is significant if it deviates
   more than any word does when the labels are dealt at random, so the bar follows the number of documents. Documents with
   a word, or a piece of one, are counted by the executors, one shuffle for the words and one for the pieces.
3. A text's words, in lower case with single blanks between, are cut into overlapping
   windows. Each is compressed with either dictionary. Differences in length get the logarithm of how much
   likelier they are in a toxic document. A document scores the largest sum over a run of its
   windows, so that ordinary text elsewhere can't cancel a passage; beyond the usual number
   of windows, the logarithm of their excess is taken off, as chance has more runs to choose from.
4. The logarithms, and the threshold that leaves a share ``FALSE_ALARMS`` of the ordinary documents above it, come
   from all of them: each part is judged with dictionaries made of the others.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import c, documents, materialise, mix, small, text_chunks

PARTS = 3
#: Bytes of ordinary text in a dictionary, taken in chunks of so many words from anywhere in the texts.
BASE_BYTES, CHUNK = 500_000, 64
LEVEL, WINDOW, STEP = 3, 6, 4
#: Ratio of the shares of documents that hold it from which a piece is typical; random labellings that set the bar,
#: and the margin above them.
RATIO, SHUFFLES, MARGIN = 8.0, 20, 1.2
#: Words that a task counts before it hands them on.
TASK_WORDS = 100_000
#: Least and most bytes of a piece.
PIECE = (5, 14)
FALSE_ALARMS = 0.01
#: Differences in length are told apart up to this many bytes, more than a window of ordinary words has.
MOST = 64

_LUT = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _LUT[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place of the blank before each word and of the last blank, first word of
    each text and the number of words)."""
    low = _LUT[data]
    word = low != 32
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    start[first] = word[first]
    nth = np.cumsum(start)
    body = np.flatnonzero(word)
    out = np.full(len(body) + int(nth[-1] if len(nth) else 0) + 1, 32, np.uint8)
    out[np.arange(len(body)) + nth[body]] = low[body]
    starts = np.flatnonzero(start)
    before = np.cumsum(word)[starts] - 1 + np.arange(len(starts))
    return out, np.append(before, len(out) - 1), np.searchsorted(starts, offs)


def windows(data: np.ndarray, offs: np.ndarray, size: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each window, text of each)."""
    out, blank, at = normalise(data, offs)
    n = np.diff(at)
    m = np.where(n > 0, np.maximum(0, -(-(n - size) // step)) + 1, 0)
    text = np.repeat(np.arange(len(n)), m)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(m) - m, m)
    lo = at[:-1][text] + nth * step
    hi = np.minimum(lo + size, at[1:][text])
    return out, blank[lo], blank[hi] + 1, text


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def differences(ordinary, toxic, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that the toxic dictionary saves on each window, within +-``MOST``; its text)."""
    out, lo, hi, text = windows(data, offs)
    raw, a, b = memoryview(out), ordinary.compress, toxic.compress
    d = np.fromiter((len(a(raw[i:j])) - len(b(raw[i:j])) for i, j in zip(lo.tolist(), hi.tolist())), np.int64, len(lo))
    return np.clip(d, -MOST, MOST), text


def _deviation(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Squared deviation, in variances, of the shares a / n and b / m from each other; 0 unless the first is
    ``RATIO`` times the second."""
    if not n or not m:
        return np.zeros(len(a))
    p = (a + b) / (n + m)
    var = p * (1 - p) * (1 / n + 1 / m)
    out = np.divide((a / n - b / m) ** 2, var, out=np.zeros(len(p)), where=var > 0)
    return np.where((a / n > RATIO * (b + 0.5) / m) & (a > 2), out, 0.0)


def _words(text: pa.Scalar) -> list[bytes]:
    data = np.frombuffer(text.as_buffer(), np.uint8)
    return normalise(data, np.array([0, len(data)]))[0].tobytes().split()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic, ...): the rest, three keys of which near copies share one, and the size."""
    for b in batches:
        keys, size = [], []
        for t, y in zip(b.column(0), b.column(1).to_pylist()):
            words = _words(t)
            runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
            keys.append([min(zlib.crc32(x, k) for x in runs) | k << 32 | y << 34 for k in (1, 2, 3)])
            size.append(sum(map(len, words)) + len(words))
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(keys, pa.list_(pa.int64())), pa.array(size, pa.int64())], names=[*b.schema.names[1:], "keys", "size"])


def originals(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(n): of ``rows`` (n, u, h, keys), in order of (u, h, n), each that shares no key with one taken before it. A round takes those that
    are the first of all their keys; what shares a key with them is gone."""
    left, out = rows.select("n", "u", "h", F.explode(F.array_distinct("keys")).alias("key"), F.size(F.array_distinct("keys")).alias("of")), []
    while not (left := materialise(spark, left, "left")).isEmpty():
        first = left.groupBy("key").agg(F.min(F.struct("u", "h", "n", "of")).alias("r"))
        out.append(now := materialise(spark, first.groupBy("r.n", "r.of").agg(F.count("*").alias("firsts")).where(F.col("firsts") == F.col("of")).select("n"), "originals"))
        gone = left.join(left.join(now, "n").select("key").distinct(), "key").select("n").distinct()
        left = left.join(gone, "n", "left_anti")
    return reduce(DataFrame.union, out) if out else rows.select("n")


def deals(u: np.ndarray, rate: float) -> np.ndarray:
    """Labels dealt at random at a rate: (documents, ``SHUFFLES``) booleans, that depend on ``u``."""
    x = mix(u.astype(np.int64).view(np.uint64)[:, None] ^ mix(np.arange(1, SHUFFLES + 1, dtype=np.uint64)))
    return (x >> np.uint64(11)).astype(float) / (1 << 53) < rate


def _marks(toxic: np.ndarray, u: np.ndarray, rate: float) -> np.ndarray:
    """(documents, 2 + ``SHUFFLES``): counted; toxic; toxic as dealt."""
    return np.column_stack([np.ones(len(u), bool), toxic.astype(bool), deals(u, rate)])


def _documents_dealt(rate: float):
    """Rows (toxic, u, part): documents of each part by mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, 2 + SHUFFLES), np.int64)
        for b in batches:
            y, u, part = (x.to_numpy() for x in b.columns)
            np.add.at(total, part, _marks(y, u, rate))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["k", "n"])

    return run


def _held(batch: pa.RecordBatch, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words of each text of the first column, as numbers; its row)."""
    found = [np.fromiter((number.setdefault(w, len(number)) for w in set(_words(t))), np.int64) for t in batch.column(0)]
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.repeat(np.arange(len(found)), [len(x) for x in found])


def _counted(rate: float):
    """Rows (text, toxic, u, part): words, and documents that hold them by part and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            cols = np.ascontiguousarray(total[: len(number)].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(list(number), pa.binary()), pa.array([x.tobytes() for x in cols], pa.binary())], names=["word", "n"])

        number, total = {}, np.zeros((0, PARTS * (2 + SHUFFLES)), np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                y, u, part = (x.to_numpy() for x in b.columns[1:])
                flat, doc = _held(b, number)
                if len(number) > len(total):
                    total = np.concatenate([total, np.zeros((max(len(number), 2 * len(total)) - len(total), total.shape[1]), np.int32)])
                mark, top = _marks(y, u, rate), int(flat.max(initial=-1)) + 1
                for k in range(mark.shape[1]):
                    on = mark[doc, k]
                    got = np.bincount(flat[on] * PARTS + part[doc[on]], minlength=top * PARTS).reshape(top, PARTS)
                    total[:top, k::mark.shape[1]] += got.astype(np.int32)
                if len(number) > TASK_WORDS:
                    yield made()
                    number, total = {}, np.zeros((0, PARTS * (2 + SHUFFLES)), np.int32)
        if number:
            yield made()

    return run


def _models(n: np.ndarray) -> np.ndarray:
    """Of counts (parts, ...), those of each model: without each part, and of all."""
    return np.concatenate([n.sum(0) - n, n.sum(0)[None]])


def _sides(n: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """Deviations towards the ordinary and the toxic class, from (counted, toxic) of what is counted and of all documents."""
    y, z = n[..., 1], n[..., 0] - n[..., 1]
    return [_deviation(z, docs[0] - docs[1], y, docs[1]), _deviation(y, docs[1], z, docs[0] - docs[1])]


def _deviating(docs: np.ndarray):
    """Rows (word, counts), all of a word in one task: words and their deviations by model and class, if any is above 0; and without a word,
    by model, the largest deviation towards a class that was dealt at random. ``docs`` has the documents by model and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[bytes, int] = {}
        total = np.zeros((0, PARTS * (2 + SHUFFLES)), np.int64)
        for b in batches:
            x = np.array([at.setdefault(w, len(at)) for w in b.column(0).to_pylist()], np.int64)
            if len(at) > len(total):
                total = np.concatenate([total, np.zeros((max(len(at), 2 * len(total)) - len(total), total.shape[1]), np.int64)])
            np.add.at(total, x, np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32).reshape(len(x), -1))
        if not at:
            return
        n = _models(total[: len(at)].reshape(len(at), PARTS, -1).transpose(1, 0, 2))
        real = np.stack([d for k in range(PARTS + 1) for d in _sides(n[k], docs[k])], 1)
        bars = [max(float(_deviation(n[k, :, s], docs[k, s], n[k, :, 0] - n[k, :, s], docs[k, 0] - docs[k, s]).max(initial=0)) for s in range(2, 2 + SHUFFLES)) for k in range(PARTS + 1)]
        words, some = list(at), np.flatnonzero(real.max(1) > 0)
        rows = [real[i].tolist() for i in some] + [bars]
        yield pa.RecordBatch.from_arrays([pa.array([*(words[i] for i in some), None], pa.binary()), pa.array(rows, pa.list_(pa.float64()))], names=["word", "z"])

    return run


def pieces_of(words: list[bytes]) -> dict[bytes, set[bytes]]:
    """Pieces of words, blanks at their edges included, and the words that hold each."""
    out: dict[bytes, set[bytes]] = {}
    for word in words:
        w = b" " + word + b" "
        for x in {w[i : i + j] for j in range(PIECE[0], PIECE[1] + 1) for i in range(len(w) - j + 1)} or {w}:
            out.setdefault(x, set()).add(word)
    return out


def _pieces_counted(sent, cutoff: int):
    """Rows (text, toxic, part): the places of pieces, with documents that hold them by part and class; and chunks of
    ordinary text whose hash is below ``cutoff``, with hash and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        find = ahocorasick.Automaton()
        for k, x in enumerate(pieces):
            find.add_word(x.decode("latin-1"), k)
        if pieces:
            find.make_automaton()
        number, held = {}, []
        total = np.zeros((len(pieces), PARTS * 2), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                y, part = (x.to_numpy() for x in b.columns[1:])
                chunks = []
                for t, toxic, p in zip(b.column(0), y.tolist(), part.tolist()):
                    words = [] if toxic else _words(t)
                    for i in range(0, len(words), CHUNK):
                        piece = b" " + b" ".join(words[i : i + CHUNK])
                        if (h := zlib.crc32(piece)) < cutoff:
                            chunks.append((p, h, piece))
                if chunks:
                    p, h, x = zip(*chunks)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(h, pa.int64()), pa.array(x, pa.binary()), pa.nulls(len(p), pa.list_(pa.int64()))], names=["k", "hash", "chunk", "n"])
                if not pieces:
                    continue
                if len(number) > TASK_WORDS:
                    number, held = {}, []
                flat, doc = _held(b, number)
                for w in list(number)[len(held) :]:
                    held.append(sorted({k for _, k in find.iter(f" {w.decode('latin-1')} ")}))
                some = [(d, k) for w, d in zip(flat.tolist(), doc.tolist()) for k in held[w]]
                if some:
                    d, k = np.unique(np.array(some), axis=0).T
                    np.add.at(total, (k, part[d] * 2 + y[d]), 1)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["k", "hash", "chunk", "n"])

    return run


def passages(pieces: dict[bytes, set[bytes]], weight: dict[bytes, float], bar: float) -> list[bytes]:
    """Pieces whose presence is typical, the most typical first. No piece holds another, and each covers typical words
    that those before it don't."""
    out, covered = [], set()
    for z, _, x in sorted((-weight[x], -len(x), x) for x in pieces if weight[x] > bar):
        if pieces[x] - covered and not any(x in y or y in x for y in out):
            out.append(x)
            covered |= pieces[x]
    return out


def dictionaries(spark: SparkSession, found: DataFrame) -> dict[int, tuple[bytes, bytes, int]]:
    """By model, (ordinary content, toxic content, toxic pieces), from all of ``found`` (text, toxic, u, h, n, part)."""
    signed = materialise(spark, found.select("text", "toxic", "u", "h", "n", "part").mapInArrow(_keys, "toxic int, u bigint, h bigint, n bigint, part int, keys array<bigint>, size bigint"), "keys")
    first = materialise(spark, originals(spark, signed), "first")
    kept = signed.join(small(first, 8), "n")
    size = {(r["part"], r["toxic"]): r for r in kept.groupBy("part", "toxic").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes")).collect()}
    n = np.array([[sum(r["docs"] for (p, y), r in size.items() if p == k and y in of) for of in ((0, 1), (1,))] for k in range(PARTS)])
    if not 0 < n[:, 1].sum() < n[:, 0].sum():
        return {}
    rate = float(n[:, 1].sum() / n[:, 0].sum())
    docs = np.zeros((PARTS, 2 + SHUFFLES), np.int64)
    for k, x in kept.select("toxic", "u", "part").mapInArrow(_documents_dealt(rate), "k bigint, n bigint").groupBy("k").agg(F.sum("n")).collect():
        docs.reshape(-1)[k] = x
    docs = _models(docs)
    own = found.join(small(first, 8), "n")
    words = own.select("text", "toxic", "u", "part").mapInArrow(_counted(rate), "word binary, n binary").repartition("word")
    words = materialise(spark, words.mapInArrow(_deviating(docs), "word binary, z array<double>"), "words")
    bars = [MARGIN * x for x in words.where("word is null").agg(*[F.max(F.get("z", F.lit(k))) for k in range(PARTS + 1)]).first()]
    z = lambda k: F.get("z", F.lit(k)) > bars[k // 2] / 4
    telling = words.where(F.col("word").isNotNull() & reduce(lambda x, y: x | y, [z(k) for k in range(2 * PARTS + 2)])).select("word", F.array(*[z(k) for k in range(2 * PARTS + 2)])).collect()  # significant words only
    telling = sorted((bytes(w), on) for w, on in telling)
    each = [pieces_of([w for w, on in telling if on[k]]) for k in range(2 * PARTS + 2)]
    pieces = sorted(set().union(*each))
    fewest = min((x for x in _models(np.array([[size[k, 0]["bytes"] if (k, 0) in size else 0] for k in range(PARTS)])).reshape(-1) if x), default=0)
    cutoff = (1 << 32) if fewest <= 2 * BASE_BYTES else int((1 << 32) * 2 * BASE_BYTES / fewest)  # twice what fits, so that all of least hash are there
    got = materialise(spark, own.select("text", "toxic", "part").mapInArrow(_pieces_counted(spark.sparkContext.broadcast(pieces), cutoff), "k bigint, hash bigint, chunk binary, n array<bigint>"), "pieces")
    count = np.zeros((len(pieces), PARTS, 2), np.int64)
    for k, *x in got.where("chunk is null").groupBy("k").agg(*[F.sum(F.get("n", F.lit(j))) for j in range(PARTS * 2)]).collect():
        count[k] = np.array(x).reshape(PARTS, 2)
    count = _models(np.stack([count.sum(2), count[..., 1]], 2).transpose(1, 0, 2))
    chunks = sorted((r["hash"], bytes(r["chunk"]), r["k"]) for r in got.where("chunk is not null").select("k", "hash", "chunk").collect())  # a few MB at any size of the input
    out = {}
    for model in range(PARTS + 1):
        if not 0 < docs[model, 1] < docs[model, 0]:
            continue
        sides = [dict(zip(pieces, x)) for x in _sides(count[model], docs[model])]
        tops = [passages(each[2 * model + side], sides[side], bars[model]) for side in (0, 1)]
        tails = [b"".join(x[::-1]) + b" " for x in tops]
        base = [x for _, x, part in chunks if part != model]
        base = base[: int(np.searchsorted(np.cumsum([len(x) for x in base]), BASE_BYTES, "right"))]
        common, longest = b"".join(base), max(map(len, tails))
        out[model] = *(common + common[: longest - len(t)] + t for t in tails), len(tops[1])
    return out


def _differing(sent):
    """Rows (text, toxic, part): the class, and a byte for each window, the difference that dictionaries of the other parts make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [tuple(compressor(x) for x in sent.value[k]) for k in range(PARTS)]
        for whole in batches:
            part = whole.column(2).to_numpy()
            for k in np.unique(part).tolist():
                b = whole.filter(pa.array(part == k))
                for lo, hi, data, offs in text_chunks(b.column(0)):
                    d, text = differences(*pairs[k], data, offs)
                    cut = np.searchsorted(text, np.arange(hi - lo + 1))
                    d = d.astype(np.int8)
                    yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array([d[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], names=["toxic", "d"])

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, differences): windows by class and difference."""
    total = np.zeros((2, 2 * MOST + 1), np.int64)
    for b in batches:
        for y, d in zip(b.column(0).to_pylist(), b.column(1)):
            total[y] += np.bincount(np.frombuffer(d.as_buffer(), np.int8).astype(np.int64) + MOST, minlength=2 * MOST + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["k", "n"])


def _best(llr: np.ndarray):
    """Rows (differences): the best run, and the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [np.frombuffer(x.as_buffer(), np.int8) for x in b.column(0)]
            n = np.array([len(x) for x in d], np.int64)
            points = llr[np.concatenate([*d, np.zeros(0, np.int8)]).astype(np.int64) + MOST]
            yield pa.RecordBatch.from_arrays([pa.array(best_runs(points, np.repeat(np.arange(len(d)), n), len(d))), pa.array(n)], names=["best", "n"])

    return run


def best_runs(points: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The largest sum of ``points`` over a run of windows of each of ``n`` texts; 0 for the empty run."""
    at, out = np.searchsorted(text, np.arange(n + 1)), np.zeros(n)
    for k in np.flatnonzero(np.diff(at)).tolist():
        s = np.cumsum(np.append(0.0, points[at[k] : at[k + 1]]))
        out[k] = (s - np.minimum.accumulate(s)).max()
    return out


def corrected(best: np.ndarray, n_windows: np.ndarray, usual: float) -> np.ndarray:
    """Best runs, less the logarithm of how often the usual number of windows is exceeded."""
    return best - np.log(np.maximum(1.0, n_windows / usual))


def _scored(sent, part: int, llr: np.ndarray, rest: str, usual: float):
    """Rows (text, other): the other, the score, the windows, and those that speak for toxicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (compressor(x) for x in sent.value[part])
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(0)):
                d, text = differences(a, b, data, offs)
                points = llr[d + MOST]
                n = np.bincount(text, minlength=hi - lo)
                cols = [corrected(best_runs(points, text, hi - lo), n, usual), n, np.bincount(text[points > 1], minlength=hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), *(pa.array(x) for x in cols)], names=[rest, "score", "n_windows", "n_telling"])

    return run


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log ratio of each difference's shares, from (2 x differences) windows; smoothed
    towards none, and never in favour of toxicity below 0."""
    whole = counts.sum(0) + 0.01
    prior = 5 * whole / whole.sum()
    p = (counts + prior) / (counts.sum(1, keepdims=True) + 5)
    llr = np.log(p[1] / p[0])
    llr[:MOST] = np.minimum(llr[:MOST], 0)
    return llr


def quantile(spark: SparkSession, rows: DataFrame, share: float) -> float:
    """The quantile of the only column of ``rows``, between two neighbours in proportion, from those above it."""
    rows = materialise(spark, rows.toDF("v"), "values")
    n = rows.count()
    at = (n - 1) * share
    above = n - int(at)
    lo, hi = (rows.orderBy(F.desc("v")).limit(max(1, k)).agg(F.min("v")).first()[0] for k in (above, above - 1))
    return lo + (hi - lo) * (at - int(at))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """(dictionaries, log ratios, usual number of windows, threshold); None without labelled texts of both classes, or
    where nothing tells them apart."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.select(F.col("doc_id").alias("l_id"), "toxic", F.xxhash64("doc_id").alias("u"))
    found = docs.where(c("text").isNotNull() & (c("text") != "")).select(c("doc_id").alias("id"), c("text").alias("text"))
    found = found.join(small(known, 24), F.col("id") == F.col("l_id"))
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(PARTS)).cast("int")
    found = materialise(spark, found.select("text", "toxic", "u", F.xxhash64("text").alias("h"), part.alias("part"), F.monotonically_increasing_id().alias("n")), "labelled")
    fitted = dictionaries(spark, found)
    if PARTS not in fitted or not fitted[PARTS][2]:
        if PARTS in fitted:
            warnings.warn("no piece of a word is typical of the toxic labels; nothing is judged toxic", RuntimeWarning, stacklevel=2)
        return None
    # 1 MB a model at any size of the input
    sent = spark.sparkContext.broadcast([fitted.get(k, fitted[PARTS])[:2] for k in range(PARTS + 1)])
    d = materialise(spark, found.select("text", "toxic", "part").mapInArrow(_differing(sent), "toxic int, d binary"), "differences")
    h = d.mapInArrow(_histogram, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * (2 * MOST + 1))
    counts[h["k"].to_numpy()] = h["n"].to_numpy()
    llr = log_ratios(counts.reshape(2, -1))
    clean = materialise(spark, d.where("toxic = 0").select("d").mapInArrow(_best(llr), "best double, n bigint"), "clean")
    usual = max(1.0, float(clean.agg(F.percentile("n", 0.5)).first()[0]))
    least = quantile(spark, clean.select(F.col("best") - F.log(F.greatest(F.lit(1.0), F.col("n") / usual))), 1 - FALSE_ALARMS)
    return sent, llr, usual, max(least, 1.0)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, n_windows, n_telling, toxic) of every row of ``docs``.

    A null, empty or wordless text has no windows, scores 0 and isn't toxic. Repeated rows
    are judged alike; ids may be null. Labels that are null or of no document don't count;
    an id with both labels counts as toxic. Without labelled texts of both
    classes, or a piece of a word typical of the toxic ones, every score is null and nothing is toxic. Texts of any
    length are judged whole. An empty table gives an empty one;
    further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = train(spark, docs, labels)
    if model is None:
        return docs.select(c("doc_id").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("n_windows"), F.lit(0).cast("bigint").alias("n_telling"), F.lit(False).alias("toxic"))
    sent, llr, usual, least = model
    out = docs.select(c("text"), c("doc_id")).mapInArrow(_scored(sent, PARTS, llr, "doc_id", usual), f"doc_id {kind}, score double, n_windows bigint, n_telling bigint")
    return out.withColumn("toxic", F.col("score") > least)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are judged toxic."""
    return score(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("toxic")
