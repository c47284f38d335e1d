"""Text embeddings fitted to a corpus: BM25, TF-IDF, bag of words, character n-grams, SVD.

Fitting is grouped aggregation over the whole table; what is kept is a vocabulary of at most
``dimension`` terms. Embedding uses it row by row in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import json
import math
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, UnsupportedProvider
from ..functions import text as tx
from .search import top_rows


#: Texts embedded at a time, texts taken from a batch at a time, and terms that a task counts before it passes them on.
BLOCK, READ, HELD_TERMS = 1024, 128, 1 << 17


class Embedder(ABC):
    """What a provider offers. A user's own needs ``embed`` and ``dimension``."""

    dimension: int

    @abstractmethod
    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def fit(self, df: DataFrame, text: str = "text") -> None:
        return None

    def add_document(self, text: str) -> None:
        return None

    def export_state(self) -> bytes:
        return b""

    def import_state(self, state: bytes) -> None:
        return None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """Texts of the first column that aren't null; few are strings at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, READ):
            yield from b.column(0).slice(lo, READ).drop_null().to_pylist()


def _counts(tokens: Callable[[str], list[str]], terms: bool):
    """Rows (text): (term, occurrences, texts), and for the null term (all tokens, all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cf, df = Counter(), Counter()
        n = length = 0

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None, *cf], pa.string()), pa.array([length, *cf.values()], pa.int64()), pa.array([n, *(df[t] for t in cf)], pa.int64())], names=["term", "cf", "df"])

        for t in _read(batches):
            toks = tokens(t)
            n, length = n + 1, length + len(toks)
            if terms:
                cf.update(toks)
                df.update(set(toks))
            if len(cf) > HELD_TERMS:
                yield held()
                cf.clear(), df.clear()
                n = length = 0
        if n:
            yield held()

    return run


class Lexical(Embedder):
    """Shared part: tokens, vocabulary, weights."""

    name = ""
    #: Whether the vocabulary is chosen by inverse document frequency, and whether tokens count in place of texts.
    by_idf = counts_tokens = False

    def __init__(self, dimension: int):
        self.dimension = dimension
        self.terms: dict[str, int] = {}
        self.df: list[int] = []
        self.n_docs, self.mean_length = 0, 0.0

    def py_tokens(self, text: str) -> list[str]:
        return tx.py_words_any(text)

    def order(self) -> list[Column]:
        return [F.col("cf").desc(), F.col("term").asc()]

    def counted(self, df: DataFrame, text: str = "text", terms: bool = True) -> DataFrame:
        """(term, cf, df) of all terms, and in the row of the null term the tokens and the number of texts. Texts are
        read once; tasks count before anything is shuffled."""
        part = df.select(F.col(text)).mapInArrow(_counts(self.py_tokens, terms), "term string, cf bigint, df bigint")
        return part.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))

    def vocabulary(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(term, cf, df) of the ``dimension`` best terms: one grouped count, then a top-k."""
        return self.counted(df, text).where("term is not null").orderBy(*self.order()).limit(self.dimension)

    def stats(self, df: DataFrame, text: str = "text") -> DataFrame:
        """One row (n_docs, mean_length)."""
        n = self.counted(df, text, False).agg(F.coalesce(F.sum("df"), F.lit(0).cast("bigint")).alias("n_docs"), F.sum("cf").alias("tokens"))
        return n.select("n_docs", F.coalesce(F.try_divide("tokens", "n_docs"), F.lit(0.0)).alias("mean_length"))

    def fit(self, df: DataFrame, text: str = "text") -> None:
        if self.by_idf:
            self.n_docs = df.where(F.col(text).isNotNull()).count()
        # the row of totals, and at most ``dimension`` terms
        rows = self.counted(df, text).orderBy(F.col("term").isNull().desc(), *self.order()).limit(self.dimension + 1).collect()
        n, length = next(((r["df"], r["cf"]) for r in rows if r["term"] is None), (0, 0))
        self.n_docs, self.mean_length = n, length / n if n else 0.0
        rows = [r for r in rows if r["term"] is not None][: self.dimension]
        self.terms = {r["term"]: i for i, r in enumerate(rows)}
        self.df = [r["cf" if self.counts_tokens else "df"] for r in rows]

    def add_document(self, text: str) -> None:
        """New terms join, in order, while there is room; no place ever changes."""
        toks = self.py_tokens(text)
        self.mean_length = (self.mean_length * self.n_docs + len(toks)) / (self.n_docs + 1)
        self.n_docs += 1
        for t in sorted(set(toks)):
            if t in self.terms:
                self.df[self.terms[t]] += 1
            elif len(self.terms) < self.dimension:
                self.terms[t] = len(self.terms)
                self.df.append(1)

    def weights(self, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Weights from counts (texts x terms) and the number of tokens of each text."""
        return count

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Embeddings of texts as rows, of unit length or 0."""
        out = np.zeros((len(texts), self.dimension))
        get, k = self.terms.get, max(1, len(self.terms))
        for lo in range(0, len(texts), BLOCK):
            some = texts[lo : lo + BLOCK]
            length, count = np.zeros(len(some)), np.zeros((len(some), k), np.int64)
            for i, t in enumerate(some):  # the tokens of one text at a time
                toks = self.py_tokens(t)
                length[i] = len(toks)
                place = np.fromiter(map(get, toks, repeat(-1)), np.int64, len(toks))
                count[i] = np.bincount(place + 1, minlength=k + 1)[1:]
            if self.terms:
                w = self.weights(count, length[:, None])
                norm = np.sqrt((w * w).sum(1, keepdims=True))
                out[lo : lo + len(some), :k] = w / np.where(norm > 0, norm, 1)
        return out

    def embed(self, text: str) -> list[float]:
        return self.matrix([text])[0].astype(np.float32).tolist()

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return self.matrix(texts).astype(np.float32).tolist()

    def embed_column(self, text: Column) -> Column:
        """Vectors of a text column; null for null."""

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                known = s.dropna()
                parts = [self.matrix(known.iloc[lo : lo + BLOCK].tolist()).astype(np.float32) for lo in range(0, len(known), BLOCK)]
                yield pd.Series([v for m in parts for v in m], known.index, object).reindex(s.index)

        return run(text)

    def export_state(self) -> bytes:
        return json.dumps({"type": self.name, "terms": list(self.terms), "df": self.df, "n_docs": self.n_docs, "mean_length": self.mean_length}).encode()

    def import_state(self, state: bytes) -> None:
        s = json.loads(state)
        self.terms = {t: i for i, t in enumerate(s["terms"])}
        self.df, self.n_docs, self.mean_length = s["df"], s["n_docs"], s["mean_length"]


class Bm25(Lexical):
    name, k1, b = "bm25", 1.5, 0.75

    def weights(self, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        df = np.array(self.df, np.float64)
        idf = np.log((self.n_docs - df + 0.5) / (df + 0.5) + 1)
        return idf * count * (self.k1 + 1) / (count + self.k1 * (1 - self.b + self.b * length / (self.mean_length or 1.0)))


class TfIdf(Lexical):
    name, by_idf = "tfidf", True

    def py_tokens(self, text: str) -> list[str]:
        return tx.py_words_long(text)

    def order(self) -> list[Column]:
        idf = F.greatest(F.lit(0.0), F.log(F.lit(float(max(1, self.n_docs))) / F.col("df")))
        return [(F.col("cf") * idf).desc(), F.col("term").asc()]

    def weights(self, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not self.n_docs:
            return np.zeros(count.shape)
        return count / np.maximum(1, length) * np.maximum(0.0, np.log(self.n_docs / np.array(self.df, np.float64)))


class BagOfWords(Lexical):
    name, counts_tokens = "bow", True
    py_tokens = TfIdf.py_tokens


class CharNgram(Lexical):
    name, counts_tokens = "char_ngram", True

    def __init__(self, dimension: int, n: int = 3):
        super().__init__(dimension)
        self.n = n

    def py_tokens(self, text: str) -> list[str]:
        return tx.py_char_ngrams(text, self.n)


class Svd(TfIdf):
    """TF-IDF of ``WIDTH`` terms projected on orthonormal pseudo-random rows seeded by the vocabulary.
    Until fitted every vector is 0; vectors aren't brought to unit length."""

    name, WIDTH = "svd", 512

    def __init__(self, dimension: int):
        super().__init__(self.WIDTH)
        self.out, self.axes = dimension, None

    def fit(self, df: DataFrame, text: str = "text") -> None:
        super().fit(df, text)
        self._project()

    def import_state(self, state: bytes) -> None:
        super().import_state(state)
        self._project()

    def _project(self) -> None:
        import zlib

        rng = np.random.default_rng(zlib.crc32("\0".join(self.terms).encode()))
        q, _ = np.linalg.qr(rng.uniform(-1, 1, (self.WIDTH, max(1, min(self.out, self.WIDTH)))))
        self.axes = np.pad(q, [(0, 0), (0, self.out - q.shape[1])])

    def matrix(self, texts: list[str]) -> np.ndarray:
        if self.axes is None:
            return np.zeros((len(texts), self.out))
        return super().matrix(texts) @ self.axes


class Onnx(Embedder):
    """A sentence model from a folder with ``model.onnx`` and ``tokenizer.json``, mean pooled."""

    def __init__(self, folder: str, dimension: int):
        import os

        import onnxruntime
        from tokenizers import Tokenizer

        if not os.path.exists(f"{folder}/model.onnx"):
            raise UnsupportedProvider(f"no model.onnx in {folder}")
        self.dimension, self.folder = dimension, folder
        self.session = onnxruntime.InferenceSession(f"{folder}/model.onnx")
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")

    def embed(self, text: str) -> list[float]:
        e = self.tokenizer.encode(text)
        have = {i.name for i in self.session.get_inputs()}
        feed = {"input_ids": e.ids, "attention_mask": e.attention_mask, "token_type_ids": e.type_ids}
        out = self.session.run(None, {k: np.array([v], np.int64) for k, v in feed.items() if k in have})[0][0]
        v = np.asarray(out, np.float64).mean(0)
        if len(v) != self.dimension:
            raise InvalidArgument(f"the model has dimension {len(v)}")
        n = math.sqrt(float(v @ v))
        return (v / n if n else v).astype(np.float32).tolist()


PROVIDERS = {x.name: x for x in (Bm25, TfIdf, BagOfWords, CharNgram, Svd)}


def build_provider(name: str, dimension: int) -> Embedder:
    if name in PROVIDERS:
        return PROVIDERS[name](dimension)
    if name.startswith("fastembed:path:"):
        return Onnx(name.split(":", 2)[2], dimension)
    raise UnsupportedProvider(f"{name!r}; there are {', '.join(available_providers())}")


def available_providers() -> list[str]:
    return sorted(PROVIDERS)


def _nearest(embedder: Lexical, q: np.ndarray, k: int):
    """Rows (id, slot, text): (id, slot, score) of the best ``k`` of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, BLOCK) for x in batches for lo in range(0, x.num_rows, BLOCK)):
            b = b.filter(b.column(2).is_valid())
            if b.num_rows:
                s = np.clip(embedder.matrix(b.column(2).to_pylist()) @ q, -1.0, 1.0).astype(np.float32)
                best = pa.array(top_rows(-s, b.column(1), k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(best), b.column(1).take(best), pa.array(s).take(best)], names=["id", "slot", "score"])

    return run


def text_search(df: DataFrame, embedder: Lexical, query: str, k: int = 10, id: str = "id", text: str = "text", slot: str | None = None) -> DataFrame:
    """(id, slot, score): cosine of embedded texts and query, the best ``k`` by score, then slot; nothing for a query
    without known terms. Texts are embedded and scored where they are read; ``k`` rows of a batch go on."""
    q = embedder.matrix([query])[0]
    rows = df.select(F.col(id).alias("id"), F.col(slot or id).alias("slot"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)
    if not q.any():
        return rows.select("id", "slot", F.lit(0.0).cast("float").alias("score")).limit(0)
    near = rows.mapInArrow(_nearest(embedder, q, k), f"id {kinds['id']}, slot {kinds['slot']}, score float")
    return near.orderBy(F.col("score").desc(), "slot").limit(k)
