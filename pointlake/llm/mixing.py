"""Mixing sources to target weights by soft membership.

1. A naive Bayes classifier of hashed words, stems and marks gives each document posteriors
   over domains (``good``, ``plain``, ``toxic``). It is fitted on rows of the label table,
   with the words whose shares differ significantly between domains, and calibrated by
   logistic regression on rows kept out of the fit.
2. Projected gradient least squares finds a rate w >= 0 for each document so that the
   expected tokens of domain k, sum over d of w_d n_d p_dk, meet target_k times the budget:

       minimise  sum_k ((A w)_k - t_k)^2 / t_k   over w >= 0, from w = 1,

   in the metric that weighs a document by its tokens, with Nesterov's momentum, restarted when it overshoots. A step needs one sum over the
   table per iteration: the K residuals. A document's rate follows from its posteriors and
   the residuals so far, so no state is kept by document. Documents with equal posteriors,
   in steps of 1/``GRID``, have equal rates, and the sums run over those.
3. A document comes floor(rate + u) times, u being uniform by its id.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, c, documents, fresh, materialise, text_chunks

DOMAINS = ("good", "plain", "toxic")
TARGETS = {"good": 0.90, "plain": 0.07, "toxic": 0.03}
#: Bound of the labelled rows the classifier is fitted on: those of least hash.
TRAIN_ROWS = 50_000
SLOT_BITS = 18
STEM = 4
GRID, GRID_TASKS = 256, 16
#: Squared deviation, in variances, from which a word's share in a domain is significant.
SIGNIFICANT = 30.0
#: Sums of log-odds saturate here: what more a very long text has to say would not be calibrated.
CLIP = 12.0
#: Rounds of descent end when targets are met this closely, or when three in a row moved nothing; a fit
#: that still moves after ``ROUNDS`` warns.
ROUNDS, TOLERANCE = 200, 1e-4


def domain_of() -> Column:
    """Domain of a row of the label table."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


@dataclass
class Classifier:
    log_word: np.ndarray  # slots x K
    tells: np.ndarray  # slots: whether the word counts
    weights: np.ndarray  # K + 1 rows x K: from the sums of log-odds, and 1, to logits

    def scores(self, slots: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Sums of the words' log-odds by domain, within +-``CLIP``, and a 1."""
        tells = self.tells[slots]
        slots, doc = slots[tells], doc[tells]
        s = [np.bincount(doc, self.log_word[slots, k], n_docs) for k in range(self.log_word.shape[1])]
        return np.clip(np.stack([*s, np.ones(n_docs)], 1), -CLIP, CLIP)

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        x = scores @ self.weights
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def calibrate(self, s: np.ndarray, y: np.ndarray) -> None:
        """Fit the weights by multinomial logistic regression (Newton's bound of Boehning)."""
        K = self.weights.shape[1]
        bound = np.linalg.inv(0.5 * (s.T @ s) + 1e-3 * np.eye(s.shape[1]))
        for _ in range(3000):
            off = np.eye(K)[y] - self.posteriors(s)
            step = bound @ (s.T @ off - 1e-3 * self.weights)
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-5:
                break


def _slots(words: Words, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's slot and its stem's, and the text of each."""
    h, start, end, at = words(data, offs)
    both = np.concatenate([h, words.stems(start, end, STEM)]) if len(h) else h
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return (both >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate([doc, doc])


def _counts(K: int):
    """Rows (text, domain, part): word counts by part, domain and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(marks=True), np.zeros(K << SLOT_BITS, np.int64)
        for b in batches:
            dom = b.column(1).to_numpy()
            for lo, hi, data, offs in text_chunks(b.column(0)):
                slot, doc = _slots(words, data, offs)
                total += np.bincount((dom[lo:hi][doc].astype(np.int64) << SLOT_BITS) + slot, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return run


def _held_out(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(marks=True)
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(0)):
                s = model.scores(*_slots(words, data, offs), hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["domain", "scores"])

    return run


def fit_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Classifier | None:
    """None if no labelled document is at hand."""
    K = len(DOMAINS)
    known = labels.select(F.col("doc_id").alias("l_id"), domain_of().alias("domain")).where("domain is not null and l_id is not null")
    known = known.groupBy("l_id").agg(F.max("domain").alias("domain")).withColumn("u", F.xxhash64("l_id")).orderBy("u", "l_id").limit(rows)
    known = F.broadcast(known.select("l_id", "domain", (F.col("u") % 5 == 0).alias("held")))  # at most ``rows`` rows
    found = docs.select(c(key).alias("id"), c(text).alias("text")).where("text is not null").join(known, F.col("id") == F.col("l_id")).select("text", "domain", "held")
    found = materialise(spark, found, "labelled")
    if found.where("not held").isEmpty():
        return None
    got = found.where("not held").select("text", "domain").mapInArrow(_counts(K), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(K << SLOT_BITS)
    n[got["slot"].to_numpy()] = got["n"].to_numpy()
    n = n.reshape(K, -1)
    share = (n.sum(0) + 0.5) / (n.sum() + 0.5 * n.shape[1])
    mean = n.sum(1, keepdims=True) * share
    seen = mean > 0  # a domain without labelled words says nothing of any word
    tells = np.divide((n - mean) ** 2, mean, out=np.zeros_like(mean), where=seen).max(0) > SIGNIFICANT
    p = (n + 50 * share) / (n.sum(1, keepdims=True) + 50)  # smoothed towards all domains together
    start = np.vstack([np.eye(K), np.zeros((1, K))])
    model = Classifier(np.ascontiguousarray(np.log(p / share).T), tells, start)
    held = found.where("held").select("text", "domain").mapInArrow(_held_out(model), "domain int, scores array<double>").toArrow()
    if held.num_rows:
        y, s = held["domain"].to_numpy(), np.array(held["scores"].to_pylist())

        model.calibrate(s, y)
    return model


def _posteriors(model, key_cols: int):
    """Rows (text, keys ...): the keys, tokens, and grid posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(marks=True), Classifier(*model.value)
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(0)):
                slot, doc = _slots(words, data, offs)
                p = np.rint(m.posteriors(m.scores(slot, doc, hi - lo)) * GRID).astype(np.int32)
                n = np.bincount(doc, minlength=hi - lo).astype(np.int64) // 2
                cols = [*(b.column(1 + j).slice(lo, hi - lo) for j in range(key_cols)), pa.array(n), *(pa.array(p[:, k]) for k in range(p.shape[1]))]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[1:], "n_tokens", *(f"p_{x}" for x in DOMAINS)])

    return run


def rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates by replaying the gradient steps (K numbers and the momentum after it) on posteriors ``p`` (rows x K)."""
    return _replayed(p, steps)[0]


def _replayed(p: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = ahead = np.ones(len(p))
    for s in steps:
        now = np.maximum(0.0, ahead - p @ s[:-1])
        w, ahead = now, now + s[-1] * (now - w)
    return w, ahead


def _expected(steps: np.ndarray, K: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * K)
        for b in batches:
            p, n = np.stack([b.column(1 + k).to_numpy() for k in range(K)], 1) / GRID, b.column(0).to_numpy()
            w, ahead = _replayed(p, steps)
            total += np.concatenate([(w * n) @ p, (ahead * n) @ p])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * K)), pa.array(total)], names=["k", "x"])

    return run


def solve(spark: SparkSession, grid: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, tokens aimed at, tokens expected) for the table (n_tokens, p_good, ...) of summed
    tokens by posteriors. Without a budget, it is the most that meets the targets
    with every domain's average rate at most 1. A domain without tokens gets no target."""
    K, cols = len(DOMAINS), [f"p_{x}" for x in DOMAINS]
    p = [F.col(x) / GRID for x in cols]
    n = F.col("n_tokens")
    sums = grid.agg(*[F.sum(n * x) for x in p], *[F.sum(n * x * y) for x in p for y in p]).first()
    now = np.array([float(x or 0) for x in sums[:K]])
    square = np.array([float(x or 0) for x in sums[K:]]).reshape(K, K)
    share = np.array([(targets or TARGETS).get(x, 0.0) for x in DOMAINS]) * (now > 0)
    if not share.sum():
        return np.zeros((0, K + 1)), now, now
    share /= share.sum()
    if budget is None:
        budget = float((now[share > 0] / share[share > 0]).min())
    aim = share * budget
    scale = np.where(now > 0, np.maximum(aim, 0.01 * now), 1.0)
    size = 1.0 / np.linalg.eigvalsh(square / np.sqrt(scale)[:, None] / np.sqrt(scale)[None, :])[-1]
    few = grid.select("n_tokens", *cols).coalesce(GRID_TASKS)  # the grid has one size; 2 K sums a task come back
    steps = np.zeros((0, K + 1))
    got = ahead = now
    t, loss = 1.0, float("inf")
    still = 0  # rounds in a row that moved nothing: a target may be out of reach
    for _ in range(ROUNDS):
        if np.abs((got - aim) / scale).max() < TOLERANCE or still >= 3:
            break
        before, t = t, (1 + np.sqrt(1 + 4 * t * t)) / 2
        steps = np.vstack([steps, np.append(size * (ahead - aim) / scale, (before - 1) / t)])
        out = few.mapInArrow(_expected(steps, K), "k bigint, x double").toArrow()
        both = np.bincount(out["k"].to_numpy(), out["x"].to_numpy(), 2 * K)
        still = still + 1 if np.abs((both[:K] - got) / scale).max() < TOLERANCE / 10 else 0
        got, ahead = both[:K], both[K:]
        if (now_loss := float(((got - aim) ** 2 / scale).sum())) > loss:  # overshot: momentum starts afresh
            t, ahead, steps[-1, -1] = 1.0, got, 0.0
        loss = now_loss
    else:
        warnings.warn(f"the rates still move after {ROUNDS} rounds; expected tokens {got.tolist()} for {aim.tolist()}", RuntimeWarning, stacklevel=2)
    return steps, aim, got


def _uniform(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), c(key)), 11) / float(1 << 53)


def _mixed(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str, key: str, targets, budget):
    """(posterior function, rate function) as columns to add, or None without labels."""
    model = fit_classifier(spark, docs, labels, text, key)
    if model is None:
        return None
    # plain arrays of one size, slots x domains: a worker without this package can read them
    sent = spark.sparkContext.broadcast((model.log_word, model.tells, model.weights))
    shape = "n_tokens bigint, " + ", ".join(f"p_{x} int" for x in DOMAINS)
    grid = docs.select(c(text)).mapInArrow(_posteriors(sent, 0), shape).groupBy(*[f"p_{x}" for x in DOMAINS]).agg(F.sum("n_tokens").alias("n_tokens"))
    steps, _, _ = solve(spark, materialise(spark, grid, "grid"), targets, budget)
    return sent, steps


def mix_weights(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_plain, p_toxic, rate, copies) for every row of ``docs``.

    A null or empty text has no tokens and the posteriors of a text without evidence.
    Labels that are null, or of no document here, don't count; of several for one id the
    last in the order good, plain, toxic does. Texts of any length are read whole. With no usable label every rate is 1 and the posteriors are null. Repeated
    rows are treated alike, a null id as an id of its own. A domain with no tokens has
    no target. An empty table gives an empty one; further columns are ignored.
    """
    found = _mixed(spark, docs, labels, text, key, targets, budget)
    ids = docs.select(c(text), c(key).alias("doc_id"))
    if found is None:
        none = {f"p_{x}": F.lit(None).cast("double") for x in DOMAINS}
        return ids.select("doc_id", F.lit(None).cast("bigint").alias("n_tokens")).withColumns(none | {"rate": F.lit(1.0), "copies": F.lit(1).cast("bigint")})
    sent, steps = found
    kind = ids.schema["doc_id"].dataType.simpleString()
    out = ids.mapInArrow(_posteriors(sent, 1), f"doc_id {kind}, n_tokens bigint, " + ", ".join(f"p_{x} int" for x in DOMAINS))
    p = [F.col(f"p_{x}") for x in DOMAINS]
    out = out.withColumn("rate", _rate(steps)(*p))
    out = out.withColumn("copies", F.floor(F.col("rate") + _uniform("doc_id")))
    return out.withColumns({f"p_{x}": F.col(f"p_{x}") / GRID for x in DOMAINS})


def _rate(steps: np.ndarray):
    @F.pandas_udf(T.DoubleType())
    def rate(*p):
        return __import__("pandas").Series(rates(np.stack([x.to_numpy() for x in p], 1) / GRID, steps))

    return rate


def _copied(model, steps: np.ndarray, at: int, u: int):
    """Each row as often as its rate and its number ``u`` (a column, dropped) say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(marks=True), Classifier(*model.value)
        for b in batches:
            keep = [b.column(j) for j in range(b.num_columns) if j != u]
            names = [x for j, x in enumerate(b.schema.names) if j != u]
            for lo, hi, data, offs in text_chunks(b.column(at)):
                slot, doc = _slots(words, data, offs)
                p = np.rint(m.posteriors(m.scores(slot, doc, hi - lo)) * GRID) / GRID
                n = np.floor(rates(p, steps) + b.column(u).slice(lo, hi - lo).to_numpy()).astype(np.int64)
                take = pa.array(np.repeat(np.arange(lo, hi), n))
                yield pa.RecordBatch.from_arrays([x.take(take) for x in keep], names=names)

    return run


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix_weights` says, all columns kept, whatever
    their names. Null, empty and very long texts, null and repeated ids, ties and empty tables are treated
    as there; without a usable label every row comes once."""
    found = _mixed(spark, docs, labels, text, key, targets, budget)
    if found is None:
        return docs
    (u,) = fresh(docs, "u")
    rows = docs.withColumn(u, _uniform(key))
    return rows.mapInArrow(_copied(*found, docs.columns.index(text), len(docs.columns)), docs.schema)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_weights(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
