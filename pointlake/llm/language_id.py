"""Language identification by Bayesian fusion of text, markup, address and host.

Evidence for a language l of a record:

* text: a model of hashed byte trigrams for each language, counted over every labelled
  text, against a uniform model for text in no known language;
* the language its markup declares, and the suffix of its host: likelihoods
  P(value | l) from counts of the text-only posteriors, grouped by value;
* its host: a prior P(l | host) smoothed towards the registered domain's, that towards the
  suffix's, and that towards the whole table's. A record's own text-only posterior is
  taken out of the counts of its host, domain and suffix before they judge it.

The counts are grouped aggregations over the whole table; the model is one array of
fixed size for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import c, documents, fresh, materialise, small, text_chunks

SLOT_BITS = 16
UNKNOWN = "und"
#: Prior of the uniform model, and the least posterior at which a record is accepted.
P_UNKNOWN, ACCEPT = 0.01, 0.5
#: Neighbouring trigrams share bytes, so each counts for a third.
WEIGHT = 1 / 3
#: Languages of the model at most, the most frequent labels: 256 KB each are broadcast, and six columns each carried.
LANGS = 128
#: Pseudo-counts: of the level above a host, domain or suffix, and of a markup or suffix value.
LEVEL, VALUE = 4.0, 1.0


def _lower() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint32)
    lut[65:91] += 32
    lut[48:58] = 48  # which digit it is says nothing of the language
    return lut


def _slots(lut: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the trigram that starts at each byte but the last two, and whether it lies
    within one text."""
    b = lut[data]
    h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    inside = np.ones(len(h), bool)
    cut = offs[1:-1]
    for k in (1, 2):
        at = cut - k
        inside[at[(at >= 0) & (at < len(h))]] = False
    return (h >> np.uint32(32 - SLOT_BITS)).astype(np.int64), inside


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, of = _lower(), {x: i for i, x in enumerate(langs)}
        total = np.zeros(len(langs) << SLOT_BITS, np.int64)
        for b in batches:
            label = np.array([of.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            for lo, hi, data, offs in text_chunks(b.column(0)):
                if len(data) < 3:
                    continue
                slot, inside = _slots(lut, data, offs)
                of_byte = np.repeat(label[lo:hi], np.diff(offs))[: len(slot)]
                use = inside & (of_byte >= 0)
                total += np.bincount((of_byte[use] << SLOT_BITS) + slot[use], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return run


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of slots by language) from every labelled text.

    At most ``LANGS`` languages, those with the most texts (ties by name), have a model. A text with a rarer
    label counts as unlabelled, so a column of dirty labels can't grow the model.
    """
    rows = labelled.where(c(text).isNotNull() & c(lang).isNotNull() & (c(lang) != UNKNOWN))
    top = rows.groupBy(c(lang).alias("lang")).count().orderBy(F.col("count").desc(), "lang").limit(LANGS)
    langs = sorted(r[0] for r in top.collect())
    if not langs:
        return [], np.zeros((0, 1 << SLOT_BITS), np.float32)
    counts = rows.select(c(text), c(lang)).mapInArrow(_count(langs), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.full(len(langs) << SLOT_BITS, 0.5)
    n[counts["slot"].to_numpy()] += counts["n"].to_numpy()
    n = n.reshape(len(langs), -1)
    return langs, np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def log_likelihoods(model: np.ndarray, data: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) sums of log probabilities, and the number of trigrams."""
    n = len(offs) - 1
    if len(data) < 3:
        return np.zeros((n, len(model))), np.zeros(n, np.int64)
    slot, _ = _slots(lut, data, offs)
    lo = np.minimum(offs[:-1], len(slot))
    hi = np.maximum(lo, np.minimum(offs[1:] - 2, len(slot)))
    out = np.empty((n, len(model)))
    run = np.zeros(len(slot) + 1)
    for k, row in enumerate(model):
        np.cumsum(row[slot], dtype=np.float64, out=run[1:])
        out[:, k] = run[hi] - run[lo]
    return out, hi - lo


def _score(model, n_langs: int):
    """Append to each row: ll_0 .. ll_{n-1}, the numbers of trigrams and of bytes; drop the text (column 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, table = _lower(), model.value
        for b in batches:
            ll, n, size = np.zeros((b.num_rows, n_langs)), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for lo, hi, data, offs in text_chunks(b.column(0)):
                ll[lo:hi], n[lo:hi] = log_likelihoods(table, data, offs, lut)
                size[lo:hi] = np.diff(offs)
            cols = [*b.columns[1:], *(pa.array(ll[:, k]) for k in range(n_langs)), pa.array(n), pa.array(size)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[1:], *(f"ll_{k}" for k in range(n_langs)), "trigrams", "bytes"])

    return run


def _softmax(logs: list[Column]) -> tuple[Column, list[Column]]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    shifted = [F.exp(x - top) for x in logs]
    total = reduce(lambda a, b: a + b, shifted)
    return total, [x / total for x in shifted]


def identify(spark: SparkSession, records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``records`` (text, markup, suffix, domain, host, and others carried along) without the
    text, with ``lang``, its ``posterior``, and ``accepted``.

    Any of the five may be null, and then is no evidence. A text of fewer than three
    bytes is judged by the other evidence alone. A record is accepted if its text is neither
    null nor empty, and its best language isn't unknown and has a posterior of ``ACCEPT`` or
    more. Ties go to the
    language first in the alphabet. Texts of any length are read whole. Other columns may have any names but
    those three, which raise ``ValueError``. Repeated rows are judged alike. With no labelled
    text at all every ``lang`` is null and none is accepted. An empty table gives an empty one.
    """
    langs, table = model
    L = len(langs)
    rest = [x for x in records.columns if x != "text"]
    if {x.lower() for x in rest} & {"lang", "posterior", "accepted"}:
        raise ValueError("lang, posterior and accepted are columns of the result")
    if not L:
        return records.select(*[c(x) for x in rest]).withColumns({"lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "accepted": F.lit(False)})
    evidence = ("text", "markup", "suffix", "domain", "host")
    carried = [x for x in records.columns if x not in evidence]
    plain = {x: f"carried_{i}" for i, x in enumerate(carried)}  # names of its own, that clash with none used here
    records = records.select(*[c(x).alias(plain.get(x, x)) for x in records.columns])
    rest = [x for x in records.columns if x != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*[c(x) for x in rest]).schema)
    sent = spark.sparkContext.broadcast(table)  # 256 KB for each of at most ``LANGS`` languages
    scored = records.select(c("text"), *[c(x) for x in rest]).mapInArrow(_score(sent, L), fields + "".join(f", ll_{k} double" for k in range(L)) + ", trigrams bigint, bytes bigint")
    unknown = F.col("trigrams") * float(-np.log(1 << SLOT_BITS))
    known = [F.col(f"ll_{k}") * WEIGHT + float(np.log((1 - P_UNKNOWN) / L)) for k in range(L)]
    _, q = _softmax([*known, unknown * WEIGHT + float(np.log(P_UNKNOWN))])
    none = F.col("trigrams") == 0
    scored = scored.withColumns({f"q_{k}": F.when(none, 0.0).otherwise(q[k]) for k in range(L)} | {"q_und": F.when(none, 0.0).otherwise(q[L])})
    scored = materialise(spark, scored, "scored")

    sums = [F.sum(f"q_{k}").alias(f"s_{k}") for k in range(L)]
    whole = scored.agg(*sums).first()
    n = np.array([x or 0.0 for x in whole]) + 1.0
    out = scored
    for level in ("host", "domain", "suffix", "markup"):
        g = scored.where(c(level).isNotNull()).groupBy(c(level).alias(f"by_{level}")).agg(*[F.sum(f"q_{k}").alias(f"{level}_{k}") for k in range(L)])
        g = materialise(spark, g, level)
        out = out.join(small(g, 64 + 8 * L), c(level) == F.col(f"by_{level}"), "left").drop(f"by_{level}")
        if level == "markup":
            n_markup = g.count()
    result = fields + ", lang string, posterior double, accepted boolean"
    fused = out.mapInArrow(_fused(langs, out.columns, len(rest), n, n_markup), result)
    back = {v: k for k, v in plain.items()}
    return fused.select(*[c(x).alias(back.get(x, x)) for x in fused.columns])


def fuse(q: np.ndarray, ll: np.ndarray, trigrams: np.ndarray, seen: dict[str, np.ndarray], has_markup: np.ndarray, total: np.ndarray, n_markup: int) -> np.ndarray:
    """(rows x languages and unknown) posteriors.

    ``q``: own text-only posteriors; ``seen``: by level, the summed posteriors of the records
    that share its value (0 where there is none); ``total``: those of the whole table.
    """
    prior = np.broadcast_to(total / total.sum(), q.shape)
    for level in ("suffix", "domain", "host"):
        others = np.maximum(seen[level] - q, 0.0)
        prior = (others + LEVEL * prior) / (others.sum(1, keepdims=True) + LEVEL)
    lp = np.log(prior * (1 - P_UNKNOWN)) + WEIGHT * ll
    declared = np.log((np.maximum(seen["markup"] - q, 0.0) + VALUE) / (total + VALUE * (n_markup + 1)))
    lp += np.where(has_markup[:, None], declared, 0.0)
    und = np.log(P_UNKNOWN) - WEIGHT * trigrams * np.log(1 << SLOT_BITS) - np.where(has_markup, np.log(n_markup + 1), 0.0)
    lp = np.concatenate([lp, und[:, None]], 1)
    p = np.exp(lp - lp.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fused(langs: list[str], names: list[str], n_rest: int, total: np.ndarray, n_markup: int):
    L = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {x: i for i, x in enumerate(names)}
            block = lambda p: np.stack([b.column(at[f"{p}_{k}"]).fill_null(0.0).to_numpy(zero_copy_only=False) for k in range(L)], 1)
            seen = {x: block(x) for x in ("suffix", "domain", "host", "markup")}
            has = b.column(at["markup"]).is_valid().to_numpy(zero_copy_only=False)
            p = fuse(block("q"), block("ll"), b.column(at["trigrams"]).to_numpy(), seen, has, total, n_markup)
            best = p.argmax(1)
            top = p[np.arange(len(p)), best]
            ok = (b.column(at["bytes"]).to_numpy() > 0) & (best < L) & (top >= ACCEPT)
            cols = [*b.columns[:n_rest], pa.array([(*langs, UNKNOWN)[k] for k in best], pa.string()), pa.array(top), pa.array(ok)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names[:n_rest], "lang", "posterior", "accepted"])

    return run


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents have no markup or address; their source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(c("text"), c("doc_id"), c("source"), F.xxhash64(c("text")).alias("h"), none.alias("markup"), none.alias("suffix"), none.alias("domain"), c("source").cast("string").alias("host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Visible text, declared language and parts of the address of (page_id, url, html)."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    part = lambda s, n: F.nullif(F.regexp_extract(s, n, 1), F.lit(""))
    out = pages.select("page_id", visible.alias("text"), part(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), "(.+)").alias("markup"), F.nullif(host, F.lit("")).alias("host"))
    return out.withColumns({"domain": part(F.col("host"), r"([^.]+\.[^.]+)$"), "suffix": part(F.col("host"), r"([^.]+)$")})


def rejected(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Identity (doc_id, source, hash of text) of the documents not accepted."""
    return identify(spark, from_documents(docs), train(docs)).where("not accepted").select("doc_id", "source", "h").distinct()


def keep_known(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The accepted rows of ``docs`` with all their columns; see :func:`identify`.

    A row is known by its id, source and text, nulls included, so repeated rows stay or go
    together; rows with a null or empty text go. Columns may have any names. Without any labelled text no
    language is known and every row goes; an empty table stays empty.
    """
    out = materialise(spark, rejected(spark, docs), "rejected")
    i, o, h = fresh(docs, "r_id", "r_source", "r_h")
    out = small(out.select(F.col("doc_id").alias(i), F.col("source").alias(o), F.col("h").alias(h)), 48)
    same = c("doc_id").eqNullSafe(c(i)) & c("source").eqNullSafe(c(o)) & F.xxhash64(c("text")).eqNullSafe(c(h))
    return docs.join(out, same, "left_anti")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page, judged together: a page has a page_id and no doc_id."""
    d = documents(spark, sf_dir)
    none, parts = F.lit(None).cast("bigint"), ["text", "markup", "suffix", "domain", "host"]
    both = from_documents(d).select("doc_id", none.alias("page_id"), *parts)
    p = from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(none.alias("doc_id"), "page_id", *parts)
    return identify(spark, both.unionByName(p), train(d)).select("doc_id", "page_id", "lang", "posterior", "accepted")
