"""Filters, text functions, embeddings, codecs, fusion and approximate search against fixtures and brute force."""

import json
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointlake.errors import InvalidArgument
from pointlake.functions import quant, text, vectors
from pointlake.functions.filters import Condition, Filter
from pointlake.operators import ann, lexical, search

DATA = os.path.join(os.path.dirname(__file__), "data")


def test_filter_types(spark):
    payloads = ['{"k":"2024"}', '{"k":2024}', '{"k":2024.0}', '{"k":true}', '{"k":null}', "{}", None, "7", "[1]", '{"k":1}', '{"k":"x y"}']
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    s = lambda f: [r[0] for r in df.where((f if isinstance(f, Filter) else Filter.from_json(f)).compile(F.col("p"))).orderBy("i").collect()]
    k = lambda t: {"key": "k", **t}
    assert s({"must": [k({"match": {"value": 2024}})]}) == [1, 2]
    assert s({"must": [k({"match": {"value": "2024"}})]}) == [0]
    assert s({"must": [k({"match": {"value": True}})]}) == [3]
    assert s({"must": [k({"match": {"any": ["x y", 1, True]}})]}) == [3, 9, 10]
    assert s({"must": [k({"range": {"gte": None}})]}) == [1, 2, 9]
    assert s({"must": [k({"range": {"gt": 1, "lte": 2024}})]}) == [1, 2]
    assert s({"must": [k({"exists": False})]}) == [0, 1, 2, 3, 4, 9, 10]
    assert s({"must_not": [k({"exists": True})]}) == [5, 6, 7, 8]
    assert s({"must": [{"should": [k({"match": {"value": 1}})], "must_not": [k({"match": {"value": 2024}})]}]}) == [9]
    assert s({}) == list(range(11))
    assert s(Filter(must_not=[Condition.eq("k", "2024")])) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    for bad in ({"x": []}, {"must": {}}, {"must": [{"match": {"value": 1}}]}, {"must": [k({"match": {"value": 1.5}})]}, {"must": [{"key": "a.b", "exists": True}]}, {"must": [k({"range": {"gte": "x"}})]}, {"must": [k({})]}):
        with pytest.raises(InvalidArgument):
            Filter.from_json(bad)


def test_tokens_agree_with_python(spark):
    texts = ["Élève's  (a) ab é! x", "", "  ", "Foo bar　BAZ--qux.", "the the The", "ab", "日本 語です"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for col, py in ((text.words_any, text.py_words_any), (text.words_long, text.py_words_long), (text.char_ngrams, text.py_char_ngrams)):
        assert [r[0] for r in df.orderBy("i").select(col(F.col("t"))).collect()] == [py(t) for t in texts]


def test_chunks(spark):
    assert text.chunks("hello world", 100, 0) == [("hello world", 0, 11)]
    assert text.chunks("   padded   ", 100, 0) == [("padded", 3, 9)]
    fox = "The quick brown fox jumps over the lazy dog near the river bank at dawn."
    assert [(a, b) for _, a, b in text.chunks(fox, 24, 6)] == [(0, 19), (14, 34), (29, 52), (47, 66), (61, 72), (67, 72)]
    marks = "café résumé naïve über Zürich piñata jalapeño smörgåsbord"
    assert [(a, b) for _, a, b in text.chunks(marks, 20, 4)] == [(0, 14), (11, 27), (24, 43), (40, 53), (50, 67), (63, 67)]
    assert all(t == x.encode()[a:b].decode() for x, m, o in ((fox, 24, 6), (marks, 20, 4)) for t, a, b in text.chunks(x, m, o))
    df = spark.createDataFrame([("a b. c",), (None,), ("",)], "t string")
    assert [r[0] and len(r[0]) for r in df.select(text.chunk_column(F.col("t"), 4, 1)).collect()] == [len(text.chunks("a b. c", 4, 1)), None, []]


def test_embeddings_agree_with_fixture(spark):
    fx = json.load(open(f"{DATA}/embeddings.json"))  # published vectors, without their zeros
    df = spark.createDataFrame([(t,) for t in fx["corpus"]], "text string")
    for name in ("bm25", "tfidf", "bow", "char_ngram"):
        e = lexical.build_provider(name, 64)
        e.fit(df)
        got = np.array([e.embed(t) for t in fx["queries"] + fx["corpus"]])
        want = np.array([[r.get(str(i), 0.0) for i in range(64)] for r in fx[name]])
        assert np.abs(got - want).max() < 1e-5
        rows = df.select("text", e.embed_column(F.col("text")).alias("v")).collect()
        assert np.abs(np.array([r["v"] for r in rows]) - np.array([e.embed(r["text"]) for r in rows])).max() < 1e-7
        twin = lexical.build_provider(name, 64)
        twin.import_state(e.export_state())
        assert twin.embed("furry cats") == e.embed("furry cats")


FUSIONS = [
    {"alpha": 0.5, "rrf_k": 60.0, "dense": "abcdef", "sparse": "cdef", "expected": "cdefab"},
    {"alpha": 0.9, "rrf_k": 60.0, "dense": "xyz", "sparse": "zyx", "expected": "xyz"},
    {"alpha": 0.1, "rrf_k": 60.0, "dense": "xyz", "sparse": "zyx", "expected": "zyx"},
    {"alpha": 0.5, "rrf_k": 60.0, "dense": "abcd", "sparse": "dc", "expected": "dcab"},
    {"alpha": 0.5, "rrf_k": 60.0, "dense": "pqrst", "sparse": "tp", "expected": "ptqrs"},
]


def test_fusion_agrees_with_fixture(spark):
    for s in FUSIONS:
        rank = {x: i for i, x in enumerate(s["sparse"])}
        rows = [(x, i, [float(i)], {"indices": [0], "values": [float(len(rank) - rank[x])]} if x in rank else None) for i, x in enumerate(s["dense"])]
        df = spark.createDataFrame(rows, "id string, slot bigint, vector array<float>, sparse struct<indices:array<bigint>,values:array<float>>")
        got = search.hybrid(df, [0.0], {"indices": [0], "values": [1.0]}, len(rows), s["alpha"], s["rrf_k"], "euclidean", slot="slot").collect()
        assert "".join(r["id"] for r in got) == s["expected"]


def test_knn_agrees_with_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 6)).astype(np.float32)  # many ties
    v = v[np.abs(v).sum(1) > 0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id bigint, vector array<float>").repartition(4)
    qs = rng.normal(size=(3, 6))
    for metric in ("cosine", "euclidean", "dot"):
        x, q = v.astype(float), qs.astype(np.float32).astype(float)
        if metric == "cosine":
            x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
        s = (np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)) if metric == "euclidean" else -(q @ x.T)).astype(np.float32).round(5)
        got = search.batch_knn(df, qs.tolist(), 20, metric).orderBy("qid", "rank").collect()
        for j in range(3):
            mine = [r["id"] for r in got if r["qid"] == j]
            assert len(mine) == 20 and sorted(s[j][mine]) == pytest.approx(sorted(s[j])[:20], abs=1e-4)
    with pytest.raises(InvalidArgument):
        search.knn(df, [0.0] * 6, 5)


def test_codecs(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(-1, 1, (400, 16)).astype(np.float32)
    df = spark.createDataFrame([(x.tolist(),) for x in v], "vector array<float>")
    for bits in (8, 4, 2, 1):
        c = quant.ScalarCodec(bits).fit(df)
        back = c.decode(c.encode(v), 16)
        assert back.shape == v.shape and np.abs(back - v).max() <= (c.scale / 2 + 1e-6 if bits > 1 else 2)
        assert quant.deserialize_params(c.serialize_params()).encode(v).tolist() == c.encode(v).tolist()
    exact = np.argsort(((v[:40, None] - v[None]) ** 2).sum(2), 1)[:, :10]
    c = quant.ScalarCodec(8).fit(df)
    near = np.argsort(((v[:40, None] - c.decode(c.encode(v), 16)[None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, near)]) >= 0.98
    b = quant.BinaryCodec().fit(df)
    assert b.threshold == np.sort(v.reshape(-1))[v.size // 2]
    assert b.similarity(v[:1], b.encode(v[:1]))[0] == 1.0
    p = quant.ProductCodec(4, 32).fit(df)
    assert p.quality_loss(v) < v.var() / 2
    r = df.agg(F.min(F.array_min("vector")).alias("lo"), F.max(F.array_max("vector")).alias("hi"))
    codes = df.crossJoin(r).select(quant.sq8_codes(F.col("vector"), F.col("lo"), F.col("hi"))).collect()
    assert (np.array([x[0] for x in codes]) != c.codes(v)).mean() < 0.001


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, -1.0])], "a array<float>, b array<float>")
    r = df.select(*[f("a", "b").alias(n) for n, f in (("dot", lambda a, b: vectors.dot(F.col(a), F.col(b))), ("l2", lambda a, b: vectors.l2(F.col(a), F.col(b))), ("l1", lambda a, b: vectors.manhattan(F.col(a), F.col(b))))], vectors.normalize(F.col("a")).alias("n"), vectors.sparse_from_dense(F.col("a")).alias("s"), vectors.argmin(F.col("b")).alias("m")).collect()
    assert r[0]["dot"] == 11 and r[0]["l1"] == 4 and r[0]["l2"] == pytest.approx(8**0.5)
    assert r[0]["n"] == pytest.approx([0.6, 0.8]) and r[1]["n"] == [0.0, 0.0] and r[1]["s"] is None and r[1]["m"]["index"] == 1


def test_ivf_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 16))
    v = (centres[rng.integers(0, 16, 1000)] + 0.35 * rng.normal(size=(1000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<float>")
    c = ann.fit_cells(df, 16)
    celled = ann.assign(df, c).cache()
    hits = []
    for i in range(8):
        got = {r["id"] for r in ann.ivf_search(celled, c, v[i].tolist(), 10, 4, "euclidean").collect()}
        hits.append(len(got & set(np.argsort(((v - v[i]) ** 2).sum(1))[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.95


def test_terms_are_counted_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(lexical, "HELD_TERMS", 50)
    texts = [f"common w{i}a w{i}b, (w{i}a)" for i in range(300)] + [None]
    out = [b.to_pylist() for b in lexical._counts(text.py_words_long, True)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))]
    assert max(map(len, out)) <= 55  # a batch of texts was counted whole before
    total = lambda t, key: sum(r[key] for b in out for r in b if r["term"] == t)
    assert (total(None, "df"), total(None, "cf"), total("common", "df"), total("w7a", "cf"), total("w7a", "df")) == (300, 1200, 300, 2, 1)


def test_edges_of_words():
    for w in ("(word),", "«mot»", "--", "'a.b'", "x_", "_", "日本。", "**é**", "5%", "á.", ".­.", "ⓐ!", "٣)"):
        assert text._trim(w) == text._PY_EDGE.sub("", w), w


def _peak(f) -> tuple:
    """(what ``f`` returns, MB allocated at most meanwhile)."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _nearest(v, q, metric, k, batches=1):
    ids = pa.array([f"{i:05}" for i in range(len(v))])
    rows = pa.RecordBatch.from_arrays([ids, ids, pa.array(list(v))], names=["id", "slot", "vector"])
    step = -(-len(v) // batches)
    out = search._best((np.arange(len(q)) * 7, q.astype(np.float64)), metric, k, metric != "cosine")(iter([rows.slice(lo, step) for lo in range(0, len(v), step)]))
    got = [(a, s, int(i)) for b in out for a, i, s in zip(b["qid"].to_pylist(), b["id"].to_pylist(), b["score"].to_pylist())]
    got.sort(key=lambda x: (x[0], x[1] if metric == "euclidean" else -x[1], x[2]))
    return np.array([[x[2] for x in got if x[0] == 7 * j][:k] for j in range(len(q))]) if len(q) < 100 else got


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_many_queries_are_scored_in_bounded_memory(metric):
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(4000, 8)).astype(np.float32), rng.normal(size=(4000, 8))
    out, mb = _peak(lambda: _nearest(v, q, metric, 3))
    assert len(out) == 12_000 and mb < 100  # all pairs in double precision are 128 MB, and were there twice
    v = rng.integers(-1, 2, (500, 3)).astype(np.float32)  # many ties, settled by the id
    v, q = v[np.abs(v).sum(1) > 0], np.eye(3)
    x = v / np.linalg.norm(v, axis=1, keepdims=True) if metric == "cosine" else v
    want = [sorted(range(len(v)), key=lambda i: (-np.float32(x[i] @ y), i))[:20] for y in q]
    for n in (1, 7):
        assert _nearest(v, q, metric, 20, n).tolist() == want


def test_euclidean_neighbours_of_many_queries_in_bounded_memory(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(4000, 8)).astype(np.float32), rng.normal(size=(4000, 8))
    out, mb = _peak(lambda: _nearest(v, q, "euclidean", 3))
    assert len(out) == 12_000 and mb < 100
    for far in (0, 1e6):  # far from 0, squares lose what differences keep
        v = (rng.integers(0, 3, (600, 3)) + far).astype(np.float32)
        q = v[:5] + 0.25
        want = [sorted(range(len(v)), key=lambda i: (np.float32(np.sqrt(((v[i].astype(float) - y.astype(float)) ** 2).sum())), i))[:20] for y in q]
        for held in (search.HELD_HITS, 50):
            monkeypatch.setattr(search, "HELD_HITS", held)
            assert _nearest(v, q, "euclidean", 20, 7).tolist() == want
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<float>").repartition(3)
    cells = ann.fit_cells(df, 4)
    got = ann.ivf_batch(ann.assign(df, cells), cells, q.tolist(), 20, 4, "euclidean").orderBy("qid", "rank").collect()  # all cells are open
    assert [[r["id"] for r in got if r["qid"] == j] for j in range(5)] == want


@pytest.mark.parametrize("name", ["tfidf", "char_ngram"])
def test_texts_are_embedded_in_bounded_memory(name):
    e = lexical.build_provider(name, 64)
    words = [f"w{i}" for i in range(64)]
    e.terms, e.df, e.n_docs = {w: i for i, w in enumerate(words if name == "tfidf" else [w[:3] for w in words])}, [1] * 64, 100
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(400)) for i in range(1024)]
    m, mb = _peak(lambda: e.matrix(texts))
    assert mb < 12  # the tokens of 1024 texts alone took 25 and more
    for i in (0, 1, 5, 1023):
        toks = e.py_tokens(texts[i])
        w = e.weights(np.array([[toks.count(t) for t in e.terms]]), np.array([[len(toks)]]))[0]
        assert m[i] == pytest.approx(w / (np.linalg.norm(w) or 1))


def test_grams_are_counted_without_being_made(spark):
    texts = ["", "a", "ab", "abc", "aaaa", "AbCabc", "日本語です日本語", "😀😀😀😀", "İstanbul ΣΑΣ", None, "x" * 5000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    for n in (1, 2, 3, 4):
        got = df.select(text.gram_counts(F.col("t"), n).alias("g")).collect()
        want = df.select(F.size(text.char_ngrams(F.col("t"), n)), F.size(F.array_distinct(text.char_ngrams(F.col("t"), n)))).collect()
        assert [r["g"] and tuple(r["g"]) for r in got] == [None if t is None else tuple(w) for t, w in zip(texts, want)]
