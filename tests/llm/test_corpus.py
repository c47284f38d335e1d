"""The corpus operators against brute force, held-out labels and edge cases."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm import ctw, exact_dedup, language_id, licenses, media, minhash_dedup, mixing, packing, sharding, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = "wide word " * 30_000
EDGE = [(1, "one two three four", "en", "s"), (1, "one two three four", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "one two three four", "en", "s"), (4, LONG, "en", "t"), (5, "!!! ??", None, "t"), (6, "é", "fr", None)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE).withColumns({"h": F.lit(1), "cell": F.lit("x"), "kept": F.lit(0), "gone": F.lit(None).cast("string"), "u": F.lit(0), "bits": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


VOCABULARY = ["".join(p) for p in itertools.product("bcdfghklmnprst", "aeiou", "rstlnmkdpbgfhv", "iouae")]
random.Random(0).shuffle(VOCABULARY)


def test_exact_dedup(spark, edge, none):
    got = sorted(((r[0] is None, r[0]), r[1]) for r in exact_dedup.duplicates(spark, edge).collect())
    assert got == [((False, 1), 1), ((True, None), 1)]
    kept = exact_dedup.deduplicate(spark, edge)
    assert kept.columns == edge.columns and kept.count() == 6
    assert exact_dedup.duplicates(spark, none).count() == 0 == exact_dedup.deduplicate(spark, none).count()
    rng = random.Random(1)
    rows = [(i, "t%d" % rng.randrange(60), "en", "s") for i in range(300)]
    first = {}
    want = sorted((i, first[t]) for i, t, _, _ in rows if first.setdefault(t, i) != i)
    small = exact_dedup.duplicates(spark, docs_of(spark, rows), bucket_bytes=200, owner_bytes=400)
    assert sorted(map(tuple, small.collect())) == want


def test_directory_doubles_and_splits():
    cells = np.zeros(256, np.int64)
    cells[[0, 1, 2, 200]] = 100
    depth, directory, local = exact_dedup.build_directory(cells, 150)
    assert depth == 8 and len(directory) == 256 and local.max() == 8
    load = np.bincount(directory, cells)
    assert load.max() <= 150
    assert all((directory == b).sum() == 1 << (depth - local[b]) for b in range(len(local)))


def test_sharding(spark, edge, none):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.array([0, 1, -1, 10**12, -(2**63), 2**63 - 1] + list(range(500)), np.int64)
    for n in (1, 2, 7, 1024):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k) % (1 << 64), n) for k in keys]
    a, b = sharding.jump_hash(keys, 10), sharding.jump_hash(keys, 11)
    assert set(b[a != b]) <= {10} and (a != b).mean() < 0.2
    out = sharding.assign_shards(edge, 8).collect()
    assert len(out) == len(EDGE) and len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    assert sharding.assign_shards(none, 8).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(edge.withColumn("shard", F.lit(1)))


def test_minhash(spark, edge, none):
    rng = random.Random(3)
    rows, truth = [], defaultdict(set)
    for g in range(40):
        base = words(rng, 120, VOCABULARY).split()
        for k in range(1 + g % 4):
            t = list(base)
            for _ in range(3 * (k > 0)):
                t[rng.randrange(len(t))] = rng.choice(VOCABULARY)
            truth[g].add(len(rows))
            rows.append((len(rows), " ".join(t), "en", "s"))
    got = {r[0]: r[1] for r in minhash_dedup.near_duplicates(spark, docs_of(spark, rows)).collect()}
    want = {i: min(g) for g in truth.values() for i in g if i != min(g)}
    assert sum(got.get(i) == r for i, r in want.items()) >= 0.9 * len(want) and set(got) <= set(want)
    many = docs_of(spark, [(i, words(random.Random(9), 50, VOCABULARY), "en", "s") for i in range(500)])
    assert minhash_dedup.keep_one(spark, many).count() == 1
    assert minhash_dedup.near_duplicates(spark, edge).count() == 0
    assert minhash_dedup.keep_one(spark, edge).columns == edge.columns and minhash_dedup.keep_one(spark, none).count() == 0
    # densified signatures estimate the similarity of sets of shingles
    w = minhash_dedup.Words()
    a, b = "x y z " + words(rng, 40, VOCABULARY), "q r " + words(rng, 3, VOCABULARY)
    for t, u in ((a, a + " more words"), (b, b + " z")):
        data = np.frombuffer((t + u).encode(), np.uint8)
        _, s = minhash_dedup.signatures(w, data, np.array([0, len(t), len(t + u)]))
        sets = [{tuple(x.split()[i : i + 3]) for i in range(len(x.split()) - 2)} for x in (t, u)]
        assert abs((s[0] == s[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.25


@pytest.mark.parametrize("size", [50, 300])
def test_minhash_closes_buckets(spark, size):
    rng = random.Random(size)
    base = words(rng, 100, VOCABULARY).split()
    texts = [" ".join(base)]
    for _ in range(size):  # variants about as far from the original as the threshold
        t = list(base)
        for k in rng.sample(range(len(t)), rng.randrange(5, 14)):
            t[k] = rng.choice(VOCABULARY)
        texts.append(" ".join(t))
    rng.shuffle(texts)
    raw = [t.encode() for t in texts]
    _, sigs = minhash_dedup.signatures(minhash_dedup.Words(), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rows = sigs.shape[1] // minhash_dedup.BANDS
    bands = sigs[:, : rows * minhash_dedup.BANDS].reshape(len(sigs), minhash_dedup.BANDS, rows)
    root = list(range(len(texts)))
    for i in range(len(texts)):  # all pairs that share a bucket
        for j in np.flatnonzero((bands[:i] == bands[i]).all(2).any(1) & ((sigs[:i] == sigs[i]).mean(1) >= minhash_dedup.THRESHOLD)).tolist():
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    got = {r[0]: r[1] for r in minhash_dedup.near_duplicates(spark, docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i}


@pytest.mark.parametrize("close", [20])
def test_minhash_splits_crowded_buckets(spark, close):
    """Signatures that share a band but little else, with pairs that agree hidden among them."""
    rng = np.random.default_rng(close)
    sigs = rng.integers(0, 1 << 16, (300, minhash_dedup.BINS)).astype(np.uint16)
    sigs[:, :40] = sigs[0, :40]  # far below the threshold, but ten bands in common
    for i in range(100, 130):  # as alike as the threshold just asks for
        sigs[i] = np.where(np.arange(128) < 71, sigs[i - 100], sigs[i])
    sigs[200:210, 40:] = np.where(rng.random((10, 88)) < 0.6, sigs[199, 40:], sigs[200:210, 40:])
    rng.shuffle(sigs)
    root = list(range(300))
    for i in range(300):
        for j in np.flatnonzero((sigs[:i] == sigs[i]).mean(1) >= minhash_dedup.THRESHOLD).tolist():
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "id bigint, sig binary")
    got = {r[0]: r[1] for r in minhash_dedup._grouped(spark, df, minhash_dedup.BANDS, minhash_dedup.THRESHOLD, close).collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i} and len(got) > 30


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        lo, hi = sorted((root[a], root[b]))
        root = {x: lo if r == hi else r for x, r in root.items()}
    got = {r[0]: r[1] for r in minhash_dedup.components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_keys_of_other_types(spark):
    """Ids are strings; the columns have names that the operators use themselves."""
    rng = random.Random(13)
    base = [words(rng, 60, VOCABULARY) for _ in range(20)]
    rows = [(f"d{i:03d}", t, "en", "s") for i, t in enumerate(base + base + [t + " more" for t in base])] + [(None, base[0], "en", "s")]
    docs = spark.createDataFrame([(i, t, la, s, len(t)) for i, t, la, s in rows], DOCS.replace("doc_id bigint", "doc_id string"))
    for x in ("kept", "kept_dup", "dup", "nth", "owner", "split", "x", "bytes", "trigrams", "ll_0", "q_0", "by_host", "gone", "copies", "grp"):
        docs = docs.withColumn(x, F.lit(1))
    near = {r[0]: r[1] for r in minhash_dedup.near_duplicates(spark, docs).collect()}
    assert near == {f"d{i:03d}": f"d{i % 20:03d}" for i in range(20, 60)}
    assert minhash_dedup.keep_one(spark, docs).count() == 21
    for size in (200, 1 << 20):  # split hashes, and none
        kept = exact_dedup.deduplicate(spark, docs, bucket_bytes=size)
        assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == [f"d{i:03d}" for i in (*range(20), *range(40, 60))]
    assert sum(r["tokens"] for r in packing.pack_documents(spark, docs, capacity=64).collect()) == sum(len(t.split()) for _, t, _, _ in rows)
    assert language_id.keep_known(spark, docs).columns == docs.columns
    got = language_id.identify(spark, docs.drop("lang").withColumns({x: F.lit(None).cast("string") for x in ("markup", "suffix", "domain", "host")}), language_id.train(docs))
    assert got.count() == 61 and {"bytes", "trigrams", "ll_0"} < set(got.columns)
    with pytest.raises(ValueError):
        language_id.identify(spark, got, language_id.train(docs))


def test_packing_deals_equal_rows_apart(spark):
    docs = docs_of(spark, [(7, "a b c", "en", "s")] * 5000 + [(8, "d " * 30, "en", "s")] * 100)
    one = packing.pack_documents(spark, docs.coalesce(1), capacity=64, group=500)
    many = packing.pack_documents(spark, docs.repartition(7), capacity=64, group=500)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert one.select(F.shiftright("bin_id", 32)).distinct().count() > 5 and one.agg(F.sum("tokens")).first()[0] == 18_000


def test_fullest_completion():
    rng = random.Random(14)
    for _ in range(300):
        sizes = sorted((rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))), reverse=True)
        room = rng.randrange(1, 60)
        got = packing.fullest(sizes, list(range(len(sizes))), room)
        sums = {sum(x) for k in range(len(sizes) + 1) for x in itertools.combinations(sizes, k)}
        assert len(set(got)) == len(got) and sum(sizes[i] for i in got) == max(x for x in sums if x <= room)


def test_packing(spark, edge, none):
    rng = random.Random(4)

    def least(sizes, capacity):
        best = [len(sizes)]

        def go(i, rooms):
            if len(rooms) >= best[0] and i < len(sizes):
                return
            if i == len(sizes):
                best[0] = min(best[0], len(rooms))
                return
            for k in range(len(rooms)):
                if rooms[k] >= sizes[i]:
                    go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
            go(i + 1, [*rooms, capacity - sizes[i]])

        go(0, [])
        return best[0]

    for _ in range(60):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(0, 9))]
        bins = packing.pack(sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 20 for b in bins)
        assert len(bins) == least(sizes, 20)
    got = packing.pack_documents(spark, edge, capacity=50).collect()
    assert sum(r["tokens"] for r in got) == sum(len((t or "").split()) for _, t, _, _ in EDGE)
    held = Counter()
    for r in got:
        held[r["bin_id"]] += r["tokens"]
    assert max(held.values()) <= 50 and all(held[r["bin_id"]] == r["bin_tokens"] for r in got)
    assert packing.pack_documents(spark, none).count() == 0


def test_language(spark, edge, none):
    rng = random.Random(5)
    lists = {"aa": VOCABULARY[:90], "bb": [w[::-1] + "ß" for w in VOCABULARY[90:180]]}
    rows = [(i, words(rng, 40, lists[x]), x, f"s{i % 3}") for i in range(120) for x in [rng.choice(["aa", "bb"])]]
    train = docs_of(spark, rows)
    fresh = [(i, words(rng, 30, lists[x]), x, "s9") for i, x in enumerate(["aa", "bb"] * 20)]
    model = language_id.train(train)
    got = {r["doc_id"]: r for r in language_id.identify(spark, language_id.from_documents(docs_of(spark, fresh)).select("text", "doc_id", "markup", "suffix", "domain", "host"), model).collect()}
    assert sum(got[i]["lang"] == x for i, _, x, _ in fresh) >= 0.95 * len(fresh)
    junk = [(0, "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(200)), None, "s1")]
    assert language_id.keep_known(spark, docs_of(spark, rows + [(1000 + i, *x[1:]) for i, x in enumerate(junk)])).where("doc_id >= 1000").count() == 0
    assert language_id.keep_known(spark, train).count() == len(rows)
    kept = language_id.keep_known(spark, edge)
    assert kept.columns == edge.columns and kept.where("text is null or text = ''").count() == 0
    assert language_id.keep_known(spark, none).count() == 0
    # a page without text follows its markup and host
    q, ll, t = np.zeros((1, 2)), np.zeros((1, 2)), np.zeros(1)
    seen = {"suffix": np.array([[0.0, 9.0]]), "domain": np.array([[0.0, 9.0]]), "host": np.array([[0.0, 9.0]]), "markup": np.array([[1.0, 30.0]])}
    assert language_id.fuse(q, ll, t, seen, np.array([True]), np.array([50.0, 50.0]), 2).argmax() == 1


def test_mixing(spark, edge, none, no_labels):
    rng = random.Random(6)
    kinds = [VOCABULARY[:60], VOCABULARY[60:120], VOCABULARY[120:180]]
    rows, labels = [], []
    for i in range(900):
        k = i % 3
        rows.append((i, words(rng, 60, kinds[k] + VOCABULARY[180:220]), "en", "s"))
        if i < 600:
            labels.append((i, int(k == 0), int(k == 2)))
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, LABELS)
    out = mixing.mix_weights(spark, docs, lab).toPandas().set_index("doc_id")
    p = out[["p_good", "p_plain", "p_toxic"]].to_numpy()
    held = np.arange(600, 900)
    assert (out.loc[held, ["p_good", "p_plain", "p_toxic"]].to_numpy().argmax(1) == held % 3).mean() > 0.95
    got = (out["rate"].to_numpy()[:, None] * out["n_tokens"].to_numpy()[:, None] * p).sum(0)
    assert np.abs(got / got.sum() - [0.90, 0.07, 0.03]).max() < 0.01 and (out["rate"] >= 0).all()
    assert mixing.mix(spark, docs, lab).count() == out["copies"].sum()
    assert mixing.mix(spark, edge, no_labels).count() == len(EDGE) and mixing.mix_weights(spark, edge, no_labels).count() == len(EDGE)
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], LABELS)
    assert mixing.mix_weights(spark, edge, some).count() == len(EDGE) and mixing.mix(spark, edge, some).columns == edge.columns
    assert mixing.mix(spark, none, some).count() == 0
    # a domain without any label takes nothing from the others
    m = mixing.fit_classifier(spark, docs, lab.where("toxic = 0"))
    raw = [t.encode() for _, t, _, _ in rows[600:]]
    slots = mixing._slots(mixing.Words(marks=True), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    p = m.posteriors(m.scores(*slots, 300))
    assert (p[held % 3 < 2, :2].argmax(1) == held[held % 3 < 2] % 3).mean() > 0.95 and np.isfinite(p).all()
    # conflicting labels: toxic counts before plain, plain before good, in any order
    a, b = (mixing.fit_classifier(spark, docs, lab.unionByName(lab.where("toxic = 1").withColumns({"toxic": F.lit(0), "quality": F.lit(1)})).orderBy(F.rand(k))) for k in (1, 2))
    assert (a.log_word == b.log_word).all() and (a.tells == b.tells).all()


def test_mixing_rates_are_least_squares(spark):
    """The distributed descent against a dense one over documents, in the same metric."""
    rng = np.random.default_rng(3)
    p = np.rint(rng.dirichlet([0.4, 0.4, 0.4], 60) * mixing.GRID)
    n = rng.integers(1, 500, 60)
    grid = spark.createDataFrame([(int(m), *map(int, x)) for m, x in zip(n, p)], "n_tokens bigint, p_good int, p_plain int, p_toxic int").coalesce(1)
    for targets, budget in (({"good": 0.6, "plain": 0.25, "toxic": 0.15}, None), ({"good": 0.8, "plain": 0.1, "toxic": 0.1}, 6000.0)):
        steps, aim, got = mixing.solve(spark, grid, targets, budget)
        q = p / mixing.GRID
        A = (q * n[:, None]).T
        scale = np.maximum(aim, 0.01 * A.sum(1))
        loss = lambda w: float((((A @ w - aim) ** 2) / scale).sum())
        w = np.ones(60)
        size = 1 / np.linalg.eigvalsh((A / n) @ A.T / np.sqrt(scale)[:, None] / np.sqrt(scale)[None])[-1]
        for _ in range(60_000):
            w = np.maximum(0, w - size * (q @ ((A @ w - aim) / scale)))
        mine = mixing.rates(q, steps)
        assert (mine >= 0).all() and np.abs(A @ mine - got).max() < 1e-6 * got.sum()
        assert loss(mine) <= loss(w) + 1e-3 * (loss(np.ones(60)) - loss(w)) + 1e-6 * aim.sum()


def test_toxicity(spark, edge, none, no_labels):
    rng = random.Random(7)
    bad = ["wretchling", "gutterfool", "nastyface"]
    rows, labels = [], []
    for i in range(1500):
        t = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(80)]
        if i % 4 == 0:
            for _ in range(3):
                t[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(t), "en", "s"))
        if i < 1100:
            labels.append((i, 1, int(i % 4 == 0)))
    out = toxicity.score(spark, docs_of(spark, rows), spark.createDataFrame(labels, LABELS)).toPandas().set_index("doc_id")
    held = np.arange(1100, 1500)
    flag = out.loc[held, "toxic"].to_numpy()
    assert flag[held % 4 == 0].mean() > 0.9 and flag[held % 4 > 0].mean() < 0.05
    got = toxicity.score(spark, edge, no_labels)
    assert got.count() == len(EDGE) and got.where("toxic").count() == 0
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 0), (None, 1, 1)], LABELS)
    assert toxicity.score(spark, edge, some).where("toxic and n_windows = 0").count() == 0 and toxicity.score(spark, none, some).count() == 0
    t = b"Ab, c!  d e f g"
    raw, lo, hi, text = toxicity.windows(np.frombuffer(t, np.uint8), np.array([0, 3, 3, len(t)]), 2, 1)
    assert [raw[a:b].tobytes() for a, b in zip(lo, hi)] == [b" ab ", b" c d ", b" d e ", b" e f ", b" f g "] and text.tolist() == [0, 2, 2, 2, 2]


def test_toxicity_scores_are_compressed_lengths(spark):
    """Every window compressed by itself, and every run of windows tried."""
    rng = random.Random(15)
    rows = [(i, " ".join([*(rng.choice(VOCABULARY) for _ in range(30)), *(["Wretchling!"] * (i % 3 == 0)), *(rng.choice(VOCABULARY) for _ in range(10))]), "en", "s") for i in range(240)]
    docs, labels = docs_of(spark, rows + [(500, None, "en", "s"), (501, "  ?", "en", "s"), (502, "wretchling", "en", "s")]), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], LABELS)
    sent, llr, usual, least = toxicity.train(spark, docs, labels)
    ordinary, toxic = (toxicity.compressor(x) for x in sent.value[toxicity.PARTS])
    assert b"wretchling" in sent.value[toxicity.PARTS][1][-40:]
    got = {r["doc_id"]: r for r in toxicity.score(spark, docs, labels).collect()}
    for i, t, *_ in rows[::20] + [(500, "", 0, 0), (501, "  ?", 0, 0), (502, "wretchling", 0, 0)]:
        w = "".join(ch.lower() if ch.isalnum() else " " for ch in t).split()
        cuts = [w[k : k + toxicity.WINDOW] for k in range(0, max(1, len(w) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)] if w else []
        raw = [(" " + " ".join(x) + " ").encode() for x in cuts]
        points = [llr[len(ordinary.compress(x)) - len(toxic.compress(x)) + toxicity.MOST] for x in raw]
        best = max([0.0, *(sum(points[a:b]) for a in range(len(points)) for b in range(a + 1, len(points) + 1))])
        want = best - math.log(max(1, len(points) / usual))
        assert got[i]["score"] == pytest.approx(want) and got[i]["n_windows"] == len(cuts) and got[i]["toxic"] == (want > least)


def test_toxicity_is_fitted_on_all_labels(spark):
    """More ordinary documents than a sample had: ratios and threshold are those of all."""
    rng = random.Random(21)
    rows = [(i, " ".join([words(rng, rng.randrange(4, 30), VOCABULARY), *(["wretchling"] * (i % 32 == 0))]), "en", "s") for i in range(12_800)]
    docs = docs_of(spark, rows)
    sent, llr, usual, least = toxicity.train(spark, docs, spark.createDataFrame([(i, 1, int(i % 32 == 0)) for i in range(12_800)], LABELS))
    part = dict(docs.select("doc_id", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(toxicity.PARTS))).collect())
    pairs = [[toxicity.compressor(x) for x in sent.value[k]] for k in range(toxicity.PARTS)]
    counts, runs = np.zeros((2, 2 * toxicity.MOST + 1)), []
    for i, t, *_ in rows:
        d, _ = toxicity.differences(*pairs[part[i]], np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        np.add.at(counts[int(i % 32 == 0)], d + toxicity.MOST, 1)
        runs += [d] if i % 32 else []
    assert np.allclose(llr, toxicity.log_ratios(counts)) and usual == np.median([len(d) for d in runs])
    best = np.array([toxicity.best_runs(llr[d + toxicity.MOST], np.zeros(len(d), int), 1)[0] for d in runs])
    n = np.array([len(d) for d in runs])
    assert least == pytest.approx(max(1.0, np.quantile(toxicity.corrected(best, n, usual), 1 - toxicity.FALSE_ALARMS)))


def test_toxicity_originals(spark):
    rng = random.Random(22)
    rows = [(n, rng.randrange(60), rng.randrange(3), [rng.randrange(150) * 4 + k for k in (1, 2, 3)]) for n in range(150)]
    seen, want = set(), set()
    for n, *_, keys in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if not seen & set(keys):
            want.add(n)
            seen |= set(keys)
    got = [r[0] for r in toxicity.originals(spark, spark.createDataFrame(rows, "n bigint, u bigint, h bigint, keys array<bigint>")).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) < 100


def test_toxicity_of_long_documents(spark):
    rng = random.Random(11)
    bad = ["wretchling", "gutterfool", "nastyface"]
    ordinary = lambda n: [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n)]
    rows = [(i, " ".join(ordinary(80) + [rng.choice(bad) for _ in range(3 * (i % 4 == 0))]), "en", "s") for i in range(1500)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1500)], LABELS)
    for k, n in enumerate((200, 2000, 20_000)):
        for j in range(20):
            t = ordinary(n)
            rows.append((10_000 * (k + 1) + j, " ".join(t), "en", "s"))
            passage = [w for b in bad * 2 for w in (b, *ordinary(3))]  # the same few insults at any length
            rows.append((10_000 * (k + 1) + 1000 + j, " ".join(t[: n // 2] + passage + t[n // 2 :]), "en", "s"))
    flag = toxicity.score(spark, docs_of(spark, rows), labels).toPandas().set_index("doc_id")["toxic"].sort_index()
    for k in (10_000, 20_000, 30_000):
        assert flag.loc[k + 1000 : k + 1019].mean() >= 0.95 and flag.loc[k : k + 19].mean() <= 0.1
    assert toxicity.best_runs(np.array([-1.0, 2, -0.5, 3, -9, 4, -1]), np.array([0, 0, 0, 0, 0, 2, 2]), 3).tolist() == [4.5, 0, 4]


def test_ctw(spark, edge, none):
    texts = ["abracadabra", "banana band", "", "é abra", None, "a", "a"]
    got = {r["doc_id"]: r for r in ctw.score(spark, docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    D = ctw.DEPTH
    count = defaultdict(lambda: [0, 0])

    def decisions(t):
        b = b"\0" * D + (t or "").encode()
        for i in range(D, len(b)):
            for k in range(8):
                yield b[i - D : i], (1 << k) | (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1

    path = lambda c, node: [(node, c[D - d :]) for d in range(D + 1)]
    for t in texts:
        for c, node, bit in decisions(t):
            for x in path(c, node):
                count[x][bit] += 1
    below = defaultdict(list)
    for node, c in count:
        if c:
            below[node, c[1:]].append((node, c))
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def weighted(x):
        return kt(count[x]) if len(x[1]) == D else math.log(0.5) + np.logaddexp(kt(count[x]), sum(map(weighted, below[x])))

    def predicted(c, node):
        q = None
        for x in path(c, node)[::-1]:
            p = (count[x][1] + 0.5) / (sum(count[x]) + 1)
            w = 1 if q is None else 1 / (1 + math.exp(sum(map(weighted, below[x])) - kt(count[x])))
            q = w * p + (1 - w) * (q or 0)
        return q

    for i, t in enumerate(texts):
        bits = sum(-math.log2(q if bit else 1 - q) for c, node, bit in decisions(t) for q in [predicted(c, node)])
        assert got[i]["bits"] == pytest.approx(bits, abs=1e-4) and got[i]["n_bytes"] == len((t or "").encode())
        assert (got[i]["bits_per_byte"] is None) == (not t)
    out = ctw.score(spark, edge)
    assert out.count() == len(EDGE) and out.where("n_bytes = 300000 and bits_per_byte < 1").count() == 1
    assert ctw.score(spark, none).count() == 0 and ctw.score(spark, docs_of(spark, [(1, None, "en", "s"), (2, "", "en", "s")])).count() == 2


def test_licences(spark, edge, none):
    rng = random.Random(8)
    for _ in range(100):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        sam, t = licenses.Automaton(seqs), [rng.randrange(4) for _ in range(25)]
        for i, (v, n) in enumerate(sam.statistics(t)):
            found = [(k, a + m) for m in range(i + 2) for k, s in enumerate(seqs) for a in range(len(s) - m + 1) if m and s[a : a + m] == t[i + 1 - m : i + 1]]
            assert n == max([m for m in range(i + 2) if any(s[a : a + m] == t[i + 1 - m : i + 1] for s in seqs for a in range(len(s) - m + 1))])
            assert not n or sam.ends[v] == sorted({x for x in found if x[1] - n >= 0 and seqs[x[0]][x[1] - n : x[1]] == t[i + 1 - n : i + 1]})
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    rows = [(1, "foo " * 50 + mit.replace("merge,", "fuse,") + " bar", "en", "s"), (2, "x. Released under the MIT License.\nmore", "en", "s"), (3, "nothing of the kind under the sun", "en", "s"), (4, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "en", "s")]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs_of(spark, rows)).collect())
    assert got == [(1, "MIT"), (2, "MIT"), (4, "Apache-2.0"), (4, "CC-BY-NC-4.0")]
    one = licenses.scan(docs_of(spark, rows[:1])).first()
    assert one["first_token"] == 50 and one["coverage"] > 0.98
    assert licenses.scan(edge).count() == 0 == licenses.scan(none).count()


def test_licence_bodies_and_chains(spark):
    bodies = [(n, t) for n, t in licenses.TEMPLATES if len(t) > 5000]
    assert {n for n, _ in bodies} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"}
    rows = [(i, "words before " * 9 + t.replace("\n", "\n * ") + " words after", "en", "s") for i, (_, t) in enumerate(bodies)]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, rows)).where("coverage > 0.95").collect()}
    assert all(got[i]["license"] == n and got[i]["first_token"] == 18 for i, (n, _) in enumerate(bodies))
    rng = random.Random(16)
    gap = licenses.GAP
    for _ in range(300):
        found = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(4, 9)) for _ in range(rng.randrange(1, 8))})

        def longest(path, n):
            best = n
            x, y, m = path[-1]
            for a, b, k in found:
                over = max(0, x + m - a, y + m - b)
                if a > x and b > y and over < k and a - x - m <= gap and b - y - m <= gap:
                    best = max(best, longest([*path, (a, b, k)], n + k - over))
            return best

        out = licenses.chains(found)
        assert max(n for _, _, n in out) == max(longest([f], f[2]) for f in found)
        assert all(lo < hi and 0 < n <= hi - lo for lo, hi, n in out)
    scan = licenses.Scanner([("A", "a b c d e f g h"), ("B", "c d e f g h i j k l m n")])
    assert scan.spans({0: [(0, 0, 8)], 1: [(2, 0, 6)]}) == [("A", 0, 8, 8, 1.0)]
    assert scan.spans({0: [(2, 2, 6)], 1: [(2, 0, 12)]}) == [("B", 2, 14, 12, 1.0)]


def png(px):
    raw = b"".join(bytes([2 * (y > 0)]) + (row.astype(int) - (px[y - 1] if y else 0)).astype(np.uint8).tobytes() for y, row in enumerate(px))
    part = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    h, w = px.shape
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\0\0\0\0") + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_media(spark):
    rng = np.random.default_rng(9)
    base = [np.rint(np.kron(rng.integers(0, 256, (12, 12)), np.ones((9, 9)))).astype(np.uint8) for _ in range(12)]
    px = {i: b for i, b in enumerate(base)}
    px |= {100 + i: b[10:100, 14:104] for i, b in enumerate(base)}  # cropped
    px |= {200 + i: np.rint(np.rot90(b) * 0.7 + 40).astype(np.uint8) for i, b in enumerate(base)}  # turned and edited
    half = {300 + i: np.rint(media._resized(base[i][None].astype(np.float32), 0.7071)[0]).astype(np.uint8) for i in range(12)}
    rows = [(i, png(p) if i % 2 else media.pgm(p)) for i, p in (px | half).items()] + [(400, png(base[1])), (401, png(base[1])), (402, None), (403, b""), (404, b"P5 junk"), (None, png(base[1])), (405, media.pgm(np.zeros((40, 40))))]
    assert (media.decode(png(base[0])) == base[0]).all() and (media.decode(media.pgm(base[0])) == base[0]).all() and media.decode(b"P5 junk") is None
    whole = png(base[0])
    palette = whole.replace(b"\x08\0\0\0\0", b"\x08\x03\0\0\0")
    huge = whole[:16] + (60_000).to_bytes(4, "big") * 2 + whole[24:]
    for bad in (whole[:8], whole[:20], whole[:40], palette, huge, whole[:33], whole[:60] + b"\xff" * 40, b"P6 3 3 255\n"):
        assert media.decode(bad) is None
    df = spark.createDataFrame(rows, "image_id bigint, image binary").withColumn("id", F.lit("x"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in media.copies(spark, df).collect():
        assert r["image_id"] % 100 == r["copy_of"] % 100 or r["image_id"] in (400, 401)
        parent[root(r["image_id"])] = root(r["copy_of"])
    assert np.mean([root(i) == root(k + i) for i in range(12) for k in (100, 200)]) >= 0.9  # measured: 22 of 24
    assert np.mean([root(i) == root(300 + i) for i in range(12)]) >= 0.5
    assert root(400) == root(1) == root(401) and 405 not in parent
    assert media.copies(spark, df.limit(0)).count() == 0
    names = df.where("image_id in (0, 1, 200, 201, 400)").withColumn("image_id", F.concat(F.lit("p"), F.lpad("image_id", 4, "0")))
    assert {tuple(r)[:2] for r in media.copies(spark, names).collect()} >= {("p0200", "p0000"), ("p0400", "p0001")}
    assert media.render(np.arange(20.0)).shape == (64, 24)


def test_media_pairs_are_all_pairs(spark, monkeypatch):
    """Sixty pictures share a pattern: every two of them are judged, whatever lies between them in a bucket."""
    rng = np.random.default_rng(3)
    shared, px = rng.integers(0, 256, (6, 6)), {}
    for i in range(60):
        cells = rng.integers(0, 256, (11, 11))
        if i < 50:
            cells[i % 5 : i % 5 + 6, i % 4 : i % 4 + 6] = shared
        px[7 * i - 100] = np.rint(np.kron(cells, np.ones((9, 9)))).astype(np.uint8)
    seen = {i: media.corners(p[None])[1:] for i, p in px.items()}
    want = {}
    for i, j in itertools.combinations(sorted(px), 2):
        (p, a), (q, b) = seen[i], seen[j]
        key = [media._ORDER[t * media.KEY_BITS : (t + 1) * media.KEY_BITS] for t in range(media.TABLES)]
        far = media._ORDER[media.TABLES * media.KEY_BITS :][:64]
        near = np.any([(a[:, None, k] == b[None, :, k]).all(2) for k in key], 0) & ((a[:, None, far] != b[None, :, far]).sum(2) <= media.HAMMING)
        x, y = np.nonzero(near)
        if len(x) >= media.INLIERS and (one := media.agree(np.stack([p[x], q[y]], 1))):
            want[j, i] = one[0]
    assert len(want) >= 50 * 49 // 2
    df = spark.createDataFrame([(i, media.pgm(p)) for i, p in px.items()], "image_id bigint, image binary")
    for size in (150_000, 500):  # one group, and several
        monkeypatch.setattr(media, "GROUP_CORNERS", size)
        got = media.copies(spark, df).collect()
        assert {(r["image_id"], r["copy_of"]): r["inliers"] for r in got} == want and len(got) == len(want)
    links = Counter(x for pair in want for x in pair)
    got = {r["image_id"]: r for r in media.classes(spark, df).collect()}
    assert set(got) == set(px) and all(r["links"] == links[i] for i, r in got.items())
    assert all(got[7 * i - 100]["class_id"] == -100 for i in range(50)) and all(r["class_id"] == i for i, r in got.items() if i not in links)


def test_media_join_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    rows = np.stack([np.repeat(np.arange(40), 25), np.arange(1000), *rng.integers(0, 4, (2, 1000)), rng.integers(0, 1 << 12, 1000)])
    a, b = media.Corners.of(rows[:, rows[0] % 2 == 0]), media.Corners.of(rows[:, rows[0] % 2 == 1])

    def met(a, b, own):
        return {(*p, *sorted(map(tuple, x[lo:hi].tolist()))) for ids, cut, x in media.joined(a, b, own) for p, lo, hi in zip(ids.tolist(), cut[:-1], cut[1:])}

    whole = met(a, b, False), met(a, a, True)
    assert len(whole[0]) == 400 and len(whole[1]) == 190 and all(x[0] < x[1] for w in whole for x in w)
    monkeypatch.setattr(media, "BUDGET", 50)
    assert (met(a, b, False), met(a, a, True)) == whole


def test_media_agreement_of_many_pictures():
    rng = np.random.default_rng(4)
    for m in (4, 7, 30):
        at = rng.integers(0, 12, (40, m, 2, 2))
        at[::2, :, 1] = at[::2, :, 0] + 3  # shifted
        pairs = at[..., 0] << 24 | at[..., 1] << 8 | rng.integers(0, 2, (40, m, 2)) << 2
        got = zip(*media.agree_all(pairs))
        assert [tuple(x) if x[0] else None for x in got] == [media.agree(p) for p in pairs]


def test_pipeline(spark, edge, none, tmp_path):
    """Every stage against its own account of rows, on a table whose groups are known."""
    import corpus_pipeline as cp

    rng = random.Random(17)
    lists = {"aa": VOCABULARY[:300], "bb": [w[::-1] + "q" for w in VOCABULARY[300:600]]}
    texts = [words(rng, 80, lists[x]) for x in ("aa", "bb") * 60]
    rows = [(i, t, ("aa", "bb")[i % 2], f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(200 + i, texts[i], ("aa", "bb")[i % 2], "s1") for i in range(30)]  # equal texts
    rows += [(300 + i, texts[i] + " " + lists["aa"][i], ("aa", "bb")[i % 2], "s2") for i in range(20)]  # near ones
    rows += [(400, None, None, None), (401, "", "aa", "s"), (402, "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(300)), None, "s9")]
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(120)] + [(5, 0, 1)], LABELS)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    kept = docs
    want = [sorted(r[0] for r in rows[:170]), list(range(120)) + list(range(300, 320)), list(range(120))]
    for (name, stage), w in zip(cp.STAGES[:3], want):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns and ids(out) == w, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_weights(spark, kept, labels).collect()}
    mixed = cp.STAGES[3][1](spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and Counter(ids(mixed)) == Counter({i: n for i, n in copies.items() if n})
    packed = cp.run(spark, str(tmp_path)).collect()
    assert Counter({i: sum(r["tokens"] for r in packed if r["doc_id"] == i) for i in {r["doc_id"] for r in packed}}) == Counter({i: 80 * n for i, n in copies.items() if n})
    for name, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        got = stage(spark, edge, str(tmp_path))
        assert name == "best_fit_packing" or got.columns == edge.columns
        got.count()
