"""The published conformance cases, in memory and on disk, and rules of the catalog."""

import asyncio
import math

import pytest
from pyspark.sql import functions as F

from pointlake import cli
from pointlake import errors as er
from pointlake.aio import Async
from pointlake.functions.filters import Filter
from pointlake.operators.lexical import Embedder
from pointlake.plans.catalog import Database, Point
from pointlake.sources import exchange, store
from pointlake.streaming.ingest import upsert_stream


@pytest.fixture(params=["memory", "file"])
def db(request, spark, tmp_path):
    d = Database.memory(spark) if request.param == "memory" else Database.open(spark, str(tmp_path / "db"), durability="full")
    yield d
    d.close()


def line(db):
    c = db.create_collection("c", 1, metric="euclidean", quantization_bits=0)
    payloads = [{"lang": "en", "year": 2020}, {"lang": "en", "year": 2022}, {"lang": "fr", "year": 2021}, {"lang": "en", "year": 2023}, {"lang": "fr"}]
    c.upsert_batch(list("abcde"), [[float(i)] for i in range(5)], payloads)
    return c


def ids(hits):
    return "".join(h.id for h in hits)


def test_filters(db):
    c = line(db)
    s = lambda f: ids(c.search([0.0], filter=f))
    en = {"key": "lang", "match": {"value": "en"}}
    assert s({"must": [en]}) == "abd"
    assert s({"must": [{"key": "year", "range": {"gte": 2022}}]}) == "bd"
    assert s({"must_not": [en]}) == "ce"
    assert s({"should": [{"key": "lang", "match": {"value": "fr"}}, {"key": "year", "range": {"gte": 2023}}]}) == "cde"
    assert s({"must": [{"key": "year", "exists": True}]}) == "abcd"
    assert s({"must": [en, {"key": "year", "range": {"lt": 2023}}]}) == "ab"
    page = c.scroll(limit=100, filter={"must": [en]})
    assert [p.id for p in page.points] == list("abd") and page.next_cursor is None
    with pytest.raises(er.InvalidArgument):
        s({"must": [{"key": "x", "geo_radius": {}}]})


def test_hybrid(db):
    c = db.create_collection("c", 1, metric="euclidean", quantization_bits=0)
    for i, x in enumerate("abcdef"):
        c.upsert(x, [i + 1.0], sparse={"indices": [0], "values": [6.0 - i]} if i > 1 else None)
    hits = c.hybrid_search([0.0], {"indices": [0], "values": [1.0]}, limit=6)
    assert ids(hits) == "cdefab"
    assert [h.score for h in hits] == pytest.approx([0.0161332, 0.0158770, 0.0156288, 0.0153883, 0.0081967, 0.0080645], abs=1e-6)
    d = db.create_collection("d", 1, metric="euclidean")
    for i, x in enumerate("xyz"):
        d.upsert(x, [i + 1.0], sparse={"indices": [0], "values": [i + 1.0]})
    q = {"indices": [0], "values": [1.0]}
    assert ids(d.hybrid_search([0.0], q, alpha=0.1, limit=3)) == "zyx"
    assert ids(d.hybrid_search([0.0], q, alpha=0.9, limit=3)) == "xyz"
    assert ids(d.search_sparse(q)) == "zyx" == ids(d.hybrid_search(sparse=q))
    assert ids(d.hybrid_search([0.0])) == "xyz"


def test_crud_and_scroll(db):
    c = db.create_collection("c", 2, metric="euclidean", quantization_bits=0)
    c.upsert("a", [1.0, 0.0], {"tag": "first"})
    c.upsert("b", [0.0, 1.0])
    assert len(c) == 2 and c.get("a") == Point("a", [1.0, 0.0], {"tag": "first"})
    assert c.delete("a") and c.get("a") is None and not c.delete("ghost") and len(c) == 1
    assert {k: c.stats()[k] for k in ("dimension", "len", "tombstones", "auto_embed")} == {"dimension": 2, "len": 1, "tombstones": 1, "auto_embed": False}
    c.upsert("b", [2.0, 0.0], {"w": 2})
    assert c.get("b").payload == {"w": 2}
    s = db.create_collection("s", 1, metric="euclidean")
    s.upsert_batch(list("abcde"), [[float(i)] for i in range(5)])
    page = s.scroll(limit=2)
    assert ([p.id for p in page.points], page.next_cursor) == (["a", "b"], "b")
    s.delete("b")
    page = s.scroll("b", 2)
    assert ([p.id for p in page.points], page.next_cursor) == (["c", "d"], "d")
    page = s.scroll("d", 2)
    assert ([p.id for p in page.points], page.next_cursor) == (["e"], None)
    assert s.delete_batch(["a", "a", "x"]) == 1


def test_defaults_and_errors(db):
    d = db.create_collection("d", 2, quantization_bits=0)
    d.upsert("near_angle", [10.0, 0.0])
    d.upsert("close_euclid", [1.0, 0.5])
    assert [(h.id, round(h.score, 6)) for h in d.search([1.0, 0.0], 2)] == [("near_angle", 1.0), ("close_euclid", 0.894427)]
    q = db.create_collection("q", 4, metric="euclidean")
    q.upsert("q", [0.1, 0.4, 0.7, 0.95])
    assert q.get("q").vector == pytest.approx([0.1, 0.4, 0.7, 0.95], abs=1e-6)
    for error, f in (
        (er.CollectionNotFound, lambda: db.collection("nope")),
        (er.AlreadyExists, lambda: db.create_collection("d", 2)),
        (er.DimensionMismatch, lambda: d.upsert("a", [1.0])),
        (er.DimensionMismatch, lambda: d.search([1.0], 1)),
        (er.UnsupportedProvider, lambda: db.create_collection("t", 64, embedding_provider="not_a_provider")),
        (er.InvalidArgument, lambda: d.upsert("z", [0.0, 0.0])),
        (er.InvalidArgument, lambda: d.upsert("z", [math.nan, 0.0])),
        (er.InvalidArgument, lambda: d.upsert("z", [1.0, 0.0], {"_x": 1})),
        (er.InvalidArgument, lambda: d.upsert("", [1.0, 0.0])),
        (er.InvalidArgument, lambda: d.search([1.0, 0.0], 0)),
        (er.InvalidArgument, lambda: d.search([0.0, 0.0])),
        (er.InvalidArgument, lambda: d.search([1.0, 0.0], ef_search=5000)),
        (er.InvalidArgument, lambda: d.hybrid_search()),
    ):
        with pytest.raises(error):
            f()


def test_text(db):
    c = db.create_collection("docs", 128, embedding_provider="bm25")
    for i, t in enumerate(["the quick brown fox jumps", "a lazy dog sleeps all day", "the quick fox runs fast"]):
        c.upsert_text(f"d{i + 1}", t)
    for _ in range(2):
        hits = c.search_text("quick fox", 3)
        assert [h.id for h in hits] == ["d1", "d3", "d2"]
        assert [h.score for h in hits] == pytest.approx([0.4132739, 0.4132739, 0.0], abs=1e-5)
        assert c.stats()["tombstones"] == 3 and c.stats()["auto_embed"]
    assert c.search_text("unheard") == []
    assert ids(c.hybrid_search(text="lazy dog", limit=1)) == "d2"


def test_aliases_rename_delete(db):
    for n in ("zeta", "alpha", "mu"):
        db.create_collection(n, 2)
    assert db.list_collections() == ["alpha", "mu", "zeta"]
    db.create_alias("nick", "mu")
    c = db.collection("nick")
    c.upsert("a", [1.0, 0.0])
    db.rename_collection("mu", "nu")
    assert db.aliases() == [("nick", "nu")] and len(c) == 1
    with pytest.raises(er.AlreadyExists):
        db.create_collection("nick", 2)
    db.delete_collection("nu")
    assert db.aliases() == [] and len(c) == 0
    with pytest.raises(er.CollectionNotFound):
        c.get("a")


class Length(Embedder):
    dimension = 2

    def embed(self, text):
        return [float(len(text)), 1.0]


def test_own_embedder(db):
    db.register_embedder("length", Length())
    with pytest.raises(er.AlreadyExists):
        db.register_embedder("bm25", Length())
    c = db.create_collection("c", 2, metric="euclidean", embedding_provider="length")
    c.upsert_text_batch([("a", "x"), ("b", "xxxx", {"k": 1})])
    assert ids(c.search_text("xxx")) == "ba" and c.get("b").payload == {"k": 1, "_text": "xxxx"}


def test_reopen_checkpoint_vacuum_snapshot(spark, tmp_path):
    root = str(tmp_path / "db")
    with Database.open(spark, root) as db:
        with pytest.raises(er.Locked):
            Database.open(spark, root)
        c = db.create_collection("c", 1, metric="euclidean", payload_indexes={"k": "integer"})
        c.upsert_batch(list("abcdef"), [[float(i)] for i in range(6)], [{"k": i} for i in range(6)])
        c.delete("b")
        t = db.create_collection("t", 64, embedding_provider="bm25")
        t.upsert_text_batch([("d1", "the quick brown fox"), ("d2", "a lazy dog")])
        before = t.search_text("quick dog")
    (tmp_path / "db" / "torn-part.parquet").write_bytes(b"half a file")
    with Database.open(spark, root) as db:
        c = db.collection("c")
        assert [p.id for p in c.scroll().points] == list("acdef") and c.scroll("b", 1).points[0].id == "c"
        assert [r[0] for r in c.live().where("pidx_k_integer >= 4").orderBy("id").select("id").collect()] == ["e", "f"]
        assert db.collection("t").search_text("quick dog") == before
        c.delete_where({"must": [{"key": "k", "range": {"lt": 3}}]})
        assert c.stats()["tombstones"] == 3
        db.vacuum()
        assert c.stats()["tombstones"] == 0 and ids(c.search([0.0])) == "def"
        db.snapshot(str(tmp_path / "copy"))
        with pytest.raises(er.AlreadyExists):
            db.snapshot(str(tmp_path / "copy"))
        data = db.serialize()
    assert store.verify(root) == [] and store.inspect(root)["collections"][0]["rows"] == 3
    with Database.open(spark, str(tmp_path / "copy"), read_only=True) as db:
        assert len(db.collection("c")) == 3
        with pytest.raises(er.ReadOnly):
            db.collection("c").upsert("z", [1.0])
    with Database.deserialize(spark, data, str(tmp_path / "again")) as db:
        assert ids(db.collection("c").search([5.0], 1)) == "f"
    part = next(p for p in (tmp_path / "copy").rglob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:-20])
    assert store.verify(str(tmp_path / "copy"))


def test_exchange(spark, tmp_path):
    with Database.memory(spark) as db:
        c = db.create_collection("docs", 64, embedding_provider="tfidf")
        c.upsert_text_batch([("a", "one fine morning"), ("b", "two fine evenings"), ("c", "nothing there")])
        want = c.search_text("fine morning")
        assert exchange.export_database(db, str(tmp_path / "out"))["collections"] == ["docs"]
        with Database.memory(spark) as other:
            assert exchange.import_database(str(tmp_path / "out"), other)["warnings"] == []
            got = other.collection("docs").search_text("fine morning")
            assert [(h.id, round(h.score, 5)) for h in got] == [(h.id, round(h.score, 5)) for h in want]
            with pytest.raises(er.InvalidArgument):
                exchange.import_database(str(tmp_path / "out"), other, ["nope"])


def test_frames_batches_and_streams(spark, tmp_path):
    with Database.memory(spark) as db:
        c = db.create_collection("c", 2, metric="euclidean")
        df = spark.range(50).selectExpr("cast(id as string) id", "array(cast(id as float), cast(0 as float)) vector", "to_json(struct(id as n)) payload", "id o")
        c.upsert_df(df, "o")
        assert ids(c.search([0.0, 0.0], 3, filter={"must": [{"key": "n", "range": {"gte": 7}}]})) == "789"
        got = c.search_batch([[0.0, 0.0], [49.0, 0.0]], 2).orderBy("qid", "rank").collect()
        assert [r["id"] for r in got] == ["0", "1", "49", "48"]
        with pytest.raises(er.InvalidArgument):
            c.upsert_df(spark.sql("select 'x' id, array(cast(1 as float)) vector"))
        df.where("o < 3").selectExpr("concat('s', id) id", "vector").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, vector array<float>").parquet(str(tmp_path / "in"))
        upsert_stream(stream, c, str(tmp_path / "cp"), once=True).awaitTermination(120)
        assert len(c) == 53


def test_random_operations_agree_with_a_dict(spark):
    import random

    rng = random.Random(5)
    with Database.memory(spark) as db:
        c, model = db.create_collection("c", 4, metric="euclidean"), {}
        for _ in range(25):
            if rng.random() < 0.7:
                pts = [(rng.choice("abcde"), [float(rng.randint(-9, 9)) for _ in range(4)]) for _ in range(rng.randint(1, 3))]
                c.upsert_points([Point(*p) for p in pts])
                model |= dict(pts)
            else:
                x = rng.choice("abcde")
                assert c.delete(x) == (model.pop(x, None) is not None)
        assert {r["id"]: list(r["vector"]) for r in c.live().collect()} == model


def test_indexes_prune_and_keep_every_match(spark, tmp_path):
    values = ['"x"', '"3"', "3", "3.0", "3.7", "-3.7", "1e3", "true", "null", "9223372036854775807", "1e30", "[3]"]
    with Database.open(spark, str(tmp_path / "db")) as db:
        c = db.create_collection("c", 1, metric="euclidean", payload_indexes={"k": "keyword", "n": "integer", "f": "float"})
        rows = [(str(i), [float(i)], f'{{"k": {v}, "n": {v}, "f": {v}}}' if i % 13 else None) for i, v in enumerate(values * 4)]
        c.upsert_df(spark.createDataFrame(rows, "id string, vector array<float>, payload string"))
        db.checkpoint()
        c.upsert("late", [0.5], {"k": "x", "n": 3, "f": 3})
        live = c.live().cache()
        for key in "knf":
            for test in ({"match": {"value": 3}}, {"match": {"value": "x"}}, {"match": {"any": ["x", "3"]}}, {"match": {"any": [3, 1000]}}, {"match": {"value": True}}, {"range": {"gte": 3.5}}, {"range": {"lt": -3.5}}, {"range": {"gt": 3, "lte": 4}}, {"range": {"gt": 1e18}}):
                f = Filter.from_json({"must": [{"key": key, **test}]})
                want = sorted(r[0] for r in live.where(f.compile(F.col("payload"))).select("id").collect())
                assert want == sorted(r[0] for r in c.matching(f).select("id").collect()), (key, test)
        live.unpersist()
        spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
        plan = c.matching(Filter.from_json({"must": [{"key": "f", "range": {"gte": 3}}]}))._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        assert "GreaterThanOrEqual(pidx_f_float,3.0)" in plan
        db.vacuum()
        assert sorted(r[0] for r in c.live().select("slot").collect()) == list(range(len(rows) + 1))


def test_command_line_and_asyncio(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    with Database.open(spark, root) as db:
        line(db)

        async def ask():
            a = Async(db)
            c = await a.collection("c")
            await c.upsert("f", [9.0])
            return ids(await c.search([9.0], 2)), await a.list_collections(), c.dimension

        assert asyncio.run(ask()) == ("fe", ["c"], 1)
    assert cli.main(["inspect", root]) == 0 and '"rows": 6' in capsys.readouterr().out
    assert cli.main(["verify", root]) == 0 == cli.main(["vacuum", root])
    assert cli.main(["export", root, str(tmp_path / "out"), "--collection", "c"]) == 0
    assert cli.main(["import", str(tmp_path / "new"), str(tmp_path / "out")]) == 0
    assert cli.main(["snapshot", root, str(tmp_path / "copy")]) == 0 and cli.main(["snapshot", root, str(tmp_path / "copy")]) == 1
    assert cli.main(["nonsense"]) == 2
    with Database.open(spark, str(tmp_path / "new"), read_only=True) as db:
        assert ids(db.collection("c").search([9.0], 1)) == "f"
    part = next((tmp_path / "copy").rglob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:-20])
    assert cli.main(["verify", str(tmp_path / "copy")]) == 3


def test_text_frames_are_embedded_without_a_shuffle(spark):
    with Database.memory(spark) as db:
        c = db.create_collection("docs", 128, embedding_provider="bm25")
        texts = [("d1", "the quick brown fox jumps", 1), ("d2", "a lazy dog sleeps all day", 0), ("d3", "the quick fox runs fast", 2), ("d4", "(...)", 3)]
        c.upsert_text_df(spark.createDataFrame(texts, "id string, text string, o int"), "o")
        c._append([c._row(Point("plain", [0.0] * 127 + [1.0]))])  # without a text
        for _ in range(2):
            c.refit()
            assert [h.id for h in c.search_text("quick fox", 5) if h.id in ("d1", "d3")] == ["d1", "d3"]
            plan = c.live()._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort" not in plan
        assert [p.id for p in c.scroll().points] == ["plain", "d2", "d1", "d3", "d4"]
        got = {p.id: p for p in c.scroll().points}
        assert got["plain"].vector == [0.0] * 127 + [1.0] and got["d4"].sparse == {"indices": [0], "values": [1.0]}
        assert got["d1"].vector == c.embed(texts[0][1]) and got["d1"].payload == {"_text": texts[0][1]}
        assert c.stats()["len"] == 5 and c.stats()["tombstones"] == 8
        c.upsert_text_df(spark.createDataFrame([("d2", "one"), ("d2", "two")], "id string, text string"))  # of equal ids one stays
        c.delete("d3")
        assert len(c) == 4 and c.get("d2").payload["_text"] in ("one", "two")
        for bad in ("select '' id, 'x' text", "select 'a' id, cast(null as string) text"):
            with pytest.raises(er.InvalidArgument):
                c.upsert_text_df(spark.sql(bad))
        want = {p.id: p.payload for p in c.scroll().points}
        db.vacuum()
        assert {p.id: p.payload for p in c.scroll().points} == want
        v = db.create_collection("v", 2)
        for bad in ("1, double('NaN')", "1, 1e39", "1, -1e39", "1, null", "0, -0D"):
            with pytest.raises(er.InvalidArgument):
                v.upsert_df(spark.sql(f"select 'x' id, cast(array({bad}) as array<float>) vector"))
