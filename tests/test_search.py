import hashlib
import json
import math

import pytest

import __spark_entry__ as entry
from conftest import workspace
from loamdex.errors import BackendKindError, BackendNotFound, BackendUnavailable, IndexVersionError
from loamdex.plans.query import Query
from loamdex.search import backends, config, rank, registry

DOCS = {"a.md": ({"title": "Candles", "tags": ["Blue"]}, "All about café candles and wicks."), "b.md": ({"title": "Lanterns", "owner": "Ann"}, "Lanterns turn wicks, wicks, wicks."), "c.md": ({}, "Nothing else."), "d.md": ({"title": " "}, "")}


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, DOCS)


def ids(hits):
    return [r.packet_id for r in hits.collect()]


def test_grep(ws):
    assert ids(registry.search(ws, "WICKS")) == ["a.md", "b.md"] and ids(registry.search(ws, "WICKS", options={"case_sensitive": True})) == []
    assert ids(registry.search(ws, "ann")) == ["b.md"] and ids(registry.search(ws, "blue")) == ["a.md"]
    assert ids(registry.search(ws, r"wicks[.,]", options={"regex": True}, k=1)) == ["a.md"]
    assert ids(registry.search(ws, "")) == [] and ids(registry.search(ws, "wicks", k=0)) == []
    for bad in ({"nope": 1}, {"regex": True}):
        with pytest.raises(ValueError):
            registry.search(ws, "(", options=bad)
    assert Query(ws).search("wicks").where(title__startswith="C").ids() == ["a.md"]


def test_registry(ws):
    with pytest.raises(BackendNotFound):
        registry.search(ws, "x", index="nope")
    with pytest.raises(BackendKindError):
        registry.build(ws, ws.packets, index="grep")
    with pytest.raises(BackendKindError):
        registry.search(ws, "x", location="/tmp/x")

    class Fixed:
        name = "fixed"

        def query(self, text, ws, *, k=10, options=None):
            return ws.packets.selectExpr("packet_id", "1.0 score", "'' snippet").limit(1)

        def info(self):
            return backends.BackendInfo("fixed", "1", "scan")

    backends.register(Fixed())
    assert len(ids(registry.search(ws, "x", index="fixed"))) == 1 and not backends.is_indexed(backends.backend("fixed"))
    backends.clear()
    assert "fixed" not in backends.discover()


def test_rrf(spark):
    one = spark.createDataFrame([("p", 9.0), ("q", 8.0), ("r", 7.0), ("s", 6.0)], "packet_id string, score double")
    two = spark.createDataFrame([("s", 0.5), ("q", 0.4)], "packet_id string, score double")
    got = [(r.packet_id, r.score) for r in rank.ranked(rank.rrf(one, two), None).collect()]
    assert got == [("q", pytest.approx(2 / 62)), ("s", pytest.approx(1 / 64 + 1 / 61)), ("p", pytest.approx(1 / 61)), ("r", pytest.approx(1 / 63))]


def test_all_queries_and_backends_are_fused(spark, tmp_path):
    hits = [(1, "bm25", "a", 2.0), (1, "dense", "b", 9.0), (2, "regex", "a", 1.0), (2, None, "a", 5.0), (2, "regex", "c", 3.0), (2, "regex", "c", None)]
    spark.createDataFrame(hits, "query_id long, backend string, packet_id string, score double").write.parquet(str(tmp_path / "search_hits.parquet"))
    got = {(r.query_id, r.packet_id): r.score for r in entry.queries()["rrf_fusion"](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in {(1, "a"): 1 / 61, (1, "b"): 1 / 61, (2, "a"): 1 / 62 + 1 / 61, (2, "c"): 1 / 61}.items()}


def test_all_runs_are_compared(spark, tmp_path):
    spark.createDataFrame([("a", "X"), ("b", "y")], "packet_id string, content_hash string").write.parquet(str(tmp_path / "packets.parquet"))
    spark.createDataFrame([("a", "x", 1), ("b", "z", 1), ("b", "y", 2), ("c", "q", 2)], "packet_id string, content_hash string, run_id long").write.parquet(str(tmp_path / "packet_index.parquet"))
    got = entry.queries()["index_diff"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "b", "changed"), (2, "a", "new"), (2, "c", "removed")]


def test_hash_of_whole_documents(spark, tmp_path):
    long = "x" * 50_000
    docs = [(1, " T ", "\u00a0 a\tb \n\u2028"), (2, None, None), (3, " ", ""), (4, "T", long + "1"), (5, "T", long + "2"), (6, "", " \r\n")]
    spark.createDataFrame(docs, "doc_id long, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.packet_id: r.hash for r in entry.queries()["document_hash"](spark, str(tmp_path)).collect()}
    want = {"1": "T\n\na\tb", "2": "", "3": "", "4": f"T\n\n{long}1", "5": f"T\n\n{long}2", "6": ""}
    assert got == {k: hashlib.sha256(f"title\n{t}".encode()).hexdigest() for k, t in want.items()}


def test_bm25_against_plain_formula(spark):
    texts = {"1": "the cat sat", "2": "the dog and the cat and the cat", "3": "", "4": "naïve dog"}
    docs = spark.createDataFrame(list(texts.items()), "packet_id string, text string")
    s = rank.corpus_stats(docs).first()
    got = {r.packet_id: r.score for r in rank.bm25(rank.postings(docs), ["cat", "naive", "cat"], s.n, s.mean).collect()}
    split = {k: t.replace("ï", "i").split() for k, t in texts.items()}
    mean = sum(map(len, split.values())) / 4

    def score(w):
        total = 0
        for q in ("cat", "naive"):
            df, tf = sum(q in x for x in split.values()), w.count(q)
            total += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return total

    assert got == {k: pytest.approx(score(w)) for k, w in split.items() if score(w)}


def test_nearest(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0]), ("c", [2.0, 0.1]), ("d", [1.0]), ("e", None)], "packet_id string, embedding array<float>")
    assert ids(rank.nearest(v, [1.0, 0.0], 2)) == ["a", "c"] and ids(rank.nearest(v, [0.0, 1.0], 1, metric="cosine")) == ["b"]


def test_hybrid_index(ws, tmp_path):
    at = str(tmp_path / "index")
    s = registry.build(ws, ws.packets, index="hybrid", location=at)
    assert (s.packets_indexed, s.packets_skipped, s.packets_removed) == (4, 0, 0)
    assert ids(registry.search(ws, "wicks", index="hybrid", location=at, options={"sparse_only": True})) == ["b.md", "a.md"]
    assert len(ids(registry.search(ws, "wicks", index="hybrid", location=at))) == 4
    assert len(ids(registry.search(ws, "wicks", index="hybrid", location=at, k=2, options={"dense_only": True}))) == 2
    assert ids(registry.search(ws, " ", index="hybrid", location=at)) == []
    s = registry.build(ws, ws.packets.filter("packet_id != 'c.md'"), index="hybrid", location=at)
    assert (s.packets_indexed, s.packets_skipped, s.packets_removed) == (0, 3, 1)
    config.RERANKERS["by_length"] = lambda q, docs: [len(d) for d in docs]
    assert ids(registry.search(ws, "wicks", index="hybrid", location=at, options={"reranker": "by_length", "sparse_only": True, "reranker_top_n": 1})) == ["b.md"]
    assert ids(registry.search(ws, "wicks", index="hybrid", location=at, options={"reranker": "gone", "sparse_only": True})) == ["b.md", "a.md"]
    with pytest.raises(BackendUnavailable):
        registry.search(ws, "wicks", index="hybrid", location=at, options={"reranker": "gone", "rerank_required": True})
    with pytest.raises(FileNotFoundError):
        registry.search(ws, "wicks", index="hybrid", location=at + "x")
    config.EMBEDDERS["other"] = config.hash_embedder
    with pytest.raises(BackendUnavailable):
        registry.build(ws, ws.packets, index="hybrid", location=at, options={"model": "other"})
    assert registry.build(ws, ws.packets, index="hybrid", location=at, options={"model": "other", "force": True}).packets_indexed == 4
    meta = json.loads((tmp_path / "index" / "current.json").read_text())
    (tmp_path / "index" / "current.json").write_text(json.dumps(meta | {"format": 9}))
    with pytest.raises(IndexVersionError):
        registry.search(ws, "wicks", index="hybrid", location=at, options={"sparse_only": True})
    assert backends.backend("hybrid").info(at).metadata["format"] == 9 and backends.backend("hybrid").info("/nowhere").metadata == {}


def test_failed_build_keeps_the_index(ws, tmp_path):
    at = str(tmp_path / "index")
    registry.build(ws, ws.packets.limit(2), index="hybrid", location=at)

    def broken(texts):
        raise RuntimeError("service gone")

    config.EMBEDDERS["hash"], kept = broken, config.EMBEDDERS["hash"]
    try:
        with pytest.raises(Exception, match="service gone"):
            registry.build(ws, ws.packets, index="hybrid", location=at)
    finally:
        config.EMBEDDERS["hash"] = kept
    assert registry.build(ws, ws.packets, index="hybrid", location=at).packets_skipped == 2


def test_config(tmp_path):
    (tmp_path / "env").write_text("LOAMDEX_BATCH_SIZE=7\nLOAMDEX_MODEL=x\n")
    c = config.resolve({"env": str(tmp_path / "env"), "model": "y", "fields": "a, b"}, "build", environ={"LOAMDEX_MAX_TOKENS": "5", "LOAMDEX_BATCH_SIZE": "3"})
    assert (c.batch_size, c.model, c.max_tokens, c.fields) == (7, "y", 5, ("a", "b"))
    for options, kind in (({"nope": 1}, "build"), ({"fetch_k": 1}, "build"), ({"fetch_k": "x"}, "query"), ({"dense_only": "maybe"}, "query"), ({"dense_only": True, "sparse_only": 1}, "query")):
        with pytest.raises(config.ConfigError):
            config.resolve(options, kind, environ={})


def test_own_backends_keep_the_contract(spark, tmp_path):
    from loamdex.search import conformance

    conformance.check_scan(backends.backend("grep"), spark)
    conformance.check_index(backends.backend("hybrid"), spark, str(tmp_path / "index"))

    class Careless:
        name = "careless"

        def query(self, text, ws, *, k=10, options=None):
            return ws.packets.selectExpr("packet_id", "1.0D score", "cast(null as string) snippet")

        def info(self, location=None):
            return backends.BackendInfo("careless", "1", "scan")

    with pytest.raises(AssertionError):
        conformance.check_scan(Careless(), spark)
