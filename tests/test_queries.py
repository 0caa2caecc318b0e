"""Order, groups, profile, references and patterns on small workspaces."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import workspace
from loamdex.errors import PatternError, QueryError
from loamdex.operators import graph
from loamdex.operators.aggregate import Avg, Count, Max, Min, Sum
from loamdex.operators.ordering import OrderKey, places
from loamdex.operators.pattern import PatternQuery
from loamdex.operators.profile import report, report_json, report_text
from loamdex.plans.query import Query, compile_query
from loamdex.sources import sinks


@pytest.fixture(scope="module")
def ring(spark):
    return workspace(spark, {k: ({"uuid": k, "next": v}, "") for k, v in {"a": "b", "b": "c", "c": "a", "d": "d", "e": ["b", "b"], "f": "gone"}.items()}, default_resolver=graph.FieldResolver("uuid"))


def test_order_places_nulls_and_types(spark):
    ws = workspace(spark, {"a": ({"k": 3}, ""), "b": ({"k": 1}, ""), "c": ({"k": "x"}, ""), "d": ({"k": True}, ""), "e": ({"k": dt.date(2026, 1, 1)}, ""), "f": ({"k": None}, ""), "g": ({}, ""), "h": ({"k": 1.0}, ""), "i": ({"k": [1]}, "")})
    q = Query(ws)
    assert q.order_by("k").ids() == ["d", "b", "h", "a", "e", "c", "i", "f", "g"]
    assert q.order_by("k", desc=True).ids() == ["f", "g", "i", "c", "e", "a", "b", "h", "d"]
    assert q.order_by("k", nulls="first").ids()[:2] == ["f", "g"]
    assert compile_query("* ORDER BY k DESC NULLS LAST", ws).ids()[-2:] == ["f", "g"]
    with pytest.raises(ValueError):
        OrderKey("k", nulls="middle")


def test_places_of_all_rows_over_partitions(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("packet_id"), (F.col("id") % 7).alias("k")).repartition(5)
    got = places(df.orderBy("k", F.col("packet_id").desc()))
    want = sorted(((i % 7, str(i)) for i in range(5000)), key=lambda x: x[1], reverse=True)
    want = [x for _, x in sorted(want, key=lambda x: x[0])]
    assert sorted((r.r, r.packet_id) for r in got.collect()) == list(enumerate(want, 1))
    assert places(df.filter("k > 7").orderBy("k")).collect() == []


def test_registered_orders_place_every_row(spark, tmp_path):
    heads = [*(json.dumps({"priority": i % 9}) for i in range(150)), '{"priority": "high"}', '{"priority": true}', '{"priority": "2026-01-01"}', '{"priority": null}', None]
    rows = [(f"p{i:03}", h, "") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "packet_id string, frontmatter string, body string").write.parquet(str(tmp_path / "packets.parquet"))
    got = {r.packet_id: r.r for r in entry.queries()["order_mixed_types"](spark, str(tmp_path)).collect()}
    assert len(got) == 153 and (got["p151"], got["p000"], got["p152"], got["p150"]) == (1, 2, 152, 153)
    spark.createDataFrame([(i, "S", float(i)) for i in range(120)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.packet_id: r.r for r in entry.queries()["order_by_keys"](spark, str(tmp_path)).collect()}
    assert got == {str(i): 120 - i for i in range(120)}


def test_groups(yard):
    boats = Query(yard).where(kind="boat")
    assert boats.group_by("moored").as_dict(n=Count(), b=Sum("built")) == {"north": {"n": 1, "b": 1962}, "south": {"n": 2, "b": 3889}}
    assert boats.group_by("moored").as_dict(lo=Min("checked"), hi=Max("checked"))["south"] == {"lo": "2025-06-09", "hi": "2025-06-09"}
    assert Query(yard).group_by("marks").as_dict(n=Count()) == {}
    assert Query(yard).group_by("kind").as_dict(s=Sum("key"), a=Avg("key"), c=Count("needs"))["boat"] == {"s": 0, "c": 2}
    assert {r["key"]: r["value"] for r in Query(yard).group_by("moored").count().collect()} == {"north": 1, "south": 2}
    # The first value in order of ids, a text, says what is compared.
    assert Query(yard).group_by("kind").as_dict(m=Min("crew"))["boat"] == {"m": "many"}


def test_profile(yard):
    r = report(yard)
    assert (r["packet_count"], r["files_without_frontmatter"]) == (6, 1)
    p = {f["name"]: f for f in r["fields"]}["crew"]
    assert p["types"] == {"int": 2, "str": 1} and (p["numeric_min"], p["numeric_max"], p["numeric_avg"]) == (2, 4, 3)
    assert [f["name"] for f in r["fields"]][:2] == ["key", "kind"]
    assert "crew" in report_text(r) and '"present_in": 5' in report_json(r)


def test_follow(yard, ring):
    assert Query(yard).where(key="tar").follow("needs", direction="reverse").ids() == ["boats/heron.md", "stores/rope.md"]
    assert Query(yard).where(key="heron").follow("needs", include_origin=True).ids() == ["boats/heron.md", "stores/rope.md", "stores/tar.md"]
    a = Query(ring).where(uuid="a")
    assert a.follow("next", depth="*").ids() == ["b", "c"]
    assert a.follow("next", depth=0).ids() == [] and a.follow("next", depth=0, include_origin=True).ids() == ["a"]
    assert Query(ring).where(uuid="d").follow("next", depth="all").ids() == []
    assert Query(ring).in_ids(["a", "b"]).follow("next").ids() == ["c"]
    for bad in (-1, "x", 1.5):
        with pytest.raises(QueryError):
            a.follow("next", depth=bad)
    with pytest.raises(QueryError):
        a.follow("next", direction="up").ids()


def test_paths_and_slugs(spark):
    ws = workspace(spark, {"tasks/a.md": ({"on": "b.md"}, ""), "tasks/b.md": ({"on": "../shared/./c.md"}, ""), "shared/c.md": ({"on": ["../../etc/passwd", "/shared/c.md", "nope.md"]}, "")})
    assert sorted(map(tuple, ws.edges("on").collect())) == [("tasks/a.md", "tasks/b.md"), ("tasks/b.md", "shared/c.md")]
    slugs = workspace(spark, {"x/one.md": ({"to": ["two", "uno", "missing"]}, ""), "y/two.md": ({}, ""), "z/three.md": ({"slug": "uno"}, ""), "z/two.md": ({}, "")}, default_resolver=graph.resolver_by_name("slug"))
    assert sorted(map(tuple, slugs.edges("to").collect())) == [("x/one.md", "y/two.md"), ("x/one.md", "z/three.md")]
    with pytest.raises(QueryError):
        graph.resolver_by_name("guess")


def test_subgraph(ring):
    g = graph.subgraph(ring, Query(ring).where(uuid="a").frame(), ["next"], include_origin=False)
    assert sorted(r.packet_id for r in g.nodes.collect()) == ["b", "c"]
    assert sorted((r.source, r.target) for r in g.edges.collect()) == [("a", "b"), ("b", "c"), ("c", "a")]
    back = graph.subgraph(ring, Query(ring).where(uuid="b").frame(), ["next"], depth=1, direction="reverse")
    assert sorted((r.source, r.target) for r in back.edges.collect()) == [("a", "b"), ("e", "b")]
    doc = sinks.graph_document(ring, back, "cytoscape")
    assert doc["elements"]["edges"][0]["data"]["id"] == "a__next__b" and doc["elements"]["nodes"][0] == {"data": {"id": "a", "frontmatter": {"uuid": "a", "next": "b"}}}
    assert sinks.graph_document(ring, back, "raw", ids_only=True)["nodes"] == [{"id": "a"}, {"id": "b"}, {"id": "e"}]
    with pytest.raises(QueryError):
        graph.subgraph(ring, ring.packets, [])


def test_hint(spark, yard):
    ws = workspace(spark, {"a": ({"to": "zzz"}, ""), "b": ({}, "")}, default_resolver=graph.FieldResolver("uuid"))
    assert "1 packet" in graph.mismatch_hint(ws, "to")
    assert graph.mismatch_hint(yard, "needs") is None and graph.mismatch_hint(ws, "other") is None


def test_patterns(yard, ring):
    one = lambda ws, t: [tuple(r) for r in PatternQuery(ws, t).result().collect()]
    assert one(yard, "MATCH (a)-[:needs]->(b) RETURN a, b") == [("boats/ark.md", "stores/rope.md"), ("boats/heron.md", "stores/rope.md"), ("boats/heron.md", "stores/tar.md"), ("stores/rope.md", "stores/tar.md")]
    assert one(yard, 'MATCH (a:Boat)-[:needs]->(b) WHERE b.amount < 3 AND a.kind = "boat" RETURN a') == [("boats/heron.md",)]
    assert one(yard, 'MATCH (a)-[:needs]->(b) WHERE a.kind = "boat" RETURN b ORDER BY a.built DESC, b DESC') == [("stores/tar.md",), ("stores/rope.md",)]
    assert one(ring, "MATCH (a)-[:next*]->(a) RETURN a") == [("a",), ("b",), ("c",), ("d",)]
    assert one(ring, 'MATCH (a)-[:next*]->(a) WHERE a.uuid = "b" RETURN a') == [("b",)]
    assert one(ring, "MATCH (a)-[:next]->(b)-[:next]->(c) RETURN count(a)") == [(5,)]
    assert one(ring, 'MATCH (a)-[:next*2..3]->(b) WHERE a.uuid = "a" RETURN b') == [("a",), ("c",)]
    assert one(ring, 'MATCH (a)-[:next*2..3]->(b) WHERE a.uuid = "a" OR b.uuid = "a" RETURN a, b') == [("a", "a"), ("a", "c"), ("b", "a"), ("e", "a")]
    assert one(ring, "MATCH (a)-[:next*..0]->(b) RETURN a") == []
    assert Query(ring).pattern("MATCH (a)-[:next]->(a) RETURN a").ids() == ["d"]
    values = [sinks.native(r[0].asDict()) for r in PatternQuery(yard, "MATCH (a) RETURN a.crew").result().collect() if r[0]]
    assert values == [2, 4, "many"]
    with pytest.raises(PatternError):
        Query(ring).pattern("MATCH (a) RETURN a.uuid")
    assert list(sinks.pattern_lines(PatternQuery(yard, 'MATCH (a) WHERE a.key = "heron" RETURN a, a.checked, a.nope').result(), "rows", scalar=False)) == ["boats/heron.md\t2025-03-01\t"]


def test_packet_lines(yard):
    lines = [r.line for r in sinks.packet_lines(yard, Query(yard).where(key="heron").df(), "json").collect()]
    assert lines == ['{"id": "boats/heron.md", "frontmatter": {"key": "heron", "kind": "boat", "built": 1962, "crew": 4, "moored": "north", "checked": "2025-03-01", "needs": ["rope","tar"], "marks": ["red","old"]}}']


def test_lookups(yard):
    assert "boats/heron.md" in yard and "x" not in yard and len(yard) == 6
    assert yard.get("boats/otter.md").body == "Fast." and next(iter(yard)).packet_id == "boats/ark.md"
