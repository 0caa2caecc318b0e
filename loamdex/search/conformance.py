"""Checks that a search backend keeps the contract, for the tests of backends registered from outside.

``check_scan`` and ``check_index`` run a backend over a small workspace of its own making and raise ``AssertionError`` with
the rule that is broken. ``found`` is a text with hits in ``DOCS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamdex.search.backends import HITS, IndexStats
from loamdex.workspace import Workspace

DOCS = {
    "a.md": ({"title": "Tide tables"}, "High water at the harbour comes an hour later each day. The harbour silts up."),
    "b.md": ({"title": "Harbour dues"}, "Boats pay by length; the harbour master keeps the book."),
    "c.md": ({"title": "Bread"}, "Flour, water and salt, left to rise."),
    "d.md": ({}, ""),
}
FOUND = "harbour"


def sample(spark: SparkSession) -> Workspace:
    from loamdex.sources.frontmatter import from_records

    return Workspace(from_records(spark, DOCS).drop("error"), dynamic=True)


def _require(rule: bool, text: str) -> None:
    if not rule:
        raise AssertionError(text)


def _check_hits(search, found: str) -> None:
    """Rules that hold for hits of any backend; ``search(text, k)`` gives a DataFrame."""
    hits: DataFrame = search(found, 10)
    _require(hits.columns == [x.split()[0] for x in HITS.split(", ")], f"hits are ({HITS}), not {hits.columns}")
    rows = hits.collect()
    _require(bool(rows), f"{found!r} has hits")
    _require({r.packet_id for r in rows} <= set(DOCS), "hits are packets of the workspace")
    _require(len({r.packet_id for r in rows}) == len(rows), "a packet is one hit")
    _require(all(r.score is not None and r.score == r.score for r in rows), "a hit has a score that is a number")
    _require([r.score for r in rows] == sorted((r.score for r in rows), reverse=True), "hits come by falling score")
    _require([r.packet_id for r in search(found, 10).collect()] == [r.packet_id for r in rows], "the same search gives the same order")
    _require([r.packet_id for r in search(found, 1).collect()] == [rows[0].packet_id], "k=1 gives the first hit alone")
    _require(search(found, 0).collect() == [], "k=0 gives no hit")
    _require(search("", 10).collect() == [], "an empty text gives no hit")
    _require({r.packet_id for r in search(found, None).collect()} >= {r.packet_id for r in rows}, "without k all hits come")


def check_scan(backend, spark: SparkSession, *, found: str = FOUND) -> None:
    """A backend that searches a workspace without an index."""
    ws = sample(spark)
    _check_hits(lambda text, k: backend.query(text, ws, k=k), found)
    _require(backend.info().name == backend.name and backend.info().kind == "scan", "info names the backend and its kind")
    try:
        backend.query(found, ws, options={"no such option": 1})
    except ValueError:
        return
    raise AssertionError("an unknown option is an error")


def check_index(backend, spark: SparkSession, location: str, *, found: str = FOUND) -> None:
    """A backend that builds an index at a location and searches it."""
    ws = sample(spark)
    try:
        backend.query(found, f"{location}-absent")
    except FileNotFoundError:
        pass
    else:
        raise AssertionError("searching an index that isn't there is FileNotFoundError")
    first = backend.build(ws, ws.packets, location)
    _require(isinstance(first, IndexStats) and first.packets_indexed == len(DOCS), "a build indexes every packet")
    _check_hits(lambda text, k: backend.query(text, location, k=k), found)
    again = backend.build(ws, ws.packets, location)
    _require(again.packets_indexed == 0 and again.packets_skipped == len(DOCS), "a build that is repeated skips what is unchanged")
    fewer = backend.build(ws, ws.packets.filter("packet_id != 'a.md'"), location)
    _require(fewer.packets_removed == 1, "packets left out leave the index")
    _require("a.md" not in {r.packet_id for r in backend.query(found, location, k=None).collect()}, "removed packets are no hits")
    _require(backend.info(location).kind == "indexed" and bool(backend.info(location).metadata), "info describes the index at a location")
