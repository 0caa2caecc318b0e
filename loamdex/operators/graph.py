"""References between packets: resolution to edges, traversal, closure and diagnostics.

A traversal is a loop over hops, each a join of the frontier with the edges; what a hop finds is
written to the checkpoint folder, so that plans stay short however deep the graph is.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.errors import QueryError
from loamdex.session import checkpointed

if TYPE_CHECKING:
    from loamdex.workspace import Workspace


@runtime_checkable
class Resolver(Protocol):
    """Turns the references under a field into (source, target) packet ids."""

    def edges(self, ws: Workspace, field: str) -> DataFrame: ...


@dataclass(frozen=True)
class PathResolver:
    """A path relative to the packet that names it; what leads out of the root resolves to nothing."""

    def edges(self, ws: Workspace, field: str) -> DataFrame:
        raw = ws.values(field).filter(~F.col("raw").cast("string").startswith("/"))
        steps = F.split(F.concat_ws("/", F.regexp_extract("packet_id", r"^(.*)/[^/]*$", 1), F.col("raw").cast("string")), "/")
        # Fold the steps: ".." takes one back, "." and empty ones stay; above the root the path is lost.
        fold = F.aggregate(
            steps,
            F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")),
            lambda acc, s: F.when(s.isin("", "."), acc)
            .when(s == "..", F.struct(F.when(F.size(acc["at"]) > 0, F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).otherwise(acc["at"]).alias("at"), (acc["ok"] & (F.size(acc["at"]) > 0)).alias("ok")))
            .otherwise(F.struct(F.array_append(acc["at"], s).alias("at"), acc["ok"].alias("ok"))),
        )
        found = raw.select(F.col("packet_id").alias("source"), fold.alias("f")).filter("f.ok").select("source", F.array_join("f.at", "/").alias("target"))
        return found.join(ws.packets.select(F.col("packet_id").alias("target")), "target", "left_semi")


@dataclass(frozen=True)
class FieldResolver:
    """The first packet, by id, whose ``field`` equals the reference."""

    field: str = "uuid"

    def edges(self, ws: Workspace, field: str) -> DataFrame:
        raw = ws.values(field)
        index = ws.index_by_field(self.field).withColumnRenamed("packet_id", "target")
        if index.schema["value"].dataType != raw.schema["raw"].dataType:
            index, raw = index.withColumn("value", F.col("value").cast("string")), raw.withColumn("raw", F.col("raw").cast("string"))
        return raw.join(index, F.col("raw") == F.col("value")).select(F.col("packet_id").alias("source"), "target")


@dataclass(frozen=True)
class SlugResolver:
    """By a slug field, else by file stem."""

    field: str = "slug"

    def edges(self, ws: Workspace, field: str) -> DataFrame:
        raw = ws.values(field).withColumn("raw", F.col("raw").cast("string"))
        slug = ws.index_by_field(self.field).select(F.col("value").cast("string").alias("raw"), F.col("packet_id").alias("slug"))
        stem = ws.index_by_stem().select(F.col("value").alias("raw"), F.col("packet_id").alias("stem"))
        return raw.join(slug, "raw", "left").join(stem, "raw", "left").select(F.col("packet_id").alias("source"), F.coalesce("slug", "stem").alias("target")).filter("target is not null")


def resolver_by_name(name: str) -> Resolver:
    known = {"path": PathResolver, "uuid": FieldResolver, "slug": SlugResolver}
    if name not in known:
        raise QueryError(f"unknown resolver {name!r}; known: {', '.join(known)}")
    return known[name]()


def hop_limit(depth: int | str) -> int | None:
    """Hops of a depth; None for ``*`` and ``all``."""
    if depth in ("*", "all"):
        return None
    try:
        n = int(depth)
    except (TypeError, ValueError) as e:
        raise QueryError(f"invalid depth: {depth!r}") from e
    if isinstance(depth, float) and depth != n or isinstance(depth, bool) or n < 0:
        raise QueryError(f"invalid depth: {depth!r}")
    return n


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (here, there) of a step."""
    if direction not in ("forward", "reverse"):
        raise QueryError(f"invalid direction: {direction!r}")
    here, there = ("source", "target") if direction == "forward" else ("target", "source")
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there")).distinct()


def _merged(seen: DataFrame, hops: int) -> DataFrame:
    """What has been seen, written as one every few hops, so that it isn't a union of ever more pieces."""
    return checkpointed(seen) if hops % 8 == 0 else seen


def reach(steps: DataFrame, seeds: DataFrame, limit: int | None) -> list[DataFrame]:
    """Layers of a breadth-first search from ``seeds`` (packet_id): the seeds, then what each hop finds first."""
    layers = [checkpointed(seeds.select("packet_id").distinct())]
    seen = layers[0]
    while (limit is None or len(layers) <= limit) and not layers[-1].isEmpty():
        found = layers[-1].join(steps, layers[-1]["packet_id"] == steps["here"]).select(F.col("there").alias("packet_id")).distinct().join(seen, "packet_id", "left_anti")
        layers.append(checkpointed(found))
        seen = _merged(seen.unionByName(layers[-1]), len(layers))
    return layers


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def follow(ws: Workspace, seeds: DataFrame, field: str, *, depth: int | str = 1, direction: str = "forward", resolver: Resolver | None = None, include_origin: bool = False) -> DataFrame:
    """(packet_id) of the packets reached from ``seeds``; a seed itself only with ``include_origin``."""
    limit = hop_limit(depth)
    layers = reach(oriented(ws.edges(field, resolver), direction), seeds, limit)
    out = layers if include_origin else layers[1:]
    return union_all(out) if out else seeds.select("packet_id").filter("false")


@dataclass(frozen=True)
class Subgraph:
    nodes: DataFrame
    edges: DataFrame


def subgraph(ws: Workspace, seeds: DataFrame, fields: Iterable[str], *, depth: int | str = "*", direction: str = "forward", resolver: Resolver | None = None, include_origin: bool = True) -> Subgraph:
    """Nodes reached over several fields, and the edges (source, target, field) of every node that was expanded."""
    fields = list(dict.fromkeys(fields))
    if not fields:
        raise QueryError("a subgraph needs a field")
    limit = hop_limit(depth)
    edges = union_all([ws.edges(f, resolver).withColumn("field", F.lit(f)) for f in fields])
    steps = oriented(edges, direction)
    known = seeds.select("packet_id").join(ws.packets.select("packet_id"), "packet_id", "left_semi")
    layers = reach(steps, known, limit)
    expanded = layers if limit is None else layers[:limit]
    here = "source" if direction == "forward" else "target"
    taken = edges.join(union_all(expanded).withColumnRenamed("packet_id", here), here, "left_semi").select("source", "target", "field").distinct() if expanded else edges.select("source", "target", "field").filter("false")
    nodes = layers if include_origin else layers[1:]
    return Subgraph(union_all(nodes) if nodes else known.filter("false"), taken)


def mismatch(ws: Workspace, field: str, resolver: Resolver | None = None) -> DataFrame:
    """(populated, resolved): packets with a value under a field, and packets of which a reference resolves."""
    f = ws.field(field)
    there = f.present() & (f.v["t"] != "null") if ws.dynamic else f.present()
    some = ws.edges(field, resolver).select("source").distinct()
    return ws.packets.filter(there).select("packet_id").agg(F.count(F.lit(1)).alias("populated")).crossJoin(some.agg(F.count(F.lit(1)).alias("resolved")))  # one row each


def mismatch_hint(ws: Workspace, field: str, resolver: Resolver | None = None) -> str | None:
    r = mismatch(ws, field, resolver).first()
    if r.populated and not r.resolved:
        return f"hint: {field!r} has a value in {r.populated} packet(s), none of which resolves; another resolver (uuid, slug, path) may fit"
    return None


# ------------------------------------------------------------------ paths of variable length


def closure(steps: DataFrame) -> DataFrame:
    """(source, target) of all paths of one hop or more; what a round knows is joined with itself, so rounds grow with the logarithm of the longest shortest path."""
    pairs = checkpointed(steps.select(F.col("here").alias("source"), F.col("there").alias("target")).distinct())
    n = pairs.count()
    while True:
        on = pairs.select(F.col("source").alias("target"), F.col("target").alias("far"))
        grown = checkpointed(pairs.join(on, "target").select("source", F.col("far").alias("target")).unionByName(pairs).distinct())
        if (m := grown.count()) == n:
            return grown
        pairs, n = grown, m


def reachable(steps: DataFrame, low: int, high: int | None, sources: DataFrame | None = None) -> DataFrame:
    """(source, target) whose shortest distance lies within [low, high]; a source reaches itself if a cycle leads back within it.

    The pairs grow by one hop a round; sources are all nodes with an edge unless given.
    """
    if high == 0:
        return steps.select(F.col("here").alias("source"), F.col("there").alias("target")).filter("false")
    if sources is None and high is None and low <= 1:
        return closure(steps)
    steps = checkpointed(steps)
    first = steps if sources is None else steps.join(sources.select(F.col("packet_id").alias("here")), "here", "left_semi")
    first = first.select(F.col("here").alias("source"), F.col("there").alias("target"))
    loops = checkpointed(first.filter("source = target"))  # such a node comes back at every number of hops
    layers = [checkpointed(first.filter("source != target").distinct())]
    seen = layers[0]
    while (high is None or len(layers) < high) and not layers[-1].isEmpty():
        grown = layers[-1].join(steps, F.col("target") == F.col("here")).select("source", F.col("there").alias("target")).filter("source != target").distinct()
        layers.append(checkpointed(grown.join(seen, ["source", "target"], "left_anti")))
        seen = _merged(seen.unionByName(layers[-1]), len(layers))
    far = union_all([f.withColumn("d", F.lit(k + 1)) for k, f in enumerate(layers)])
    back = far.join(steps, (F.col("target") == F.col("here")) & (F.col("source") == F.col("there"))).select("source", F.col("source").alias("target"), (F.col("d") + 1).alias("d"))
    within = (F.col("d") >= low) & (F.lit(True) if high is None else F.col("d") <= high)
    return far.unionByName(back).filter(within).select("source", "target").unionByName(loops).distinct()
