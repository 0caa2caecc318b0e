"""A collection of documents to query: a table whose types are known, or files with a head of their own types."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.expr import DynamicField, StaticField
from loamdex.operators.graph import FieldResolver, PathResolver, Resolver


class Workspace:
    """``packets`` has a column packet_id; its other columns are the fields, or the map ``fm`` holds them."""

    def __init__(self, packets: DataFrame, *, dynamic: bool, root: str | None = None, null_means: str = "missing", resolvers: dict[str, Resolver] | None = None, default_resolver: Resolver | None = None, body: str | None = "body", glob: Iterable[str] = ("**/*.md",)):
        if null_means not in ("missing", "null"):
            raise ValueError("null_means must be missing or null")
        self.packets, self.dynamic, self.root, self.null_means, self.glob = packets, dynamic, root, null_means, tuple(glob)
        self.resolvers = dict(resolvers or {})
        self.default_resolver = default_resolver or (PathResolver() if dynamic else FieldResolver("packet_id"))
        self.body = body if body in packets.columns else None
        self.spark: SparkSession = packets.sparkSession
        self._edges: dict[tuple, DataFrame] = {}

    @classmethod
    def of(cls, df: DataFrame, *, id: str | list[str], body: str | None = None, **options) -> Workspace:
        """Over a table: a field is a column, an id a column or several joined by ``/``."""
        key = F.col(id).cast("string") if isinstance(id, str) else F.concat_ws("/", *id)
        return cls(df.withColumn("packet_id", key), dynamic=False, body=body, **options)

    @classmethod
    def open(cls, spark: SparkSession, root: str, glob: Iterable[str] = ("**/*.md",), *, warn: bool = True, **options) -> Workspace:
        """Over a folder of Markdown files; a file that can't be read is reported and left out."""
        from loamdex.sources import frontmatter

        scanned = frontmatter.scan(spark, root, glob)
        if warn:
            for r in scanned.filter("error is not null").select("packet_id", "error").toLocalIterator():
                print(f"warning: {r.packet_id}: {r.error}", file=sys.stderr)
        return cls(scanned.filter("error is null").drop("error"), dynamic=True, root=root, glob=glob, **options)

    def rescan(self) -> Workspace:
        """Read the folder again and forget all indexes."""
        if self.root is None:
            self._edges.clear()
            return self
        return Workspace.open(self.spark, self.root, self.glob, resolvers=self.resolvers, default_resolver=self.default_resolver)

    # ---- fields

    def field(self, name: str, packets: str | None = None) -> StaticField | DynamicField:
        """A field, of a joined alias ``packets`` if given."""
        at = f"`{packets}`." if packets else ""
        if self.dynamic:
            return DynamicField(name, F.col(f"{at}fm").getItem(name))
        types = {f.name: f.dataType for f in self.packets.schema.fields}
        return StaticField(name, F.col(f"{at}`{name}`") if name in types else None, types.get(name), self.null_means)

    def values(self, name: str) -> DataFrame:
        """(packet_id, raw) of the references under a field: a scalar itself, a list its elements; of files only text."""
        if self.dynamic:
            v = self.field(name).v
            texts = F.when(v["t"] == "list", F.transform(v["l"], lambda x: F.when(x["t"] == "str", x["s"]))).when(v["t"] == "str", F.array(v["s"]))
            return self.packets.select("packet_id", F.explode(texts).alias("raw")).filter("raw is not null")
        f = self.field(name)
        if f.column is None:
            return self.packets.select("packet_id", F.lit(None).cast("string").alias("raw")).filter("false")
        raw = F.explode(f.column) if f.kind == "list" else f.column
        return self.packets.select("packet_id", raw.alias("raw")).filter("raw is not null")

    def index_by_field(self, name: str) -> DataFrame:
        """(value, packet_id): of the packets with one scalar value under a field the first by id."""
        if self.dynamic:
            v = self.field(name).v
            src = self.packets.select(F.when(v["t"] == "str", v["s"]).alias("value"), "packet_id")
        else:
            src = self.packets.select((self.field(name).scalar() if name != "packet_id" else F.col("packet_id")).alias("value"), "packet_id")
        return src.filter("value is not null").groupBy("value").agg(F.min("packet_id").alias("packet_id"))

    def index_by_stem(self) -> DataFrame:
        """(value, packet_id): of the packets with one file stem the first by id."""
        stem = F.regexp_extract("packet_id", r"([^/]+?)(?:\.[^./]*)?$", 1)
        return self.packets.select(stem.alias("value"), "packet_id").groupBy("value").agg(F.min("packet_id").alias("packet_id"))

    def resolver(self, field: str, explicit: Resolver | None = None) -> Resolver:
        return explicit or self.resolvers.get(field) or self.default_resolver

    def edges(self, field: str, resolver: Resolver | None = None) -> DataFrame:
        """(source, target) of the references under a field, each once; kept while the workspace lives."""
        r = self.resolver(field, resolver)
        key = (field, r)
        if key not in self._edges:
            self._edges[key] = r.edges(self, field).select("source", "target").distinct()
        return self._edges[key]

    # ---- look-ups

    def get(self, packet_id: str):
        return self.packets.filter(F.col("packet_id") == packet_id).first()

    def __contains__(self, packet_id: str) -> bool:
        return not self.packets.filter(F.col("packet_id") == packet_id).isEmpty()

    def __len__(self) -> int:
        return self.packets.count()

    def __iter__(self):
        return self.packets.orderBy("packet_id").toLocalIterator()

    def body_column(self) -> Column:
        return F.col(self.body) if self.body else F.lit(None).cast("string")
