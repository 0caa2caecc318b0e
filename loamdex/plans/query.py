"""A query as an immutable plan of stages, lowered to one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex import expr
from loamdex.functions import dates
from loamdex.lang.filters import parse_filter
from loamdex.operators import graph
from loamdex.operators.aggregate import GroupedQuery
from loamdex.operators.ordering import OrderKey, sort_columns
from loamdex.operators.pattern import PatternQuery

if TYPE_CHECKING:
    from loamdex.workspace import Workspace


@dataclass(frozen=True)
class Filter:
    expr: expr.Expr


@dataclass(frozen=True)
class Follow:
    field: str
    depth: int | str = 1
    direction: str = "forward"
    resolver: graph.Resolver | None = None
    include_origin: bool = False


@dataclass(frozen=True)
class Search:
    text: str
    index: str = "grep"
    location: str | None = None
    options: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class IdSet:
    ids: object  # a DataFrame (packet_id) or a collection of ids


@dataclass(frozen=True)
class Query:
    ws: Workspace
    stages: tuple[Filter | Follow | Search | IdSet, ...] = ()
    order: tuple[OrderKey, ...] = ()

    def _with(self, stage) -> Query:
        return replace(self, stages=(*self.stages, stage))

    def all(self) -> Query:
        return self

    def where(self, **kwargs) -> Query:
        return self._with(Filter(expr.from_kwargs(kwargs))) if kwargs else self

    def where_expr(self, e: expr.Expr) -> Query:
        return self._with(Filter(e))

    def follow(self, field: str, *, depth: int | str = 1, direction: str = "forward", resolver: graph.Resolver | None = None, include_origin: bool = False) -> Query:
        graph.hop_limit(depth)
        return self._with(Follow(field, depth, direction, resolver, include_origin))

    def search(self, text: str, *, index: str = "grep", location: str | None = None, options: dict | None = None) -> Query:
        return self._with(Search(text, index, location, tuple((options or {}).items())))

    def in_ids(self, ids) -> Query:
        return self._with(IdSet(ids if isinstance(ids, DataFrame) else tuple(ids)))

    def cypher(self, text: str) -> Query:
        """Keep the packets a pattern, matched over the whole workspace, returns."""
        return self._with(IdSet(PatternQuery(self.ws, text).ids()))

    pattern = cypher

    def order_by(self, field: str, *, desc: bool = False, nulls: str = "auto") -> Query:
        return replace(self, order=(*self.order, OrderKey(field, desc, nulls)))

    def order_by_keys(self, keys) -> Query:
        return replace(self, order=(*self.order, *keys))

    def group_by(self, field: str) -> GroupedQuery:
        return GroupedQuery(self, field)

    # ---- lowering

    def frame(self) -> DataFrame:
        """The packets that all stages keep, in no order."""
        df = self.ws.packets
        for s in self.stages:
            if isinstance(s, Filter):
                df = df.filter(expr.columns(s.expr, lambda p: self.ws.field(p.field)))
            elif isinstance(s, Follow):
                ids = graph.follow(self.ws, df, s.field, depth=s.depth, direction=s.direction, resolver=s.resolver, include_origin=s.include_origin)
                df = self.ws.packets.join(ids, "packet_id", "left_semi")
            elif isinstance(s, Search):
                from loamdex.search import registry

                df = df.join(registry.search_all(self.ws, s.text, index=s.index, location=s.location, options=dict(s.options)).select("packet_id"), "packet_id", "left_semi")
            elif isinstance(s.ids, DataFrame):
                df = df.join(s.ids, "packet_id", "left_semi")
            else:
                own = self.ws.spark.createDataFrame([(i,) for i in s.ids], "packet_id string")
                df = df.join(own, "packet_id", "left_semi")
        return df

    def df(self) -> DataFrame:
        """The packets in the asked order, else by id."""
        return self.frame().orderBy(*sort_columns(list(self.order), self.ws.field, F.col("packet_id")))

    def ids(self) -> list[str]:
        return [r.packet_id for r in self.df().select("packet_id").collect()]

    def count(self) -> int:
        return self.frame().count()

    def __iter__(self):
        return self.df().toLocalIterator()

    def explain(self) -> None:
        self.df().explain("formatted")

    # ---- edits

    def _edit(self, op: str, /, *args, **kwargs):
        from loamdex.operators import edits

        return getattr(edits, f"plan_{op}")(self.ws, self.ids(), *args, **kwargs)

    def set(self, /, **values):
        return self._edit("set", **values)

    def remove(self, *fields):
        return self._edit("remove", *fields)

    def rename(self, /, **names):
        return self._edit("rename", **names)

    def append(self, /, **values):
        return self._edit("append", **values)

    def toggle(self, *fields):
        return self._edit("toggle", *fields)


def compile_query(text: str, ws: Workspace, *, clock: dates.Clock = dates.local_clock) -> Query:
    """A filter text as a query."""
    e, keys = parse_filter(text, clock=clock)
    q = Query(ws)
    return (q.where_expr(e) if e is not None else q).order_by_keys(keys)
