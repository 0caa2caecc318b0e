"""Graph patterns as joins: one join of bindings with edges a hop, filters left to the optimizer to push down."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex import expr
from loamdex.functions import dates
from loamdex.lang.patterns import Item, Pattern, parse_pattern
from loamdex.operators.graph import Resolver, oriented, reachable
from loamdex.operators.ordering import rank_columns, sort_columns

if TYPE_CHECKING:
    from loamdex.workspace import Workspace


def _var(name: str) -> str:
    return f"_of_{name}"


def _alone(e: expr.Expr | None) -> dict[str, list[expr.Expr]]:
    """Variable -> the parts of a conjunction that speak of it alone."""
    out: dict[str, list[expr.Expr]] = {}
    for part in e.items if isinstance(e, expr.And) else [e] if e is not None else []:
        if isinstance(part, expr.And):
            for v, own in _alone(part).items():
                out.setdefault(v, []).extend(own)
        elif len(names := _vars(part)) == 1:
            out.setdefault(next(iter(names)), []).append(part)
    return out


def bindings(ws: Workspace, p: Pattern, resolver: Resolver | None = None) -> DataFrame:
    """One column for each variable, one row for each way to match.

    Paths of variable length start from the packets that can be bound where they begin, or end where conditions
    bind their end alone; without either they are those of the whole graph.
    """
    alone = _alone(p.where)

    def bound(var: str) -> DataFrame | None:
        if var not in alone:
            return None
        df = ws.packets
        for e in alone[var]:
            df = df.filter(expr.columns(e, lambda q: ws.field(q.field)))
        return df.select("packet_id")

    first = bound(p.nodes[0])
    out = (ws.packets if first is None else first).select(F.col("packet_id").alias(p.nodes[0]))
    narrow = first is not None
    for hop, here, there in zip(p.hops, p.nodes, p.nodes[1:]):
        edges = ws.edges(hop.field, resolver)
        if hop.single:
            pairs = oriented(edges, "forward").select(F.col("here").alias("_s"), F.col("there").alias("_t"))
        else:
            ends = bound(there)
            if narrow or ends is None:
                sources = out.select(F.col(f"`{here}`").alias("packet_id")).distinct() if narrow else None
                pairs = reachable(oriented(edges, "forward"), hop.low, hop.high, sources).select(F.col("source").alias("_s"), F.col("target").alias("_t"))
            else:
                pairs = reachable(oriented(edges, "reverse"), hop.low, hop.high, ends).select(F.col("target").alias("_s"), F.col("source").alias("_t"))
            narrow = narrow or ends is not None
        out = out.join(pairs, F.col(f"`{here}`") == F.col("_s")).drop("_s")
        out = out.filter(F.col(f"`{there}`") == F.col("_t")).drop("_t") if there in out.columns else out.withColumnRenamed("_t", there)
    return out


class PatternQuery:
    def __init__(self, ws: Workspace, text: str | Pattern, *, resolver: Resolver | None = None, clock: dates.Clock = dates.local_clock):
        self.ws, self.resolver = ws, resolver
        self.pattern = parse_pattern(text, clock=clock) if isinstance(text, str) else text

    @property
    def is_scalar(self) -> bool:
        return any(i.count for i in self.pattern.items)

    def _matched(self) -> tuple[DataFrame, dict[str, str]]:
        """Bindings that hold, joined with the fields of every variable of which one is used."""
        p = self.pattern
        used = {i.var for i in p.items if i.field} | {k.field.split(".")[0] for k in p.order if "." in k.field}
        if p.where:
            used |= _vars(p.where)
        df = bindings(self.ws, p, self.resolver)
        df = df.select(*[F.col(f"`{v}`").alias(_var(v)) for v in df.columns])
        alias = {}
        for v in sorted(used):
            alias[v] = f"_{v}"
            df = df.join(self.ws.packets.alias(alias[v]), F.col(_var(v)) == F.col(f"{alias[v]}.packet_id"))
        if p.where:
            df = df.filter(expr.columns(p.where, lambda q: self.ws.field(q.field, alias[q.var])))
        return df, alias

    def count(self) -> DataFrame:
        """The number of bindings, as one row (n)."""
        return self._matched()[0].agg(F.count(F.lit(1)).alias("n"))

    def result(self) -> DataFrame:
        """Distinct rows of the RETURN items in the asked or the default order."""
        p = self.pattern
        if self.is_scalar:
            return self.count().withColumnRenamed("n", p.items[0].name)
        df, alias = self._matched()
        columns = [self._item(i, alias).alias(f"_c{k}") for k, i in enumerate(p.items)]
        raw = [f"_c{k}" for k in range(len(p.items))]
        names = [F.col(c).alias(i.name) for c, i in zip(raw, p.items)]
        if p.order:
            bind = lambda f: self.ws.field(f.split(".", 1)[1], alias[f.split(".")[0]]) if "." in f else _Id(f)
            keys = [replace(k) for k in p.order]
            sort = sort_columns(keys, bind, F.concat_ws("\x01", *[F.col(_var(v)) for v in dict.fromkeys(p.nodes)]))
            group = [F.col(c) if not self._dynamic(i) else F.col(c)["j"] for c, i in zip(raw, p.items)]
            # The first binding of each row by the sort keys, within the row's own group; then one range-partitioned sort.
            df = df.select("*", *columns)
            return df.withColumn("_first", F.row_number().over(Window.partitionBy(*group).orderBy(*sort))).filter("_first = 1").orderBy(*sort).select(*names)
        keyed = df.select(*columns)
        group = [F.col(c) if not self._dynamic(i) else F.coalesce(F.col(c)["j"], F.lit("")) for c, i in zip(raw, p.items)]
        keyed = keyed.withColumns({f"_g{k}": g for k, g in enumerate(group)}).dropDuplicates([f"_g{k}" for k in range(len(group))])
        order = []
        for c, i in zip(raw, p.items):
            f = expr.DynamicField(i.name, F.col(c)) if self._dynamic(i) else expr.StaticField(i.name, F.col(c), keyed.schema[c].dataType)
            null, values = rank_columns(f)
            order += [null.desc(), *[v.asc_nulls_last() for v in values]]
        return keyed.orderBy(*order).select(*names)

    def _dynamic(self, i: Item) -> bool:
        return self.ws.dynamic and i.field is not None

    def _item(self, i: Item, alias: dict[str, str]):
        return self.ws.field(i.field, alias[i.var]).scalar() if i.field else F.col(_var(i.var))

    def ids(self) -> DataFrame:
        """(packet_id) of the one variable that is returned."""
        from loamdex.errors import PatternError

        if len(self.pattern.items) != 1 or self.pattern.items[0].field or self.is_scalar:
            raise PatternError("a pattern used as a filter returns one variable")
        return self._matched()[0].select(F.col(_var(self.pattern.items[0].var)).alias("packet_id")).distinct()


class _Id(expr.StaticField):
    def __init__(self, var: str):
        from pyspark.sql import types as T

        super().__init__(var, F.col(_var(var)), T.StringType())


def _vars(e: expr.Expr) -> set[str]:
    if isinstance(e, expr.Not):
        return _vars(e.item)
    return set().union(*map(_vars, e.items)) if isinstance(e, (expr.And, expr.Or)) else {e.var}
