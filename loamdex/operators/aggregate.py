"""Grouping by one field and aggregates over fields of mixed type; all of it partial and final hash aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.expr import DynamicField, StaticField

if TYPE_CHECKING:
    from loamdex.plans.query import Query


@dataclass(frozen=True)
class Count:
    """Rows, or present values that aren't null."""

    field: str | None = None

    def column(self, bind) -> Column:
        if self.field is None:
            return F.count(F.lit(1))
        f = bind(self.field)
        return F.count(F.when(f.v["t"] != "null", 1)) if isinstance(f, DynamicField) else F.count(f.scalar())


@dataclass(frozen=True)
class Sum:
    """Sum of the numbers; 0 if there are none. Whole numbers stay whole in a typed column."""

    field: str

    def column(self, bind) -> Column:
        n = bind(self.field).number()
        return F.coalesce(F.sum(n), F.lit(0))


@dataclass(frozen=True)
class Avg:
    """Mean of the numbers; null if there are none."""

    field: str

    def column(self, bind) -> Column:
        return F.avg(bind(self.field).number().cast("double"))


@dataclass(frozen=True)
class _Extreme:
    field: str
    least = True

    def column(self, bind) -> Column:
        pick = F.min if self.least else F.max
        f = bind(self.field)
        if isinstance(f, StaticField):
            return pick(F.when(F.lit(f.kind in ("int", "float", "str", "date", "datetime")), f.scalar()))
        # The first value in row order says which class of values is compared.
        t = f.v["t"]
        kind = F.when(t.isin("int", "float"), "number").when(t == "datetime", F.when(f.v["ts"].isNotNull(), "zoned").otherwise("naive")).when(t.isin("str", "date"), t)
        first = F.min_by(kind, F.when(kind.isNotNull(), F.col("packet_id")))
        of = lambda c, k: F.struct(pick(F.when(kind == k, c)).alias("v"))["v"].cast("string")
        number = pick(F.when(kind == "number", f.number()))
        return F.when(first == "number", F.regexp_replace(number.cast("string"), r"\.0$", "")).when(first == "str", of(f.v["s"], "str")).when(first == "date", of(f.v["d"], "date")).when(first == "naive", of(f.v["tn"], "naive")).when(first == "zoned", of(f.v["ts"], "zoned"))


class Min(_Extreme):
    """Least of the values that compare with the first; null if there are none."""


class Max(_Extreme):
    """Greatest of the values that compare with the first; null if there are none."""

    least = False


def group_key(f: StaticField | DynamicField) -> tuple[Column, Column, list[Column]]:
    """Whether a value can be a group key, the key, and columns that sort keys by type name, then value."""
    if isinstance(f, StaticField):
        ok = f.scalar().isNotNull() if f.column is not None and f.kind not in ("list", "map") else F.lit(False)
        return ok, f.scalar(), []
    v, t = f.v, f.v["t"]
    number = f.number()
    key = F.when(t.isin("int", "float"), F.regexp_replace(number.cast("string"), r"\.0$", "")).when(t == "bool", v["b"].cast("string")).when(t == "str", v["s"]).when(t == "date", v["d"].cast("string")).otherwise(F.coalesce(v["tn"].cast("string"), v["ts"].cast("string")))
    return F.coalesce(~t.isin("null", "list", "map"), F.lit(False)), F.struct(F.when(t == "float", "int").otherwise(t).alias("type"), key.alias("value"), number.alias("number")), []


class GroupedQuery:
    def __init__(self, query: Query, field: str):
        self.query, self.field = query, field

    def aggregate(self, **aggs) -> DataFrame:
        """One row (key, aggregates...) for each value of the field, sorted by type and value.

        For documents of mixed type ``key`` is text and ``key_type`` its type.
        """
        ws = self.query.ws
        df = self.query.frame()
        f = ws.field(self.field)
        ok, key, _ = group_key(f)
        out = df.filter(ok).groupBy(key.alias("key")).agg(*[a.column(ws.field).alias(n) for n, a in aggs.items()])
        if isinstance(f, StaticField):
            return out.orderBy("key")
        return out.orderBy("key.type", "key.number", "key.value").select(F.col("key.value").alias("key"), F.col("key.type").alias("key_type"), *aggs)

    def _one(self, agg) -> DataFrame:
        return self.aggregate(value=agg)

    def count(self) -> DataFrame:
        return self._one(Count())

    def sum(self, field: str) -> DataFrame:
        return self._one(Sum(field))

    def avg(self, field: str) -> DataFrame:
        return self._one(Avg(field))

    def min(self, field: str) -> DataFrame:
        return self._one(Min(field))

    def max(self, field: str) -> DataFrame:
        return self._one(Max(field))

    def groups(self) -> DataFrame:
        """(key, ids): the packets of each group, as a column of one row a packet."""
        ok, key, _ = group_key(self.query.ws.field(self.field))
        return self.query.frame().filter(ok).select(key.alias("key"), "packet_id")

    def as_dict(self, **aggs) -> dict:
        """Small results as a dict of dicts, aggregates without a value left out."""
        return {r["key"]: {k: r[k] for k in aggs if r[k] is not None} for r in self.aggregate(**aggs).collect()}
