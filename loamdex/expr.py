"""Predicates and their translation to Spark columns.

Two-valued logic: a predicate on a missing field is false, its negation true. Predicates are
type-honest: values that can't be compared are left out instead of being cast. A column for a
predicate that stands positively is the bare comparison, one that stands under NOT is
``missing or not comparison``, so that both reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.errors import FilterError
from loamdex.values import TYPE_ALIASES, TYPE_NAMES, canonical, type_name

OPERATORS = ("eq", "ne", "not", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "icontains", "startswith", "endswith", "matches", "exists", "is_null", "not_empty", "type")
_ORDER = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


class Expr:
    def __and__(self, other: Expr) -> Expr:
        return And((self, other))

    def __or__(self, other: Expr) -> Expr:
        return Or((self, other))

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class Pred(Expr):
    field: str
    op: str
    value: object = None
    var: str | None = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise FilterError(f"unknown operator: {self.op}")
        if not self.field:
            raise FilterError("a predicate needs a field")
        if self.op in ("in", "not_in") and not isinstance(self.value, (list, tuple, set, frozenset)):
            raise FilterError(f"{self.op} needs a list")
        if self.op == "matches" and isinstance(self.value, str):
            try:
                re.compile(self.value)
            except re.error as e:
                raise FilterError(f"bad pattern {self.value!r}: {e}") from e
        if self.op == "type" and (str(self.value).lower() not in TYPE_NAMES and str(self.value).lower() not in TYPE_ALIASES):
            raise FilterError(f"unknown type: {self.value}")


@dataclass(frozen=True)
class And(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    item: Expr


def from_kwargs(kwargs: dict[str, object]) -> Expr:
    """``field__op=value`` pairs, split at the last double underscore; all must hold."""
    preds = []
    for key, value in kwargs.items():
        field, sign, op = key.rpartition("__")
        preds.append(Pred(field, op, value) if sign else Pred(key, "eq", value))
    return preds[0] if len(preds) == 1 else And(tuple(preds))


def columns(expr: Expr, bind, negated: bool = False) -> Column:
    """The column of an expression; ``bind(pred)`` gives a field. Negation is carried down to the leaves."""
    if isinstance(expr, Not):
        return columns(expr.item, bind, not negated)
    if isinstance(expr, (And, Or)):
        both = isinstance(expr, And) != negated
        parts = [columns(x, bind, negated) for x in expr.items]
        return reduce(and_ if both else or_, parts) if parts else F.lit(both)
    return bind(expr).predicate(expr.op, expr.value, negated)


# ------------------------------------------------------------------ regular expressions

_NAMED = re.compile(r"\(\?P<(\w+)>")


def java_pattern(pattern: str) -> str | None:
    """The same pattern for the JVM, or None where the dialects differ too much."""
    if re.search(r"\(\?P=|\(\?\(|\\Z|\\[gN]|\(\?[aiLmsux]*[aLux]|\\p\{|&&|\[\[", pattern):
        return None
    named = _NAMED.sub(lambda m: "(" if "_" in m[1] else f"(?<{m[1]}>", pattern)
    return f"(?U){named}"


def matches(text: Column, pattern: str) -> Column:
    """Python's ``re.search`` on a text column: as ``rlike`` where the JVM has the same, else in Arrow batches."""
    java = java_pattern(pattern)
    if java is not None:
        return text.rlike(java)
    rx = re.compile(pattern)

    @F.pandas_udf("boolean")
    def search(col):
        return col.map(lambda s: None if s is None else rx.search(s) is not None).astype(object)

    return search(text)


# ------------------------------------------------------------------ fields


def _naive(v) -> bool:
    return v.tzinfo is None


class StaticField:
    """A column of a table whose type is known when the query is planned; null means missing, or null if told so."""

    def __init__(self, name: str, column: Column | None, data_type: T.DataType | None, null_means: str = "missing"):
        self.name, self.column, self.data_type, self.null_is_value = name, column, data_type, null_means == "null"

    @property
    def kind(self) -> str:
        d = self.data_type
        if isinstance(d, T.BooleanType):
            return "bool"
        if isinstance(d, T.IntegralType):
            return "int"
        if isinstance(d, (T.FractionalType, T.DecimalType)):
            return "float"
        if isinstance(d, (T.StringType, T.VarcharType, T.CharType)):
            return "str"
        if isinstance(d, T.DateType):
            return "date"
        if isinstance(d, (T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        return "list" if isinstance(d, T.ArrayType) else "map"

    def _comparable(self, v) -> bool:
        t, k = type_name(v), self.kind
        if t in ("int", "float"):
            return k in ("int", "float")
        if t == "datetime":
            return k == "datetime" and _naive(v) == isinstance(self.data_type, T.TimestampNTZType)
        return t == k and t in ("bool", "str", "date")

    def _literal(self, v) -> Column:
        if type_name(v) == "datetime" and _naive(v):
            return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(v)

    def present(self) -> Column:
        return F.lit(False) if self.column is None else F.lit(True) if self.null_is_value else self.column.isNotNull()

    def predicate(self, op: str, v, negated: bool) -> Column:
        c = self.column
        if op == "exists":
            return self.present() if bool(v) != negated else ~self.present()
        if c is None:
            holds = (op == "is_null" and not v) or (op == "not_empty" and not v)
            return F.lit(holds != negated)
        if op == "is_null":
            p = c.isNull() if self.null_is_value else F.lit(False)
            return p if bool(v) != negated else ~p
        if op == "not_empty":
            full = c != "" if self.kind == "str" else F.size(c) > 0 if self.kind in ("list", "map") and not isinstance(self.data_type, T.StructType) else c.isNotNull()
            return full if bool(v) != negated else c.isNull() | ~full
        if op == "type":
            t = TYPE_ALIASES.get(str(v).lower(), str(v).lower())
            p = (self.present() if t == self.kind else F.lit(False)) if not self.null_is_value else c.isNull() if t == "null" else c.isNotNull() if t == self.kind else F.lit(False)
            return ~p if negated else p
        if op in ("ne", "not", "not_in"):
            p = self._positive("eq" if op != "not_in" else "in", v)
            if p is None:
                return ~self.present() if negated else self.present()
            hit = p if not self.null_is_value else F.coalesce(p, F.lit(False))
            if v is None:
                return p if negated else ~p
            return (c.isNull() | hit) if negated and not self.null_is_value else hit if negated else ~hit
        p = self._positive(op, v)
        if p is None:
            return F.lit(negated)
        if v is None and op == "eq":
            return ~p if negated else p
        return (c.isNull() | ~p) if negated else p

    def _positive(self, op: str, v) -> Column | None:
        """The bare comparison, null where the column is; None if it can't hold."""
        c = self.column
        if op == "eq":
            if v is None:
                return c.isNull() if self.null_is_value else None
            if self.kind == "list" and isinstance(v, (list, tuple)):
                return c == F.array(*map(F.lit, v)) if v else F.size(c) == 0
            return c == self._literal(v) if self._comparable(v) else None
        if op in _ORDER:
            return _ORDER[op](c, self._literal(v)) if self._comparable(v) and not isinstance(v, bool) else None
        if op == "in":
            own = [x for x in v if self._comparable(x)]
            return c.isin([self._plain_literal(x) for x in own]) if own else None
        if op == "contains" and self.kind == "list":
            element = StaticField("", c[0], self.data_type.elementType)
            return F.array_contains(c, self._literal(v)) if element._comparable(v) else None
        if self.kind != "str" or not isinstance(v, str):
            return None
        if op == "matches":
            return matches(c, v)
        return {"contains": lambda: c.contains(v), "icontains": lambda: F.lower(c).contains(v.lower()), "startswith": lambda: c.startswith(v), "endswith": lambda: c.endswith(v)}[op]()

    def _plain_literal(self, v):
        return self._literal(v) if type_name(v) == "datetime" else v

    # values for grouping, ordering and aggregates

    def scalar(self) -> Column:
        return self.column if self.column is not None else F.lit(None)

    def number(self) -> Column:
        return self.column if self.column is not None and self.kind in ("int", "float") else F.lit(None).cast("double")

    def key_json(self) -> Column:
        return self.scalar()


class DynamicField:
    """A field of a document's head: a tagged value whose type may differ from row to row."""

    def __init__(self, name: str, value: Column):
        self.name, self.v = name, value

    def present(self) -> Column:
        return self.v.isNotNull()

    def predicate(self, op: str, v, negated: bool) -> Column:
        if op in ("ne", "not", "not_in"):
            hit = F.coalesce(self._positive(self.v, "eq" if op != "not_in" else "in", v), F.lit(False))
            p = self.present() & ~hit
        elif op in ("exists", "is_null", "not_empty"):
            p = {"exists": self.present(), "is_null": F.coalesce(self.v["t"] == "null", F.lit(False)), "not_empty": self._full()}[op]
            if not v:
                p = ~p
        else:
            p = self._positive(self.v, op, v)
        return ~F.coalesce(p, F.lit(False)) if negated else p

    def _full(self) -> Column:
        t = self.v["t"]
        empty = F.when(t == "null", True).when(t == "str", self.v["s"] == "").when(t == "list", F.size(self.v["l"]) == 0).when(t == "map", self.v["j"] == "{}").otherwise(False)
        return self.present() & ~F.coalesce(empty, F.lit(True))

    @staticmethod
    def number_of(v: Column) -> Column:
        return F.when(v["t"] == "int", v["i"].cast("double")).when(v["t"] == "float", v["f"])

    def _same(self, x: Column, v, loose: bool = False) -> Column:
        """Equality with a literal; ``loose`` lets true equal 1 as membership does."""
        t = type_name(v)
        if t == "null":
            return x["t"] == "null"
        if t == "bool":
            p = (x["t"] == "bool") & (x["b"] == F.lit(v))
            return p | F.coalesce(self.number_of(x) == F.lit(float(v)), F.lit(False)) if loose else p
        if t in ("int", "float"):
            whole = isinstance(v, int) and -(2**63) <= v < 2**63
            p = F.when(x["t"] == "int", x["i"] == F.lit(v) if whole else x["i"].cast("double") == F.lit(float(v))).when(x["t"] == "float", x["f"] == F.lit(float(v)))
            return F.coalesce(p, F.lit(False)) | ((x["t"] == "bool") & (x["b"].cast("int") == F.lit(v))) if loose and v in (0, 1) else p
        if t == "str":
            return (x["t"] == "str") & (x["s"] == F.lit(v))
        if t == "date":
            return (x["t"] == "date") & (x["d"] == F.lit(v))
        if t == "datetime":
            return x["tn"] == F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz") if _naive(v) else x["ts"] == F.lit(v)
        return x["t"].isin("list", "map") & (x["j"] == F.lit(canonical(v)))

    def _positive(self, x: Column, op: str, v) -> Column:
        if op == "eq":
            return self._same(x, v)
        if op == "in":
            return reduce(or_, [F.coalesce(self._same(x, y, True), F.lit(False)) for y in v], F.lit(False)) & x.isNotNull()
        if op == "type":
            return x["t"] == TYPE_ALIASES.get(str(v).lower(), str(v).lower())
        if op in _ORDER:
            t = type_name(v)
            if t in ("int", "float"):
                return _ORDER[op](self.number_of(x), F.lit(float(v)))
            if t == "str":
                return (x["t"] == "str") & _ORDER[op](x["s"], F.lit(v))
            if t == "date":
                return _ORDER[op](x["d"], F.lit(v))
            if t == "datetime":
                return _ORDER[op](x["tn"], F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")) if _naive(v) else _ORDER[op](x["ts"], F.lit(v))
            return F.lit(False)
        if op == "contains":
            member = F.exists(x["l"], lambda e: F.coalesce(self._same(e, v, True), F.lit(False)))
            return F.when(x["t"] == "list", member).when(x["t"] == "str", x["s"].contains(v)) if isinstance(v, str) else F.when(x["t"] == "list", member)
        if not isinstance(v, str):
            return F.lit(False)
        s = F.when(x["t"] == "str", x["s"])
        return {"icontains": lambda: F.lower(s).contains(v.lower()), "startswith": lambda: s.startswith(v), "endswith": lambda: s.endswith(v), "matches": lambda: matches(s, v)}[op]()

    def scalar(self) -> Column:
        return self.v

    def number(self) -> Column:
        return self.number_of(self.v)
