"""The predicate compiler against a plain evaluator, over packets and predicates made at random."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import workspace
from loamdex import expr
from loamdex.errors import FilterError
from loamdex.expr import And, Not, Or, Pred
from loamdex.plans.query import Query
from loamdex.values import TYPE_ALIASES, type_name
from loamdex.workspace import Workspace

VALUES = [None, True, False, 0, 1, 2, 3.0, 2.5, "", "a", "Ab", "b1", "2", dt.date(2026, 1, 1), dt.date(2026, 5, 1), dt.datetime(2026, 1, 1, 3), dt.datetime(2026, 1, 1, 3, tzinfo=dt.timezone.utc), [], ["a", 1], [True, "b1"], {}, {"k": 1}]
MISSING = object()


def equal(got, want):
    if isinstance(got, bool) != isinstance(want, bool):
        return False
    if type_name(got) in ("date", "datetime") or type_name(want) in ("date", "datetime"):
        return type(got) is type(want) and (not isinstance(got, dt.datetime) or (got.tzinfo is None) == (want.tzinfo is None)) and got == want
    return got == want


def comparable(a, b):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if number(a) and number(b) or isinstance(a, str) and isinstance(b, str):
        return True
    if isinstance(a, dt.datetime) and isinstance(b, dt.datetime):
        return (a.tzinfo is None) == (b.tzinfo is None)
    return type(a) is dt.date and type(b) is dt.date


def member(x, among):
    return any((x == y) and (type_name(x) in ("date", "datetime")) == (type_name(y) in ("date", "datetime")) and (not isinstance(x, dt.date) or type(x) is type(y) and (not isinstance(x, dt.datetime) or (x.tzinfo is None) == (y.tzinfo is None))) for y in among)


def holds(p, fields):
    v = fields.get(p.field, MISSING)
    op, w = p.op, p.value
    if op == "exists":
        return (v is not MISSING) == bool(w)
    if op == "is_null":
        return (v is not MISSING and v is None) == bool(w)
    if op == "not_empty":
        return (v is not MISSING and v is not None and v not in ("", [], {}) or v is not MISSING and v is False or v == 0 and v is not MISSING) == bool(w)
    if v is MISSING:
        return False
    if op == "eq":
        return equal(v, w)
    if op in ("ne", "not"):
        return not equal(v, w)
    if op in ("in", "not_in"):
        return member(v, w) == (op == "in")
    if op in ("gt", "gte", "lt", "lte"):
        if not comparable(v, w):
            return False
        return {"gt": v > w, "gte": v >= w, "lt": v < w, "lte": v <= w}[op]
    if op == "contains":
        return member(w, v) if isinstance(v, list) else isinstance(v, str) and isinstance(w, str) and w in v
    if op == "type":
        return type_name(v) == TYPE_ALIASES.get(w, w)
    if not isinstance(v, str) or not isinstance(w, str):
        return False
    return {"icontains": lambda: w.lower() in v.lower(), "startswith": lambda: v.startswith(w), "endswith": lambda: v.endswith(w), "matches": lambda: re.search(w, v) is not None}[op]()


def evaluate(e, fields):
    if isinstance(e, Not):
        return not evaluate(e.item, fields)
    if isinstance(e, And):
        return all(evaluate(x, fields) for x in e.items)
    return any(evaluate(x, fields) for x in e.items) if isinstance(e, Or) else holds(e, fields)


def some_pred(r, loose=True):
    """``loose``: with truth values in lists, which only documents compare with numbers."""
    op = r.choice(expr.OPERATORS)
    value = r.choice(VALUES)
    if op in ("in", "not_in"):
        value = [v for v in r.sample(VALUES, 3) if not isinstance(v, (list, dict)) and v is not None and (loose or not isinstance(v, bool))]
    elif op in ("exists", "is_null", "not_empty"):
        value = r.random() < 0.5
    elif op == "type":
        value = r.choice(["int", "str", "null", "none", "map", "dict", "bool", "date", "datetime", "list", "float"])
    elif op == "contains" and isinstance(value, (list, dict)):
        value = "a"
    elif op == "matches":
        value = r.choice(["a", "^b", r"\d", "(?P<x>A)b", ""])
    return Pred(r.choice("xyz"), op, value)


def some_expr(r, depth=2, loose=True):
    if depth == 0 or r.random() < 0.4:
        return some_pred(r, loose)
    kind = r.random()
    if kind < 0.3:
        return Not(some_expr(r, depth - 1, loose))
    items = tuple(some_expr(r, depth - 1, loose) for _ in range(r.randint(1, 3)))
    return And(items) if kind < 0.65 else Or(items)


def test_mixed_types_agree_with_plain_evaluation(spark):
    r = random.Random(5)
    records = {f"p{i:03d}": ({f: r.choice(VALUES) for f in "xyz" if r.random() < 0.85}, "") for i in range(120)}
    ws = workspace(spark, records)
    exprs = [some_expr(r) for _ in range(150)]
    for s in range(0, len(exprs), 30):
        part = exprs[s : s + 30]
        cols = [F.coalesce(expr.columns(e, lambda p: ws.field(p.field)), F.lit(False)).alias(f"e{k}") for k, e in enumerate(part)]
        for row in ws.packets.select("packet_id", *cols).collect():
            for k, e in enumerate(part):
                assert row[f"e{k}"] == evaluate(e, records[row.packet_id][0]), (e, records[row.packet_id][0])


def test_typed_columns_agree_with_plain_evaluation(spark):
    r = random.Random(9)
    kinds = {"x": ("bigint", [0, 1, 2, 5]), "y": ("string", ["", "a", "Ab", "b1"]), "z": ("timestamp_ntz", [dt.datetime(2026, 1, 1, 3), dt.datetime(2026, 2, 1)])}
    rows = [tuple([f"p{i}", *(r.choice(v) if r.random() < 0.8 else None for _, v in kinds.values())]) for i in range(60)]
    ws = Workspace.of(spark.createDataFrame(rows, "id string, " + ", ".join(f"{k} {t}" for k, (t, _) in kinds.items())), id="id")
    fields = {row[0]: {k: v for k, v in zip(kinds, row[1:]) if v is not None} for row in rows}
    exprs = [some_expr(r, loose=False) for _ in range(120)]
    for s in range(0, len(exprs), 40):
        part = exprs[s : s + 40]
        cols = [F.coalesce(expr.columns(e, lambda p: ws.field(p.field)), F.lit(False)).alias(f"e{k}") for k, e in enumerate(part)]
        for row in ws.packets.select("packet_id", *cols).collect():
            for k, e in enumerate(part):
                assert row[f"e{k}"] == evaluate(e, fields[row.packet_id]), (e, fields[row.packet_id])


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 a").write.parquet(str(tmp_path / "t"))
    ws = Workspace.of(spark.read.parquet(str(tmp_path / "t")), id="id")
    q = Query(ws).where_expr(And((Pred("a", "gt", 0), Not(Pred("id", "gte", 7)))))
    plan = q.frame()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,0)" in plan and "Or(IsNull(id),LessThan(id,7))" in plan.replace("Not(GreaterThanOrEqual(id,7))", "LessThan(id,7)")


@pytest.mark.parametrize("bad", [{"a__nope": 1}, {"__eq": 1}, {"a__in": 3}, {"a__matches": "("}, {"a__type": "word"}])
def test_bad_predicates(bad):
    with pytest.raises(FilterError):
        expr.from_kwargs(bad)


def test_kwargs_split_at_the_last_double_underscore():
    assert expr.from_kwargs({"a__b__gt": 1}) == Pred("a__b", "gt", 1)


def test_null_can_be_a_value(spark):
    ws = Workspace.of(spark.createDataFrame([("1", None), ("2", "x")], "id string, a string"), id="id", null_means="null")
    assert Query(ws).where(a__is_null=True).ids() == ["1"]
    assert Query(ws).where(a__exists=True).count() == 2
    assert Query(ws).where(a=None).ids() == ["1"]
    assert Query(ws).where(a__ne="x").ids() == ["1"]
