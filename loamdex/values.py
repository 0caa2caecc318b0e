"""Values of documents: nine types, told apart by a tag.

A document's head is a map from field to a tagged struct, so that a field may have another type in
each document while every comparison stays a JVM expression on one member of the struct.
"""

from __future__ import annotations

import datetime as dt
import json

TYPE_NAMES = ("null", "bool", "int", "float", "str", "datetime", "date", "list", "map")
TYPE_ALIASES = {"dict": "map", "none": "null"}

_SCALARS = "t string, b boolean, i bigint, f double, s string, d date, ts timestamp, tn timestamp_ntz, j string"
TAGGED = f"struct<{', '.join(x.replace(' ', ':', 1) for x in _SCALARS.split(', '))},l:array<struct<{', '.join(x.replace(' ', ':', 1) for x in _SCALARS.split(', '))}>>>"


def type_name(v) -> str:
    if v is None:
        return "null"
    for name, kind in (("bool", bool), ("int", int), ("float", float), ("str", str), ("datetime", dt.datetime), ("date", dt.date)):
        if isinstance(v, kind):
            return name
    return "list" if isinstance(v, (list, tuple)) else "map" if isinstance(v, dict) else "unknown"


def iso(v: dt.date | dt.datetime) -> str:
    return v.isoformat()


def plain(v):
    """A value that JSON can hold: dates as ISO text, keys as text."""
    if isinstance(v, (dt.date, dt.datetime)):
        return iso(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    return v


def canonical(v) -> str:
    """JSON that is equal for equal values: keys sorted, whole floats as integers, dates marked."""

    def norm(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
            return int(x)
        if isinstance(x, (dt.date, dt.datetime)):
            return {"@": iso(x)}
        if isinstance(x, (list, tuple)):
            return [norm(y) for y in x]
        if isinstance(x, dict):
            return {str(k): norm(y) for k, y in x.items()}
        return x

    return json.dumps(norm(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


_NAMES = {type(None): "null", bool: "bool", int: "int", float: "float", str: "str", dt.datetime: "datetime", dt.date: "date", list: "list", tuple: "list", dict: "map"}
_PARTS = ("t", "b", "i", "f", "s", "d", "ts", "tn", "j")


def tagged_array(values: list, nested: bool = False):
    """Tagged values of a batch as one Arrow array, built member by member."""
    import pyarrow as pa

    n = len(values)
    cols: dict[str, list] = {p: [None] * n for p in _PARTS}
    t, j = cols["t"], cols["j"]
    inner: list = []
    offsets, not_list = [0], [True] * n
    for k, v in enumerate(values):
        name = _NAMES.get(type(v)) or type_name(v)
        if name == "int" and not -(2**63) <= v < 2**63:
            name, v = "float", float(v)
        t[k] = name
        if name == "str":
            cols["s"][k], j[k] = v, json.dumps(v, ensure_ascii=False)
        elif name in ("bool", "int", "float"):
            cols[name[0]][k], j[k] = v, canonical(v)
        elif name == "date":
            cols["d"][k], j[k] = v, canonical(v)
        elif name == "datetime":
            cols["ts" if v.tzinfo else "tn"][k], j[k] = v, canonical(v)
        else:
            j[k] = "null" if name == "null" else canonical(v)
            if name == "list":
                inner += v
                not_list[k] = False
        offsets.append(len(inner))
    kind = arrow_type(nested)
    arrays = [pa.array(cols[p], kind.field(p).type) for p in _PARTS]
    if not nested:
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tagged_array(inner, True), mask=pa.array(not_list, pa.bool_())))
    return pa.StructArray.from_arrays(arrays, fields=list(kind))


def head_array(heads: list[dict]):
    """Maps field -> tagged value of a batch of heads."""
    import pyarrow as pa

    offsets = [0]
    for h in heads:
        offsets.append(offsets[-1] + len(h))
    keys = pa.array([str(k) for h in heads for k in h], pa.string())
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), keys, tagged_array([v for h in heads for v in h.values()]))


def arrow_type(nested: bool = False):
    import pyarrow as pa

    fields = [("t", pa.string()), ("b", pa.bool_()), ("i", pa.int64()), ("f", pa.float64()), ("s", pa.string()), ("d", pa.date32()), ("ts", pa.timestamp("us", "UTC")), ("tn", pa.timestamp("us")), ("j", pa.string())]
    return pa.struct(fields if nested else [*fields, ("l", pa.list_(arrow_type(True)))])
