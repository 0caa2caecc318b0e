"""Results as text: ids, JSON lines, tab-separated rows, graph documents."""

from __future__ import annotations

import datetime as dt
import json
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.operators.graph import Subgraph

if TYPE_CHECKING:
    from loamdex.workspace import Workspace


def json_default(v):
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "__fspath__"):
        return str(v)
    raise TypeError(f"not JSON: {type(v).__name__}")


def native(v):
    """A tagged value as a Python value."""
    if v is None or v["t"] == "null":
        return None
    if v["t"] in ("list", "map"):
        return json.loads(v["j"])
    return {"bool": v["b"], "int": v["i"], "float": v["f"], "str": v["s"], "date": v["d"], "datetime": v["ts"] or v["tn"]}[v["t"]]


def packet_lines(ws: Workspace, df: DataFrame, fmt: str) -> DataFrame:
    """One line a packet: its id, or JSON of id and fields."""
    if fmt == "paths":
        return df.select(F.col("packet_id").alias("line"))
    if ws.dynamic:
        value = lambda v: F.when(v["t"].isin("date", "datetime"), F.concat(F.lit('"'), F.coalesce(v["d"].cast("string"), F.date_format(v["tn"], "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(v["ts"], "yyyy-MM-dd'T'HH:mm:ssxxx")), F.lit('"'))).otherwise(v["j"])
        body = F.array_join(F.transform("keys", lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(": "), value(F.col("fm")[k]))), ", ")
        fields: Column = F.concat(F.lit("{"), body, F.lit("}"))
    else:
        own = [c for c in ws.packets.columns if c != "packet_id"]
        fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))
    quoted = F.to_json(F.array("packet_id"))
    return df.select(F.concat(F.lit('{"id": '), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(', "frontmatter": '), fields, F.lit("}")).alias("line"))


def cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else json.dumps(v, default=json_default, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v)


def rows(result: DataFrame):
    """Rows of a pattern result as Python values."""
    for r in result.toLocalIterator():
        yield [native(v.asDict()) if hasattr(v, "asDict") else v for v in r]


def pattern_lines(result: DataFrame, fmt: str, *, scalar: bool):
    for values in rows(result):
        if scalar:
            yield json.dumps({"count": values[0]}) if fmt == "json" else str(values[0])
        elif fmt == "json":
            yield json.dumps({"columns": result.columns, "row": values}, default=json_default, ensure_ascii=False)
        else:
            yield "\t".join(map(cell, values))


def hit_lines(hits: DataFrame, fmt: str) -> DataFrame:
    if fmt == "paths":
        return hits.select(F.col("packet_id").alias("line"))
    if fmt == "json":
        return hits.select(F.to_json(F.struct(F.col("packet_id").alias("id"), "score", "snippet"), {"ignoreNullFields": "false"}).alias("line"))
    return hits.select(F.concat_ws("\t", "packet_id", F.format_string("%.6f", "score"), F.regexp_replace(F.coalesce("snippet", F.lit("")), r"[\t\r\n]", " ")).alias("line"))


def graph_document(ws: Workspace, g: Subgraph, fmt: str = "raw", *, ids_only: bool = False) -> dict:
    """Nodes, with their frontmatter unless ``ids_only``, and edges as one document, plain or for graph viewers that expect elements."""
    if ids_only:
        nodes = [{"id": r.packet_id} for r in g.nodes.orderBy("packet_id").collect()]
    else:
        own = ws.packets.join(g.nodes.select("packet_id").distinct(), "packet_id", "left_semi").orderBy("packet_id")
        nodes = [json.loads(r.line) for r in packet_lines(ws, own, "json").collect()]
    edges = [r.asDict() for r in g.edges.orderBy("source", "target", "field").collect()]
    if fmt == "raw":
        return {"nodes": nodes, "edges": edges}
    named = [{"data": {**e, "id": f"{e['source']}__{e['field']}__{e['target']}"}} for e in edges]
    return {"elements": {"nodes": [{"data": n} for n in nodes], "edges": named}}
