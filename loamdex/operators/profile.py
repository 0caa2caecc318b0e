"""Profile of a workspace: presence, types, frequent values and ranges of each field."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from loamdex.workspace import Workspace


def _observed(ws: Workspace) -> DataFrame:
    """(field, t, shown, n, d) of each value; values of lists and maps aren't shown."""
    if ws.dynamic:
        x = ws.packets.select(F.explode("fm").alias("field", "v"))
        t = F.col("v.t")
        number = F.when(t == "int", F.col("v.i").cast("double")).when(t == "float", F.col("v.f"))
        stamp = F.coalesce(F.col("v.d").cast("string"), F.col("v.tn").cast("string"), F.col("v.ts").cast("string"))
        shown = F.when(t == "str", F.col("v.s")).when(t == "null", F.lit(None)).when(~t.isin("list", "map"), F.coalesce(stamp, F.col("v.j")))
        return x.select("field", t.alias("t"), shown.alias("shown"), number.alias("n"), stamp.alias("d"))
    fields = [ws.field(c) for c in ws.packets.columns if c != "packet_id"]
    one = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.when(f.scalar().isNull(), "null").otherwise(f.kind).alias("t"),
            (F.lit(None).cast("string") if f.kind in ("list", "map") else f.scalar().cast("string")).alias("shown"),
            f.number().cast("double").alias("n"),
            (f.scalar().cast("string") if f.kind in ("date", "datetime") else F.lit(None).cast("string")).alias("d"),
        )
        for f in fields
    ]
    x = ws.packets.select(F.explode(F.array(*one)).alias("x")).select("x.*")
    return x if ws.null_means == "null" else x.filter("t != 'null'")


def profile(ws: Workspace, *, top_n: int = 5) -> DataFrame:
    """One row a field: present_in, types, top_values, numeric and date ranges; by falling presence, then name."""
    x = _observed(ws)
    kinds = x.groupBy("field", "t").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("total"), F.count("n").alias("numbers"), F.min("d").alias("first"), F.max("d").alias("last"))
    stats = kinds.groupBy("field").agg(
        F.sum("c").alias("present_in"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "c")))).alias("types"),
        F.min("lo").alias("numeric_min"),
        F.max("hi").alias("numeric_max"),
        (F.sum("total") / F.sum("numbers")).alias("numeric_avg"),
        F.min("first").alias("date_min"),
        F.max("last").alias("date_max"),
    )
    counts = x.filter(~F.col("t").isin("list", "map")).groupBy("field", "shown").agg(F.count(F.lit(1)).alias("c"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.col("c").desc(), F.col("shown").asc_nulls_last()))).filter(F.col("r") <= top_n)
    top = best.groupBy("field").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "shown", "c"))), lambda s: F.struct(s["shown"].alias("value"), s["c"].alias("count"))).alias("top_values"))
    return stats.join(top, "field", "left").orderBy(F.col("present_in").desc(), "field")


def report(ws: Workspace, *, top_n: int = 5) -> dict:
    """The profile and the counts of packets as a JSON-ready document."""
    n = len(ws)
    bare = ws.packets.filter("not has_frontmatter").count() if "has_frontmatter" in ws.packets.columns else 0
    rows = profile(ws, top_n=top_n).collect()
    fields = [{"name": r.field, "present_in": r.present_in, "types": dict(r.types), "top_values": [{"value": v.value, "count": v["count"]} for v in r.top_values or []], "numeric_min": r.numeric_min, "numeric_max": r.numeric_max, "numeric_avg": r.numeric_avg, "date_min": r.date_min, "date_max": r.date_max} for r in rows]
    return {"root": ws.root, "packet_count": n, "files_without_frontmatter": bare, "fields": fields}


def report_text(r: dict) -> str:
    number = lambda v: f"{v:g}" if float(v).is_integer() else f"{v:.2f}"
    width = max([len(f["name"]) for f in r["fields"]], default=0)
    lines = [f"workspace: {r['root']}", f"  packets: {r['packet_count']}", f"  no-frontmatter: {r['files_without_frontmatter']}", "", "fields:"]
    for f in r["fields"]:
        cells = [f"  {f['name']:<{width}}", f"present={f['present_in']}", "types={" + ", ".join(f"{k}: {n}" for k, n in f["types"].items()) + "}"]
        if f["numeric_min"] is not None:
            cells += [f"range=[{number(f['numeric_min'])}..{number(f['numeric_max'])}]", f"avg={number(f['numeric_avg'])}"]
        if f["date_min"] is not None:
            cells.append(f"range=[{f['date_min']}..{f['date_max']}]")
        if f["top_values"]:
            cells.append("top: " + ", ".join(f"{v['value']} ({v['count']})" for v in f["top_values"]))
        lines.append("  ".join(cells))
    return "\n".join(lines if r["fields"] else [*lines, "  (none)"]) + "\n"


def report_json(r: dict) -> str:
    return json.dumps(r, ensure_ascii=False, indent=2)
