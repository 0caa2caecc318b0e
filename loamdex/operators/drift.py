"""Schemas that drift between files.

Method: rescue-column ingestion. A JSON column is read once into observed fields; those of
the target schema become typed columns, whatever is unknown or can't be cast stays as JSON in a rescue
column. Fields approved later, also under the names they had before, are promoted: rescued
values are replayed into new typed columns and leave the rescue column.

The drift report compares, of each two scans in a row, the observed fields, their majority
types and, to tell a rename from a removal and an addition, the distributions of what the values consist
of: of each ended and each begun field of one type, the shares of the hashed parts both have are joined
and summed. All of it is partial aggregation and joins on (workspace, scan, part), so no task holds a workspace; what
comes to the assignment of names is one row for each pair of an ended and a begun field.
The report also says which names mean one field, and those are what the consistent table promotes (``approved``).

Defined results: unreadable, null and empty frontmatter has no field (such packets still count
for the existence of their scan); of two types that are equally frequent the first by name
holds; a field with just nulls has no type and is neither retyped nor renamed; repeated rows
count once; a text that isn't a JSON object is unreadable.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import checkpointed

# The stable core of the project's heads; all else is rescued until it is promoted.
TARGET = {"uuid": "str", "title": "str", "type": "str", "owner": "str", "in_sprint": "str"}
SAME_CONTENT = 0.2
# Counts a task keeps before it passes them on.
_HELD = 200_000
_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_DATETIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d")


def type_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, list):
        return "list"
    if isinstance(v, dict):
        return "map"
    return "date" if _DATE.fullmatch(v) else "datetime" if _DATETIME.fullmatch(v) else "str"


def parts_of(v) -> list[str]:
    """What a value consists of: its words with digits alike, the size of a number, the year of a date, the keys of a map."""
    t = type_of(v)
    if t == "null":
        return []
    if t == "bool":
        return ["b"]
    if t in ("int", "float"):
        return [f"n{math.floor(math.log2(abs(v)) / 2)}" if v and math.isfinite(v) else "n"]
    if t in ("date", "datetime"):
        return [f"d{v[:4]}"]
    if t == "list":
        return [p for x in v for p in parts_of(x)]
    if t == "map":
        return [f"k{k}" for k in v]
    return [x.strip() for x in re.split("[,;]", re.sub(r"\d+", "9", v.lower()))]


@lru_cache(1 << 16)
def _content(text: str) -> tuple[str, tuple[int, ...]]:
    """Type and hashes of the distinct parts of a value given as JSON; most values come again and again."""
    from xxhash import xxh64_intdigest

    v = json.loads(text)
    return type_of(v), tuple(xxh64_intdigest(p) - (1 << 63) for p in set(parts_of(v)))


# Target type -> (Spark type, observed types that can be cast to it).
_CASTS = {
    "bool": ("boolean", ("bool",)),
    "int": ("bigint", ("int",)),
    "float": ("double", ("int", "float")),
    "str": ("string", ("str", "date", "datetime")),
    "date": ("date", ("date",)),
    "datetime": ("timestamp_ntz", ("date", "datetime")),
    "list": ("array<string>", ("list",)),
    "map": ("map<string,string>", ("map",)),
}


def cast(v, kind: str):
    """A JSON value as a target type, None where it can't be."""
    if type_of(v) not in _CASTS[kind][1]:
        return None
    text = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    try:
        if kind == "int":
            return v if -(2**63) <= v < 2**63 else None
        if kind == "float":
            return float(v)
        if kind == "date":
            return dt.date.fromisoformat(v)
        if kind == "datetime":
            return dt.datetime.fromisoformat(v)
    except (ValueError, OverflowError):
        return None
    if kind == "list":
        return [text(x) for x in v]
    return {k: text(x) for k, x in v.items()} if kind == "map" else v


def parse(text: str | None) -> dict | None:
    try:
        v = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def ingest(df: DataFrame, json_column: str, schema: dict[str, str], *, prefix: str = "") -> DataFrame:
    """Typed columns of the target ``schema`` (field -> type name) and ``_rescued``: field -> JSON of all that is unknown or can't be cast.

    A null under a known field is rescued too, so that it stays apart from a missing one; ``_rescued`` is
    null where the column is unreadable. ``prefix`` keeps the new columns apart from columns with the same names.
    """
    names = [f"c{k}" for k in range(len(schema))]

    @F.pandas_udf(", ".join([*(f"{n} {_CASTS[t][0]}" for n, t in zip(names, schema.values())), "rescued map<string,string>"]))
    def read(col):
        import pandas as pd

        out: dict[str, list] = {n: [] for n in (*names, "rescued")}
        for t in col:
            v = parse(t)
            for n, (field, kind) in zip(names, schema.items()):
                x = cast(v[field], kind) if v is not None and field in v else None
                out[n].append(x)
                if x is not None:
                    del v[field]
            out["rescued"].append(None if v is None else {k: json.dumps(x, ensure_ascii=False) for k, x in v.items()})
        return pd.DataFrame({n: pd.Series(x, dtype=object) for n, x in out.items()})

    d = df.withColumn("_x", read(F.col(json_column)))
    return d.withColumns({f"{prefix}{f}": F.col(f"_x.{n}") for f, n in zip(schema, names)} | {"_rescued": F.col("_x.rescued")}).drop("_x")


def promote(ingested: DataFrame, fields: dict[str, tuple[str, list[str]]], *, prefix: str = "") -> DataFrame:
    """Replay rescued values of approved fields (name -> (type, earlier names)) into typed columns.

    A value is taken from the first of the names that has one of the type, unless the column has one
    already; only what is taken leaves ``_rescued``.
    """
    names = [f"c{k}" for k in range(len(fields))]

    @F.pandas_udf(", ".join([*(f"{n} {_CASTS[t][0]}" for n, (t, _) in zip(names, fields.values())), "rescued map<string,string>"]))
    def replay(rescued, *free):
        import pandas as pd

        out: dict[str, list] = {n: [] for n in (*names, "rescued")}
        for row, *open_ in zip(rescued, *free):
            left = None if row is None else dict(row)
            for n, (field, (kind, earlier)), may in zip(names, fields.items(), open_):
                value = None
                for name in (field, *earlier) if left and may else ():
                    if name in left and (value := cast(json.loads(left[name]), kind)) is not None:
                        del left[name]
                        break
                out[n].append(value)
            out["rescued"].append(left)
        return pd.DataFrame({n: pd.Series(x, dtype=object) for n, x in out.items()})

    there = {f: F.col(f"{prefix}{f}") for f in fields if f"{prefix}{f}" in ingested.columns}
    d = ingested.withColumn("_x", replay("_rescued", *[there[f].isNull() if f in there else F.lit(True) for f in fields]))
    typed = {f"{prefix}{f}": F.coalesce(there[f], F.col(f"_x.{n}")) if f in there else F.col(f"_x.{n}") for f, n in zip(fields, names)}
    return d.withColumns(typed | {"_rescued": F.col("_x.rescued")}).drop("_x")


def field_counts(ingested: DataFrame, schema: dict[str, str], *, prefix: str = "") -> DataFrame:
    """(workspace, scan_no, field, kind, part, n): how often a field has a type, and (with a null kind) how often it holds a part; counted within tasks first."""
    import pyarrow as pa

    cols = [F.col("workspace").cast("string"), F.col("scan_no").cast("int").alias("scan_no"), "_rescued", *[F.col(f"{prefix}{f}").alias(f"c{k}") for k, f in enumerate(schema)]]
    src = ingested.filter("_rescued is not null").select(*cols)
    out = pa.schema([("workspace", pa.string()), ("scan_no", pa.int32()), ("field", pa.string()), ("kind", pa.string()), ("part", pa.int64()), ("n", pa.int64())])

    def run(batches):
        count: Counter = Counter()

        def held():
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*(k + (n,) for k, n in count.items())) if count else [[]] * 6, out.types)], schema=out)
            count.clear()
            return got

        for batch in batches:
            rows = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for w, s, rescued, *typed in zip(*rows):
                # A date in a text column is still a date as the project's types go.
                seen = [(f, *_content(t)) for f, t in rescued]
                for f, kind, v in zip(schema, schema.values(), typed):
                    if v is not None:
                        own = _content(json.dumps(v.isoformat() if isinstance(v, dt.date) else v))
                        seen.append((f, own[0] if kind == "str" else kind, own[1]))
                for f, kind, parts in seen:
                    count[w, s, f, kind, None] += 1
                    for p in parts:
                        count[w, s, f, None, p] += 1
                if len(count) > _HELD:
                    yield held()
        yield held()

    return src.mapInArrow(run, "workspace string, scan_no int, field string, kind string, part long, n long").groupBy("workspace", "scan_no", "field", "kind", "part").agg(F.sum("n").alias("n"))


def likeness(ended: DataFrame, begun: DataFrame, parts: DataFrame) -> DataFrame:
    """(workspace, now, old, new, alike): of ended and begun fields of one type the shared part of their contents.

    ``ended`` is (workspace, was, now, field, kind), ``begun`` (workspace, now, field, kind).
    """
    total = parts.groupBy("workspace", "scan_no", "field").agg(F.sum("n").alias("total"))
    side = lambda d, scan, name: (
        d.withColumnRenamed(scan, "scan_no").join(total, ["workspace", "scan_no", "field"]).join(parts, ["workspace", "scan_no", "field"]).select("workspace", *(["now"] if scan != "now" else [F.col("scan_no").alias("now")]), "kind", "part", F.col("field").alias(name), (F.col("n") / F.col("total")).alias(f"{name}_share"))
    )
    both = side(ended, "was", "old").join(side(begun, "now", "new"), ["workspace", "now", "kind", "part"])
    return both.groupBy("workspace", "now", "old", "new").agg(F.round(F.sum(F.least("old_share", "new_share")), 9).alias("alike"))


def one_to_one(alike: DataFrame, same_content: float) -> DataFrame:
    """(workspace, now, old, new): renames, the most alike pair first, each name once; a group holds pairs of fields of one scan."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("alike")).alias("by"), "old", "new")))
    none = F.array().cast("array<struct<old:string,new:string>>")
    taken = lambda acc, x: F.exists(acc, lambda t: (t["old"] == x["old"]) | (t["new"] == x["new"]))
    chosen = F.aggregate("pairs", none, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(F.struct(x["old"].alias("old"), x["new"].alias("new"))))))
    return alike.filter(F.col("alike") >= same_content).groupBy("workspace", "now").agg(pairs.alias("pairs")).select("workspace", "now", F.explode(chosen).alias("x")).select("workspace", "now", "x.old", "x.new")


def _counts(packets: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Checkpointed counts of the fields of all distinct packets, ingested under ``schema``."""
    p = packets.select(F.col("workspace").cast("string").alias("workspace"), F.col("scan_no").cast("int").alias("scan_no"), "packet_id", "frontmatter").filter("workspace is not null and scan_no is not null").distinct()
    return checkpointed(field_counts(ingest(p, "frontmatter", schema, prefix="is_"), schema, prefix="is_"))


def drift(packets: DataFrame, *, schema: dict[str, str] = TARGET, same_content: float = SAME_CONTENT, counts: DataFrame | None = None) -> DataFrame:
    """(workspace, scan_no, field, change_kind, became) of each change from a scan of a workspace to the next.

    The table is ingested under ``schema``; typed and rescued values together are what a scan holds.
    """
    counts = _counts(packets, schema) if counts is None else counts
    scans = packets.select(F.col("workspace").cast("string").alias("workspace"), F.col("scan_no").cast("int").alias("scan_no")).filter("workspace is not null and scan_no is not null").distinct()
    scans = scans.select("workspace", F.col("scan_no").alias("was"), F.lead("scan_no").over(Window.partitionBy("workspace").orderBy("scan_no")).alias("now")).filter("now is not null")
    # Of equally frequent types the first by name; null where a field has nulls alone.
    first = F.min(F.when(F.col("kind") != "null", F.struct((-F.col("n")).alias("by"), "kind")))
    fields = counts.filter("kind is not null").groupBy("workspace", "scan_no", "field").agg(first.alias("t")).select("workspace", "scan_no", "field", F.col("t.kind").alias("kind"))
    before = fields.withColumnRenamed("scan_no", "was").join(scans, ["workspace", "was"]).select("workspace", "now", "field", "was", F.col("kind").alias("old"), F.lit(True).alias("there"))
    after = fields.withColumnRenamed("scan_no", "now").join(scans, ["workspace", "now"]).select("workspace", "now", "field", F.col("kind").alias("new"), F.lit(True).alias("here"))
    both = checkpointed(before.join(after, ["workspace", "now", "field"], "full").filter("here is null or there is null or old != new"))
    ended, begun = both.filter("here is null"), both.filter("there is null")
    alike = likeness(ended.filter("old is not null").select("workspace", "was", "now", "field", F.col("old").alias("kind")), begun.filter("new is not null").select("workspace", "now", "field", F.col("new").alias("kind")), counts.filter("kind is null").drop("kind"))
    named = checkpointed(one_to_one(alike, same_content))
    retyped = both.filter("here and there").select("workspace", "now", "field", F.lit("retyped").alias("change_kind"), F.col("new").alias("became"))
    gone = ended.join(named.withColumnRenamed("old", "field").withColumnRenamed("new", "to"), ["workspace", "now", "field"], "left").select("workspace", "now", "field", F.when(F.col("to").isNull(), "removed").otherwise("renamed").alias("change_kind"), F.coalesce("to", F.lit("")).alias("became"))
    added = begun.join(named.withColumnRenamed("new", "field"), ["workspace", "now", "field"], "left_anti").select("workspace", "now", "field", F.lit("added").alias("change_kind"), F.lit("").alias("became"))
    return retyped.unionByName(gone).unionByName(added).withColumnRenamed("now", "scan_no").select("workspace", "scan_no", "field", "change_kind", "became")


_FAMILY = {"int": "number", "float": "number", "date": "time", "datetime": "time"}


def approved(counts: DataFrame, report: DataFrame, *, share: float = 0.001) -> dict[str, tuple[str, list[str]]]:
    """Fields to promote, by the drift report: name -> (type, other names renames connect it with).

    Names that at least ``share`` of all readings have take part, so what is collected is bounded by 1 / share times the
    mean number of fields of a packet. The most frequent name of a group stands for it; its type is that of most
    values, a float or datetime where numbers or times of both precisions occur.
    """
    kinds = counts.filter("kind is not null").groupBy("field", "kind").agg(F.sum("n").alias("n"))
    # Each packet counts for its most frequent field at least, so that is the number of packets to within the fields' spread.
    total = kinds.groupBy("field").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    often = kinds.groupBy("field").agg(F.sum("n").alias("all")).filter(F.col("all") >= share * total)
    seen: dict[str, Counter] = {}
    for r in kinds.join(often, "field", "left_semi").collect():
        seen.setdefault(r.field, Counter())[r.kind] += r.n
    names = often.select("field")
    pairs = report.filter("change_kind = 'renamed'").select("field", "became").distinct().join(names, "field", "left_semi").join(names.withColumnRenamed("field", "became"), "became", "left_semi")
    group = {f: f for f in seen}

    def top(f: str) -> str:
        while group[f] != f:
            f = group[f]
        return f

    for r in pairs.collect():
        group[top(r.field)] = top(r.became)
    members: dict[str, list[str]] = {}
    for f in seen:
        members.setdefault(top(f), []).append(f)
    out: dict[str, tuple[str, list[str]]] = {}
    for own in members.values():
        first, *others = sorted(own, key=lambda f: (-sum(seen[f].values()), f))
        n = sum((seen[f] for f in own), Counter())
        n.pop("null", None)
        if not n:
            continue
        best = Counter()
        for k, c in n.items():
            best[_FAMILY.get(k, k)] += c
        family = min(best, key=lambda k: (-best[k], k))
        kind = {"number": "float" if n["float"] else "int", "time": "datetime" if n["datetime"] else "date"}.get(family, family)
        out[first] = (kind, others)
    return dict(sorted(out.items()))


def consistent(packets: DataFrame, *, schema: dict[str, str] = TARGET, same_content: float = SAME_CONTENT) -> DataFrame:
    """All packets as one table: the target schema, the fields the drift report approves replayed into typed columns, the rest rescued."""
    counts = _counts(packets, schema)
    fields = {f: v for f, v in approved(counts, drift(packets, schema=schema, same_content=same_content, counts=counts)).items() if f not in schema}
    p = packets.select("packet_id", "workspace", "scan_no", "frontmatter").distinct()
    clash = {"packet_id", "workspace", "scan_no", "frontmatter", "rescued"}
    table = promote(ingest(p, "frontmatter", schema), {f: v for f, v in fields.items() if f.lower() not in clash and f.lower() not in {x.lower() for x in schema}})
    return table.withColumnRenamed("_rescued", "rescued").drop("frontmatter")
