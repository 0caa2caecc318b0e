"""References to records that do not exist.

Method: references and the records they may name are co-partitioned and sorted by key
and merged in one linear pass (a sort-merge join); a record carries the interval in which it
is valid, so that the merge tells missing, deleted and late ones apart. A key that very many
references name is split over tasks while the plan runs (adaptive skew-join splitting of the
reference side; a key has one record, so only that record is copied).

Defined results: null and blank references are skipped; of several records with one key
the interval spans from the first creation to the last deletion, and a record without
deletion keeps it open; a record without creation time was always there; a reference without time can
only be missing; a reference that is both deleted and late counts as deleted; repeated rows yield one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_key(c: Column | str) -> Column:
    """A reference without surrounding blanks, a leading ``./`` and everything from ``#`` on."""
    return F.regexp_extract(c, r"(?s)^\s*(?:\./)?\s*([^#]*?)\s*(?:#.*)?$", 1)


def plain_name(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def records(*sources: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(ref_key, opened, closed) of the records of several (table, key, created, deleted)."""
    out = None
    for df, key, created, deleted in sources:
        d = df.select(F.col(key).alias("ref_key"), F.col(created).alias("opened"), F.col(deleted).alias("closed")).filter("ref_key is not null")
        out = d if out is None else out.unionByName(d)
    always = F.lit("0001-01-01").cast("timestamp_ntz")
    never = F.lit("9999-12-31").cast("timestamp_ntz")
    return out.groupBy("ref_key").agg(F.min(F.coalesce("opened", always)).alias("opened"), F.max(F.coalesce("closed", never)).alias("closed"))


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Of references (src_table, row_key, field, ref_key, at): those whose record is missing, deleted or late."""
    refs = references.filter("ref_key is not null and ref_key != ''")
    joined = refs.hint("merge").join(parents.withColumn("_there", F.lit(True)), "ref_key", "left")
    kind = F.when(F.col("_there").isNull(), "missing").when(F.col("closed") <= F.col("at"), "deleted").when(F.col("opened") > F.col("at"), "late")
    found = joined.withColumn("kind", kind).filter("kind is not null").select("src_table", "row_key", "field", "ref_key", "kind", F.date_format("at", "yyyy-MM").alias("month_key"))
    # An exchange of its own: a distinct that relied on the join's partitioning would keep the join from splitting a hot key.
    return found.repartition("row_key", "field", "ref_key").distinct()


def frontmatter_references(packets: DataFrame, fields: list[str], *, key: str = "packet_id", frontmatter: str = "frontmatter", at: str = "modified_at") -> DataFrame:
    """(row_key, field, ref_key, at) of the strings, single or in a list, under some fields of a JSON column; unreadable JSON has none."""
    v = F.try_parse_json(F.col(frontmatter))
    p = packets.select(F.col(key).alias("row_key"), F.col(at).alias("at"), v.alias("v")).filter("v is not null")
    one = [F.struct(F.lit(f).alias("field"), F.coalesce(F.try_variant_get("v", f"$.{f}", "array<string>"), F.array(F.try_variant_get("v", f"$.{f}", "string"))).alias("refs")) for f in fields]
    return p.select("row_key", "at", F.explode(F.array(*one)).alias("x")).select("row_key", "at", F.col("x.field").alias("field"), F.explode("x.refs").alias("raw")).select("row_key", "field", reference_key("raw").alias("ref_key"), "at")


def found(edges: DataFrame, packets: DataFrame, registry: DataFrame) -> DataFrame:
    """Orphans of edges.target and of blocked_by, in_sprint and owner in packets.frontmatter."""
    registered = (registry, "ref_key", "opened_at", "retired_at")
    e = edges.select(F.lit("edges").alias("src_table"), F.col("edge_id").cast("string").alias("row_key"), plain_name("field").alias("field"), reference_key("target").alias("ref_key"), F.col("seen_at").alias("at"))
    f = frontmatter_references(packets, ["blocked_by", "in_sprint", "owner"]).select(F.lit("packets").alias("src_table"), "row_key", "field", "ref_key", "at")
    # One merge for all: a prefix keeps the two spaces of keys apart, packet ids and registry keys from uuids.
    space = F.when(F.col("field") == "blocked_by", "u:").otherwise("k:")
    refs = e.withColumn("ref_key", F.concat(F.lit("e:"), "ref_key")).unionByName(f.withColumn("ref_key", F.concat(space, "ref_key"))).filter(F.length("ref_key") > 2)
    mark = lambda d, key, p: d.withColumn(key, F.concat(F.lit(p), key))
    parents = records((mark(packets, "packet_id", "e:"), "packet_id", "created_at", "deleted_at"), (mark(registry, "ref_key", "e:"), *registered[1:]), (mark(registry, "ref_key", "k:"), *registered[1:]), (mark(packets, "uuid", "u:"), "uuid", "created_at", "deleted_at"))
    return orphans(refs, parents).withColumn("ref_key", F.substring("ref_key", 3, 1 << 30))
