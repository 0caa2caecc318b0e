"""Queries of the document-query engine over the shared tables, with SQL that says the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators import graph
from loamdex.operators.aggregate import Avg, Count, Max, Min, Sum
from loamdex.operators.ordering import places
from loamdex.operators.pattern import PatternQuery
from loamdex.operators.profile import profile
from loamdex.plans.query import Query, compile_query
from loamdex.search import rank, registry
from loamdex.session import ensure_checkpoint, table
from loamdex.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _ws(spark: SparkSession, sf: str, name: str, id: str | list[str], **options) -> Workspace:
    ensure_checkpoint(spark)
    return Workspace.of(table(spark, sf, name), id=id, **options)


def _ids(df: DataFrame, *more: str) -> DataFrame:
    return df.select("packet_id", *more)


CLOCK = lambda: dt.datetime(1997, 1, 10, tzinfo=dt.timezone.utc)

# ------------------------------------------------------------------ predicates and the filter language


@query("select o_orderkey::varchar packet_id from orders where o_orderstatus = 'O' and o_totalprice > 200000")
def filter_eq_and_gt(spark, sf):
    return _ids(compile_query('o_orderstatus = "O" AND o_totalprice > 200000', _ws(spark, sf, "orders", "o_orderkey")).frame())


@query("select o_orderkey::varchar packet_id from orders where o_totalprice < 50000 or not (o_orderstatus = 'F' or o_totalprice >= 150000)")
def filter_or_not(spark, sf):
    return _ids(compile_query('o_totalprice < 50000 OR NOT (o_orderstatus = "F" OR o_totalprice >= 150000)', _ws(spark, sf, "orders", "o_orderkey")).frame())


@query("select p_partkey::varchar packet_id from part where p_size in (1, 7, 30)")
def filter_in(spark, sf):
    return _ids(compile_query('p_size IN [1, 7, 30, "x"]', _ws(spark, sf, "part", "p_partkey")).frame())


@query("select p_partkey::varchar packet_id from part where p_size not in (1, 7, 30) and p_brand != 'Brand#11'")
def filter_not_in_ne(spark, sf):
    return _ids(Query(_ws(spark, sf, "part", "p_partkey")).where(p_size__not_in=[1, 7, 30], p_brand__ne="Brand#11").frame())


@query("select packet_id from (select c_custkey::varchar packet_id, nullif(c_mktsegment, 'BUILDING') s from customer) where s is null or s != 'MACHINERY'")
def filter_not_keeps_missing(spark, sf):
    c = table(spark, sf, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return _ids(compile_query('NOT segment = "MACHINERY"', Workspace.of(c, id="c_custkey")).frame())


@query("select doc_id::varchar packet_id from documents where contains(text, 'ferry') and not contains(lower(text), 'bridge')")
def filter_contains(spark, sf):
    from loamdex.expr import Pred

    return _ids(Query(_ws(spark, sf, "documents", "doc_id")).where(text__contains="ferry").where_expr(~Pred("text", "icontains", "Bridge")).frame())


@query("select p_partkey::varchar packet_id from part where starts_with(p_type, 'STANDARD') or ends_with(p_name, 'e')")
def filter_prefix_suffix(spark, sf):
    from loamdex.expr import Pred

    return _ids(Query(_ws(spark, sf, "part", "p_partkey")).where_expr(Pred("p_type", "startswith", "STANDARD") | Pred("p_name", "endswith", "e")).frame())


@query("select p_partkey::varchar packet_id from part where regexp_matches(p_brand, '#[1-3]+$')")
def filter_matches(spark, sf):
    return _ids(compile_query('p_brand MATCHES "#[1-3]+$"', _ws(spark, sf, "part", "p_partkey")).frame())


@query("select doc_id::varchar packet_id, (text is not null)::int there, (text is not null and text != '')::int filled from documents")
def filter_exists_empty(spark, sf):
    ws = _ws(spark, sf, "documents", "doc_id")
    f = ws.field("text")
    return ws.packets.select("packet_id", f.predicate("exists", True, False).cast("int").alias("there"), F.coalesce(f.predicate("not_empty", True, False), F.lit(False)).cast("int").alias("filled"))


@query("select event_id::varchar packet_id from events where event_type in ('click', 'view') and value > 50")
def filter_type(spark, sf):
    return _ids(Query(_ws(spark, sf, "events", "event_id")).where(value__type="float", event_type__type="str", event_type__in=["click", "view"], value__gt=50).frame())


@query("select l_orderkey::varchar || '/' || l_linenumber::varchar packet_id from lineitem where l_quantity != 7 and l_quantity > 45")
def filter_type_mismatch(spark, sf):
    """A text never equals a number, so != keeps every row that has the field, and > with a text none."""
    ws = _ws(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    return _ids(compile_query('l_quantity != "7" AND l_quantity != 7 AND NOT l_quantity > "a" AND l_quantity > 45', ws).frame())


@query("select o_orderkey::varchar packet_id from orders where o_orderdate >= timestamp '1997-01-01 12:00:00' and o_orderdate < timestamp '1997-02-01'")
def filter_date_range(spark, sf):
    return _ids(compile_query("o_orderdate >= 1997-01-01T12:00:00 AND o_orderdate < 1997-02-01T00:00:00", _ws(spark, sf, "orders", "o_orderkey")).frame())


@query("select o_orderkey::varchar packet_id from orders where o_orderdate::date > date '1997-01-03' and o_orderdate::date <= date '1997-01-10'")
def filter_date_words(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    ensure_checkpoint(spark)
    return _ids(compile_query("day > today-7d AND day <= today", Workspace.of(o, id="o_orderkey"), clock=CLOCK).frame())


@query(
    """select packet_id, json_extract_string(frontmatter, '$.status') status from
    (select distinct packet_id, frontmatter from packets where json_valid(frontmatter))
    where json_type(json_extract(frontmatter, '$.priority')) in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_extract(frontmatter, '$.priority')::double >= 3
      and not (json_type(json_extract(frontmatter, '$.status')) is not distinct from 'VARCHAR' and json_extract_string(frontmatter, '$.status') = 'done')"""
)
def filter_dynamic(spark, sf):
    """Documents whose fields have another type from row to row."""
    ws = _dynamic(spark, sf)
    q = compile_query('priority >= 3 AND NOT status = "done"', ws)
    return q.frame().select("packet_id", F.get_json_object(F.concat(F.lit('{"s":'), F.col("fm")["status"]["j"], F.lit("}")), "$.s").alias("status"))


def _dynamic(spark, sf) -> Workspace:
    """The packets table as a workspace of documents with heads of mixed types."""
    import pyarrow as pa

    from loamdex.operators.drift import parse, type_of
    from loamdex.values import TAGGED, head_array

    def value(x):
        kind = type_of(x) if isinstance(x, str) else ""
        return dt.date.fromisoformat(x) if kind == "date" else dt.datetime.fromisoformat(x) if kind == "datetime" else x

    def read(batches):
        for batch in batches:
            heads = [{k: value(x) for k, x in (parse(t) or {}).items()} for t in batch.column(1).to_pylist()]
            has = pa.array([t is not None for t in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), has, head_array(heads), batch.column(2)], names=["packet_id", "has_frontmatter", "fm", "body"])

    ensure_checkpoint(spark)
    p = table(spark, sf, "packets").select("packet_id", "frontmatter", "body").distinct()
    return Workspace(p.mapInArrow(read, f"packet_id string, has_frontmatter boolean, fm map<string,{TAGGED}>, body string"), dynamic=True, default_resolver=graph.FieldResolver("uuid"))


# ------------------------------------------------------------------ order


@query("select c_custkey::varchar packet_id, row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey::varchar) r from customer")
def order_by_keys(spark, sf):
    """The place of every customer."""
    return places(compile_query("* ORDER BY c_mktsegment, c_acctbal DESC", _ws(spark, sf, "customer", "c_custkey")).df())


@query("select packet_id, r from (select n_nationkey::varchar packet_id, row_number() over (order by nullif(n_regionkey, 2) desc nulls last, n_nationkey::varchar) r from nation)")
def order_nulls(spark, sf):
    n = table(spark, sf, "nation").withColumn("region", F.nullif("n_regionkey", F.lit(2)))
    return places(compile_query("* ORDER BY region DESC NULLS LAST", Workspace.of(n, id="n_nationkey")).df())


@query(
    """with v as (select distinct packet_id, json_extract(frontmatter, '$.priority') p from packets where json_valid(frontmatter)),
    k as (select packet_id, json_type(p) t, case when json_type(p) = 'BOOLEAN' then p::boolean::int::double when json_type(p) in ('UBIGINT', 'BIGINT', 'DOUBLE') then p::double end n, json_extract_string(p, '$') s
        from v where p is not null and json_type(p) not in ('NULL', 'ARRAY', 'OBJECT')),
    c as (select *, case when t = 'BOOLEAN' then 1 when t != 'VARCHAR' then 2 when regexp_full_match(s, '\\d{4}-\\d\\d-\\d\\d(T\\d\\d:\\d\\d:\\d\\d)?') then 3 else 4 end rk from k)
    select packet_id, row_number() over (order by rk, n nulls last, case when rk > 2 then s end nulls last, packet_id) r from c"""
)
def order_mixed_types(spark, sf):
    """The place of every packet with a scalar priority: truth values, numbers, dates, then texts."""
    from loamdex.expr import Pred

    ws = _dynamic(spark, sf)
    q = Query(ws).where_expr(Pred("priority", "is_null", False)).where(priority__exists=True).where_expr(~Pred("priority", "type", "list") & ~Pred("priority", "type", "map"))
    return places(q.order_by("priority").df())


# ------------------------------------------------------------------ aggregation


@query("select o_orderstatus \"key\", count(*) n, round(sum(o_totalprice), 2) total, round(avg(o_totalprice), 2) mean, min(o_orderdate) first, max(o_totalprice) top from orders group by 1")
def group_aggregates(spark, sf):
    q = Query(_ws(spark, sf, "orders", "o_orderkey"))
    out = q.group_by("o_orderstatus").aggregate(n=Count(), total=Sum("o_totalprice"), mean=Avg("o_totalprice"), first=Min("o_orderdate"), top=Max("o_totalprice"))
    return out.withColumns({c: F.round(c, 2) for c in ("total", "mean")})


@query("select l_returnflag \"key\", count(*) n, round(sum(l_extendedprice), 2) total from lineitem where l_shipdate < timestamp '1998-09-02' group by 1")
def group_after_filter(spark, sf):
    ws = _ws(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    out = compile_query("l_shipdate < 1998-09-02T00:00:00", ws).group_by("l_returnflag").aggregate(n=Count(), total=Sum("l_extendedprice"))
    return out.withColumn("total", F.round("total", 2))


@query("select c_mktsegment \"key\", count(s) named, 0 words from (select c_mktsegment, nullif(c_nationkey, 3) s from customer) group by 1")
def group_count_field(spark, sf):
    c = table(spark, sf, "customer").withColumn("nation", F.nullif("c_nationkey", F.lit(3)))
    return Query(Workspace.of(c, id="c_custkey")).group_by("c_mktsegment").aggregate(named=Count("nation"), words=Sum("c_name")).withColumn("words", F.col("words").cast("int"))


@query(
    """select json_extract_string(frontmatter, '$.type') "key", 'str' key_type, count(*)::bigint n,
       sum(case when json_type(json_extract(frontmatter, '$.priority')) in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract(frontmatter, '$.priority')::double else 0 end)::decimal(18, 2)::double total
    from (select distinct packet_id, frontmatter from packets where json_valid(frontmatter)) where json_type(json_extract(frontmatter, '$.type')) = 'VARCHAR' group by 1"""
)
def group_dynamic(spark, sf):
    return Query(_dynamic(spark, sf)).group_by("type").aggregate(n=Count(), total=Sum("priority")).withColumn("total", F.round("total", 2))


@query(
    """select 'c_mktsegment' field, count(c_mktsegment) present_in, null::double numeric_min, null::double numeric_max, null::double numeric_avg from customer
    union all select 'c_acctbal', count(c_acctbal), min(c_acctbal), max(c_acctbal), round(avg(c_acctbal), 4) from customer
    union all select 'c_nationkey', count(c_nationkey), min(c_nationkey), max(c_nationkey), round(avg(c_nationkey), 4) from customer
    union all select 'c_custkey', count(c_custkey), min(c_custkey), max(c_custkey), round(avg(c_custkey), 4) from customer
    union all select 'c_name', count(c_name), null, null, null from customer"""
)
def describe_profile(spark, sf):
    return profile(_ws(spark, sf, "customer", "c_custkey")).select("field", "present_in", "numeric_min", "numeric_max", F.round("numeric_avg", 4).alias("numeric_avg"))


@query(
    """with v as (select distinct packet_id, frontmatter from packets where json_valid(frontmatter)),
    k as (select packet_id, unnest(json_keys(frontmatter)) field from v) select field, count(*) present_in from k group by 1"""
)
def describe_dynamic(spark, sf):
    return profile(_dynamic(spark, sf)).select("field", "present_in")


@query(
    """select field, r, value, n from (select field, value, n, row_number() over (partition by field order by n desc, value) r from (
    select 'o_orderstatus' field, o_orderstatus value, count(*) n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2)) where r <= 3"""
)
def describe_top_values(spark, sf):
    ws = Workspace.of(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), id="o_orderkey")
    p = profile(ws, top_n=3).filter("field != 'o_orderkey'").select("field", F.posexplode("top_values").alias("r", "v"))
    return p.select("field", (F.col("r") + 1).cast("long").alias("r"), F.col("v.value").alias("value"), F.col("v.count").alias("n"))


@query(
    """select 'o_orderdate' field, count(*) present_in, strftime(min(o_orderdate), '%Y-%m-%d') first, strftime(max(o_orderdate), '%Y-%m-%d') last, 'datetime' kind from orders
    union all select 'o_orderstatus', count(*), null, null, 'str' from orders union all select 'o_totalprice', count(*), null, null, 'float' from orders"""
)
def describe_types(spark, sf):
    """Types and date ranges of a profile."""
    ws = Workspace.of(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"), id="o_orderkey")
    p = profile(ws).filter("field != 'o_orderkey'").select("field", "present_in", F.substring("date_min", 1, 10).alias("first"), F.substring("date_max", 1, 10).alias("last"), F.explode("types").alias("kind", "n"))
    return p.filter("n = present_in").select("field", "present_in", "first", "last", "kind")


@query(
    """select json_extract_string(frontmatter, '$.type') "key", min(json_extract(frontmatter, '$.priority')::double) lo, max(json_extract(frontmatter, '$.priority')::double) hi
    from (select distinct packet_id, frontmatter from packets where json_valid(frontmatter))
    where json_type(json_extract(frontmatter, '$.type')) = 'VARCHAR' and json_type(json_extract(frontmatter, '$.priority')) in ('UBIGINT', 'BIGINT', 'DOUBLE') group by 1"""
)
def group_min_max_dynamic(spark, sf):
    """Least and greatest numbers of a field of mixed type, its other values filtered out by type."""
    from loamdex.expr import Pred

    q = Query(_dynamic(spark, sf)).where_expr(Pred("priority", "type", "int") | Pred("priority", "type", "float"))
    out = q.group_by("type").aggregate(lo=Min("priority"), hi=Max("priority"))
    return out.select("key", *[F.get_json_object(F.concat(F.lit('{"s":'), F.col(c)["j"], F.lit("}")), "$.s").cast("double").alias(c) if dict(out.dtypes)[c].startswith("struct") else F.col(c).cast("double").alias(c) for c in ("lo", "hi")])


# ------------------------------------------------------------------ references, traversal, patterns


def _places(spark, sf) -> Workspace:
    """Customers, nations and regions as one workspace with references up."""
    ensure_checkpoint(spark)
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("kind"), F.concat(F.lit("n"), "c_nationkey").alias("within"), F.col("c_acctbal").alias("balance"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.concat(F.lit("r"), "n_regionkey").alias("within"), F.lit(None).cast("double").alias("balance"))
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.lit(None).cast("string").alias("within"), F.lit(None).cast("double").alias("balance"))
    return Workspace.of(c.unionByName(n).unionByName(r), id="id")


@query("select distinct 'n' || c_nationkey packet_id from customer where c_acctbal > 9900")
def follow_one_hop(spark, sf):
    return _ids(Query(_places(spark, sf)).where(balance__gt=9900).follow("within").frame())


@query("select 'c' || c_custkey packet_id from customer join nation on n_nationkey = c_nationkey where n_regionkey = 1 union select 'n' || n_nationkey from nation where n_regionkey = 1")
def follow_reverse(spark, sf):
    return _ids(Query(_places(spark, sf)).where(id="r1").follow("within", depth=2, direction="reverse").frame())


@query("select 'n' || n_nationkey packet_id from nation where n_nationkey in (select c_nationkey from customer where c_acctbal > 9990) union select 'r' || n_regionkey from nation where n_nationkey in (select c_nationkey from customer where c_acctbal > 9990)")
def follow_closure(spark, sf):
    return _ids(Query(_places(spark, sf)).where(balance__gt=9990).follow("within", depth="*").frame())


def _rings(spark, sf) -> Workspace:
    """Parts with a reference that forms rings of ten, and one that forms a tree with a link to itself at the root."""
    ensure_checkpoint(spark)
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.cast("string").alias("id"), (F.floor(k / 10) * 10 + (k + 1) % 10).cast("string").alias("next"), F.floor(k / 2).cast("string").alias("half"), "p_size")
    return Workspace.of(p, id="id")


@query("select p_partkey::varchar packet_id from part where p_partkey // 10 = 3 and p_partkey != 31")
def follow_cycle(spark, sf):
    return _ids(Query(_rings(spark, sf)).where(id="31").follow("next", depth="*").frame())


_TREE = "select p_partkey s, p_partkey // 2 t, 'half' f from part where p_partkey // 2 in (select p_partkey from part) union select p_partkey, (p_partkey // 10) * 10 + (p_partkey + 1) % 10, 'next' from part where (p_partkey // 10) * 10 + (p_partkey + 1) % 10 in (select p_partkey from part)"


@query(f"with recursive e as ({_TREE}), w(n) as (select 77::bigint union select t from w join e on s = n) select n::varchar packet_id from w")
def subgraph_nodes(spark, sf):
    ws = _rings(spark, sf)
    return graph.subgraph(ws, Query(ws).where(id="77").frame(), ["half", "next"]).nodes


@query(f"with recursive e as ({_TREE}), w(n) as (select 77::bigint union select t from w join e on s = n) select s::varchar source, t::varchar target, f field from w join e on s = n")
def subgraph_edges(spark, sf):
    ws = _rings(spark, sf)
    return graph.subgraph(ws, Query(ws).where(id="77").frame(), ["half", "next"], include_origin=False).edges


@query("select 'c' || c_custkey a, 'n' || c_nationkey b from customer where c_acctbal > 9000 and c_nationkey != 3")
def pattern_hop(spark, sf):
    return PatternQuery(_places(spark, sf), 'MATCH (a:Customer)-[:within]->(b) WHERE a.balance > 9000 AND NOT b.id = "n3" RETURN a, b').result()


@query("select distinct 'n' || c_nationkey b_id, 'r' || n_regionkey c from customer join nation on n_nationkey = c_nationkey")
def pattern_chain(spark, sf):
    return PatternQuery(_places(spark, sf), 'MATCH (a)-[:within]->(b)-[:within]->(c) WHERE a.kind = "customer" RETURN b.id, c').result().withColumnRenamed("b.id", "b_id")


@query("select p_partkey::varchar a from part where (select count(*) from part q where q.p_partkey // 10 = part.p_partkey // 10) = 10")
def pattern_cycle(spark, sf):
    return PatternQuery(_rings(spark, sf), "MATCH (a)-[:next*]->(a) RETURN a").result()


@query(
    """with recursive e as (select p_partkey s, p_partkey // 2 t from part where p_partkey // 2 in (select p_partkey from part)),
    w(s, t, d) as (select s, t, 1 from e union select w.s, e.t, d + 1 from w join e on e.s = w.t where d < 3)
    select s::varchar a, t::varchar b from (select s, t, min(d) d from w group by 1, 2) where d between 2 and 3 and s != t
    union select s::varchar, t::varchar from e where s = t"""
)
def pattern_variable_length(spark, sf):
    return PatternQuery(_rings(spark, sf), "MATCH (a)-[:half*2..3]->(b) RETURN a, b").result()


@query("select count(*) n from customer join nation on n_nationkey = c_nationkey")
def pattern_count(spark, sf):
    return PatternQuery(_places(spark, sf), "MATCH (a)-[:within]->(b)-[:within]->(c) RETURN count(a)").count()


@query("select c_custkey::varchar packet_id from customer where c_acctbal > 0 and c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def id_set_filter(spark, sf):
    """The customers a query over orders names, as an id set."""
    o = Query(_ws(spark, sf, "orders", "o_orderkey")).where(o_orderstatus="P").frame()
    return _ids(Query(_ws(spark, sf, "customer", "c_custkey")).in_ids(o.select(F.col("o_custkey").cast("string").alias("packet_id"))).where(c_acctbal__gt=0).frame())


@query("select p_partkey::varchar packet_id from part where p_partkey in (7, 11, 30)")
def id_list_filter(spark, sf):
    return _ids(Query(_ws(spark, sf, "part", "p_partkey")).in_ids(["11", "7", "30", "nothing", "7"]).frame())


@query("""select 'n' || n_nationkey packet_id, row_number() over (order by max(c_acctbal) desc, 'n' || n_nationkey) r from customer join nation on n_nationkey = c_nationkey group by n_nationkey""")
def pattern_order_by(spark, sf):
    """Each nation once, in the order of its best customer."""
    p = PatternQuery(_places(spark, sf), 'MATCH (a)-[:within]->(b) WHERE a.kind = "customer" RETURN b ORDER BY a.balance DESC, b')
    return places(p.result().withColumnRenamed("b", "packet_id"))


@query(
    """with recursive e as (select p_partkey s, p_partkey // 2 t from part where p_partkey // 2 in (select p_partkey from part)),
    w(s, t) as (select s, t from e where s in (select p_partkey from part where p_size > 45) union select w.s, e.t from w join e on e.s = w.t)
    select s::varchar a, t::varchar b from w where t in (select p_partkey from part where p_size < 10)"""
)
def pattern_bound_paths(spark, sf):
    """Paths of any length between packets that conditions bind at both ends."""
    return PatternQuery(_rings(spark, sf), "MATCH (a)-[:half*]->(b) WHERE a.p_size > 45 AND b.p_size < 10 RETURN a, b").result()


@query(
    """with recursive e as (select p_partkey s, p_partkey // 2 t from part where p_partkey // 2 in (select p_partkey from part)),
    w(s, t) as (select s, t from e where t in (select p_partkey from part where p_size = 1) union select e.s, w.t from w join e on e.t = w.s)
    select s::varchar a, t::varchar b from w"""
)
def pattern_bound_ends(spark, sf):
    """Paths of any length into packets that a condition binds, walked from their ends."""
    return PatternQuery(_rings(spark, sf), "MATCH (a)-[:half*]->(b) WHERE b.p_size = 1 RETURN a, b").result()


@query(
    """select packet_id from (select distinct packet_id, json_extract(frontmatter, '$.tags') x from packets where json_valid(frontmatter))
    where case json_type(x) when 'ARRAY' then list_contains(json_extract_string(x, '$[*]'), 'urgent') when 'VARCHAR' then contains(json_extract_string(x, '$'), 'urgent') else false end"""
)
def filter_list_member(spark, sf):
    return _ids(compile_query('tags CONTAINS "urgent"', _dynamic(spark, sf)).frame())


def _files(spark, sf) -> Workspace:
    """Regions, nations and customers as documents in folders, with relative paths up and slugs or file stems as names."""
    ensure_checkpoint(spark)
    name = lambda folder, c: F.concat(F.lit(folder), F.col(c).cast("string"), F.lit(".md"))
    none = F.lit(None).cast("string")
    r = table(spark, sf, "region").select(name("regions/", "r_regionkey").alias("id"), none.alias("up"), F.col("r_name").alias("slug"), none.alias("of"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(name("nations/n", "n_nationkey").alias("id"), F.concat(F.lit("../regions/./"), "n_regionkey", F.lit(".md")).alias("up"), none.alias("slug"), F.col("r_name").alias("of"))
    c = table(spark, sf, "customer").select(name("customers/c", "c_custkey").alias("id"), F.concat(F.when(F.col("c_acctbal") < 0, "../../nations/n").otherwise("../nations/n"), F.col("c_nationkey").cast("string"), F.lit(".md")).alias("up"), none.alias("slug"), F.concat(F.lit("n"), "c_nationkey").alias("of"))
    return Workspace.of(r.unionByName(n).unionByName(c), id="id")


@query(
    """select 'nations/n' || n_nationkey || '.md' source, 'regions/' || n_regionkey || '.md' target from nation join region on r_regionkey = n_regionkey
    union all select 'customers/c' || c_custkey || '.md', 'nations/n' || c_nationkey || '.md' from customer join nation on n_nationkey = c_nationkey where c_acctbal >= 0"""
)
def resolve_paths(spark, sf):
    """References as relative paths; those that lead out of the root resolve to nothing."""
    return graph.PathResolver().edges(_files(spark, sf), "up").select("source", "target")


@query(
    """select 'nations/n' || n_nationkey || '.md' source, 'regions/' || r_regionkey || '.md' target from nation join region on r_regionkey = n_regionkey
    union all select 'customers/c' || c_custkey || '.md', 'nations/n' || c_nationkey || '.md' from customer join nation on n_nationkey = c_nationkey"""
)
def resolve_slugs(spark, sf):
    """References as slugs, or as file stems where no slug fits."""
    return graph.SlugResolver().edges(_files(spark, sf), "of").select("source", "target")


@query("select p_partkey::varchar packet_id from part where p_size > 45 and (select count(*) from part q where q.p_partkey // 10 = part.p_partkey // 10) = 10")
def pattern_as_filter(spark, sf):
    return _ids(Query(_rings(spark, sf)).where(p_size__gt=45).pattern("MATCH (a)-[:next*]->(a) RETURN a").frame())


@query("select (select count(*) from customer) + (select count(*) from nation) populated, (select count(*) from customer) + (select count(*) from nation) resolved")
def resolver_diagnostic(spark, sf):
    return graph.mismatch(_places(spark, sf), "within")


# ------------------------------------------------------------------ search


@query("select doc_id::varchar packet_id, 1.0::double score from documents where contains(lower(text), 'observatory') order by 1 limit 25")
def search_grep(spark, sf):
    ws = _ws(spark, sf, "documents", "doc_id", body="text")
    return registry.search(ws, "Observatory", k=25).select("packet_id", "score")


@query("select doc_id::varchar packet_id from documents where regexp_matches(text, 'c[aou]nal of|the ferr(y|ies)\\s') and lang = 'en'")
def search_then_filter(spark, sf):
    ws = _ws(spark, sf, "documents", "doc_id", body="text")
    return _ids(Query(ws).search(r"c[aou]nal of|the ferr(y|ies)\s", options={"regex": True, "case_sensitive": True}).where(lang="en").frame())


_WORDS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce(content, ''))), '[^\\p{L}\\p{N}_]+'), lambda x: x != '')"


@query(
    f"""with d as (select packet_id, {_WORDS} w from (select packet_id, max(content) content from packets_fts group by 1)),
    s as (select count(*) n, avg(len(w)) mean from d), p as (select packet_id, len(w) l, unnest(w) t from d),
    q as (select packet_id, t, any_value(l) l, count(*) tf from p where t in ('granite', 'harbour', 'ledger') group by 1, 2),
    f as (select t, count(*) df from q group by 1)
    select packet_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) score from q join f using (t), s group by 1"""
)
def search_bm25(spark, sf):
    d = table(spark, sf, "packets_fts").groupBy("packet_id").agg(F.max("content").alias("text"))
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    s = rank.corpus_stats(d).first()
    return rank.bm25(rank.postings(d), ["granite", "harbour", "ledger"], s.n, s.mean).select("packet_id", F.round("score", 6).alias("score"))


_PROBE = [((7 * i) % 13 - 6) / 10 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(map(str, _PROBE)) + "]::double[64]"


@query(f"select vec_id::varchar packet_id, round(-array_distance(embedding::double[64], {_PROBE_SQL}), 6) score from embeddings order by array_distance(embedding::double[64], {_PROBE_SQL}), 1 limit 20")
def knn_l2(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("packet_id", F.col("vec_id").cast("string"))
    return rank.nearest(e, _PROBE, 20).withColumn("score", F.round("score", 6))


@query(f"select vec_id::varchar packet_id, round(array_cosine_similarity(embedding::double[64], {_PROBE_SQL}) - 1, 6) score from embeddings order by array_cosine_similarity(embedding::double[64], {_PROBE_SQL}) desc, 1 limit 20")
def knn_cosine(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("packet_id", F.col("vec_id").cast("string"))
    return rank.nearest(e, _PROBE, 20, metric="cosine").withColumn("score", F.round("score", 6))


@query(
    """with h as (select query_id, backend, packet_id, max(score) s from search_hits where score is not null group by 1, 2, 3),
    p as (select *, row_number() over (partition by query_id, backend order by s desc, packet_id) r from h)
    select query_id, packet_id, round(sum(1.0 / (60 + r)), 9) score from p group by 1, 2"""
)
def rrf_fusion(spark, sf):
    """Every query's hits of all backends, fused."""
    h = table(spark, sf, "search_hits").filter("score is not null").groupBy("query_id", "backend", "packet_id").agg(F.max("score").alias("score"))
    backends = sorted(r.backend for r in h.filter("backend is not null").select("backend").distinct().collect())  # a handful of names
    lists = [h.filter(F.col("backend").eqNullSafe(F.lit(b))) for b in [*backends, None]]
    return rank.rrf(*lists, by="query_id").select("query_id", "packet_id", F.round("score", 9).alias("score"))


_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    rf"""with d as (select doc_id::varchar packet_id, nullif(trim(title), '') h, nullif(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '') b from documents)
    select packet_id, sha256('title' || chr(10) || concat_ws(chr(10) || chr(10), h, b)) hash from d"""
)
def document_hash(spark, sf):
    """Hashes over title and whole text."""
    from loamdex.search.hybrid import document, document_hash as hashed

    ws = _ws(spark, sf, "documents", "doc_id", body="text")
    return ws.packets.select("packet_id", hashed(document(ws, ("title",), None), ("title",)).alias("hash"))


@query(
    """with p as (select packet_id, max(lower(content_hash)) h from packets where packet_id is not null group by 1),
    i as (select run_id, packet_id, max(lower(content_hash)) h from packet_index where packet_id is not null and run_id is not null group by 1, 2),
    w as (select run_id, packet_id, p.h from (select distinct run_id from i), p)
    select coalesce(w.run_id, i.run_id) run_id, coalesce(w.packet_id, i.packet_id) packet_id, case when i.packet_id is null then 'new' when w.packet_id is null then 'removed' else 'changed' end change_kind
    from w full join i on w.run_id = i.run_id and w.packet_id = i.packet_id where i.packet_id is null or w.packet_id is null or w.h is distinct from i.h"""
)
def index_diff(spark, sf):
    """What each run of the index lacks, has in excess or has in another state than the packets; every run is compared."""
    from loamdex.operators.increment import state_changes

    id, digest = F.col("packet_id").alias("record"), F.max(F.lower("content_hash")).alias("digest")
    stored = table(spark, sf, "packet_index").filter("packet_id is not null and run_id is not null").groupBy(id, "run_id").agg(digest)
    present = table(spark, sf, "packets").filter("packet_id is not null").groupBy(id).agg(digest)
    return state_changes(stored, present, "run_id").withColumnRenamed("record", "packet_id")


# ------------------------------------------------------------------ edits


_HEAD = "'---' || chr(10) || 'kind: {0} # kept' || chr(10) || 'flag: {1}' || chr(10) || '{2}: ' || packet_id || chr(10) || '{3}---' || chr(10) || coalesce(body, '')"


@query(f"select distinct packet_id, {_HEAD.format('note', 'true', 'path', '')} \"before\", {_HEAD.format('task', 'false', 'file', 'rank: 3@').replace('@', chr(39) + ' || chr(10) || ' + chr(39))} \"after\", null::varchar error from packets")
def edit_preview(spark, sf):
    """Heads of all packets as YAML documents, two fields set, one toggled and one renamed: whole text before and after, and the error where that can't be."""
    from loamdex.operators import edits

    p = table(spark, sf, "packets").select("packet_id", F.concat(F.lit("---\nkind: note # kept\nflag: true\npath: "), "packet_id", F.lit("\n---\n"), F.coalesce("body", F.lit(""))).alias("raw")).distinct()
    return edits.changes(p, [edits.op("set", kind="task", rank=3), edits.op("toggle", "flag"), edits.op("rename", path="file")])
