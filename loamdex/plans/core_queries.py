"""Queries of the general data-processing problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamdex.operators import drift, hierarchy, increment, references
from loamdex.session import ensure_checkpoint, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    ensure_checkpoint(spark)
    return hierarchy.found(table(spark, sf, "edges"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift(table(spark, sf, "packets"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return increment.found(table(spark, sf, "packets"), table(spark, sf, "packet_index"), table(spark, sf, "index_runs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.found(table(spark, sf, "edges"), table(spark, sf, "packets"), table(spark, sf, "registry"))


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path from the root, depth and root of each node."""
    ensure_checkpoint(spark)
    return hierarchy.hierarchy(hierarchy.links(table(spark, sf, "edges")), with_path=True)


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every node under every node, with the number of links between them."""
    return hierarchy.descendants(p1_paths(spark, sf))


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    """All packets as one consistent table: the target schema, fields the drift report approves, the rest rescued."""
    return drift.consistent(table(spark, sf, "packets"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_table, p6_found, p7_found)}

_KEY = r"regexp_extract({0}, '(?s)^\s*(?:\./)?\s*([^#]*?)\s*(?:#.*)?$', 1)"

_LINKS = rf"""
        with recursive e as (
            select {_KEY.format("source")} s, {_KEY.format("target")} t, lower(trim(field)) f, seen_at, loaded_at, edge_id from edges),
        l as (
            select case f when 'parent' then s else t end node, case f when 'parent' then t else s end up, seen_at, loaded_at, edge_id
            from e where f in ('parent', 'children') and s != '' and t != ''),
        h as (
            select node, up from l
            qualify row_number() over (partition by node order by seen_at desc nulls last, loaded_at desc nulls last, edge_id desc nulls last, up desc) = 1),
        w(node, pos, d) as (
            select node, node, 0 from (select node from h union select up from h)
            union all
            select w.node, h.up, w.d + 1 from w join h on h.node = w.pos where w.d < 200),
        deep as (select node, max(d) d from w group by node),
        looped as (select node from deep where d = 200),
        ring as (select distinct w.node, w.pos from w join looped using (node) where w.d > 100)"""

ORACLES = {
    "p1_found": f"""{_LINKS}
        select d.node, w.pos root_node, d.d::int node_depth from deep d join w on w.node = d.node and w.d = d.d where d.d < 200
        union all
        select node, min(pos), case when bool_or(pos = node) then -1 else -2 end from ring group by node""",
    "p1_descendants": f"""{_LINKS}
        select w.pos node, w.node descendant, w.d distance from w anti join looped using (node) where w.d > 0""",
    "p2_found": r"""
        with p as (select distinct workspace w, scan_no s, packet_id, frontmatter f from packets where workspace is not null and scan_no is not null),
        scans as (select w, s was, lead(s) over (partition by w order by s) now from (select distinct w, s from p) qualify now is not null),
        kv as (select w, s, f, unnest(json_keys(f)) k from (select * from p where json_valid(f)) where json_type(f) = 'OBJECT'),
        v as (select row_number() over () id, w, s, k, json_extract(f, '$."' || k || '"') x from kv),
        t as (
            select *, json_type(x) jt, case json_type(x) when 'NULL' then 'null' when 'BOOLEAN' then 'bool' when 'DOUBLE' then 'float' when 'ARRAY' then 'list' when 'OBJECT' then 'map'
                when 'VARCHAR' then case when regexp_full_match(json_extract_string(x, '$'), '\d{4}-\d\d-\d\d') then 'date'
                    when regexp_full_match(json_extract_string(x, '$'), '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d') then 'datetime' else 'str' end else 'int' end kind from v),
        e as (
            select id, w, s, k, json_type(x) jt, json_extract_string(x, '$') v, x from t where jt not in ('ARRAY', 'NULL') union all
            select id, w, s, k, json_type(y), json_extract_string(y, '$'), y from (select id, w, s, k, unnest(json_extract(x, '$[*]')) y from t where jt = 'ARRAY')),
        parts as (
            select w, s, k, part, count(distinct id) n from (
                select id, w, s, k, unnest(case when jt = 'NULL' then [] when jt = 'BOOLEAN' then ['b'] when jt = 'OBJECT' then list_transform(json_keys(x), lambda a: 'k' || a)
                    when jt = 'VARCHAR' then case when regexp_full_match(v, '\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d)?') then ['d' || v[:4]]
                        else list_transform(regexp_split_to_array(regexp_replace(lower(v), '\d+', '9', 'g'), '[,;]'), lambda a: trim(a)) end
                    else ['n' || case when v::double = 0 then '' else floor(log2(abs(v::double)) / 2)::int::varchar end] end) part from e) group by all),
        share as (select *, n / sum(n) over (partition by w, s, k) part_share from parts),
        fields as (select w, s, k, arg_min(kind, (-n, kind)) filter (kind != 'null') kind from (select w, s, k, kind, count(*) n from t group by all) group by all),
        b as (select f.w, now, k, was, kind from fields f join scans c on f.w = c.w and s = was),
        a as (select f.w, now, k, kind from fields f join scans c on f.w = c.w and s = now),
        ended as (select * from b anti join a using (w, now, k)),
        begun as (select * from a anti join b using (w, now, k)),
        alike as (
            select o.w, o.now, o.k old, g.k new, round(sum(least(x.part_share, y.part_share)), 9) alike
            from ended o join begun g on o.w = g.w and o.now = g.now and o.kind = g.kind
            join share x on x.w = o.w and x.s = o.was and x.k = o.k join share y on y.w = g.w and y.s = g.now and y.k = g.k and y.part = x.part group by all having alike >= 0.2),
        sorted as (select w, now, list({'old': old, 'new': new} order by alike desc, old, new) pairs from alike group by all),
        named as (
            select w, now, x.old, x.new from (
                select w, now, unnest(list_reduce(pairs, lambda acc, x: case when len(list_filter(acc, lambda z: z.old = x[1].old or z.new = x[1].new)) > 0 then acc else list_concat(acc, x) end)) x
                from (select w, now, list_transform(pairs, lambda r: [r]) pairs from sorted)))
        select w workspace, now scan_no, k field, 'retyped' change_kind, a.kind became from a join b using (w, now, k) where a.kind != b.kind
        union all select o.w, o.now, o.k, case when n.new is null then 'removed' else 'renamed' end, coalesce(n.new, '') from ended o left join named n on n.w = o.w and n.now = o.now and n.old = o.k
        union all select g.w, g.now, g.k, 'added', '' from begun g anti join (select w, now, new k from named) n using (w, now, k)""",
    "p6_found": """
        with s as (
            select packet_id, lower(content_hash) h from packet_index semi join (select run_id from index_runs where run_status = 'ok') using (run_id)
            qualify row_number() over (partition by packet_id order by indexed_at desc nulls last, entry_id desc) = 1),
        p as (select packet_id, max(lower(content_hash)) h from packets where deleted_at is null group by packet_id)
        select p.packet_id, case when s.packet_id is null then 'new' else 'changed' end change_kind
        from p left join s using (packet_id) where s.packet_id is null or s.h is distinct from p.h""",
    "p7_found": rf"""
        with refs as (
            select 'edges' src_table, edge_id::varchar row_key, lower(trim(field)) field, {_KEY.format("target")} ref_key, seen_at at_, 'e' space from edges
            union all
            select 'packets', packet_id, f, {_KEY.format("v")}, modified_at, case f when 'blocked_by' then 'u' else 'r' end from (
                select packet_id, modified_at, f, unnest(case json_type(x) when 'ARRAY' then json_extract_string(x, '$[*]') else [json_extract_string(x, '$')] end) v from (
                    select packet_id, modified_at, f, json_extract(frontmatter, '$.' || f) x
                    from (select * from packets where json_valid(frontmatter)), (values ('blocked_by'), ('in_sprint'), ('owner')) t(f)) where json_type(x) != 'NULL')),
        recs as (
            select 'e' space, packet_id k, created_at o, deleted_at c from packets union
            select 'e', ref_key, opened_at, retired_at from registry union
            select 'r', ref_key, opened_at, retired_at from registry union
            select 'u', uuid, created_at, deleted_at from packets where uuid is not null)
        select distinct src_table, row_key, field, ref_key,
            case when k is null then 'missing' when c <= at_ then 'deleted' else 'late' end kind, strftime(at_, '%Y-%m') month_key
        from refs r left join recs on recs.space = r.space and k = ref_key
        where ref_key is not null and ref_key != '' and (k is null or c <= at_ or o > at_)""",
}
