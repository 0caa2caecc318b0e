"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.llm import fusion

    return fusion.top(_table(spark, sf, "search_hits"), 3).select("query_id", "packet_id")


def p3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All packets of each query with their relative closeness to the ideal point."""
    from loamdex.llm import fusion

    return fusion.ideal_point(_table(spark, sf, "search_hits"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.llm import neighbours
    from loamdex.session import ensure_checkpoint

    ensure_checkpoint(spark)
    return neighbours.pairs(neighbours.similar(_table(spark, sf, "vectors")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.llm import markup

    p = _table(spark, sf, "packets").select(F.lit("packets").alias("src_table"), "packet_id", F.col("body").alias("text"))
    f = _table(spark, sf, "packets_fts").select(F.lit("packets_fts").alias("src_table"), "packet_id", F.col("content").alias("text"))
    return markup.elements(p.unionByName(f), text="text", keys=["src_table", "packet_id"])


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of packets and search contents, structure kept."""
    from loamdex.llm import markup

    p = _table(spark, sf, "packets").select(F.lit("packets").alias("src_table"), "packet_id", F.col("body").alias("text"))
    f = _table(spark, sf, "packets_fts").select(F.lit("packets_fts").alias("src_table"), "packet_id", F.col("content").alias("text"))
    return markup.clean_text(p.unionByName(f).distinct(), text="text").drop("text")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.llm import tokens

    return tokens.encode_corpus(_table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.llm import leakage
    from loamdex.session import ensure_checkpoint

    ensure_checkpoint(spark)
    return leakage.leaked(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.llm import residue

    return residue.residue(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_ranking, p4_found, p5_found, p5_clean, p8_ids, p9_found, p10_found)}
_CLOSENESS = """
    with h as (
        select query_id, packet_id, backend, max(score) s from search_hits
        where query_id is not null and packet_id is not null and backend is not null and score is not null and not isnan(score) group by all),
    l as (select query_id, backend, quantile_disc(s, 0.2) a, quantile_disc(s, 0.8) b from h group by all),
    x as (select query_id, packet_id, backend, case when b <= a then 1.0 else least(greatest(s, a), b) - a end x from h join l using (query_id, backend)),
    n as (select query_id, backend, sqrt(sum(x * x)) norm, max(x) / sqrt(sum(x * x)) best from x group by all),
    i as (select query_id, sum(best * best) far from n group by 1),
    s as (select query_id, packet_id, sum((x / norm) * (x / norm)) ss, sum(x / norm * best) sb from x join n using (query_id, backend) group by all),
    c as (select query_id, packet_id, round(sqrt(ss) / (sqrt(ss) + sqrt(greatest(0, far - 2 * sb + ss))), 9) closeness from s join i using (query_id))"""
ORACLES: dict[str, str] = {
    "p3_found": f"{_CLOSENESS} select query_id, packet_id from c qualify row_number() over (partition by query_id order by closeness desc, packet_id) <= 3",
    # Brute force over all pairs, as the tables of the comparison are small.
    "p4_found": """
        with v as (
            select vec_id, min(embedding) e from vectors
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0 group by 1),
        s as (select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.e::double[], b.e::double[]), 10) s from v a join v b on a.vec_id != b.vec_id),
        n as (select a, b from s qualify row_number() over (partition by a order by s desc, b) <= 5)
        select distinct least(a, b) vec_a, greatest(a, b) vec_b from n""",
    "p3_ranking": f"{_CLOSENESS} select query_id, packet_id, closeness from c",
}
