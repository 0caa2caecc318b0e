"""One ranking from several differently scaled scores.

Method: ideal-point ranking. In each query the scores of a backend are winsorised,
counted from the lower limit and vector-normalised, so that each backend's scores make a vector of length 1;
``weights`` (equal ones by default) are what a backend counts. The distances of a packet to the ideal point
(the best weighted score in every backend) and to the anti-ideal one (no hit anywhere) give its relative closeness,
by which packets are sorted. Winsorising at the outer fifths also evens out the shapes of
the distributions: with wider limits a backend whose best scores stand far off its others outweighs the rest in its vector.

All of it is aggregation with partial sums: the distances need just the sum of squares of a packet's
weighted scores and of their products with the best ones, and the limits come from
mergeable quantile sketches, so a query with a third of all rows is no single task's load.

Defined results: a null score, query or packet is no hit; a repeated hit counts once, of several scores of one
packet in one backend the highest holds; scores that are all equal in a backend count as its best;
ties go to the smaller packet_id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


LOW, HIGH = 0.2, 0.8


def ideal_point(hits: DataFrame, *, low: float = LOW, high: float = HIGH, weights: dict[str, float] | None = None, query: str = "query_id", item: str = "packet_id", source: str = "backend", score: str = "score") -> DataFrame:
    """One row (query_id, packet_id, closeness) for each packet a query has a hit of; a backend without a weight of its own has 1."""
    h = hits.select(F.col(query).alias("query_id"), F.col(item).alias("packet_id"), F.col(source).alias("backend"), F.col(score).cast("double").alias("score"))
    h = h.filter("query_id is not null and packet_id is not null and backend is not null and score is not null and not isnan(score)")
    h = h.groupBy("query_id", "backend", "packet_id").agg(F.max("score").alias("score"))
    limits = h.groupBy("query_id", "backend").agg(F.percentile_approx("score", [low, high], 10000).alias("q"))
    x = h.join(limits, ["query_id", "backend"]).withColumn("x", F.when(F.col("q")[1] <= F.col("q")[0], 1.0).otherwise(F.least(F.greatest("score", F.col("q")[0]), F.col("q")[1]) - F.col("q")[0]))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("backend") == name, float(w)).otherwise(weight)
    scale = x.groupBy("query_id", "backend").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.max("x").alias("top"))
    scale = scale.select("query_id", "backend", "norm", weight.alias("w"), (weight * F.col("top") / F.col("norm")).alias("best"))
    ideal = scale.groupBy("query_id").agg(F.sum(F.col("best") * F.col("best")).alias("far"))
    v = x.join(scale, ["query_id", "backend"]).withColumn("v", F.col("w") * F.col("x") / F.col("norm"))
    s = v.groupBy("query_id", "packet_id").agg(F.sum(F.col("v") * F.col("v")).alias("ss"), F.sum(F.col("v") * F.col("best")).alias("sb"))
    away, near = F.sqrt("ss"), F.sqrt(F.greatest(F.lit(0.0), F.col("far") - 2 * F.col("sb") + F.col("ss")))
    return s.join(ideal, "query_id").select("query_id", "packet_id", F.round(F.coalesce(away / (away + near), F.lit(0.0)), 9).alias("closeness"))


def top(hits: DataFrame, k: int = 3, **columns) -> DataFrame:
    """The ``k`` packets (query_id, packet_id, place, closeness) that stand highest in each query."""
    order = Window.partitionBy("query_id").orderBy(F.col("closeness").desc(), "packet_id")
    return ideal_point(hits, **columns).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
