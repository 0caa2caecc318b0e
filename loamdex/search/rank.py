"""Rankings over tables: BM25, nearest vectors and reciprocal rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators.ordering import places

K1, B, K_RRF = 1.2, 0.75, 60
# Marked letters of Latin script and their bare forms.
_MARKED = "áàâäãåāąăéèêëēėęěíìîïīįóòôöõøōőúùûüūůűçćčďđğłñńňřśšşťýÿźżž"
_BARE = "aaaaaaaaaeeeeeeeeiiiiiioooooooouuuuuuucccddglnnnrssstyyzzz"


def terms(text: Column | str) -> Column:
    """Words in lower case without marks."""
    c = F.lower(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\u0300-\u036f]", ""))
    return F.filter(F.split(F.translate(c, _MARKED, _BARE), r"(?U)[^\w]+"), lambda w: w != "")


def postings(docs: DataFrame, *, id: str = "packet_id", text: str = "text") -> DataFrame:
    """(term, packet_id, tf, length): one row for each term of a document."""
    d = docs.select(F.col(id).alias("packet_id"), terms(text).alias("w")).select("packet_id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return d.groupBy("term", "packet_id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def corpus_stats(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """One row (n, mean): documents, and their mean length in terms."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(terms(text))).alias("mean"))


def bm25(posts: DataFrame, query_terms: list[str], n: int, mean: float) -> DataFrame:
    """(packet_id, score) of the documents with any of the terms, each term once."""
    own = posts.filter(F.col("term").isin(sorted(set(query_terms)))) if query_terms else posts.filter("false")
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1.0))))
    return own.join(df, "term").groupBy("packet_id").agg(F.sum(idf * tf).alias("score"))


def distance(vector: Column | str, query: list[float], metric: str = "l2") -> Column:
    """Distance of an array column to a query vector, inside one expression."""
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return 1 - dot / (size * F.lit(math.sqrt(sum(x * x for x in query)) or 1.0))
    return F.sqrt(F.aggregate(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int | None, *, id: str = "packet_id", vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """The ``k`` nearest vectors (all of them without ``k``) as hits, score the negative distance; top-k is kept in each partition first."""
    d = vectors.filter(F.size(vector) == len(query)).select(F.col(id).alias("packet_id"), (-distance(vector, query, metric)).alias("score"))
    return d if k is None else d.orderBy(F.col("score").desc(), "packet_id").limit(k)


def rrf(*ranked: DataFrame, k_rrf: int = K_RRF, by: str | None = None, bounded: bool = True) -> DataFrame:
    """(packet_id, score) of several ranked lists (packet_id, score): sum of 1 / (k + rank); ties keep the earlier list's order.

    With ``by`` each value of that column is a query of its own, ranked and fused apart in its own window partition. Without it
    the lists are top-k results, so that one window over each is bounded by k; lists of any length (not ``bounded``) are
    sorted in ranges and numbered with offsets.
    """
    keys = [by] if by else []
    parts = []
    for n, r in enumerate(ranked):
        if not bounded and not by:
            parts.append(places(r.select("packet_id", "score").orderBy(F.col("score").desc(), "packet_id")).select("packet_id", "r", F.lit(n).alias("list")))
            continue
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "packet_id"))
        parts.append(r.select(*keys, "packet_id", place.alias("r"), F.lit(n).alias("list")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys, "packet_id").agg(F.sum(1 / (F.lit(k_rrf) + F.col("r"))).alias("score"), F.min(F.struct("list", "r")).alias("first"))


def ranked(hits: DataFrame, k: int | None) -> DataFrame:
    h = hits.orderBy(F.col("score").desc(), *(["first"] if "first" in hits.columns else []), "packet_id")
    return (h if k is None else h.limit(k)).select("packet_id", "score", F.lit(None).cast("string").alias("snippet"))
