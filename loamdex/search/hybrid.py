"""A hybrid index of words and vectors as Parquet tables: BM25 and nearest vectors, fused by rank.

A version of the index is a folder of its own, named by a pointer file that is
replaced when the version is complete; a build that fails leaves the last version in place.
Only documents whose hash has changed are embedded again.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.errors import BackendUnavailable, IndexVersionError
from loamdex.search import config, rank
from loamdex.search.backends import HITS, BackendInfo, IndexStats

if TYPE_CHECKING:
    from loamdex.workspace import Workspace

FORMAT = 1


def document(ws: Workspace, fields: tuple[str, ...], max_tokens: int | None) -> Column:
    """The first field that isn't blank, a blank line, the body; cut at about ``max_tokens`` tokens of four characters, whole if None."""
    heads = []
    for f in fields:
        x = ws.field(f)
        text = F.coalesce(x.v["s"], F.when(x.v["t"] != "null", x.v["j"])) if ws.dynamic else x.scalar().cast("string")
        heads.append(F.nullif(F.trim(text), F.lit("")))
    head = F.coalesce(*heads) if heads else F.lit(None).cast("string")
    body = F.nullif(F.regexp_replace(ws.body_column(), r"(?U)^\s+|\s+$", ""), F.lit(""))
    text = F.concat_ws("\n\n", head, body)
    return text if max_tokens is None else F.substring(text, 1, 4 * max_tokens)


def document_hash(text: Column, fields: tuple[str, ...]) -> Column:
    return F.sha2(F.concat(F.lit("|".join(fields) + "\n"), text), 256)


def embed(df: DataFrame, text: str, model: str, batch_size: int) -> DataFrame:
    """The table with an ``embedding`` column, texts sent to the embedder in batches where they are."""
    if model not in config.EMBEDDERS:
        raise BackendUnavailable(f"no embedder {model!r}")
    call = config.EMBEDDERS[model]

    @F.pandas_udf("array<float>")
    def run(col):
        import pandas as pd

        texts = col.fillna("").tolist()
        return pd.Series([v for s in range(0, len(texts), batch_size) for v in call(texts[s : s + batch_size])], dtype=object)

    return df.withColumn("embedding", run(F.col(text)))


class Hybrid:
    name = "hybrid"

    def default_location(self, ws: Workspace) -> str:
        if ws.root is None:
            raise BackendUnavailable("a workspace over a table needs an explicit location")
        return os.path.join(ws.root, ".loamdex", "hybrid")

    def _meta(self, location: str) -> dict | None:
        try:
            with open(os.path.join(location, "current.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _checked(self, location: str, model: str | None = None) -> dict:
        m = self._meta(location)
        if m is None:
            raise FileNotFoundError(f"no index at {location}")
        if m["format"] != FORMAT:
            raise IndexVersionError(f"index format {m['format']}, expected {FORMAT}")
        if model is not None and m["model"] != model:
            raise BackendUnavailable(f"the index was built with {m['model']!r}, not {model!r}; build it again with force")
        return m

    def build(self, ws: Workspace, packets: DataFrame, location: str, *, options: dict | None = None) -> IndexStats:
        """Packets left out of ``packets`` leave the index."""
        began = time.time()
        c = config.resolve(options, "build")
        old = None if c.force else self._meta(location)
        if old is not None:
            self._checked(location, c.model)
        docs = packets.select("packet_id", document(ws, c.fields, c.max_tokens).alias("text")).withColumn("hash", document_hash(F.col("text"), c.fields))
        name = uuid.uuid4().hex
        to = os.path.join(location, name)
        spark = packets.sparkSession
        if old is not None:
            before = spark.read.parquet(os.path.join(location, old["version"], "docs"))
            kept = before.join(docs.select("packet_id", "hash"), ["packet_id", "hash"], "left_semi")
            fresh = docs.join(before.select("packet_id", "hash"), ["packet_id", "hash"], "left_anti")
            gone = before.select("packet_id").join(docs.select("packet_id"), "packet_id", "left_anti").count()
            all_docs = kept.unionByName(embed(fresh, "text", c.model, c.batch_size))
            n_kept = kept.count()
        else:
            all_docs, gone, n_kept = embed(docs, "text", c.model, c.batch_size), 0, 0
        all_docs.write.parquet(os.path.join(to, "docs"))
        stored = spark.read.parquet(os.path.join(to, "docs"))
        # Sorted by term, so that a query's terms touch few row groups.
        rank.postings(stored).repartitionByRange("term").sortWithinPartitions("term").write.parquet(os.path.join(to, "postings"))
        s = rank.corpus_stats(stored).first()
        os.makedirs(location, exist_ok=True)
        part = os.path.join(location, f".{name}")
        with open(part, "w") as f:
            json.dump({"format": FORMAT, "model": c.model, "fields": list(c.fields), "version": name, "n": s.n, "mean": s.mean or 0.0}, f)
        os.replace(part, os.path.join(location, "current.json"))
        return IndexStats(s.n - n_kept, n_kept, gone, time.time() - began)

    def query(self, text: str, location: str, *, k: int | None = 10, options: dict | None = None) -> DataFrame:
        from pyspark.sql import SparkSession

        c = config.resolve(options, "query")
        spark = SparkSession.getActiveSession()
        if not text.strip() or (k is not None and k <= 0):
            return spark.createDataFrame([], HITS)
        m = self._checked(location, None if c.sparse_only else c.model)
        at = os.path.join(location, m["version"])
        fetch = c.fetch_k or (None if k is None else max(4 * k, 50))
        docs = spark.read.parquet(os.path.join(at, "docs"))
        lists = []
        if not c.sparse_only:
            lists.append(rank.nearest(docs, config.EMBEDDERS[c.model]([text])[0], fetch, metric=c.metric))
        if not c.dense_only:
            words = [w for w in spark.range(1).select(rank.terms(F.lit(text)).alias("w")).first().w]
            posts = spark.read.parquet(os.path.join(at, "postings"))
            sparse = rank.bm25(posts, words, m["n"], m["mean"])
            lists.append(sparse if fetch is None else sparse.orderBy(F.col("score").desc(), "packet_id").limit(fetch))
        fused = lists[0] if len(lists) == 1 else rank.rrf(*lists, bounded=fetch is not None)
        if c.reranker and not c.no_rerank:
            try:
                return self._rerank(fused, docs, text, c, k)
            except Exception as e:  # the reranker is an outside service
                if c.rerank_required:
                    raise BackendUnavailable(f"reranker: {e}") from e
                print(f"warning: reranker left out: {e}", file=sys.stderr)
        return rank.ranked(fused, k)

    def _rerank(self, fused: DataFrame, docs: DataFrame, text: str, c: config.Config, k: int | None) -> DataFrame:
        """The best ``reranker_top_n`` hits in the order of another scorer; no others are returned."""
        spark = fused.sparkSession
        top = rank.ranked(fused, c.reranker_top_n).select("packet_id")
        rows = top.join(docs.select("packet_id", "text"), "packet_id").collect()  # at most reranker_top_n
        scores = config.RERANKERS[c.reranker](text, [r.text for r in rows])
        return rank.ranked(spark.createDataFrame([(r.packet_id, float(s)) for r, s in zip(rows, scores)], "packet_id string, score double"), k)

    def info(self, location: str | None = None) -> BackendInfo:
        try:
            meta = self._meta(location) if location else None
        except (OSError, ValueError):
            meta = None
        return BackendInfo(self.name, "1", "indexed", meta or {})
