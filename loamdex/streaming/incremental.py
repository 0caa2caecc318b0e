"""Structured Streaming over packets that arrive as files: filters on the stream, and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamdex import expr
from loamdex.lang.filters import parse_filter
from loamdex.workspace import Workspace


def read(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def filtered(stream: DataFrame, text: str, *, id: str) -> DataFrame:
    """A filter text on a stream; the same expressions as on a table."""
    e, keys = parse_filter(text)
    if keys:
        raise ValueError("a stream has no order")
    ws = Workspace.of(stream, id=id)
    return ws.packets.filter(expr.columns(e, lambda p: ws.field(p.field))) if e is not None else ws.packets


def counts(stream: DataFrame, key: str, at: str, *, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by key and time window; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).count().select(F.col("w.start").alias("start"), key, "count")


def upsert(stream: DataFrame, target, *, checkpoint: str, work=lambda df: df) -> StreamingQuery:
    """Each micro-batch into a versioned table, its number saved in the same commit, so that a batch that is run again changes nothing."""

    def batch(df: DataFrame, n: int) -> None:
        m = target.read_manifest()
        if m["processed"].get("stream", -1) >= n:
            return
        out = work(df).persist()
        target.commit(out, out.select(target.key), {"stream": n}, base=m["version"])
        out.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
