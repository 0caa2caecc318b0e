"""Parent-child links to full hierarchies.

Method: the links are range-partitioned by node, so that nodes with like keys (one workspace)
share a partition; in each partition parent chains are contracted to the fragment's exit, its
first ancestor elsewhere. The exits form a smaller quotient forest with weighted links, solved the same
way, level by level, until it fits one partition; its result then expands every fragment. Loops within a
partition are found there, loops over partitions as loops of the quotient.

Below the first level keys have no locality left, so there each node tosses a coin by hash, and a node that
throws heads is put where its parent is if that throws tails (random mates). A level thus has at most about
three quarters of the nodes of the one above, whatever the keys are, and as many partitions as its size asks for: no task
holds more than about ``part_rows`` nodes. A parent of more than ``_MATES`` nodes draws none to it; it is one row of
the quotient, and its children join it from every partition.

Defined results: rows with a null or blank end are ignored; of several parents of one node the
one with the latest ``seen_at`` holds (then the latest loaded_at, edge_id, the larger parent); a
node without parent is its own root at depth 0; on a loop the root is the smallest key of the loop and the depth is
-1, below a loop -2, and such nodes have no path; repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.operators.references import plain_name, reference_key
from loamdex.session import checkpointed

PART_ROWS = 50_000
_BROADCAST_ROWS = 50_000
_MATES = 1000
_FRAGMENT = "node string, up string, kind string, end string, dist long, low string, state int, part int, trail array<string>"


def links(edges: DataFrame, *, up_field: str = "parent", down_field: str = "children") -> DataFrame:
    """(node, up) that hold, of edges rows (source, target, field, seen_at, loaded_at, edge_id)."""
    e = edges.select(reference_key("source").alias("s"), reference_key("target").alias("t"), plain_name("field").alias("f"), "seen_at", "loaded_at", "edge_id")
    e = e.filter(F.col("f").isin(up_field, down_field) & (F.col("s") != "") & (F.col("t") != ""))
    up = F.col("f") == up_field
    e = e.select(F.when(up, F.col("s")).otherwise(F.col("t")).alias("node"), F.when(up, F.col("t")).otherwise(F.col("s")).alias("up"), "seen_at", "loaded_at", "edge_id")
    return e.groupBy("node").agg(F.max(F.struct("seen_at", "loaded_at", "edge_id", "up")).alias("x")).select("node", "x.up")


def _contract(with_trail: bool):
    """Of each partition: node -> kind (root, exit, loop), end, distance, least key on the way, state."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        got = list(batches)
        t = pa.Table.from_batches(got) if got else None
        if t is None or not t.num_rows:
            return
        t = t.combine_chunks()
        flat = lambda x: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
        node, up, low = (flat(t.column(c)) for c in ("node", "up", "low"))
        n = len(node)
        nxt = np.asarray(pc.fill_null(pc.index_in(up, value_set=node), -1)).astype(np.int64)
        has = ~np.asarray(pc.is_null(up))
        here = np.arange(n)
        jump = np.where(nxt >= 0, nxt, here)
        w = np.asarray(t.column("w")).astype(np.int64)
        dist = np.where(nxt >= 0, w, 0)
        keys = pc.sort_indices(low)
        rank = np.empty(n, dtype=np.int64)
        rank[np.asarray(keys)] = np.arange(n)
        least = rank.copy()
        for _ in range(max(1, int(n).bit_length()) + 1):
            new = jump[jump]
            if (new == jump).all():
                break
            least = np.minimum(least, least[jump])
            dist = dist + dist[jump]
            jump = new
        # ``least`` covers the way up to and with the terminal node only once the jumps have met it.
        least = np.minimum(least, least[jump])
        terminal = nxt[jump] < 0
        state = np.zeros(n, dtype=np.int32)
        root_rank = np.full(n, -1, dtype=np.int64)
        cycle_of = np.full(n, -1, dtype=np.int64)
        if not terminal.all():
            for c in np.unique(jump[~terminal]).tolist():
                if cycle_of[c] >= 0:
                    continue
                ring, at = [c], int(nxt[c])
                while at != c:
                    ring.append(at)
                    at = int(nxt[at])
                cycle_of[ring] = c
                root_rank[ring] = rank[ring].min()
            bad = np.flatnonzero(~terminal)
            root_rank[bad] = root_rank[jump[bad]]
            state[bad] = np.where(cycle_of[bad] >= 0, 1, 2)
        exits = terminal & has[jump]
        end = np.where(exits, -1, np.where(terminal, jump, -1))
        base = flat(t.column("root"))
        ends = pc.take(base, pa.array(np.where(end >= 0, end, 0)))
        ends = pc.if_else(pa.array(exits), pc.take(up, pa.array(jump)), ends)
        if (state > 0).any():
            least_key = pc.take(low, pc.take(keys, pa.array(np.where(root_rank >= 0, root_rank, 0))))
            ends = pc.if_else(pa.array(state > 0), least_key, ends)
        # A root of this level brings its own depth and state from the level below.
        dist = np.where(terminal, dist + np.where(exits, w[jump], np.asarray(t.column("depth"))[jump]), 0)
        was = np.asarray(t.column("state"))[jump]
        state = np.where(terminal & ~exits & (was > 0), np.where(here == jump, was, 2), state).astype(np.int32)
        kind = np.where(state > 0, "loop", np.where(exits, "exit", "root"))
        lows = pc.take(low, pc.take(keys, pa.array(least)))
        trail: list[list[str] | None] = [None] * n
        if with_trail:
            names, own = node.to_pylist(), t.column("trail").to_pylist()
            for i in np.argsort(dist, kind="stable").tolist():
                if state[i] == 0:
                    before = trail[nxt[i]] if nxt[i] >= 0 else []
                    trail[i] = [*before, *(own[i] or [names[i]])]
        out = [node, up, pa.array(kind.tolist(), pa.string()), ends, pa.array(dist), lows, pa.array(state), pa.array(np.full(n, TaskContext.get().partitionId(), dtype=np.int32)), pa.array(trail, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([flat(x) for x in out], names=["node", "up", "kind", "end", "dist", "low", "state", "part", "trail"])

    return run


def _on_ring(pdf):
    """Nodes of one fragment with one exit that lie on a loop over partitions: from the loop's entry up to the exit."""
    import pandas as pd

    up = dict(zip(pdf.node, pdf.up))
    out = set()
    for entry in pdf.node[pdf.entry]:
        at = entry
        while at in up and at not in out:
            out.add(at)
            at = up[at]
    return pd.DataFrame({"node": pd.Series(sorted(out), dtype=object)})


def _spread(p: DataFrame, parts: int, level: int) -> DataFrame:
    """The rows of a level in partitions: by ranges of keys first, then random mates together."""
    if parts == 1:
        return p.coalesce(1)
    if level == 0:
        return p.repartitionByRange(parts, "node")
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 1
    crowded = p.groupBy("up").count().filter(F.col("up").isNotNull() & (F.col("count") > _MATES)).select("up", F.lit(True).alias("_crowded"))
    drawn = F.col("up").isNotNull() & heads("node") & ~heads("up") & F.col("_crowded").isNull()
    d = p.join(crowded, "up", "left").withColumn("_at", F.xxhash64(F.when(drawn, F.col("up")).otherwise(F.col("node")), F.lit(level)))
    return d.repartition(parts, "_at").select(*p.columns)


def _solve(p: DataFrame, part_rows: int, with_trail: bool, level: int = 0) -> DataFrame:
    """(node, root, depth, state, trail) of rows (node, up, w, low, root, depth, state, trail); ``p`` is checkpointed."""
    parts = max(1, -(-p.count() // part_rows))
    spread = _spread(p, parts, level)
    frag = checkpointed(spread.mapInArrow(_contract(with_trail), _FRAGMENT))
    own = frag.filter("kind != 'exit'").select("node", F.col("end").alias("root"), F.col("dist").alias("depth"), "state", "trail")
    if parts == 1:
        return own
    exits = frag.filter("kind = 'exit'")
    heads = exits.select(F.col("end").alias("node")).distinct()
    quotient = frag.join(heads, "node", "left_semi").select(
        "node",
        F.when(F.col("kind") == "exit", F.col("end")).alias("up"),
        F.when(F.col("kind") == "exit", F.col("dist")).otherwise(F.lit(0)).alias("w"),
        "low",
        F.when(F.col("kind") != "exit", F.col("end")).alias("root"),
        F.when(F.col("kind") == "root", F.col("dist")).otherwise(F.lit(0)).alias("depth"),
        F.when(F.col("kind") == "loop", F.lit(2)).otherwise(F.lit(0)).alias("state"),
        "trail",
    )
    solved = checkpointed(_solve(checkpointed(quotient), part_rows, with_trail, level + 1))
    known = solved.select(F.col("node").alias("end"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("state").alias("s"), F.col("trail").alias("t"))
    known = F.broadcast(known) if solved.count() <= _BROADCAST_ROWS and not with_trail else known
    up = exits.join(known, "end").select("node", F.col("r").alias("root"), F.when(F.col("s") == 0, F.col("d") + F.col("dist")).otherwise(F.lit(0)).alias("depth"), F.when(F.col("s") == 0, F.lit(0)).otherwise(F.lit(2)).alias("state"), F.when(F.col("s") == 0, F.concat("t", "trail")).alias("trail"))
    entries = solved.filter("state = 1").select("node")
    if not entries.isEmpty():
        on = exits.join(entries.withColumnRenamed("node", "end"), "end", "left_semi").join(entries.withColumn("entry", F.lit(True)), "node", "left").select("node", "up", "part", "end", F.coalesce("entry", F.lit(False)).alias("entry"))
        ring = on.groupBy("part", "end").applyInPandas(_on_ring, "node string").withColumn("ring", F.lit(True))
        up = up.join(ring, "node", "left").select("node", "root", "depth", F.when(F.col("ring"), F.lit(1)).otherwise(F.col("state")).alias("state"), "trail")
    return own.unionByName(up)


def hierarchy(held: DataFrame, *, part_rows: int = PART_ROWS, with_path: bool = False) -> DataFrame:
    """(node, root_node, node_depth[, path]) of each end of links (node, up); ``path`` runs from the root to the node."""
    held = checkpointed(held.filter("node is not null and up is not null").select("node", "up"))
    tops = held.select(F.col("up").alias("node")).distinct().join(held.select("node"), "node", "left_anti").withColumn("up", F.lit(None).cast("string"))
    p = held.unionByName(tops).select("node", "up", F.lit(1).cast("long").alias("w"), F.col("node").alias("low"), F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("state"), F.lit(None).cast("array<string>").alias("trail"))
    out = _solve(checkpointed(p), part_rows, with_path)
    depth = F.when(F.col("state") == 0, F.col("depth")).when(F.col("state") == 1, F.lit(-1)).otherwise(F.lit(-2)).cast("int")
    return out.select("node", F.col("root").alias("root_node"), depth.alias("node_depth"), *([F.col("trail").alias("path")] if with_path else []))


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, distance) of each ancestor of a node, from ``hierarchy(..., with_path=True)``."""
    p = paths.filter("path is not null").select(F.col("node").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("i", "node"))
    return p.filter(F.col("i") < F.col("n") - 1).select("node", "descendant", (F.col("n") - 1 - F.col("i")).alias("distance"))


def found(edges: DataFrame, *, part_rows: int = PART_ROWS) -> DataFrame:
    return hierarchy(links(edges), part_rows=part_rows)
