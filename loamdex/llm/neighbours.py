"""Most similar vectors for every vector.

Method: a hierarchical navigable small-world graph per shard, each layer stored as
one flat array of neighbour numbers, with the shards' results merged. Layers are built in bulk, their
candidates from blocks of similarities (from searches beyond ``_BULK`` nodes), and searched for many vectors at a time.

Vectors that point alike are in one shard: centroids are fitted on a bounded sample (``sample_rows``), and
a cell with more than ``shard_rows`` vectors is divided, by centroids fitted to a sample of its own on the executors, until
none is left. A vector goes to the cell of its nearest centroid and is searched for there, starting at its own
node, and in up to ``probes`` next cells whose centroids are nearly as similar (by ``margin``). The work
per vector thus stays the same as the table grows, in a hot cluster too. The centroids, about one for ``cell_rows`` vectors,
are the only thing gathered: 256 bytes each. Vectors from elsewhere that crowd one cell are divided over several copies of its shard.

Of vectors of one direction (to 6 decimals, copies and multiples) just the k + 1 with the smallest ids take part;
the others have the neighbours of the first of them, and it.

Defined results: embeddings that are null, of another length, with a null or no finite
number, or all zero take no part; rows with the same id count once; equally similar
vectors (to 10 decimals) are ordered by id; fewer than k others give fewer than k rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import checkpointed

K, DIM = 5, 64
DEGREE, EF_BUILD, EF_SEARCH = 16, 32, 24
SHARD_ROWS, CELL_ROWS, SAMPLE_ROWS, PROBES, MARGIN = 12_000, 6_000, 20_000, 2, 0.1
# Centroids fitted at once, sample rows for each below the first level, rounds of division.
_FAN, _EACH, _ROUNDS = 128, 100, 6
BATCH, _BULK = 1024, 25_000


class Graph:
    """Layers of a small-world graph over the rows of ``x`` (unit vectors); layer 0 holds all of them."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = 7):
        self.x, self.ef = x, ef
        n = len(x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(degree)).astype(int), 12)
        # Within a level, vectors near the same landmark are inserted together, so that small clusters are linked within.
        marks = np.random.default_rng(seed + 1).permutation(n)[: max(1, n // 32)]
        group = np.concatenate([np.argmax(x[s : s + 4096] @ x[marks].T, axis=1) for s in range(0, n, 4096)]) if n else level
        order = np.lexsort((group, -level))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # flat neighbour numbers by node, and the nodes of the layer
        for floor in range(level.max() if n else 0, -1, -1):
            nodes = order[: int((level >= floor).sum())]
            links = np.full((n, 2 * degree if floor == 0 else degree), -1, dtype=np.int32)
            self._fill(links, nodes)
            self.layers.append((links, nodes))

    def _fill(self, links: np.ndarray, nodes: np.ndarray) -> None:
        width = links.shape[1]
        if len(nodes) <= _BULK:
            self._bulk(links, nodes, width)
            return
        done = min(len(nodes), 256)
        first = nodes[:done]
        sims = self.x[first] @ self.x[first].T
        np.fill_diagonal(sims, -np.inf)
        near = np.argsort(-sims, axis=1, kind="stable")[:, : min(done - 1, self.ef)]
        if near.shape[1]:
            links[first] = self._choose(first, first[near], np.take_along_axis(sims, near, 1), width)
        while done < len(nodes):
            new = nodes[done : done + min(done, BATCH)]
            cand, sims = self._beam(links, self.x[new], self._enter(self.x[new], nodes[:done]), self.ef)
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, axis=1, kind="stable")[:, : self.ef // 2]
            cand = np.concatenate([cand, new[near]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : self.ef]
            chosen = self._choose(new, np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1), width)
            links[new] = chosen
            self._back(links, new, chosen, width)
            done += len(new)

    def _bulk(self, links: np.ndarray, nodes: np.ndarray, width: int) -> None:
        """All links of a layer: candidates by blocks of similarities to the whole layer."""
        x = self.x[nodes]
        take = min(len(nodes) - 1, self.ef)
        if take < 1:
            return
        for s in range(0, len(nodes), BATCH):
            own = nodes[s : s + BATCH]
            sims = x[s : s + BATCH] @ x.T
            sims[np.arange(len(own)), np.arange(s, s + len(own))] = -np.inf
            near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            vals = np.take_along_axis(sims, near, 1)
            best = np.argsort(-vals, axis=1, kind="stable")
            links[own] = self._choose(own, nodes[np.take_along_axis(near, best, 1)], np.take_along_axis(vals, best, 1), width)
        self._back(links, nodes, links[nodes].copy(), width)

    def _enter(self, q: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Start nodes for vectors: the best of the layer above, of whose graph the last one built is the lowest."""
        if not self.layers:
            at = known[np.argmax(q @ self.x[known[:256]].T, axis=1)]
            return at[:, None]
        at = None
        for links, nodes in self.layers:
            if at is None:
                top = nodes[:256]
                at = top[np.argmax(q @ self.x[top].T, axis=1)][:, None]
            ids, _ = self._beam(links, q, at, 8)
            at = ids[:, :4]
        return at

    def _beam(self, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all rows of ``q`` at once: ids and similarities, best first; -1 and -inf pad."""
        b, n = len(q), len(self.x)
        seen = np.zeros((b, n + 1), dtype=bool)
        seen[:, n] = True
        row = np.arange(b)[:, None]
        ids = np.full((b, ef), -1, dtype=np.int64)
        sims = np.full((b, ef), -np.inf, dtype=np.float32)
        start = np.where(start < 0, n, start)[:, :ef]
        w = start.shape[1]
        twice = np.array([[s in r[:k] for k, s in enumerate(r)] for r in start.tolist()]) if w > 1 else np.zeros((b, 1), bool)
        ok = (start < n) & ~twice
        seen[row, start] = True
        ids[:, :w] = np.where(ok, start, -1)
        sims[:, :w] = np.where(ok, np.einsum("bd,bmd->bm", q, self.x[np.minimum(start, n - 1)]), -np.inf)
        opened = ids < 0
        live = np.arange(b)
        while len(live):
            s = np.where(opened[live], -np.inf, sims[live])
            pick = np.argmax(s, axis=1)
            go = s[np.arange(len(live)), pick] > -np.inf
            live, pick = live[go], pick[go]
            if not len(live):
                break
            opened[live, pick] = True
            near = links[ids[live, pick]].astype(np.int64)
            near[near < 0] = n
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            some = fresh.any(axis=1)
            if not some.any():
                continue
            r, near, fresh = live[some], near[some], fresh[some]
            new = np.einsum("bd,bmd->bm", q[r], self.x[np.minimum(near, n - 1)])
            new[~fresh] = -np.inf
            better = (new > sims[r].min(axis=1)[:, None]).any(axis=1)
            r, near, new = r[better], near[better], new[better]
            if not len(r):
                continue
            all_sims = np.concatenate([sims[r], new], axis=1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            sims[r] = np.take_along_axis(all_sims, keep, 1)
            ids[r] = np.take_along_axis(np.concatenate([ids[r], near], axis=1), keep, 1)
            opened[r] = np.take_along_axis(np.concatenate([opened[r], np.zeros(near.shape, bool)], axis=1), keep, 1) | ~np.isfinite(sims[r])
        best = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def _choose(self, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` neighbours of each base: first those nearer to it than to any taken, then the nearest left."""
        b, c = cand.shape
        out = np.full((b, width), -1, dtype=np.int32)
        valid = (cand >= 0) & np.isfinite(sims)
        v = self.x[np.maximum(cand, 0)]
        taken = np.zeros((b, c), dtype=bool)
        closest = np.full((b, c), -np.inf, dtype=np.float32)
        for j in range(c):
            ok = valid[:, j] & (sims[:, j] > closest[:, j]) & (taken.sum(axis=1) < width)
            if ok.any():
                taken[ok, j] = True
                closest[ok] = np.maximum(closest[ok], np.einsum("bd,bcd->bc", v[ok, j], v[ok]))
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * (c + 1) + np.arange(c)
        first = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out[:, : first.shape[1]] = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(cand, first, 1), -1)
        return out

    def _back(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray, width: int) -> None:
        """Links back to new nodes; a node with too many keeps the best by the same choice."""
        source = np.repeat(new, chosen.shape[1])
        target = chosen.ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        sims = np.einsum("nd,nd->n", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begin, count)
        most = min(int(count.max()), 2 * width)
        extra = np.full((len(nodes), most), -1, dtype=np.int64)
        fits = place < most
        extra[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
        cand = np.concatenate([links[nodes].astype(np.int64), extra], axis=1)
        for s in range(0, len(nodes), BATCH):
            part, at = cand[s : s + BATCH], nodes[s : s + BATCH]
            part = np.sort(part, axis=1)
            part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
            sim = np.einsum("bd,bcd->bc", self.x[at], self.x[np.maximum(part, 0)])
            sim[part < 0] = -np.inf
            best = np.argsort(-sim, axis=1, kind="stable")[:, : 2 * width]
            links[at] = self._choose(at, np.take_along_axis(part, best, 1), np.take_along_axis(sim, best, 1), width)

    def search(self, q: np.ndarray, k: int, start: np.ndarray | None = None, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nodes most similar to each row of ``q``; ``start``: a node to begin at beside the entry of the layers above."""
        ids, sims = [], []
        for s in range(0, len(q), BATCH):
            part = q[s : s + BATCH]
            upper = self.layers
            self.layers = upper[:-1]
            at = self._enter(part, upper[-1][1])
            self.layers = upper
            if start is not None:
                at = np.concatenate([start[s : s + BATCH, None], at], axis=1)
            i, v = self._beam(upper[-1][0], part, at, max(ef, k))
            ids.append(i[:, :k])
            sims.append(v[:, :k])
        return np.concatenate(ids), np.concatenate(sims)


def unit(flat: np.ndarray, dim: int = DIM) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Spherical k-means: the first centroids by farthest-point choice, so that distinct clusters get their own."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    close = x @ x[at[0]]
    for _ in range(min(k, len(x)) - 1):
        at.append(int(np.argmin(close)))
        close = np.maximum(close, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = np.linalg.norm(total, axis=1) > 1e-12
        c[some] = total[some] / np.linalg.norm(total[some], axis=1, keepdims=True)
    return c


def _usable(df: DataFrame, vec_id: str, embedding: str, dim: int) -> DataFrame:
    """(id, e, d, f) of the vectors that take part; ``d`` and ``f`` are two hashes of their direction to 6 decimals."""
    import pyarrow as pa
    import pyarrow.compute as pc

    factors = np.random.default_rng(23).integers(0, 1 << 63, size=(dim, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def read(batches):
        for batch in batches:
            ok = pc.and_(pc.is_valid(batch.column(0)), pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False))
            batch = batch.filter(ok)
            flat = batch.column(1).flatten()
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[good]
            turned = np.rint(unit(x.ravel(), dim) * 1e6).astype(np.int64).astype(np.uint64)
            h = np.stack([(turned * factors[:, k]).sum(axis=1, dtype=np.uint64).view(np.int64) for k in (0, 1)]) if len(x) else np.zeros((2, 0), np.int64)
            e = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), e, pa.array(h[0]), pa.array(h[1])], names=["id", "e", "d", "f"])

    x = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("e")).mapInArrow(read, "id long, e array<float>, d long, f long")
    return x.groupBy("id").agg(F.min(F.struct("e", "d", "f")).alias("x")).select("id", "x.*")


def _rows(table) -> np.ndarray:
    col = table.column("e")
    col = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    return col.flatten().to_numpy(zero_copy_only=False)


def _fit_cells(table, dim: int):
    """Sub-centroids of one cell, of a sample of its vectors that says how many to fit."""
    import pyarrow as pa

    x = unit(_rows(table), dim)
    c = fit_centroids(x, min(len(x), int(table.column("parts")[0].as_py())))
    return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(c), pa.int32()), "c": pa.array(c.tolist(), pa.list_(pa.float64()))})


def _router(centroids: np.ndarray, spark, reach: int, margin: float, dim: int):
    """For mapInArrow: (id, e, near), the numbers of up to ``reach`` most similar centroids, within ``margin`` of the best."""
    import pyarrow as pa

    shared = spark.sparkContext.broadcast(centroids.astype(np.float32))

    def route(batches):
        c = shared.value
        step = max(1, 4_000_000 // len(c))
        for batch in batches:
            x = unit(_rows(batch), dim).astype(np.float32)
            near, size = [], []
            for s in range(0, len(x), step):
                sims = x[s : s + step] @ c.T
                top = np.argpartition(-sims, reach - 1, axis=1)[:, :reach] if reach < len(c) else np.tile(np.arange(len(c)), (len(sims), 1))
                vals = np.take_along_axis(sims, top, 1)
                order = np.lexsort((top, -vals), axis=1)
                top, vals = np.take_along_axis(top, order, 1)[:, :reach], np.take_along_axis(vals, order, 1)[:, :reach]
                inside = vals >= vals[:, :1] - margin
                near.append(top[inside])
                size.append(inside.sum(axis=1))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(size))]) if size else np.zeros(1)
            flat = np.concatenate(near) if near else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))], names=["id", "e", "near"])

    return route


_ROUTED = "id long, e array<float>, near array<int>"


def fit_cells(v: DataFrame, n: int, *, dim: int, shard_rows: int, cell_rows: int, sample_rows: int) -> np.ndarray:
    """Centroids of cells of at most ``shard_rows`` of the ``n`` vectors (id, e), as far as vectors can be told apart."""
    part = lambda share: F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < (share * (1 << 30)).cast("long")
    if n <= cell_rows:
        return np.zeros((1, dim))
    sample = [r.e for r in v.filter(part(F.lit(min(1.0, sample_rows / n)))).select("e").toLocalIterator()]  # about sample_rows
    if not sample:
        return np.zeros((1, dim))
    leaves = fit_centroids(unit(np.array(sample, dtype=np.float32).ravel(), dim), min(_FAN, math.ceil(n / cell_rows)))
    for _ in range(_ROUNDS):
        routed = v.mapInArrow(_router(leaves, v.sparkSession, 1, 0.0, dim), _ROUTED).select("id", "e", F.col("near")[0].alias("cell"))
        counts = {r.cell: r["count"] for r in routed.groupBy("cell").count().collect()}  # one row a centroid
        # Centroids of few vectors are given up, so that every cell has neighbours enough for its own.
        few = [c for c in range(len(leaves)) if counts.get(c, 0) < cell_rows // 20]
        big = [(c, min(_FAN, math.ceil(m / cell_rows)), min(1.0, _EACH * min(_FAN, math.ceil(m / cell_rows)) / m)) for c, m in counts.items() if m > shard_rows]
        if not big:
            return leaves if len(few) == len(leaves) else np.delete(leaves, few, axis=0)
        plan = v.sparkSession.createDataFrame(big, "cell int, parts int, share double")
        fitted = routed.join(F.broadcast(plan), "cell").filter(part(F.col("share"))).groupBy("cell").applyInArrow(lambda t: _fit_cells(t, dim), "cell int, c array<double>").collect()
        new = [r.c for r in fitted]
        leaves = np.concatenate([np.delete(leaves, sorted({r.cell for r in fitted}), axis=0), np.array(new).reshape(-1, dim)])
    return leaves


def _shard(table, k: int, dim: int, ef: int):
    """Neighbours within one shard of its own vectors (in the first copy of the shard) and of those from elsewhere."""
    import pyarrow as pa

    ids, own = table.column("id").to_numpy(), table.column("own").to_numpy(zero_copy_only=False).astype(bool)
    none = pa.table({"vec_id": pa.array([], pa.int64()), "other_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
    if not own.any():
        return none
    raw = _rows(table).reshape(-1, dim)
    x = unit(raw, dim)
    _, first, node = np.unique(raw[own], axis=0, return_index=True, return_inverse=True)
    node = node.ravel()
    base = x[own][first]
    order = np.lexsort((ids[own], node))
    begin = np.searchsorted(node[order], np.arange(len(first)))
    end = np.append(begin[1:], len(order))
    members = [ids[own][order[b : min(e, b + k + 1)]].tolist() for b, e in zip(begin, end)]
    graph = Graph(base.astype(np.float32))
    home = table.column("part")[0].as_py() == 0
    q = np.concatenate([np.flatnonzero(own) if home else np.zeros(0, np.int64), np.flatnonzero(~own)])
    if not len(q):
        return none
    start = np.full(len(q), -1, dtype=np.int64)
    if home:
        start[: int(own.sum())] = node
    got, _ = graph.search(x[q].astype(np.float32), min(len(first), k + 3), start, ef)
    sims = np.round(np.einsum("qd,qkd->qk", x[q], base[np.maximum(got, 0)]), 10)
    a, b, s = [], [], []
    for vid, nodes, vals in zip(ids[q].tolist(), got.tolist(), sims.tolist()):
        near = sorted((-t, o) for g, t in zip(nodes, vals) if g >= 0 for o in members[g] if o != vid)[:k]
        a += [vid] * len(near)
        b += [o for _, o in near]
        s += [-t for t, _ in near]
    return pa.table({"vec_id": pa.array(a, pa.int64()), "other_id": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})


def similar(
    vectors: DataFrame,
    *,
    k: int = K,
    dim: int = DIM,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    cell_rows: int = CELL_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    probes: int = PROBES,
    margin: float = MARGIN,
    ef: int = EF_SEARCH,
) -> DataFrame:
    """One row (vec_id, other_id, similarity, place) for each of the ``k`` vectors most similar to a vector."""
    best = Window.partitionBy("vec_id").orderBy(F.col("similarity").desc(), "other_id")
    usable = checkpointed(_usable(vectors, vec_id, embedding, dim))
    firsts = usable.withColumn("n", F.row_number().over(Window.partitionBy("d", "f").orderBy("id"))).filter(F.col("n") <= k + 1)  # pruned before the shuffle
    kept = checkpointed(firsts)
    v, n, total = kept.select("id", "e"), kept.count(), usable.count()
    leaves = fit_cells(v, n, dim=dim, shard_rows=shard_rows, cell_rows=cell_rows, sample_rows=sample_rows)
    routed = v.mapInArrow(_router(leaves, v.sparkSession, min(len(leaves), probes + 1), margin, dim), _ROUTED)
    to = routed.select("id", "e", F.posexplode("near").alias("rank", "cell"))
    # Copies of a shard by the number of vectors from elsewhere, one row a centroid.
    copies = to.filter("rank > 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * shard_rows)).cast("int").alias("copies")).filter("copies > 1")
    to = to.join(F.broadcast(copies), "cell", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    at = F.when(F.col("rank") == 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")))
    to = to.select("id", "e", "cell", (F.col("rank") == 0).alias("own"), F.explode(at).alias("part"))
    near = to.groupBy("cell", "part").applyInArrow(lambda t: _shard(t, k, dim, ef), "vec_id long, other_id long, similarity double")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    if total == n:
        return near
    # The others of a crowded direction: the neighbours of its first vector, and that.
    near = checkpointed(near)
    crowd = kept.filter(F.col("n") == k + 1).select("d", "f").join(kept.filter("n = 1").select("d", "f", F.col("id").alias("first")), ["d", "f"])
    rest = usable.join(crowd, ["d", "f"]).join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("vec_id"), "first")
    heads = near.join(crowd.select(F.col("first").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("first"), "other_id", "similarity")
    heads = heads.unionByName(crowd.select("first", F.col("first").alias("other_id"), F.lit(1.0).alias("similarity")))
    more = heads.groupBy("first").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other_id"))).alias("x"))
    more = rest.join(more, "first").select("vec_id", F.posexplode(F.slice("x", 1, k)).alias("p", "x"))
    return near.unionByName(more.select("vec_id", "x.other_id", (-F.col("x.s")).alias("similarity"), (F.col("p") + 1).cast("int").alias("place")))


def pairs(near: DataFrame) -> DataFrame:
    """Each pair of which at least one is among the other's nearest, once: (vec_a, vec_b) with vec_a < vec_b."""
    return near.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).distinct()
