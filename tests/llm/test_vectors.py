import numpy as np
import pytest

from loamdex.llm import fusion, neighbours


def clusters(n, seed=3):
    """Clusters of very different size, with copies and scaled vectors."""
    r = np.random.default_rng(seed)
    size = r.zipf(1.3, n).clip(1, n // 3)
    centre = np.repeat(np.arange(len(size)), size)[:n]
    x = r.normal(size=(len(size), 64))[centre] + 0.2 * r.normal(size=(n, 64))
    x[r.integers(0, n, n // 20)] = x[0]
    return (x * r.uniform(0.2, 3, (n, 1))).astype(np.float32)


def brute(x, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 10)
    np.fill_diagonal(s, -np.inf)
    return np.array([np.lexsort((np.arange(len(x)), -row))[:k] for row in s])


def test_graph_recall():
    x = clusters(2500)
    u = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    g = neighbours.Graph(u)
    want = np.argsort(-(u @ u.T), axis=1, kind="stable")[:, :6]
    for start in (np.arange(len(u)), None):
        got, _ = g.search(u, 6, start)
        assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got.tolist(), want.tolist())]) > 0.95
    assert [links.shape[1] for links, _ in g.layers] == [16] * (len(g.layers) - 1) + [32]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 250, "shard_rows": 400, "probes": 2}])
def test_similar_against_brute_force(spark, options):
    x = clusters(1200)
    df = spark.createDataFrame([(k, v.tolist(), "m") for k, v in enumerate(x)], "vec_id long, embedding array<float>, id string")
    near = neighbours.similar(df.unionByName(df), **options)
    got = {}
    for r in near.collect():
        got.setdefault(r.vec_id, {})[r.place] = r.other_id
    want = brute(x, 5)
    assert set(got) == set(range(1200)) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    assert np.mean([len(set(got[k].values()) & set(want[k].tolist())) / 5 for k in got]) >= 0.9


def test_hot_cells_are_divided(spark):
    """Half of the vectors in one cluster: cells stay bounded, each vector goes to a few of them, and the neighbours are right."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=64) + 0.5 * r.normal(size=(1500, 64)), r.normal(size=(1500, 64))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, e array<float>").checkpoint()
    leaves = neighbours.fit_cells(df, 3000, dim=64, shard_rows=400, cell_rows=200, sample_rows=600)
    near = df.mapInArrow(neighbours._router(leaves, spark, 3, 0.1, 64), "id long, e array<float>, near array<int>").collect()
    counts = np.bincount([r.near[0] for r in near])
    assert counts.max() <= 800 and max(len(r.near) for r in near) <= 3
    got = {}
    for r in neighbours.similar(df, vec_id="id", embedding="e", shard_rows=400, cell_rows=200, sample_rows=600, probes=4, margin=0.3).collect():
        got.setdefault(r.vec_id, set()).add(r.other_id)
    want = brute(x[:1500], 5)
    assert np.mean([len(got[k] & set(want[k].tolist())) / 5 for k in range(1500)]) > 0.85


def test_crowded_directions(spark):
    """More copies and multiples of one vector than anyone needs: each has the smallest others."""
    rows = [(k, [float(k % 3 + 1), 1.0 * (k % 3 + 1)] + [0.0] * 62) for k in range(60)] + [(100 + k, [1.0, 1.1 + k / 10] + [0.0] * 62) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.place): r.other_id for r in neighbours.similar(df).collect()}
    assert [got[50, p] for p in range(1, 6)] == [0, 1, 2, 3, 4] and [got[100, p] for p in range(1, 6)] == [101, 0, 1, 2, 3] and [got[2, p] for p in range(1, 6)] == [0, 1, 3, 4, 5]
    assert len(got) == 63 * 5


def test_unusable_and_few_vectors(spark):
    e = lambda *v: [float(a) for a in v] + [0.0] * (64 - len(v))
    rows = [(1, e(1)), (2, e(2)), (3, e(0, 1)), (4, None), (5, []), (6, e()), (7, [1.0]), (8, e(1)[:-1] + [None]), (9, e(1)[:-1] + [float("nan")]), (None, e(1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, neighbours.pairs(neighbours.similar(df)).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert neighbours.pairs(neighbours.similar(df.limit(0))).collect() == []


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(k, [1.0] + [0.0] * 63) for k in range(12)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.place): r.other_id for r in neighbours.similar(df, k=3).collect()}
    assert [got[9, p] for p in (1, 2, 3)] == [0, 1, 2] and [got[1, p] for p in (1, 2, 3)] == [0, 2, 3]


def plain_ranking(rows, weights=None):
    """Ideal-point ranking of one query, computed step by step."""
    best = {}
    for p, b, s in rows:
        if s is not None:
            best[b, p] = max(s, best.get((b, p), s))
    score, ideal = {}, {}
    for b in sorted({b for b, _ in best}):
        own = {p: s for (c, p), s in best.items() if c == b}
        order = sorted(own.values())
        at = lambda q: order[max(0, int(np.ceil(q * len(order))) - 1)]
        lo, hi = at(0.2), at(0.8)
        x = {p: 1.0 if hi <= lo else min(max(s, lo), hi) - lo for p, s in own.items()}
        norm = np.sqrt(sum(v * v for v in x.values())) / (weights or {}).get(b, 1.0)
        ideal[b] = max(x.values()) / norm
        for p, v in x.items():
            score.setdefault(p, {})[b] = v / norm
    out = {}
    for p, v in score.items():
        near = np.sqrt(sum((i - v.get(b, 0)) ** 2 for b, i in ideal.items()))
        away = np.sqrt(sum(a * a for a in v.values()))
        out[p] = round(float(away / (away + near)), 9)
    return out


def test_fusion_against_plain_steps(spark):
    r = np.random.default_rng(8)
    rows = []
    for b, scale in (("views", 1e6), ("bm25", 10), ("dense", -1), ("flat", 0)):
        rows += [(f"p{k}", b, float(scale * r.random() ** 3) if scale else 1.0) for k in r.permutation(40)[:25]]
    rows += [("p1", "bm25", None), ("p2", "bm25", 3.0), ("p2", "bm25", 3.0), ("q", None, 1.0), (None, "bm25", 1.0)]
    df = spark.createDataFrame([(1, p, b, s, 0.5) for p, b, s in rows], "query_id long, packet_id string, backend string, score double, closeness double")
    got = {x.packet_id: x.closeness for x in fusion.ideal_point(df).collect()}
    want = plain_ranking([(p, b, s) for p, b, s in rows if p and b])
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    weights = {"views": 3.0, "dense": 0.5}
    weighted = {x.packet_id: x.closeness for x in fusion.ideal_point(df, weights=weights).collect()}
    assert weighted == {k: pytest.approx(v, abs=1e-6) for k, v in plain_ranking([(p, b, s) for p, b, s in rows if p and b], weights).items()} and weighted != got
    top = [x.packet_id for x in fusion.top(df, 3).orderBy("place").collect()]
    assert top == sorted(want, key=lambda p: (-got[p], p))[:3]


def test_fusion_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "b", "x", 1.0), (1, "a", "x", 1.0), (2, "a", "x", None), (3, "a", "x", float("nan"))], "query_id long, packet_id string, backend string, score double")
    assert [(r.query_id, r.packet_id, r.place) for r in fusion.top(df, 1).collect()] == [(1, "a", 1)]
    assert fusion.top(df.limit(0)).collect() == []
