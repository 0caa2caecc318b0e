"""Hierarchies, drift, increments and references on small tables, against plain computations."""

import datetime as dt
import json
import random
from collections import Counter

import pytest

from loamdex.operators import drift, hierarchy, increment, references

D = dt.datetime


def climb(pairs):
    """Root and depth of each node by following links one at a time."""
    up = dict(pairs)
    out = {}
    for n in set(up) | set(up.values()):
        way, at = [], n
        while at in up and at not in way:
            way.append(at)
            at = up[at]
        if at in way:
            ring = way[way.index(at) :]
            out[n] = (min(ring), -1 if n in ring else -2)
        else:
            out[n] = (at, len(way))
    return out


def tree(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "node string, up string")
    return {r.node: (r.root_node, r.node_depth) for r in hierarchy.hierarchy(df, **options).collect()}


@pytest.mark.parametrize("size, part_rows", [(150, 20), (150, 1000), (1, 5)])
def test_hierarchy_of_random_links(spark, size, part_rows):
    r = random.Random(size + part_rows)
    names = [f"n{k:03d}" for k in range(size)]
    r.shuffle(names)
    pairs = [(n, r.choice(names[max(0, k - 3) : k] or names) if r.random() < 0.97 else r.choice(names)) for k, n in enumerate(names) if r.random() < 0.95 or size == 1]
    assert tree(spark, pairs, part_rows=part_rows) == climb(pairs)


def test_hierarchy_of_one_ring_over_partitions(spark):
    pairs = [(f"{k:03d}", f"{(k + 7) % 60:03d}") for k in range(60)] + [("x", "003"), ("y", "x")]
    assert tree(spark, pairs, part_rows=9) == climb(pairs)


def test_no_task_holds_more_than_its_share(spark, monkeypatch):
    """A chain of scattered keys and a crowded parent, on small partitions: no level may put all that is left into one task."""
    keys = [f"{(k * 7919) % 3001:04d}" for k in range(900)]
    pairs = [*zip(keys, keys[1:]), *((f"x{k}", keys[5]) for k in range(300)), *((f"y{k}", f"x{k}") for k in range(300))]
    contract = hierarchy._contract

    def bounded(with_trail):
        run = contract(with_trail)

        def check(batches):
            got = list(batches)
            if sum(b.num_rows for b in got) > 250:
                raise ValueError("too many rows in one task")
            yield from run(iter(got))

        return check

    monkeypatch.setattr(hierarchy, "_contract", bounded)
    monkeypatch.setattr(hierarchy, "_MATES", 20)
    assert tree(spark, pairs, part_rows=100) == climb(pairs)


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([(f"{k:02d}", f"{k + 1:02d}") for k in range(30)], "node string, up string")
    paths = hierarchy.hierarchy(df, part_rows=7, with_path=True)
    assert {r.node: r.path for r in paths.collect()}["00"] == [f"{k:02d}" for k in range(30, -1, -1)]
    below = hierarchy.descendants(paths)
    assert below.count() == 30 * 31 // 2 and {r.distance for r in below.filter("node = '30' and descendant = '00'").collect()} == {30}


def test_hierarchy_of_edges(spark):
    rows = [
        (1, " ./a#x ", "b", " Parent ", D(2026, 1, 1), D(2026, 1, 1), 0),
        (2, "c", "a", "CHILDREN", D(2026, 1, 2), D(2026, 1, 2), 0),  # later: c is above a
        (2, "c", "a", "CHILDREN", D(2026, 1, 2), D(2026, 1, 2), 0),
        (3, "d", "d", "parent", D(2026, 1, 1), None, 0),
        (4, None, "e", "parent", D(2026, 1, 1), None, 0),
        (5, "f", " # ", "parent", D(2026, 1, 1), None, 0),
        (6, "g", "h", "next", D(2026, 1, 1), None, 0),
        (7, "i", "d", None, None, None, 0),
        (8, "A", "a", "parent", None, None, 0),
    ]
    edges = spark.createDataFrame(rows, "edge_id long, source string, target string, field string, seen_at timestamp_ntz, loaded_at timestamp_ntz, node int")
    got = {(r.node, r.root_node, r.node_depth) for r in hierarchy.found(edges).collect()}
    assert got == {("a", "c", 1), ("c", "c", 0), ("d", "d", -1), ("A", "c", 2)}
    assert hierarchy.found(edges.limit(0)).collect() == []


# ------------------------------------------------------------------ drift


def packets(spark, scans):
    """Packets of scans, each a list of heads (dict, text or None)."""
    rows = []
    for n, heads in enumerate(scans, 1):
        rows += [("w", n, f"p{n}-{k}", json.dumps(h) if isinstance(h, dict) else h, "extra") for k, h in enumerate(heads)]
    return spark.createDataFrame(rows, "workspace string, scan_no int, packet_id string, frontmatter string, observed string")


def changes(df):
    return Counter((r.scan_no, r.field, r.change_kind, r.became) for r in drift.drift(df).collect())


def test_drift(spark):
    word = lambda k: ["red", "blue", "green"][k % 3]
    one = [{"colour": word(k), "size": k, "tags": ["a", "b"], "flag": None, "due": "2026-01-02"} for k in range(9)]
    two = [{"tint": word(k + 1), "size": k + 0.5 if k > 2 else k, "labels": ["x"], "due": "2026-01-02T03:04:05"} for k in range(9)]
    df = packets(spark, [one, [*two, None, "", "{bad", "[1]"]])
    want = {(2, "colour", "renamed", "tint"), (2, "size", "retyped", "float"), (2, "due", "retyped", "datetime"), (2, "tags", "removed", ""), (2, "labels", "added", ""), (2, "flag", "removed", "")}
    assert changes(df) == Counter(want)
    assert changes(df.unionByName(df)) == Counter(want)
    assert changes(df.limit(0)) == Counter()
    assert changes(packets(spark, [one, [None]])) == Counter((2, f, "removed", "") for f in one[0])


def test_renames_are_one_to_one(spark):
    one = [{"a": f"x{k % 2}", "b": ["p", "q", "r", "x9"][k % 4]} for k in range(8)]
    two = [{"c": f"x{k % 2}", "d": ["p", "q", "r", "s"][k % 4]} for k in range(8)]
    assert changes(packets(spark, [one, two])) == Counter({(2, "a", "renamed", "c"): 1, (2, "b", "renamed", "d"): 1})


def test_contents_are_compared_whole(spark):
    """Texts with one beginning are different contents; a workspace's scans may be of any number."""
    one = [{"site": f"https://www.example.org/a/{c}"} for c in "abcdefgh"]
    two = [{"page": f"https://www.example.org/b/{c}"} for c in "abcdefgh"]
    assert changes(packets(spark, [one, two])) == Counter([(2, "site", "removed", ""), (2, "page", "added", "")])
    three = [{"home": f"https://www.example.org/a/{c}"} for c in "abcdxyzw"]
    assert changes(packets(spark, [one, three])) == Counter([(2, "site", "renamed", "home")])


def test_consistent_table_by_the_report(spark):
    one = [{"uuid": f"u{k}", "state": ["open", "done"][k % 2], "size": k, "due": "2026-01-02"} for k in range(10)]
    two = [{"uuid": f"v{k}", "phase": ["open", "done"][k % 2], "size": k + 0.5, "due": "2026-01-02T03:04:05", "packet_id": "x"} for k in range(9)] + [{"uuid": "v9", "phase": 7, "due": None}]
    got = {r.uuid: r for r in drift.consistent(packets(spark, [one, two])).collect()}
    assert (got["u1"].phase, got["u1"]["size"], got["u1"].due, got["u1"].rescued) == ("done", 1.0, D(2026, 1, 2), {})
    assert (got["v0"].phase, got["v0"]["size"], got["v0"].due, got["v0"].rescued) == ("open", 0.5, D(2026, 1, 2, 3, 4, 5), {"packet_id": '"x"'})
    assert got["v9"].phase is None and got["v9"].rescued == {"phase": "7", "due": "null"}
    assert drift.consistent(packets(spark, [[None]])).count() == 1 and drift.consistent(packets(spark, [one]).limit(0)).count() == 0


def test_rescue_and_replay(spark):
    rows = [("1", '{"n": 3, "s": "x", "d": "2026-01-02", "old": true, "more": {"k": [1]}}'), ("2", '{"n": "three", "s": 5, "d": null}'), ("3", None), ("4", "{bad"), ("5", '{"flag": "no", "old": false, "n": 12345678901234567890}')]
    df = spark.createDataFrame(rows, "id string, head string")
    got = drift.ingest(df, "head", {"n": "int", "s": "str", "d": "date"})
    r = {x.id: x for x in got.collect()}
    assert (r["1"].n, r["1"].s, r["1"].d, r["1"]["_rescued"]) == (3, "x", dt.date(2026, 1, 2), {"old": "true", "more": '{"k": [1]}'})
    assert (r["2"].n, r["2"].s, r["2"]["_rescued"]) == (None, None, {"n": '"three"', "s": "5", "d": "null"})
    assert r["3"]["_rescued"] is None and r["4"]["_rescued"] is None and r["5"]["_rescued"]["n"] == "12345678901234567890"
    p = {x.id: x for x in drift.promote(got, {"flag": ("bool", ["old"]), "s": ("str", [])}).collect()}
    assert (p["1"].flag, p["1"]["_rescued"]) == (True, {"more": '{"k": [1]}'})
    assert (p["5"].flag, p["5"]["_rescued"]["flag"]) == (False, '"no"') and p["2"]["_rescued"] == {"n": '"three"', "s": "5", "d": "null"}


# ------------------------------------------------------------------ increments


def test_new_and_changed(spark):
    packets = spark.createDataFrame([("a", "AA", None), ("a", "AA", None), ("b", "bb", None), ("c", "cc", None), ("d", "dd", D(2026, 1, 1)), ("e", None, None), (None, "x", None), ("f", "f1", None)], "packet_id string, content_hash string, deleted_at timestamp_ntz")
    index = spark.createDataFrame(
        [(1, "a", "aa", D(2026, 1, 1), 1), (2, "b", "bb", D(2026, 1, 1), 1), (3, "b", "old", D(2026, 1, 2), 1), (4, "b", "bb", D(2026, 1, 3), 2), (5, "e", "ee", D(2026, 1, 1), 1), (6, "f", "F1", None, 1), (7, "g", "gone", D(2026, 1, 1), 1), (1, "a", "aa", D(2026, 1, 1), 1)],
        "entry_id long, packet_id string, content_hash string, indexed_at timestamp_ntz, run_id long",
    )
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (1, "ok")], "run_id long, run_status string")
    got = {(r.packet_id, r.change_kind) for r in increment.found(packets, index, runs).collect()}
    assert got == {("b", "changed"), ("c", "new"), ("e", "changed")}
    assert {r.change_kind for r in increment.found(packets, index.limit(0), runs).collect()} == {"new"}
    assert increment.found(packets.limit(0), index, runs).collect() == []


def test_rows_come_from_the_manifests(spark, tmp_path):
    packets = spark.createDataFrame([(f"p{k}", "new" if k % 10 == 0 else f"h{k}", None) for k in range(300)], "packet_id string, content_hash string, deleted_at timestamp_ntz")
    index = spark.createDataFrame([(k, f"p{k}", f"H{k}", D(2026, 1, 1), 1) for k in range(295)], "entry_id long, packet_id string, content_hash string, indexed_at timestamp_ntz, run_id long")
    runs = spark.createDataFrame([(1, "ok")], "run_id long, run_status string")
    again = lambda: {(r.packet_id, r.change_kind) for r in increment.found(packets, index, runs, folder=str(tmp_path / "x"), file_rows=40).collect()}
    want = {(f"p{k}", "new" if k >= 295 else "changed") for k in range(300) if k % 10 == 0 or k >= 295}
    assert again() == want
    out = increment.VersionedTable(spark, str(tmp_path / "x" / "delta"), "record")
    assert (out.version(), out.read_manifest()["processed"]) == (2, {"source": 2})
    assert again() == want and out.version() == 2  # a run that is repeated finds its work done


def test_unchanged_files_are_neither_read_nor_written(spark, tmp_path):
    t = increment.VersionedTable(spark, str(tmp_path / "t"), "record", file_rows=50)
    a = spark.range(1000).selectExpr("cast(id as string) record", "'x' digest")
    b = a.selectExpr("record", "if(record = '7', 'y', digest) digest").filter("record != '8'").unionByName(spark.createDataFrame([("new", "z")], "record string, digest string"))
    assert t.replace(a) == 1 and len(t.read_manifest()["files"]) == 20
    assert t.replace(a) == 1
    t.replace(b)
    assert {(r.record, r.change_kind) for r in t.delta(1).collect()} == {("7", "changed"), ("8", "removed"), ("new", "new")}
    m = t.read_manifest()
    assert len(m["files"]) - 20 <= 2 and len(m["vectors"]) <= 2
    read = t._live(t.read_manifest(1), {f["bucket"] for f in m["vectors"]})
    assert len(read.inputFiles()) <= 2
    want = sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, t.read().collect())) == want
    t.compact()
    m = t.read_manifest()
    assert m["vectors"] == [] and sorted(map(tuple, t.read().collect())) == want
    assert t.delta(m["version"] - 1).collect() == [] and sorted(map(tuple, t.read(1).collect())) == sorted(map(tuple, a.collect()))
    t.replace(a)
    assert {(r.record, r.change_kind) for r in t.delta(m["version"]).collect()} == {("7", "changed"), ("8", "new"), ("new", "removed")}
    t.replace(a.limit(0))
    assert t.read().collect() == []


def test_versions_survive_failures(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    src = increment.VersionedTable(spark, str(tmp_path / "src"), "k")
    out = increment.VersionedTable(spark, str(tmp_path / "out"), "k")
    double = lambda df: df.selectExpr("k", "v * 2 v")
    read = lambda t: sorted(map(tuple, t.read().collect()))
    assert src.read() is None and src.version() == 0
    src.commit(rows(("a", 1), ("b", 2)))
    assert increment.process(src, out, double) == 1 and read(out) == [("a", 2), ("b", 4)]
    assert increment.process(src, out, double) is None
    src.commit(rows(("b", 5)), delete=rows(("b", 0)))
    src.commit(delete=rows(("a", 0)))

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        increment.process(src, out, fails)
    put = out.storage.put_new
    out.storage.put_new = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)  # killed with its files written, before the commit
    with pytest.raises(KeyboardInterrupt):
        increment.process(src, out, double)
    out.storage.put_new = put
    assert read(out) == [("a", 2), ("b", 4)] and out.version() == 1
    assert increment.process(src, out, double) == 2 and read(out) == [("b", 10)] and read(src) == [("b", 5)]
    assert sorted(map(tuple, src.read(1).collect())) == [("a", 1), ("b", 2)]
    added, removed = src.changes(1)
    assert [tuple(r) for r in added.collect()] == [("b", 5)] and sorted(map(tuple, removed.collect())) == [("a", 1), ("b", 2)]


def test_no_commit_is_lost(spark, tmp_path):
    """Many commits at once: each is kept once; and of two runs over the same source just one commits."""
    from concurrent.futures import ThreadPoolExecutor

    at = str(tmp_path / "t")
    one = lambda k: increment.VersionedTable(spark, at, "k").commit(spark.createDataFrame([(f"k{k}", k)], "k string, v int"))
    with ThreadPoolExecutor(6) as pool:
        assert sorted(pool.map(one, range(6))) == [1, 2, 3, 4, 5, 6]
    src = increment.VersionedTable(spark, at, "k")
    assert sorted(r.v for r in src.read().collect()) == list(range(6))
    run = lambda _: increment.process(src, increment.VersionedTable(spark, str(tmp_path / "out"), "k"), lambda df: df)
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(run, range(3)), key=str) == [1, None, None]
    out = increment.VersionedTable(spark, str(tmp_path / "out"), "k")
    assert sorted(r.v for r in out.read().collect()) == list(range(6))
    with pytest.raises(increment.CommitConflict):
        out.commit(delete=spark.createDataFrame([("k1",)], "k string"), base=0)


# ------------------------------------------------------------------ references


def test_orphans(spark):
    edges = spark.createDataFrame(
        [(1, " ./p1#top ", " Parent ", D(2026, 3, 1)), (2, "p9", "x", D(2026, 3, 1)), (3, "p2", "x", D(2026, 3, 1)), (4, "p3", "x", D(2026, 3, 1)), (5, None, "x", D(2026, 3, 1)), (6, " # ", "x", D(2026, 3, 1)), (7, "s1", None, D(2025, 1, 1)), (8, "P1", "x", None), (2, "p9", "x", D(2026, 3, 1))],
        "edge_id long, target string, field string, seen_at timestamp_ntz",
    )
    heads = {"p1": {"blocked_by": ["u2", " u9 ", None, ""], "in_sprint": "s1", "owner": 5}, "p2": {"blocked_by": "u1"}, "p3": {"blocked_by": "p1", "in_sprint": None}}
    packets = spark.createDataFrame(
        [("p1", "u1", json.dumps(heads["p1"]), D(2026, 1, 1), D(2026, 2, 1), None), ("p2", "u2", json.dumps(heads["p2"]), D(2026, 1, 1), D(2026, 2, 2), D(2026, 3, 1)), ("p3", "u3", json.dumps(heads["p3"]), D(2026, 4, 1), D(2026, 2, 3), None), ("p4", None, "{bad", D(2026, 1, 1), None, None)],
        "packet_id string, uuid string, frontmatter string, created_at timestamp_ntz, modified_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    registry = spark.createDataFrame([("s1", D(2025, 6, 1), None)], "ref_key string, opened_at timestamp_ntz, retired_at timestamp_ntz")
    got = {tuple(r) for r in references.found(edges, packets, registry).collect()}
    assert got == {
        ("edges", "2", "x", "p9", "missing", "2026-03"),
        ("edges", "3", "x", "p2", "deleted", "2026-03"),
        ("edges", "4", "x", "p3", "late", "2026-03"),
        ("edges", "7", None, "s1", "late", "2025-01"),
        ("edges", "8", "x", "P1", "missing", None),
        ("packets", "p1", "blocked_by", "u9", "missing", "2026-02"),
        ("packets", "p1", "owner", "5", "missing", "2026-02"),
        ("packets", "p3", "blocked_by", "p1", "missing", "2026-02"),
    }
    assert {r.kind for r in references.found(edges, packets.limit(0), registry.limit(0)).collect()} == {"missing"}
    assert references.found(edges.limit(0), packets.limit(0), registry).collect() == []
