"""Scanning, writing back, editing and the command line, on files."""

import io
import os

import pytest

from loamdex import cli
from loamdex.errors import EditError, ParseError
from loamdex.operators import edits
from loamdex.plans.engine_queries import edit_preview
from loamdex.plans.query import Query, compile_query
from loamdex.sources.frontmatter import join, load_yaml, split
from loamdex.workspace import Workspace

FILES = {
    "tasks/a b.md": "---\nuuid: a # id\nstatus: active\nprio: 010\nflag: yes\ntags: [x, y]\n---\nBody\n",
    "tasks/b.md": "---\r\nuuid: b\r\nblocked_by: a\r\ndone: true\r\n---\r\nText",
    "c.md": "no head\n",
    "bad.md": "---\nstatus: : : bad\n---\n",
    "twice.md": "---\na: 1\na: 2\n---\n",
    "empty.md": "---\n---\nrest\n",
    "other.txt": "---\nuuid: z\n---\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.md").write_bytes(b"---\na: \xff\n---\n")
    return str(tmp_path)


def test_scan(spark, folder, capsys):
    ws = Workspace.open(spark, folder)
    assert Query(ws).ids() == ["c.md", "empty.md", "tasks/a b.md", "tasks/b.md"]
    assert sorted(line.split(": ")[1] for line in capsys.readouterr().err.splitlines() if line.startswith("warning: ")) == ["bad.md", "latin.md", "twice.md"]
    assert Query(ws).where(prio=10).ids() == ["tasks/a b.md"] and Query(ws).where(flag="yes").count() == 1
    assert Query(Workspace.open(spark, folder, ["tasks/*.md", "**/b.md"])).ids() == ["tasks/a b.md", "tasks/b.md"]
    with pytest.raises(FileNotFoundError):
        Workspace.open(spark, folder + "/nowhere")
    os.remove(os.path.join(folder, "c.md"))
    assert Query(ws.rescan()).count() == 3


def test_split_and_join():
    for text in FILES.values():
        try:
            d = split(text)
        except ParseError:
            continue
        assert join(d, d.head) == text
    assert split("﻿---\na: 1\n---\nx").prefix == "﻿" and split("---\na: 1\n").has_head is False
    assert split("a\r\n---\n").eol == "\r\n" and split("---\n---\n").fields == {}
    assert join(split("---\n---\nrest"), "") == "---\n---\nrest"


def test_yaml_dialect():
    v = load_yaml("a: yes\nb: 010\nc: 1:30\nd: 1e3\ne: 0o10\nf: 0x1f\ng: .5\nh: ~\ni: True\nj: 2026-01-02\nk: 2026-01-02T03:04:05Z\nl: '1'\n")
    assert (v["a"], v["b"], v["c"], v["d"], v["e"], v["f"], v["g"], v["h"], v["i"], v["l"]) == ("yes", 10, "1:30", 1000.0, 8, 31, 0.5, None, True, "1")
    assert v["j"].isoformat() == "2026-01-02" and v["k"].tzinfo is not None
    for bad in ("- a", "a: 1\na: 2", "a: [", "x"):
        with pytest.raises(ParseError):
            load_yaml(bad)


HEAD = "---\n# top\nstatus: active  # keep\ntags: [a, b]\nlist:\n  - x\n\n# c\npriority: 3\nflag: true\n---\nbody\n"


@pytest.mark.parametrize(
    "op, old, new",
    [
        (edits.op("set", status="done"), "status: active  # keep", "status: done  # keep"),
        (edits.op("set", new="a: b"), "flag: true\n", "flag: true\nnew: 'a: b'\n"),
        (edits.op("set", list=[1]), "list:\n  - x\n", "list:\n  - 1\n"),
        (edits.op("remove", "list"), "list:\n  - x\n", ""),
        (edits.op("remove", "nope"), "", ""),
        (edits.op("rename", status="state"), "status: active", "state: active"),
        (edits.op("append", tags="c"), "[a, b]", "[a, b, c]"),
        (edits.op("append", list="y", fresh=1), "  - x\n\n# c\npriority: 3\nflag: true\n", "  - x\n  - y\n\n# c\npriority: 3\nflag: true\nfresh:\n  - 1\n"),
        (edits.op("toggle", "flag"), "flag: true", "flag: false"),
        (edits.op("set", priority=3), "", ""),
    ],
)
def test_edits_change_nothing_else(op, old, new):
    assert edits.edit_text(HEAD, [op]) == HEAD.replace(old, new, 1)


@pytest.mark.parametrize("op", [edits.op("append", status="x"), edits.op("toggle", "status"), edits.op("toggle", "nope"), edits.op("rename", status="flag")])
def test_edits_that_cannot_be(op):
    with pytest.raises(EditError):
        edits.edit_text(HEAD, [op])


def test_edits_of_odd_files():
    assert edits.edit_text("body", [edits.op("set", a=1)]) == "---\na: 1\n---\nbody"
    assert edits.edit_text("﻿---\r\na: 1\r\n---\r\nb", [edits.op("set", a=2, b="x")]) == "﻿---\r\na: 2\r\nb: x\r\n---\r\nb"
    assert edits.edit_text("---\n---\nb", [edits.op("set", a="true")]) == "---\na: 'true'\n---\nb"
    with pytest.raises(EditError):
        edits.op("set")


def test_plan_and_apply(spark, folder):
    ws = Workspace.open(spark, folder, warn=False)
    plan = compile_query('uuid IN ["a", "b"]', ws).toggle("done")
    assert plan.summary() == "1 changed, 1 skipped (error), 0 no-op" and "-done: true" in plan.preview_diff()
    assert plan.apply(confirm_fn=lambda text: False).aborted
    r = plan.apply(confirm=False)
    assert r.written == ("tasks/b.md",) and len(r.errors) == 1
    assert open(os.path.join(folder, "tasks/b.md"), newline="").read() == FILES["tasks/b.md"].replace("true", "false")
    at_once = edits.plan_set(ws, ["tasks/b.md", "tasks/a b.md"], rank=2)  # no preview: edited and written where the files are read
    r = at_once.apply(confirm=False)
    assert r.written == ("tasks/a b.md", "tasks/b.md") and at_once.summary() == "2 changed, 0 skipped (error), 0 no-op"
    assert "rank: 2" in open(os.path.join(folder, "tasks/b.md"), newline="").read() and not [f for f in os.listdir(os.path.join(folder, "tasks")) if f.endswith(".part")]
    with pytest.raises(EditError):
        edits.plan_set(ws, ["zzz.md"], a=1)


def test_edits_of_a_table(spark):
    df = spark.createDataFrame([("1", HEAD), ("2", "---\nflag: 3\n---\n"), ("3", None)], "packet_id string, raw string")
    got = {r.packet_id: r for r in edits.changes(df, [edits.op("toggle", "flag")]).collect()}
    assert got["1"].after == HEAD.replace("flag: true", "flag: false") and "not a bool" in got["2"].error and got["3"].after is None


def test_edit_preview_returns_whole_texts(spark, tmp_path):
    bodies = {"a-packet-id-of-more-than-twenty-characters": "One\r\n\n---\nkind: note\n---\n  two \t\n", "b": "z\u00e4\u2028\U0001f600" * 3000 + " ", "c": "", "d": None}
    spark.createDataFrame(list(bodies.items()), "packet_id string, body string").write.parquet(str(tmp_path / "packets.parquet"))
    got = {r.packet_id: r for r in edit_preview(spark, str(tmp_path)).collect()}
    for k, body in bodies.items():
        assert got[k].before == f"---\nkind: note # kept\nflag: true\npath: {k}\n---\n{body or ''}" and got[k].error is None
        assert got[k].after == f"---\nkind: task # kept\nflag: false\nfile: {k}\nrank: 3\n---\n{body or ''}"


def run(spark, *args, stdin=""):
    out, src = io.StringIO(), io.StringIO(stdin)
    return cli.main(list(args), spark=spark, stdin=src, out=out), out.getvalue()


def test_command_line(spark, folder):
    assert run(spark, "query", folder, 'status = "active"') == (0, "tasks/a b.md\n")
    assert run(spark, "query", folder, 'uuid = "b"', "--follow", "blocked_by", "--resolver", "uuid") == (0, "tasks/a b.md\n")
    assert run(spark, "query", folder, 'uuid = "b"', "--format", "json")[1] == '{"id": "tasks/b.md", "frontmatter": {"uuid": "b", "blocked_by": "a", "done": true}}\n'
    assert run(spark, "query", folder, "a = =")[0] == 2
    assert run(spark, "cypher", folder, "MATCH (a)-[:blocked_by]->(b) RETURN a.uuid, b.uuid", "--resolver", "uuid") == (0, "b\ta\n")
    assert run(spark, "cypher", folder, "MATCH (a) RETURN count(a)", "--format", "json") == (0, '{"count": 4}\n')
    assert '"source": "tasks/b.md"' in run(spark, "subgraph", folder, "*", "--follow", "blocked_by", "--resolver", "uuid")[1]
    assert "packets: 4" in run(spark, "describe", folder)[1]
    assert run(spark, "search", "body", "--workspace", folder, "--format", "rows") == (0, "tasks/a b.md\t1.000000\t\n")
    assert run(spark, "list-backends")[1].startswith("grep\tscan\n") and run(spark, "version")[0] == 0
    assert run(spark, "set", "status=done", os.path.join(folder, "tasks/a b.md"), "--workspace", folder, "--dry-run")[0] == 0
    assert run(spark, "set", "rank=7", "-", "--workspace", folder, "--yes", stdin="tasks/b.md\n") == (0, "1 changed, 0 skipped (error), 0 no-op\n")
    assert run(spark, "toggle", "done", "-", "--workspace", folder, "--yes", stdin='{"id": "tasks/a b.md"}\n')[0] == 1
    assert run(spark, "remove", "rank", "-", "--workspace", folder, "--yes", stdin="[1]")[0] == 2
    assert "rank: 7" in open(os.path.join(folder, "tasks/b.md")).read()
