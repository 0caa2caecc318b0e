"""Command line: query, pattern, subgraph, describe, search, index, edits."""

from __future__ import annotations

import argparse
import json
import os
import sys

from loamdex.errors import EditError, LoamError
from loamdex.functions.coerce import assignment

VERSION = "0.1.0"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamdex")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **kw):
        return sub.add_parser(name, **kw)

    q = add("query")
    q.add_argument("workspace")
    q.add_argument("text", nargs="?", default="*")
    q.add_argument("--format", choices=["paths", "json"], default="paths")
    q.add_argument("--follow")
    q.add_argument("--depth", default="1")
    q.add_argument("--direction", choices=["forward", "reverse"], default="forward")
    q.add_argument("--resolver")
    q.add_argument("--include-origin", action="store_true")
    q.add_argument("--search")
    q.add_argument("--index", default="grep")
    q.add_argument("--index-location")
    c = add("cypher", aliases=["pattern"])
    c.add_argument("workspace")
    c.add_argument("text")
    c.add_argument("--format", choices=["rows", "json"], default="rows")
    c.add_argument("--resolver")
    g = add("subgraph")
    g.add_argument("workspace")
    g.add_argument("text", nargs="?", default="*")
    g.add_argument("--follow", action="append", required=True)
    g.add_argument("--depth", default="*")
    g.add_argument("--direction", choices=["forward", "reverse"], default="forward")
    g.add_argument("--resolver")
    g.add_argument("--no-include-origin", dest="include_origin", action="store_false")
    g.add_argument("--format", choices=["raw", "cytoscape"], default="raw")
    g.add_argument("--ids-only", action="store_true")
    d = add("describe")
    d.add_argument("workspace")
    d.add_argument("--format", choices=["text", "json"], default="text")
    d.add_argument("--top", type=int, default=5)
    s = add("search")
    s.add_argument("text")
    s.add_argument("--workspace", default=".")
    s.add_argument("--backend", default="grep")
    s.add_argument("--location", "--index")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--format", choices=["paths", "rows", "json"], default="paths")
    s.add_argument("--option", action="append", default=[])
    i = add("index")
    i.add_argument("workspace")
    i.add_argument("--backend", required=True)
    i.add_argument("--location", "--out")
    i.add_argument("--filter", default="*")
    i.add_argument("--field", action="append", default=[], help="a field to index, in order")
    i.add_argument("--format", choices=["text", "json"], default="text")
    i.add_argument("--force", action="store_true")
    i.add_argument("--option", action="append", default=[])
    add("list-backends").add_argument("--format", choices=["text", "json"], default="text")
    add("version")
    for kind in ("set", "remove", "rename", "append", "toggle"):
        e = add(kind)
        e.add_argument("tokens", nargs="+", help="FIELD=VALUE or FIELD, and files or -")
        e.add_argument("--workspace", "-w")
        e.add_argument("--dry-run", action="store_true")
        e.add_argument("--yes", "-y", action="store_true")
        if kind in ("remove", "toggle"):
            e.add_argument("--field", "-f", action="append", default=[])
    return p


def read_targets(stream) -> list[str]:
    """Ids from a pipe: a path a line, or JSON lines with an id."""
    out = []
    for line in stream:
        line = line.strip()
        if line.startswith("["):
            raise EditError("expected a path or a JSON object a line, not an array")
        if line.startswith("{"):
            out.append(json.loads(line)["id"])
        elif line:
            out.append(line)
    return out


def _workspace(spark, root: str, resolver: str | None = None):
    from loamdex.operators.graph import resolver_by_name
    from loamdex.workspace import Workspace

    return Workspace.open(spark, root, default_resolver=resolver_by_name(resolver) if resolver else None)


def _emit(df, out) -> None:
    for r in df.toLocalIterator():
        print(r.line, file=out)


def _options(pairs: list[str]) -> dict:
    return dict(assignment(p) for p in pairs)


def _inside(root: str, path: str) -> str:
    """An id for a piped path: relative to the workspace if it is there, else to the working folder."""
    if os.path.isabs(path):
        return os.path.relpath(os.path.realpath(path), root)
    if os.path.exists(os.path.join(root, path)) or not os.path.exists(path):
        return path
    return os.path.relpath(os.path.realpath(path), root)


def _edit(spark, a, stdin, out) -> int:
    from loamdex.operators import edits
    from loamdex.workspace import Workspace

    values = [t for t in a.tokens if "=" in t]
    rest = [t for t in a.tokens if "=" not in t]
    if a.command in ("remove", "toggle"):
        fields = a.field or rest[:1]
        rest = rest if a.field else rest[1:]
        op = edits.op(a.command, *fields)
    elif a.command == "rename":
        op = edits.op("rename", **dict(v.split("=", 1) for v in values))
    else:
        op = edits.op(a.command, **dict(assignment(v) for v in values))
    files = [t for t in rest if t != "-"]
    piped = read_targets(stdin) if "-" in rest or (not files and not stdin.isatty()) else []
    root = a.workspace or next((f for f in files if os.path.isdir(f)), None)
    files = [os.path.realpath(f) for f in files if not os.path.isdir(f)]
    if root is None:
        if not files and not piped:
            raise EditError("no files given")
        root = os.path.commonpath([os.path.dirname(f) for f in files] or [os.path.dirname(os.path.realpath(p)) for p in piped])
    root = os.path.realpath(root)
    ids = [os.path.relpath(f, root) for f in files] + [_inside(root, p) for p in piped]
    if not ids:
        raise EditError("no files given")
    plan = edits.EditPlan(Workspace.open(spark, root), ids, [op])
    if a.dry_run:
        print(plan.preview(), end="", file=out)
        return 1 if plan.compile() and all(c.error for c in plan.compile()) else 0

    def ask(text: str) -> bool:
        print(text, end="", file=out)
        try:
            with open("/dev/tty") as tty:
                print("apply? [y/N] ", end="", flush=True, file=out)
                return tty.readline().strip().lower() in ("y", "yes")
        except OSError:
            return False

    report = plan.apply(confirm=not a.yes, confirm_fn=ask)
    for pid, error in report.errors:
        print(f"error: {pid}: {error}", file=sys.stderr)
    if report.aborted:
        return 2
    print(plan.summary(), file=out)
    return 1 if report.errors and not report.written and len(report.errors) == len(ids) else 0


def main(argv: list[str] | None = None, *, spark=None, stdin=None, out=None) -> int:
    a = _parser().parse_args(argv)
    out, stdin = out or sys.stdout, stdin or sys.stdin
    if a.command == "version":
        print(VERSION, file=out)
        return 0
    try:
        if a.command == "list-backends":
            from loamdex.search.backends import discover

            known = {name: b.info() for name, b in sorted(discover().items())}
            if a.format == "json":
                print(json.dumps([{"name": n, "kind": i.kind, "version": i.version} for n, i in known.items()]), file=out)
            else:
                for name, i in known.items():
                    print(f"{name}\t{i.kind}", file=out)
            return 0
        from loamdex.session import get_spark

        return _run(a, spark or get_spark(), stdin, out)
    except (LoamError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(a, spark, stdin, out) -> int:
    from loamdex.operators import graph, profile
    from loamdex.operators.pattern import PatternQuery
    from loamdex.plans.query import compile_query
    from loamdex.search import registry
    from loamdex.sources import sinks

    if a.command in ("set", "remove", "rename", "append", "toggle"):
        return _edit(spark, a, stdin, out)
    ws = _workspace(spark, a.workspace, getattr(a, "resolver", None))
    if a.command == "query":
        q = compile_query(a.text, ws)
        if a.search:
            q = q.search(a.search, index=a.index, location=a.index_location)
        if a.follow:
            seeds = q
            q = q.follow(a.follow, depth=a.depth, direction=a.direction, include_origin=a.include_origin)
        df = q.df()
        _emit(sinks.packet_lines(ws, df, a.format), out)
        if a.follow and df.isEmpty() and not seeds.frame().isEmpty() and (hint := graph.mismatch_hint(ws, a.follow)):
            print(hint, file=sys.stderr)
    elif a.command in ("cypher", "pattern"):
        p = PatternQuery(ws, a.text)
        for line in sinks.pattern_lines(p.result(), a.format, scalar=p.is_scalar):
            print(line, file=out)
    elif a.command == "subgraph":
        g = graph.subgraph(ws, compile_query(a.text, ws).frame(), a.follow, depth=a.depth, direction=a.direction, include_origin=a.include_origin)
        print(json.dumps(sinks.graph_document(ws, g, a.format, ids_only=a.ids_only), ensure_ascii=False, indent=2), file=out)
    elif a.command == "describe":
        r = profile.report(ws, top_n=a.top)
        print(profile.report_json(r) if a.format == "json" else profile.report_text(r), end="\n" if a.format == "json" else "", file=out)
    elif a.command == "search":
        _emit(sinks.hit_lines(registry.search(ws, a.text, k=a.k, index=a.backend, location=a.location, options=_options(a.option)), a.format), out)
    else:
        options = _options(a.option) | ({"force": True} if a.force else {}) | ({"fields": a.field} if a.field else {})
        s = registry.build(ws, compile_query(a.filter, ws).frame(), index=a.backend, location=a.location, options=options)
        if a.format == "json":
            print(json.dumps({"indexed": s.packets_indexed, "skipped": s.packets_skipped, "removed": s.packets_removed, "seconds": s.elapsed_seconds}), file=out)
            return 0
        print(f"indexed {s.packets_indexed}, skipped {s.packets_skipped}, removed {s.packets_removed} in {s.elapsed_seconds:.1f} s", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
