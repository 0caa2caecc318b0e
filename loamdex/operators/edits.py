"""Bulk edits of document heads that leave every byte alone that isn't edited.

An edit is planned on each file's own text: the line span of a top-level key is found with the
YAML parser's marks, and only spans of touched keys are rewritten. Planning runs where the files are
read; files are written in place by an atomic replace.
"""

from __future__ import annotations

import datetime as dt
import difflib
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.errors import EditError, ParseError
from loamdex.sources.frontmatter import _Loader, join, load_yaml, split

if TYPE_CHECKING:
    from loamdex.workspace import Workspace

OPS = ("set", "remove", "rename", "append", "toggle")


@dataclass(frozen=True)
class EditOp:
    kind: str
    args: tuple[tuple[str, object], ...]


class _Dumper(yaml.SafeDumper):
    def increase_indent(self, flow=False, indentless=False):
        return super().increase_indent(flow, False)

    def ignore_aliases(self, data):
        return True


_Dumper.yaml_implicit_resolvers = _Loader.yaml_implicit_resolvers
_Dumper.add_representer(type(None), lambda d, _: d.represent_scalar("tag:yaml.org,2002:null", "null"))
_Dumper.add_representer(dt.datetime, lambda d, v: d.represent_scalar("tag:yaml.org,2002:timestamp", v.isoformat()))


def render(key: str, value, eol: str) -> str:
    """One key with its value as YAML lines."""
    text = yaml.dump({key: value}, Dumper=_Dumper, allow_unicode=True, sort_keys=False, default_flow_style=False, width=1 << 20, indent=2)
    return text.replace("\n", eol)


class Head:
    """The lines of a head, by top-level key."""

    def __init__(self, text: str, eol: str):
        self.eol = eol
        self.fields = load_yaml(text)
        self.lines = text.splitlines(keepends=True)
        node = yaml.compose(text, _Loader)
        self.flow = node is not None and getattr(node, "flow_style", False)
        pairs = node.value if node is not None else []
        starts = [k.start_mark.line for k, _ in pairs]
        self.spans: dict[str, list] = {}
        for n, (k, v) in enumerate(pairs):
            stop = v.end_mark.line + (1 if v.end_mark.column or v.end_mark.line == k.start_mark.line else 0)
            stop = max(stop, k.start_mark.line + 1)
            if n + 1 < len(starts):
                stop = min(stop, starts[n + 1])
            # Comment and blank lines after a block value belong to what follows.
            while stop > k.start_mark.line + 1 and re.match(r"\s*(?:#.*)?$", self.lines[stop - 1]):
                stop -= 1
            self.spans[self._key(k)] = [k.start_mark.line, stop, k.end_mark.column, v]

    @staticmethod
    def _key(node) -> str:
        return str(node.value)

    def text(self) -> str:
        return "".join(self.lines)

    def _splice(self, start: int, stop: int, new: str) -> Head:
        if start > 0 and self.lines and not self.lines[start - 1].endswith("\n"):
            self.lines[start - 1] += self.eol
        return Head("".join([*self.lines[:start], new, *self.lines[stop:]]), self.eol)

    def put(self, key: str, value) -> Head:
        if self.flow:
            return Head("".join(render(k, v, self.eol) for k, v in {**self.fields, key: value}.items()), self.eol)
        if key not in self.spans:
            return self._splice(len(self.lines), len(self.lines), render(key, value, self.eol))
        start, stop, _, node = self.spans[key]
        if isinstance(node, yaml.CollectionNode) and node.flow_style and isinstance(value, (list, dict)) and node.end_mark.line == start:
            # A list or map written on one line stays on one.
            line, inner = self.lines[start], yaml.dump(value, Dumper=_Dumper, allow_unicode=True, sort_keys=False, default_flow_style=True, width=1 << 20).strip()
            return self._splice(start, stop, line[: node.start_mark.column] + inner + line[node.end_mark.column :])
        new = render(key, value, self.eol)
        if stop == start + 1 and new.count(self.eol) == 1 and node.start_mark.line == start and isinstance(node, yaml.ScalarNode):
            # A scalar on one line: what stands after it, such as a comment, stays.
            line = self.lines[start]
            inner = new[len(render(key, None, self.eol)) - len("null" + self.eol) : -len(self.eol)]
            return self._splice(start, stop, line[: node.start_mark.column] + (" " if node.start_mark.column and line[node.start_mark.column - 1] == ":" else "") + inner + line[node.end_mark.column :])
        return self._splice(start, stop, new)

    def drop(self, key: str) -> Head:
        if self.flow:
            return Head("".join(render(k, v, self.eol) for k, v in self.fields.items() if k != key), self.eol)
        start, stop, *_ = self.spans[key]
        return self._splice(start, stop, "")

    def rename(self, old: str, new: str) -> Head:
        if self.flow:
            return Head("".join(render(new if k == old else k, v, self.eol) for k, v in self.fields.items()), self.eol)
        start, _, end, _ = self.spans[old]
        name = render(new, None, self.eol).rsplit(":", 1)[0]
        return self._splice(start, start + 1, name + self.lines[start][end:])


def apply_ops(head: Head, ops: Iterable[EditOp]) -> Head:
    """All operations in order; the first that can't be applied raises."""
    for op in ops:
        for key, value in op.args:
            there = key in head.fields
            if op.kind == "set":
                if not there or head.fields[key] != value or type(head.fields[key]) is not type(value):
                    head = head.put(key, value)
            elif op.kind == "remove":
                head = head.drop(key) if there else head
            elif op.kind == "rename":
                if there and value != key:
                    if value in head.fields:
                        raise EditError(f"cannot rename {key}: {value} exists")
                    head = head.rename(key, value)
            elif op.kind == "append":
                if there and not isinstance(head.fields[key], list):
                    raise EditError(f"cannot append to {key}: not a list")
                head = head.put(key, [*(head.fields[key] if there else []), value])
            else:
                if not there or not isinstance(head.fields[key], bool):
                    raise EditError(f"cannot toggle {key}: not a bool")
                head = head.put(key, not head.fields[key])
    return head


def edit_text(text: str, ops: Iterable[EditOp]) -> str:
    doc = split(text)
    before = Head(doc.head, doc.eol)
    after = apply_ops(before, ops).text()
    return text if after == doc.head else join(doc, after)


@dataclass(frozen=True)
class FileChange:
    packet_id: str
    abspath: str
    before: str | None
    after: str | None
    error: str | None = None

    @property
    def changed(self) -> bool:
        return self.error is None and self.before != self.after


@dataclass(frozen=True)
class ApplyReport:
    written: tuple[str, ...]
    errors: tuple[tuple[str, str], ...]
    aborted: bool = False


def _replace(path: str, text: str) -> None:
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, path)


class EditPlan:
    """Operations on some files, planned against what is on disk when first asked."""

    def __init__(self, ws: Workspace, targets: Iterable[str], ops: Iterable[EditOp]):
        self.ws, self.targets, self.ops = ws, list(dict.fromkeys(targets)), tuple(ops)
        known = {r.packet_id: r.abspath for r in ws.spark.createDataFrame([(t,) for t in self.targets], "packet_id string").join(ws.packets, "packet_id").select("packet_id", "abspath").collect()} if self.targets else {}
        if missing := [t for t in self.targets if t not in known]:
            raise EditError(f"no such packet: {', '.join(missing[:5])}")
        self._paths = known
        self._changes: list[FileChange] | None = None
        self._done: tuple[int, int, int] | None = None  # changed, failed and untouched files of an edit that was written at once

    def then(self, op: EditOp) -> EditPlan:
        return EditPlan(self.ws, self.targets, (*self.ops, op))

    def compile(self) -> list[FileChange]:
        """Every file before and after, read and edited on the executors; a preview needs the texts here."""
        if self._changes is None:
            rows = {r.packet_id: r for r in self._run(write=False).collect()} if self.targets else {}
            self._changes = [FileChange(t, self._paths[t], rows[t].before, rows[t].after, rows[t].error) for t in self.targets]
        return self._changes

    def _run(self, *, write: bool) -> DataFrame:
        """(packet_id, before, after, changed, error) of the targets; with ``write`` the texts stay out and changed files are replaced where they are read."""
        import pyarrow as pa

        ops, names = self.ops, ["packet_id", "before", "after", "changed", "error"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]

        def one(pid: str, path: str) -> tuple:
            try:
                with open(path, encoding="utf-8", newline="") as f:
                    before = f.read()
                after = edit_text(before, ops)
                if not write:
                    return pid, before, after, before != after, None
                if before != after:
                    _replace(path, after)
                return pid, None, None, before != after, None
            except (EditError, ParseError, OSError, UnicodeDecodeError) as e:
                return pid, None, None, False, str(e)

        def run(batches):
            for batch in batches:
                rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        files = self.ws.spark.createDataFrame([(t, self._paths[t]) for t in self.targets], "packet_id string, path string")
        return files.mapInArrow(run, "packet_id string, before string, after string, changed boolean, error string")

    def preview_diff(self) -> str:
        out = []
        for c in self.compile():
            if c.changed:
                out += difflib.unified_diff(c.before.splitlines(keepends=True), c.after.splitlines(keepends=True), f"a/{c.packet_id}", f"b/{c.packet_id}", n=3)
        return "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in out)

    def summary(self) -> str:
        n = self._done
        if n is None:
            c = self.compile()
            n = sum(x.changed for x in c), sum(x.error is not None for x in c), sum(x.error is None and not x.changed for x in c)
        return f"{n[0]} changed, {n[1]} skipped (error), {n[2]} no-op"

    def preview(self) -> str:
        errors = "".join(f"error: {c.packet_id}: {c.error}\n" for c in self.compile() if c.error)
        return self.preview_diff() + errors + self.summary() + "\n"

    dry_run = preview

    def apply(self, *, confirm: bool = True, confirm_fn: Callable[[str], bool] | None = None) -> ApplyReport:
        """Write what changes, each file by an atomic replace; with ``confirm`` only if ``confirm_fn`` agrees.

        What was planned before is written as planned; without a plan and without ``confirm`` the executors edit and write the files.
        """
        if not confirm and self._changes is None and self.targets:
            rows = self._run(write=True).select("packet_id", "changed", "error").collect()
            written, errors = tuple(sorted(r.packet_id for r in rows if r.changed)), tuple((r.packet_id, r.error) for r in rows if r.error is not None)
            self._done = len(written), len(errors), len(rows) - len(written) - len(errors)
            self.ws._edges.clear()
            return ApplyReport(written, errors)
        changes = self.compile()
        errors = [(c.packet_id, c.error) for c in changes if c.error]
        todo = [c for c in changes if c.changed]
        if todo and confirm and not (confirm_fn and confirm_fn(self.preview())):
            return ApplyReport((), tuple(errors), True)
        written = []
        for c in todo:
            try:
                _replace(c.abspath, c.after)
                written.append(c.packet_id)
            except OSError as e:
                errors.append((c.packet_id, str(e)))
        self.ws._edges.clear()
        return ApplyReport(tuple(written), tuple(errors))


def changes(packets: DataFrame, ops: Iterable[EditOp], *, raw: str = "raw") -> DataFrame:
    """(packet_id, before, after, error) of an edit over a table of document texts, planned in parallel and written nowhere."""
    ops = tuple(ops)

    @F.pandas_udf("after string, error string")
    def run(col):
        import pandas as pd

        rows = []
        for t in col:
            try:
                rows.append((None if t is None else edit_text(t, ops), None))
            except (EditError, ParseError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["after", "error"], dtype=object)

    return packets.select("packet_id", F.col(raw).alias("before"), run(F.col(raw)).alias("x")).select("packet_id", "before", "x.after", "x.error")


def op(kind: str, /, *names: str, **values) -> EditOp:
    args = tuple((n, None) for n in names) + tuple(values.items())
    if not args:
        raise EditError(f"{kind} needs a field")
    return EditOp(kind, args)


def plan_set(ws, targets, /, **values) -> EditPlan:
    return EditPlan(ws, targets, [op("set", **values)])


def plan_remove(ws, targets, *fields) -> EditPlan:
    return EditPlan(ws, targets, [op("remove", *fields)])


def plan_rename(ws, targets, /, **names) -> EditPlan:
    return EditPlan(ws, targets, [op("rename", **names)])


def plan_append(ws, targets, /, **values) -> EditPlan:
    return EditPlan(ws, targets, [op("append", **values)])


def plan_toggle(ws, targets, *fields) -> EditPlan:
    return EditPlan(ws, targets, [op("toggle", *fields)])
