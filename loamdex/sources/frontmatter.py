"""Documents with a YAML head: split, parse, scan a folder, write back.

The scan is a ``binaryFile`` read whose files are parsed where they are read; nothing of it
passes through the driver. A file that can't be read becomes a row with an ``error``, which the
workspace leaves out and reports.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.errors import ParseError
from loamdex.values import TAGGED, head_array

_HEAD = re.compile(r"---[ \t]*(\r\n|\n)(.*?)(?:(?<=\n)|\A)---[ \t]*(?:\r\n|\n|\Z)", re.S)
BOM = "\ufeff"


class _Loader(yaml.SafeLoader):
    """YAML 1.2 scalars: true and false only, 0o octal, 1e3 a float; repeated keys are an error."""

    def construct_mapping(self, node, deep=False):
        keys = set()
        for k, _ in node.value:
            key = self.construct_object(k, deep=True)
            if key in keys:
                raise yaml.constructor.ConstructorError(None, None, f"repeated key {key!r}", k.start_mark)
            keys.add(key)
        return super().construct_mapping(node, deep)


_Loader.yaml_implicit_resolvers = {}
for tag, rx, first in (
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+0123456789."),
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("timestamp", r"\d{4}-\d\d-\d\d|\d{4}-\d\d?-\d\d?(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?", "0123456789"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"^(?:{rx})$"), list(first))


def _int(loader, node):
    v = loader.construct_scalar(node)
    return int(v[2:], 8) if v.startswith("0o") else int(v[2:], 16) if v.startswith("0x") else int(v)


def _float(loader, node):
    v = loader.construct_scalar(node).lower()
    return float(v.replace(".inf", "inf").replace(".nan", "nan"))


_Loader.add_constructor("tag:yaml.org,2002:int", _int)
_Loader.add_constructor("tag:yaml.org,2002:float", _float)


def load_yaml(text: str) -> dict:
    try:
        v = yaml.load(text, _Loader)
    except (yaml.YAMLError, ValueError) as e:
        raise ParseError(f"bad head: {e}") from e
    if v is None:
        return {}
    if not isinstance(v, dict):
        raise ParseError("the head is not a mapping")
    return v


@dataclass(frozen=True)
class Document:
    fields: dict
    body: str
    head: str
    prefix: str
    eol: str
    has_head: bool
    ends_with_eol: bool


def split(text: str) -> Document:
    prefix = BOM if text.startswith(BOM) else ""
    rest = text[len(prefix) :]
    crlf, lf = rest.find("\r\n"), rest.find("\n")
    eol = "\r\n" if crlf >= 0 and crlf < lf else "\n"
    m = _HEAD.match(rest)
    if not m:
        return Document({}, rest, "", prefix, eol, False, rest.endswith("\n"))
    return Document(load_yaml(m[2]), rest[m.end() :], m[2], prefix, eol, True, rest.endswith("\n"))


def join(doc: Document, head: str, body: str | None = None, *, force_head: bool = False) -> str:
    """The text of a document with another head; without a head none is made unless the head has content or the body begins like one."""
    body = doc.body if body is None else body
    if not doc.has_head and not head and not force_head and not re.match(r"---[ \t]*\r?\n", body):
        return doc.prefix + body
    head = head if not head or head.endswith("\n") else head + doc.eol
    return f"{doc.prefix}---{doc.eol}{head}---{doc.eol}{body}"


_PACKET = f"packet_id string, abspath string, has_frontmatter boolean, fm map<string,{TAGGED}>, keys array<string>, body string, raw string, error string"


def _record(pid: str, path: str, data: bytes) -> dict:
    row = {"packet_id": pid, "abspath": path, "has_frontmatter": False, "fm": {}, "keys": [], "body": None, "raw": None, "error": None}
    try:
        text = data.decode("utf-8")
        d = split(text)
        return row | {"has_frontmatter": d.has_head, "fm": d.fields, "keys": [str(k) for k in d.fields], "body": d.body, "raw": text}
    except (ParseError, UnicodeDecodeError) as e:
        return row | {"error": str(e)}


def _batch(rows: list[dict]):
    import pyarrow as pa

    kinds = {"has_frontmatter": pa.bool_(), "keys": pa.list_(pa.string())}
    names = ["packet_id", "abspath", "has_frontmatter", "fm", "keys", "body", "raw", "error"]
    return pa.RecordBatch.from_arrays([head_array([r["fm"] for r in rows]) if n == "fm" else pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def scan(spark: SparkSession, root: str, glob: Iterable[str] = ("**/*.md",)) -> DataFrame:
    """Packets of a folder; ids are paths relative to it. A file that several patterns match is read once."""
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}").select("path", "content")
    wanted = "|".join(f"(?:{_glob_pattern(g)})" for g in glob)
    path = F.regexp_replace("path", "^file:/+", "/")
    pid = F.substring(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), len(root) + 2, 1 << 30)
    files = files.select(pid.alias("pid"), F.concat(F.lit(root + "/"), pid).alias("path"), "content").filter(F.col("pid").rlike(f"^(?:{wanted})$"))

    def read(batches):
        for batch in batches:
            yield _batch([_record(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(3)))])

    return files.mapInArrow(read, _PACKET)


def _glob_pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return out


def from_records(spark: SparkSession, records: dict[str, tuple[dict, str]]) -> DataFrame:
    """Packets of a mapping id -> (fields, body), for tests and small inputs."""
    import pyarrow as pa

    rows = [{"packet_id": k, "abspath": None, "has_frontmatter": bool(f), "fm": f, "keys": [str(n) for n in f], "body": b, "raw": None, "error": None} for k, (f, b) in records.items()]
    return spark.createDataFrame(pa.Table.from_batches([_batch(rows)]), schema=_PACKET)
