"""Options of the hybrid index: defaults, then environment, then a dotenv file, then options."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from loamdex.errors import SearchError
from loamdex.functions.coerce import read_env_file


class ConfigError(SearchError, ValueError):
    pass


@dataclass(frozen=True)
class Config:
    model: str = "hash"
    batch_size: int = 100
    max_tokens: int = 8000
    fields: tuple[str, ...] = ("title", "summary", "name")
    force: bool = False
    metric: str = "l2"
    reranker: str | None = None
    reranker_top_n: int = 50
    rerank_required: bool = False
    no_rerank: bool = False
    dense_only: bool = False
    sparse_only: bool = False
    fetch_k: int | None = None


_BUILD = {"model", "batch_size", "max_tokens", "fields", "force", "metric", "env"}
_QUERY = {"model", "metric", "reranker", "reranker_top_n", "rerank_required", "no_rerank", "dense_only", "sparse_only", "fetch_k", "env"}
_YES, _NO = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


def _convert(name: str, value):
    kind = {"batch_size": int, "max_tokens": int, "reranker_top_n": int, "fetch_k": int, "force": bool, "rerank_required": bool, "no_rerank": bool, "dense_only": bool, "sparse_only": bool}.get(name)
    if name == "fields":
        return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(map(str, value))
    if kind is bool:
        low = str(value).lower()
        if low not in _YES | _NO:
            raise ConfigError(f"{name} is true or false, not {value!r}")
        return low in _YES
    if kind is int:
        try:
            return int(value)
        except (TypeError, ValueError):
            raise ConfigError(f"{name} is a number, not {value!r}") from None
    return value


def resolve(options: dict | None, kind: str, *, environ: dict[str, str] | None = None) -> Config:
    """Variables are named LOAMDEX_ and the option in capitals."""
    o = dict(options or {})
    allowed = _BUILD if kind == "build" else _QUERY
    if unknown := sorted(set(o) - allowed):
        raise ConfigError(f"unknown options for {kind}: {', '.join(unknown)}")
    names = {f.name for f in fields(Config)} & allowed
    found = {}
    env_file = o.pop("env", None)
    for source in (os.environ if environ is None else environ, read_env_file(env_file) if env_file else {}):
        found |= {n: _convert(n, source[f"LOAMDEX_{n.upper()}"]) for n in names if f"LOAMDEX_{n.upper()}" in source}
    c = replace(Config(), **found, **{}) if not o else replace(Config(), **(found | {n: _convert(n, v) for n, v in o.items()}))
    if c.dense_only and c.sparse_only:
        raise ConfigError("dense_only and sparse_only exclude each other")
    return c


Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[float]]
EMBEDDERS: dict[str, Embedder] = {}
RERANKERS: dict[str, Reranker] = {}


def hash_embedder(texts: list[str], dim: int = 8) -> list[list[float]]:
    """A deterministic unit vector of each text, for tests and offline use."""
    import hashlib
    import math

    out = []
    for t in texts:
        raw = hashlib.sha256(t.encode()).digest()
        v = [int.from_bytes(raw[4 * i : 4 * i + 4], "big") / 2**31 - 1 for i in range(dim)]
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / size for x in v])
    return out


EMBEDDERS["hash"] = hash_embedder
