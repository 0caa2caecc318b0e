"""What a search backend is, and the registry of those there are."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import TYPE_CHECKING, Protocol, runtime_checkable

from pyspark.sql import DataFrame

from loamdex.errors import BackendNotFound

if TYPE_CHECKING:
    from loamdex.workspace import Workspace

HITS = "packet_id string, score double, snippet string"
GROUP = "loamdex.search_index"


@dataclass(frozen=True)
class IndexStats:
    packets_indexed: int
    packets_skipped: int
    packets_removed: int
    elapsed_seconds: float


@dataclass(frozen=True)
class BackendInfo:
    name: str
    version: str
    kind: str
    metadata: dict = field(default_factory=dict)


@runtime_checkable
class ScanSearch(Protocol):
    """Searches the packets themselves."""

    name: str

    def query(self, text: str, ws: Workspace, *, k: int | None = 10, options: dict | None = None) -> DataFrame: ...

    def info(self) -> BackendInfo: ...


@runtime_checkable
class IndexedSearch(Protocol):
    """Builds an index at a location and searches there."""

    name: str

    def default_location(self, ws: Workspace) -> str: ...

    def build(self, ws: Workspace, packets: DataFrame, location: str, *, options: dict | None = None) -> IndexStats: ...

    def query(self, text: str, location: str, *, k: int | None = 10, options: dict | None = None) -> DataFrame: ...

    def info(self, location: str | None = None) -> BackendInfo: ...


_cache: dict[str, object] = {}


def _built_in() -> dict[str, type]:
    from loamdex.search.grep import Grep
    from loamdex.search.hybrid import Hybrid

    return {"grep": Grep, "hybrid": Hybrid}


def discover() -> dict[str, object]:
    """All backends by name; one that can't be loaded is reported in one line."""
    if not _cache:
        _cache.update({n: c() for n, c in _built_in().items()})
        for e in entry_points(group=GROUP):
            try:
                _cache[e.name] = e.load()()
            except Exception as x:  # a plugin may fail in any way
                print(f"search backend {e.name}: {x}", file=sys.stderr)
    return _cache


def register(backend) -> None:
    discover()[backend.name] = backend


def clear() -> None:
    _cache.clear()


def backend(name: str):
    try:
        return discover()[name]
    except KeyError:
        raise BackendNotFound(f"no search backend {name!r}; there are {', '.join(sorted(discover()))}") from None


def is_indexed(b) -> bool:
    return hasattr(b, "build")
