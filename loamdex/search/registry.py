"""Search as a stage of a query, and as a ranked list."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from loamdex.errors import BackendKindError
from loamdex.search.backends import backend, is_indexed

if TYPE_CHECKING:
    from loamdex.workspace import Workspace


def search(ws: Workspace, text: str, *, k: int | None = 10, index: str = "grep", location: str | None = None, options: dict | None = None) -> DataFrame:
    """The ``k`` best hits (packet_id, score, snippet), best first; all with ``k`` None."""
    b = backend(index)
    if not is_indexed(b):
        if location is not None:
            raise BackendKindError(f"{index} searches the packets and has no location")
        return b.query(text, ws, k=k, options=options)
    return b.query(text, location or b.default_location(ws), k=k, options=options)


def search_all(ws: Workspace, text: str, *, index: str = "grep", location: str | None = None, options: dict | None = None) -> DataFrame:
    """Every hit, for use as a filter."""
    return search(ws, text, k=None, index=index, location=location, options=options)


def build(ws: Workspace, packets: DataFrame, *, index: str, location: str | None = None, options: dict | None = None):
    b = backend(index)
    if not is_indexed(b):
        raise BackendKindError(f"{index} has no index to build")
    return b.build(ws, packets, location or b.default_location(ws), options=options)
