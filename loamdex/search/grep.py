"""Search of bodies and heads for a text or a regular expression; one pass over the packets, no index."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.expr import matches
from loamdex.search.backends import HITS, BackendInfo

if TYPE_CHECKING:
    from loamdex.workspace import Workspace


class Grep:
    name = "grep"

    def query(self, text: str, ws: Workspace, *, k: int | None = 10, options: dict | None = None) -> DataFrame:
        """Hits in id order with score 1.0; options ``regex`` and ``case_sensitive``."""
        o = dict(options or {})
        regex, exact = bool(o.pop("regex", False)), bool(o.pop("case_sensitive", False))
        if o:
            raise ValueError(f"unknown options: {', '.join(sorted(o))}")
        if regex:
            try:
                re.compile(text)
            except re.error as e:
                raise ValueError(f"bad pattern {text!r}: {e}") from e
        if not text or (k is not None and k <= 0):
            return ws.spark.createDataFrame([], HITS)

        def found(c):
            if regex:
                return matches(c, text if exact else f"(?i){text}")
            return c.contains(text) if exact else F.lower(c).contains(text.lower())

        if ws.dynamic:
            head = F.array_join(F.transform(F.map_entries("fm"), lambda e: F.concat_ws(": ", e["key"], F.coalesce(e["value"]["s"], e["value"]["j"]))), "\n")
        else:
            own = [c for c, t in ws.packets.dtypes if c not in ("packet_id", ws.body)]
            head = F.concat_ws("\n", *[F.concat_ws(": ", F.lit(c), F.col(f"`{c}`").cast("string")) for c in own]) if own else F.lit("")
        hit = F.coalesce(found(ws.body_column()), F.lit(False)) | F.coalesce(found(head), F.lit(False))
        hits = ws.packets.filter(hit).select("packet_id", F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("snippet"))
        return hits if k is None else hits.orderBy("packet_id").limit(k)

    def info(self, location: str | None = None) -> BackendInfo:
        return BackendInfo(self.name, "1", "scan")
