"""Sort keys over fields of mixed type, as Spark sort columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.expr import DynamicField, StaticField
from loamdex.session import checkpointed


@dataclass(frozen=True)
class OrderKey:
    field: str
    desc: bool = False
    nulls: str = "auto"

    def __post_init__(self):
        if self.nulls not in ("auto", "first", "last"):
            raise ValueError(f"nulls must be auto, first or last, not {self.nulls}")

    @property
    def nulls_first(self) -> bool:
        return self.desc if self.nulls == "auto" else self.nulls == "first"


def rank_columns(field: StaticField | DynamicField) -> tuple[Column, list[Column]]:
    """Whether a value counts as null, and columns that order values: bools, numbers, dates, text, then the rest."""
    if isinstance(field, StaticField):
        c = field.scalar()
        if field.kind in ("list", "map"):
            c = F.to_json(c) if field.column is not None else c
        return c.isNull(), [c]
    v = field.v
    t = v["t"]
    rank = F.when(t == "bool", 1).when(t.isin("int", "float"), 2).when(t.isin("date", "datetime"), 3).when(t == "str", 4).otherwise(9)
    number = F.coalesce(field.number_of(v), v["b"].cast("double"))
    stamp = F.coalesce(v["d"].cast("string"), F.date_format(v["tn"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(v["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    return F.coalesce(t == "null", F.lit(True)), [rank, number, F.coalesce(stamp, v["s"], F.when(rank == 9, v["j"]))]


def sort_columns(keys: list[OrderKey], bind, last: Column) -> list[Column]:
    """Columns for ``orderBy``: each key with its nulls placed explicitly, ties by ``last``."""
    out = []
    for k in keys:
        null, values = rank_columns(bind(k.field))
        out.append(null.desc() if k.nulls_first else null.asc())
        out += [v.desc_nulls_last() if k.desc else v.asc_nulls_last() for v in values]
    return [*out, last.asc()]


def places(ordered: DataFrame, id: str = "packet_id") -> DataFrame:
    """(id, r): the place of every row of a sorted table, from 1: its number inside its range partition, after all rows of those before.

    The numbered rows are checkpointed, so that ranges sampled again can't move a row; one count a partition is collected.
    """
    n = F.monotonically_increasing_id()
    rows = checkpointed(ordered.select(id, F.shiftright(n, 33).alias("part"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, offsets = 0, []
    for part, count in sorted(map(tuple, rows.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += count
    first = ordered.sparkSession.createDataFrame(offsets, "part long, first long")
    return rows.join(F.broadcast(first), "part").select(id, (F.col("first") + F.col("at") + 1).alias("r"))
