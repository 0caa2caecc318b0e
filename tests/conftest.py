import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loamdex.session import ensure_checkpoint, get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ensure_checkpoint(s)
    return s


def workspace(spark, records, **options):
    from loamdex.sources.frontmatter import from_records
    from loamdex.workspace import Workspace

    return Workspace(from_records(spark, records).drop("error"), dynamic=True, **options)


@pytest.fixture(scope="session")
def yard(spark):
    """Boats of a yard, one with a crew that isn't a number, what they need from the stores, and a log without a head."""
    from loamdex.operators.graph import FieldResolver

    records = {
        "boats/ark.md": ({"key": "ark", "kind": "boat", "built": 1901, "crew": "many", "moored": "south", "needs": "rope"}, "Leaks."),
        "boats/heron.md": ({"key": "heron", "kind": "boat", "built": 1962, "crew": 4, "moored": "north", "checked": dt.date(2025, 3, 1), "needs": ["rope", "tar"], "marks": ["red", "old"]}, "Sound."),
        "boats/otter.md": ({"key": "otter", "kind": "boat", "built": 1988, "crew": 2, "moored": "south", "checked": dt.date(2025, 6, 9), "marks": ["blue"]}, "Fast."),
        "stores/rope.md": ({"key": "rope", "kind": "store", "amount": 7.5, "needs": "tar"}, ""),
        "stores/tar.md": ({"key": "tar", "kind": "store", "amount": 2}, ""),
        "log.md": ({}, "Quiet night."),
    }
    return workspace(spark, records, default_resolver=FieldResolver("key"))
