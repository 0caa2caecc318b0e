"""Date words of the filter language, resolved once when a query is planned."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from loamdex.errors import QueryError

_WORD = re.compile(r"(today|now|yesterday|tomorrow)(?:([+-])(\d+)([smhdw]))?", re.I)
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}

Clock = Callable[[], dt.datetime]


def local_clock() -> dt.datetime:
    return dt.datetime.now().astimezone()


def is_date_word(word: str) -> bool:
    return _WORD.fullmatch(word) is not None


def resolve(word: str, clock: Clock = local_clock) -> dt.date | dt.datetime:
    """today, yesterday and tomorrow are local dates, now a time with zone; an offset in s, m or h makes a date a time from midnight UTC."""
    m = _WORD.fullmatch(word)
    if not m:
        raise QueryError(f"not a date word: {word}")
    name, sign, n, unit = m[1].lower(), m[2], m[3], (m[4] or "").lower()
    now = clock()
    v: dt.date | dt.datetime = now if name == "now" else now.date() + dt.timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[name])
    if not n:
        return v
    step = dt.timedelta(**{_UNITS[unit]: int(n)}) * (-1 if sign == "-" else 1)
    if unit in "smh" and not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day, tzinfo=dt.timezone.utc)
    return v + step
