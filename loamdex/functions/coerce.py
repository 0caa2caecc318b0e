"""Text from a command line to values."""

from __future__ import annotations

import datetime as dt
import re

from loamdex.errors import EditError


def coerce(text: str):
    """Quoted text stays text; true, false, null, none, plain decimal numbers and ISO dates become what they look like.

    A sign ``+``, an exponent or a bare point is no plain number: telephone numbers and the like stay text.
    """
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none"):
        return None
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError as e:
            raise EditError(f"not a date: {text}") from e
    return text


def assignment(text: str) -> tuple[str, object]:
    name, sign, value = text.partition("=")
    if not sign or not name:
        raise EditError(f"expected FIELD=VALUE, got {text!r}")
    return name, coerce(value)


def read_env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines, with an optional ``export``, comments and quotes."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip().removeprefix("export ").strip()
            key, sign, value = line.partition("=")
            if sign and not line.startswith("#"):
                value = value.strip()
                out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out
