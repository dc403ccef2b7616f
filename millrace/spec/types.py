"""Declared data types."""

from __future__ import annotations

import re
from dataclasses import dataclass

_FORM = re.compile(r"\s*([A-Za-z_][A-Za-z_0-9]*)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*")
# Type names.
_TEXT = {"string", "text", "varchar", "char", "character"}
_PLAIN = {"integer": "bigint", "int": "bigint", "bigint": "bigint", "smallint": "smallint", "float": "double", "double": "double", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp_ntz": "timestamp_ntz"}
_INSTANT = {"timestamp", "datetime", "timestamp_tz", "timestamp_ltz", "timestamptz"}


class TypeError_(ValueError):
    """A data_type that is not supported."""


@dataclass(frozen=True)
class SqlType:
    """A declared type: its text, a family, the Spark type, the length of sized strings."""

    text: str
    base: str
    spark: str
    length: int | None = None


def parse_type(text: str) -> SqlType:
    m = _FORM.fullmatch(text or "")
    if not m:
        raise TypeError_(f"unsupported data_type `{text}`")
    name, p, s = m[1].lower(), m[2] and int(m[2]), m[3] and int(m[3])
    if name in _TEXT and s is None and p != 0 and not (name == "text" and p):
        return SqlType(text, "string", "string", p)
    if name in ("decimal", "numeric", "number") and p and 1 <= p <= 38 and (s or 0) <= p:
        return SqlType(text, "decimal", f"decimal({p},{s or 0})")
    if p is None and name in _PLAIN:
        return SqlType(text, "date" if name == "date" else "timestamp" if name == "timestamp_ntz" else "plain", _PLAIN[name])
    if p is None and name in _INSTANT:
        return SqlType(text, "timestamp", "timestamp")
    raise TypeError_(f"unsupported data_type `{text}`")
