"""Deterministic keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name space of surrogate keys.
SURROGATE_NAMESPACE = "5aa788a5-783e-5ce6-b4aa-438de8fc6971"


def joined(columns: list[Column]) -> Column:
    """Values as text with | between them; null counts as empty."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def hash_key(columns: list[Column]) -> Column:
    """SHA-256 of the joined values, in hexadecimal digits."""
    return F.sha2(joined(columns), 256)


def packed(columns: list[Column]) -> Column:
    """A short stand-in for hash_key within a load, equal where that is equal: joined values of up to 31 bytes as they are, the 32
    bytes of the SHA-256 of longer ones."""
    text = F.encode(joined(columns), "utf-8")
    return F.when(F.length(text) < 32, text).otherwise(F.unhex(F.sha2(text, 256)))


def packed_as(stored: Column, columns: list[Column]) -> Column:
    """The stand-in for a stored hash; one that was made from other columns keeps its own bytes."""
    return F.when(stored == hash_key(columns), packed(columns)).otherwise(F.unhex(stored))


def unpacked(x: Column) -> Column:
    """The hash that a stand-in is for."""
    return F.when(F.length(x) == 32, F.lower(F.hex(x))).otherwise(F.sha2(x, 256))


def uuid5(name: Column, namespace: str = SURROGATE_NAMESPACE) -> Column:
    """The version 5 UUID of a name, by built-in functions."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
    return F.concat_ws("-", *parts)
