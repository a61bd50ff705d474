"""128-bit keys as 32 lower-case hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_key(text: Column) -> Column:
    """Hex digits, at most 32, padded with zeros on the right; null if it isn't a key."""
    t = F.lower(text)
    return F.when(t.rlike("^[0-9a-f]{0,32}$"), F.rpad(t, 32, "0"))


def key_bytes(key: Column) -> Column:
    """The 16 bytes of exactly 32 hex digits of either case, else null."""
    return F.when(key.rlike("^[0-9a-fA-F]{32}$"), F.unhex(key))


def key_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def key_order(key: Column) -> Column:
    """Sorts keys as little-endian 128-bit numbers: the last byte counts most."""
    return F.concat(*[F.substring(key, i, 2) for i in range(31, 0, -2)])
