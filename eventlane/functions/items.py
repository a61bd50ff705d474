"""Items: a field number and a value number in one 64-bit integer.

Fixed layout: narrow items have 7 bits of field, a zero bit and 24 bits of
value; wide items 7 bits, a one bit, 7 more bits of field, a zero bit, 40 bits
of value and 8 unused bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NARROW_FIELD, _NARROW_VALUE = 1 << 7, 1 << 24


def pack_item(field: Column, value: Column) -> Column:
    f, v = field.cast("long"), value.cast("long")
    narrow = F.shiftleft(v, 8).bitwiseOR(f)
    wide = f.bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128)).bitwiseOR(F.shiftleft(F.shiftright(f, 7), 8)).bitwiseOR(F.shiftleft(v, 16))
    return F.when((f < _NARROW_FIELD) & (v < _NARROW_VALUE), narrow).otherwise(wide)


def is_narrow(item: Column) -> Column:
    return item.bitwiseAND(F.lit(128)) == 0


def item_field(item: Column) -> Column:
    low = item.bitwiseAND(F.lit(127))
    return F.when(is_narrow(item), low).otherwise(low.bitwiseOR(F.shiftleft(F.shiftright(item, 8).bitwiseAND(F.lit(127)), 7)))


def item_value(item: Column) -> Column:
    return F.when(is_narrow(item), F.shiftright(item, 8)).otherwise(F.shiftright(item, 16).bitwiseAND(F.lit((1 << 40) - 1)))
