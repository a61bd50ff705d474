"""Columns of a trail table, and the rules for field names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from eventlane.errors import DuplicateFields, InvalidFieldName, TooManyFields, UnknownField

#: Fixed limits of the data model.
MAX_FIELDS = 16382
MAX_NAME = 512
TIME_LIMIT = (1 << 47) - 1
_NAME = re.compile(r"[_\-%a-zA-Z0-9]+")


def check_fields(names) -> tuple[str, ...]:
    """Field names as a tuple; duplicates are told before invalid names."""
    names = tuple(names)
    if len(names) > MAX_FIELDS:
        raise TooManyFields(str(len(names)))
    if len(set(names)) < len(names):
        raise DuplicateFields(", ".join(sorted({n for n in names if names.count(n) > 1})))
    for n in names:
        if not _NAME.fullmatch(n) or len(n) >= MAX_NAME or n == "time":
            raise InvalidFieldName(repr(n))
    return names


@dataclass(frozen=True)
class TrailSchema:
    """``key``, ``time`` and ``seq`` name columns; ``fields`` are the value columns in order."""

    fields: tuple[str, ...]
    key: str = "trail_key"
    time: str = "time"
    seq: str = "seq"

    def __post_init__(self):
        object.__setattr__(self, "fields", check_fields(self.fields))

    @property
    def columns(self) -> list[str]:
        return [self.key, self.time, self.seq, *self.fields]

    @property
    def num_fields(self) -> int:
        """User fields and time."""
        return len(self.fields) + 1

    def field_id(self, name: str) -> int:
        if name == "time":
            return 0
        if name not in self.fields:
            raise UnknownField(name)
        return self.fields.index(name) + 1

    def field_name(self, number: int) -> str | None:
        if number == 0:
            return "time"
        return self.fields[number - 1] if 0 < number <= len(self.fields) else None
