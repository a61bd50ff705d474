"""Errors.  Each class has the ``code`` that callers may compare."""

from __future__ import annotations


class LaneError(Exception):
    code = "UNKNOWN"

    def __init__(self, message: str = ""):
        super().__init__(f"{self.code}: {message}" if message else self.code)


def _kind(name: str, code: str) -> type[LaneError]:
    return type(name, (LaneError,), {"code": code, "__doc__": code.replace("_", " ").lower()})


InvalidFieldName = _kind("InvalidFieldName", "INVALID_FIELDNAME")
DuplicateFields = _kind("DuplicateFields", "DUPLICATE_FIELDS")
TooManyFields = _kind("TooManyFields", "TOO_MANY_FIELDS")
UnknownField = _kind("UnknownField", "UNKNOWN_FIELD")
UnknownKey = _kind("UnknownKey", "UNKNOWN_UUID")
InvalidKey = _kind("InvalidKey", "INVALID_UUID")
InvalidTrailId = _kind("InvalidTrailId", "INVALID_TRAIL_ID")
InvalidRange = _kind("InvalidRange", "INVALID_RANGE")
InvalidOption = _kind("InvalidOption", "UNKNOWN_OPTION")
InvalidOptionValue = _kind("InvalidOptionValue", "INVALID_OPTION_VALUE")
NoSuchItem = _kind("NoSuchItem", "NO_SUCH_ITEM")
IncorrectTermType = _kind("IncorrectTermType", "INCORRECT_TERM_TYPE")
FieldsMismatch = _kind("FieldsMismatch", "APPEND_FIELDS_MISMATCH")
TimestampTooLarge = _kind("TimestampTooLarge", "TIMESTAMP_TOO_LARGE")
DiffWithFilter = _kind("DiffWithFilter", "ONLY_DIFF_FILTER")
OutputExists = _kind("OutputExists", "OUTPUT_EXISTS")
NotFound = _kind("NotFound", "IO_OPEN")
VersionMismatch = _kind("VersionMismatch", "INCOMPATIBLE_VERSION")
InvalidIndex = _kind("InvalidIndex", "INVALID_INDEX")
BadFilter = _kind("BadFilter", "BAD_FILTER")
BadInput = _kind("BadInput", "BAD_INPUT")
HandleClosed = _kind("HandleClosed", "HANDLE_IS_NULL")


def message(error: object) -> str:
    """Name of an error class, instance or code; anything else is unknown."""
    code = getattr(error, "code", error)
    known = {c.code for c in LaneError.__subclasses__()}
    return code if isinstance(code, str) and code in known else "Unknown error"
