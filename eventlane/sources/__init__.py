"""Reading and writing: delimited text, JSON lines, and the Parquet store."""

from eventlane.sources.store import open_frame, write_frame
from eventlane.sources.text import dump_csv, dump_json, field_map, read_csv, read_json

__all__ = ["dump_csv", "dump_json", "field_map", "open_frame", "read_csv", "read_json", "write_frame"]
