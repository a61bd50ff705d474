"""Operators on trails."""

from eventlane.operators.index import PageIndex
from eventlane.operators.merge import append, merge, multi_merge
from eventlane.operators.trails import TrailFrame

__all__ = ["PageIndex", "TrailFrame", "append", "merge", "multi_merge"]
