"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  ``QUERIES`` and
``ORACLES`` list what ``__spark_entry__`` registers.
"""


def registry():
    """All queries and oracle statements of the subpackage."""
    from eventlane.llm import queries

    return queries.QUERIES, queries.ORACLES
