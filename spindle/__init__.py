"""Spark-native reconciliation of keyed datasets.

diff() compares two sources of JSON records; spindle.operators.frames does the same for DataFrames of typed columns.
"""

from __future__ import annotations

from importlib import import_module

_RESULT = ("DiffResult", "diff")
_MODEL = (
    "Change", "ChangeOperation", "ConfigurationError", "DiffConfig", "Duplicate", "DuplicateKeyError", "DuplicatePolicy", "FieldChange", "FieldOperation", "FieldSummary", "InputError",
    "MissingKeyPolicy", "ReconcileError", "ResourceError", "SchemaChange", "SchemaChangeOperation", "SchemaFieldProfile", "SchemaSummary", "SourceLocation", "Summary",
)
__all__ = [*_RESULT, *_MODEL]


def __getattr__(name: str):
    """Names load when they are asked for: a Python worker that imports one operator needs no more than that."""
    if name not in __all__:
        raise AttributeError(name)
    return getattr(import_module("spindle.result" if name in _RESULT else "spindle.model"), name)
