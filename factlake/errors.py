"""What the store raises; failures of files and jobs come as OSError and Spark's own exceptions."""

from __future__ import annotations


class Corrupt(ValueError):
    """Stored bytes that don't have their layout."""


class Closed(RuntimeError):
    """A write to a log that was closed."""


class Denied(PermissionError):
    """Rules or a budget forbid what was asked."""
