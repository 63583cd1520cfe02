"""Columns of the log and of what is derived from it.

A fact is a version of (sid, pred): a value or a tombstone with a confidence, an opaque valid time
and a commit sequence. ``seq`` is the transaction time; 0 means before any write.
"""

from __future__ import annotations

PUT, DELETE = 0, 1

RULES = "rule_id bigint, agent bigint, action string, effect string, match_kind string, match_value bigint"

READ, WRITE, REMOVE = "read", "write", "delete"
ALLOW, DENY, MASK = "allow", "deny", "mask"
