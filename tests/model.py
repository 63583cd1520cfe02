"""A plain-Python model of the versioned store, written apart from the engine."""

from __future__ import annotations


class Model:
    """Writes with idempotency keys; reads as of a sequence."""

    def __init__(self):
        self.log, self.seen = [], {}

    def write(self, sid, pred, op, val, idem):
        if idem in self.seen:
            return self.seen[idem]
        seq = len(self.log) + 1
        self.log.append((seq, sid, pred, op, val, idem))
        self.seen[idem] = seq
        return seq

    def get(self, sid, pred, snapshot):
        for seq, s, p, op, val, _ in reversed(self.log):
            if (s, p) == (sid, pred) and seq <= snapshot:
                return val if op == 0 else None
        return None

    def live(self, snapshot):
        keys = {(s, p) for _, s, p, *_ in self.log}
        return {(s, p): v for s, p in keys if (v := self.get(s, p, snapshot)) is not None}
