"""The registered queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from .plans import basic, keyed, streams, windows

QUERIES: dict = {}
ORACLES: dict = {}
for plan in (windows, basic, keyed, streams):
    QUERIES |= plan.QUERIES
    ORACLES |= plan.ORACLES
