"""All queries of the engine's own operators, with the SQL that checks them."""

from __future__ import annotations

from . import guard_plans, map_plans, stream_plans, text_plans

QUERIES: dict = {}
ORACLES: dict = {}
for _plans in (text_plans, map_plans, guard_plans, stream_plans):
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
