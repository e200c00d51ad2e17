"""The engine's own queries and their SQL counterparts, collected from the plan modules."""

from __future__ import annotations

from quillon.plans import choice_plans, corpus_plans, event_plans, stat_plans, stream_plans, text_plans, trap_plans

_PLANS = (text_plans, corpus_plans, stat_plans, choice_plans, event_plans, stream_plans, trap_plans)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
