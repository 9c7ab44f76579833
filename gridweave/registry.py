"""Queries of the library and DuckDB SQL for them, by name."""

from gridweave.plans import dislocation_queries, model_queries, panel_queries, regime_queries

MODULES = (panel_queries, dislocation_queries, model_queries, regime_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
