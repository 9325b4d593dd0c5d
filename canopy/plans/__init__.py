"""Composite jobs and the query catalogue (queries + DuckDB oracles)."""
