"""Registered queries over the driver's tables and their DuckDB oracle SQL."""
