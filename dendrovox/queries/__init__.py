"""Registered queries by family, each with its DuckDB counterpart."""
