"""End-to-end stages and the registered queries (each with a DuckDB oracle)."""
