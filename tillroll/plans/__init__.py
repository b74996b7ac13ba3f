"""Plans: the staged pipeline, the query catalog and the DuckDB oracle."""
