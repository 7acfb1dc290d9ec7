"""The registered queries, by area, each with its DuckDB twin where SQL can say it."""
