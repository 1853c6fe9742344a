"""Queries over the project's tables: each module has QUERIES (name -> callable) and SQL (name -> DuckDB text)."""

MODULES = ("search", "chunking", "catalogue", "web", "pipeline", "evaluation", "texts", "maintenance", "problems")
