"""Queries by name, with DuckDB SQL for those that SQL can express."""
