"""Queries on the test tables, each with DuckDB SQL for the same rows."""
