"""Correctness oracle: DuckDB SQL for every registered query."""
