"""Compositions of operators: decisions, scoring runs and the query catalogue."""
