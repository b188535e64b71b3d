"""The registered queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptlake.plans import queries_decide, queries_jobs, queries_policy, queries_store, queries_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**queries_text.QUERIES, **queries_decide.QUERIES, **queries_store.QUERIES, **queries_policy.QUERIES, **queries_jobs.QUERIES}
ORACLE_SQL: dict[str, str] = {**queries_text.ORACLE_SQL, **queries_decide.ORACLE_SQL, **queries_store.ORACLE_SQL, **queries_policy.ORACLE_SQL, **queries_jobs.ORACLE_SQL}
