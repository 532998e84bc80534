"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import contract


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(contract.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(contract.ORACLE)
