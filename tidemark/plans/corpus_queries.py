"""Queries of the general corpus operators in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.instants import resolve_instants
from tidemark.plans.cut import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every publication time that denotes an instant, in microseconds UTC."""
    return resolve_instants(read(spark, sf_dir, "publication_times"), read(spark, sf_dir, "source_sites"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
