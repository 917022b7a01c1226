"""Registry of every query the package exposes, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelkit import oracle as report_sql
from funnelkit.plans import operator_queries, reports
from funnelkit.sources import crm as crm_views

_REGISTRY = {**reports.REPORTS, **{name: fn for name, (fn, _) in operator_queries.OPERATORS.items()}}
_ORACLE = {**report_sql.QUERIES, **{name: sql for name, (_, sql) in operator_queries.OPERATORS.items()}}


def names() -> list[str]:
    return list(_REGISTRY)


def oracle() -> dict[str, str]:
    return dict(_ORACLE)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _REGISTRY[name](crm_views.load(spark, sf_dir))
