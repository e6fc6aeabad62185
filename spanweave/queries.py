"""Queries over the network operators, one for each operator, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_build, queries_graph, queries_reports

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (queries_graph, queries_build, queries_reports):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
