"""Named queries over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import calls, checks, costs, exams, feeds, pages, planning, reviews, search, star, study, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for part in (calls, checks, costs, exams, feeds, pages, planning, reviews, search, star, study, texts):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
