"""All registered queries of the library and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wxspark.plans import amendments, climo, documents, forecasts, grids, metars, more, readers, reports, revisions, scores, temporal, writes

_MODULES = (amendments, climo, documents, forecasts, grids, metars, more, readers, reports, revisions, scores, temporal, writes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
