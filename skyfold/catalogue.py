"""Every query of the sky-map engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from skyfold.fixtures import register, with_views

Query = Callable[[SparkSession, str], DataFrame]


@cache
def _texts() -> dict[str, tuple[str, str]]:
    from skyfold.plans import catalog, filtering, geometry, imaging

    found: dict[str, tuple[str, str]] = {}
    for module in (geometry, imaging, filtering, catalog):
        for name, text in module.sql().items():
            spark, duck = text if isinstance(text, tuple) else (text, text)
            found[name] = with_views(spark, "spark"), with_views(duck, "duckdb")
    return found


def _sql_query(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(text)

    return run


def queries() -> dict[str, Query]:
    from skyfold.plans import programs

    return {name: _sql_query(texts[0]) for name, texts in _texts().items()} | programs.queries()


def oracle_sql() -> dict[str, str]:
    from skyfold.plans import programs

    return {name: texts[1] for name, texts in _texts().items()} | programs.oracle_sql()
