"""Registry of named queries: each key has a Spark builder and (when SQL can say it)
an equivalent DuckDB oracle over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from missive.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the derived inputs are UTC wall-clock times: the session must read them so
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_views(sql, *views)
        return fn
    return deco


# Trim of Unicode white space in DuckDB (RE2); mirrors missive.functions.text.utrim.
WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def sql_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def load_all() -> None:
    """Import every plan module so its queries register."""
    from missive.plans import (validation, listing, joins, metrics, windows,  # noqa: F401
                               transitions, limits, audits, streams, dispatch, sources, api, exposition)
