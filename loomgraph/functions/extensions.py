"""Registering own functions: keys, comparators and policies as Column builders; reducers as aggregates; tools as table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN_FUNCTIONS: dict[str, Callable[..., Column]] = {}
NODE_FUNCTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def column_function(name: str):
    """Keep a Column builder under a name; it stays in the JVM plan."""

    def keep(f: Callable[..., Column]) -> Callable[..., Column]:
        COLUMN_FUNCTIONS[name] = f
        return f

    return keep


def node_function(name: str):
    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        NODE_FUNCTIONS[name] = f
        return f

    return keep


def vectorised(f: Callable, returns: str):
    """A pandas function over Series as a Column function: the escape hatch where no expression will do."""
    return F.pandas_udf(f, returns)


def table_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A SQL table function, inlined by the planner."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({returns}) RETURN {body}")
