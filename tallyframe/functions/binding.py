"""Naming a value inside an expression or a row, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed here and not again."""
    return df.withColumn("_held", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))).select(*df.columns, "_held.*")
