"""Columns that are computed once a row, whatever filters and expressions use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, made by a generator of one row.

    The optimizer puts a projected expression into each filter and expression above that names it, so classifications
    that build on each other would be evaluated, and compiled, many times over. It moves nothing into a generator; filters on
    other columns still reach the scan.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_once")
    return df.select(*kept, made).select(*kept, *[F.col(f"_once.{k}").alias(k) for k in columns])
