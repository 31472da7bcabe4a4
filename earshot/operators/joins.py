"""Joins on columns that may be NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` in which NULL equals NULL, by plain equality of one struct (so it stays a hash or
    merge join). ``how``: inner, left, left_semi or left_anti."""
    if not on:
        raise ValueError("columns to join on are needed")
    key = "__match"
    slim = right.select(F.struct(*on).alias(key), *[c for c in right.columns if c not in on])
    return left.withColumn(key, F.struct(*on)).join(slim, key, how).drop(key)
