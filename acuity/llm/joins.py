"""Joins of rows with a grouping of the same rows."""

from pyspark.sql import DataFrame, functions as F


def join_grouped(rows: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a table that is grouped by ``keys`` (numbers or strings without nulls).

    A grouping is already dealt out by its keys, so Spark would join in the
    tasks of the grouping, where a very frequent key cannot be split. The keys
    of the grouped side, one row each, are therefore computed anew: Spark deals
    out both sides for the join and splits a frequent key over several tasks.
    """
    kinds = dict(grouped.dtypes)
    fresh = [(F.concat(F.col(k), F.lit("")) if kinds[k] == "string" else F.col(k).bitwiseXOR(F.lit(0).cast(kinds[k]))).alias(f"_on_{k}")
             for k in keys]
    other = grouped.select(*fresh, *[c for c in grouped.columns if c not in keys])
    on = [F.col(k) == F.col(f"_on_{k}") for k in keys]
    return rows.join(other, on).drop(*[f"_on_{k}" for k in keys])
