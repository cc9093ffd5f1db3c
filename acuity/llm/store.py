"""Derived tables that several jobs share: written once to the folder all executors reach, then read from there."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from acuity.sources.writers import materialize, remove, shared_folder

__all__ = ["new_path", "remove", "write"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame) -> DataFrame:
    """A lost executor loses nothing of the returned frame: its rows are files."""
    return materialize(df)
