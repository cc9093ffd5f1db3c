"""Frequency tables."""

from pyspark.sql import DataFrame, functions as F

from acuity.functions.scalars import percent


def freq_table(df: DataFrame, *columns: str, digits: int | None = 1, weight: str | None = None) -> DataFrame:
    """Counts ``n`` and percent ``prop`` of one or more variables; rows with a null are left out.

    With more than one variable the percent is within all but the last one.
    Rows are counted before the total is taken, so the total sees one row per
    combination of categories, and the input is read once. ``weight`` names a
    column with the number of rows that a row stands for.
    """
    counts = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.expr(f"{f'sum({weight})' if weight else 'count(*)'} as n"))
    if len(columns) > 1:
        whole = F.expr(f"sum(n) over (partition by {', '.join(columns[:-1])})")
    else:
        whole = counts.agg(F.expr("sum(n)")).scalar()  # over the same grouping, whose shuffle is reused
    return counts.withColumn("_total", whole).selectExpr(*columns, "n", f"{percent('n', '_total', digits)} as prop")


def most_frequent_first(freq: DataFrame) -> DataFrame:
    return freq.orderBy(F.expr("prop").desc_nulls_last(), F.expr("n").desc(), *freq.columns[:-2])
