"""Who is in the study: one row per study, profiles and specialties."""

from pyspark.sql import DataFrame, functions as F

from acuity.functions.scalars import specialty_group
from acuity.operators.frequency import freq_table, most_frequent_first

COLUMNS = ["study_id", "age", "trauma", "sex", "asa", "specialty", "emerg_priority_collapse"]


def studies(rows: DataFrame, order: list[str], in_cohort: str, is_trauma: str) -> DataFrame:
    """One row per study: its first row in ``order`` with ``in_cohort`` and ``any_trauma`` of the whole study.

    ``in_cohort`` and ``is_trauma`` are SQL conditions on a row; a study counts
    if any of its rows does. One grouping, combined before the shuffle, takes
    the first row and both flags together; a missing study id is one study.
    """
    columns = [c for c in dict.fromkeys(["booked_procedure", *COLUMNS]) if c not in ("study_id", "trauma")]
    keys = ", ".join(f"{c} is null, {c}" for c in order)
    first = f"min(struct({keys}, struct({', '.join(columns)}) as _row))._row as _first"
    grouped = rows.groupBy("study_id").agg(
        F.expr(first), F.expr(f"bool_or(coalesce({in_cohort}, false)) as in_cohort"),
        F.expr(f"bool_or(coalesce({is_trauma}, false)) as any_trauma"))
    return grouped.select("study_id", "_first.*", "in_cohort", "any_trauma")


def flag_shared_procedure(frame: DataFrame) -> DataFrame:
    """``trauma`` is true if the booked procedure was also booked in a trauma study of the frame."""
    shared = frame.groupBy(F.col("booked_procedure").alias("_key")).agg(F.expr("bool_or(any_trauma) as trauma"))
    return frame.join(shared, frame["booked_procedure"].eqNullSafe(F.col("_key"))).drop("_key")


def demographics(rows: DataFrame, order: list[str], in_cohort: str, is_trauma: str, cohort: bool = False) -> DataFrame:
    """Studies outside the cohort, or with ``cohort`` those inside, one row each, with the shared-procedure flag."""
    frame = studies(rows, order, in_cohort, is_trauma).filter("in_cohort" if cohort else "not in_cohort")
    return flag_shared_procedure(frame).select(COLUMNS)


def demographic_freqs(studies: DataFrame, variables: list[str]) -> DataFrame:
    """One-way frequency tables of several variables, stacked by ``variable``.

    The variables are unpivoted, so one pass counts them all; percents are
    within the variable and leave out missing values.
    """
    long = studies.selectExpr(*[f"cast({v} as string) as {v}" for v in variables]).unpivot([], variables, "variable", "value")
    return freq_table(long, "variable", "value")


def specialty_freq(studies: DataFrame) -> DataFrame:
    return most_frequent_first(freq_table(studies.selectExpr(f"{specialty_group('specialty')} as specialty"), "specialty"))


def urgent_specialty_freq(ratings: DataFrame, urgent: DataFrame) -> DataFrame:
    """Specialties of the urgent procedures; a procedure counts once per original specialty name."""
    pairs = ratings.select("booked_procedure", "specialty").distinct()
    keys = urgent.selectExpr("achi_code as booked_procedure")
    return specialty_freq(pairs.join(keys, "booked_procedure", "left_semi"))
