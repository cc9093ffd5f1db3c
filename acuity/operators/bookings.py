"""Preparation of raw bookings."""

from pyspark.sql import DataFrame, Window, functions as F

from acuity import schema as S
from acuity.functions.scalars import booking_period, collapse_priority, hours_between, rater_pseudonym

ADMISSION = ["study_id", "age", "admit_dt_tm"]
TIE_KEYS = ["episode_number", "booked_procedure", "coded_primary_procedure", "procedural_consultant"]


def with_booking_period(study: DataFrame) -> DataFrame:
    hours = study.withColumn("_hours", F.expr(hours_between("emerg_book_dt_tm", "admit_dt_tm")))
    return hours.withColumn("admit_to_book_pd", F.expr(booking_period("_hours"))).drop("_hours")


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of every key group. Null keys form a group of their own.

    ``row_number() = 1`` is limited to one row per group and task before the
    shuffle, so a very frequent key moves no more rows than any other.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_case_per_admission(study: DataFrame, tie_keys: list[str] | None = None) -> DataFrame:
    """Earliest case of an admission; a missing date comes last, ties go by ``tie_keys``."""
    ties = [c for c in (tie_keys or TIE_KEYS) if c in study.columns]
    return first_row(study, ADMISSION, [F.asc_nulls_last("case_date"), *ties])


def prepare_bookings(study: DataFrame, tie_keys: list[str] | None = None,
                     priorities: dict[str, list[str]] = S.PRIORITY_LEVELS) -> DataFrame:
    """Same-day first cases with a collapsed priority and a pseudonymous rater."""
    same_day = with_booking_period(study).filter(f"admit_to_book_pd = '{S.SAME_DAY}'")
    return first_case_per_admission(same_day, tie_keys).withColumns({
        "emerg_priority_collapse": F.expr(collapse_priority("emerg_priority", priorities)),
        "procedural_consultant": F.expr(rater_pseudonym("procedural_consultant")),
    })
