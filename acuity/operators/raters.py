"""Who rated what: sizes of the rating table."""

from pyspark.sql import DataFrame, functions as F


def rater_counts(ratings: DataFrame) -> DataFrame:
    """Ratings, distinct raters and median age per procedure; the median is null if any age is.

    One pass counts (procedure, rater) and (procedure, age) cells side by side.
    A missing rater is a cell of its own and so counts as one rater. A procedure
    with a third of all rows is reduced to its cells before anything is
    shuffled by procedure, and the median sees one entry per distinct age.
    """
    by_rater = ["booked_procedure", "procedural_consultant"]
    by_age = ["booked_procedure", "age"]
    cells = (ratings.select("booked_procedure", "procedural_consultant", "age")
             .groupingSets([by_rater, by_age], "booked_procedure", "procedural_consultant", "age")
             .agg(F.expr("count(*) as n"), F.expr("grouping(age) = 1 as _rater")))
    return cells.groupBy("booked_procedure").agg(
        F.expr("sum(if(_rater, n, 0)) as num_of_raters"),
        F.expr("count_if(_rater) as num_of_unique_raters"),
        F.expr("if(bool_or(not _rater and age is null), null, percentile(age, 0.5, n)) as age"),
    )


def rater_count_of_counts(raters: DataFrame) -> DataFrame:
    """How many procedures have a given number of distinct raters, most common number first."""
    return (raters.groupBy("num_of_unique_raters").agg(F.expr("count(*) as count_of_num_unique_raters"))
            .orderBy(F.desc("count_of_num_unique_raters"), "num_of_unique_raters"))


def distinct_sizes(ratings: DataFrame) -> DataFrame:
    """One row: distinct procedures, raters and studies; a missing value counts as one more.

    Rows become (kind, value) cells that are made distinct once, first in the
    task that reads them. Every kind is spread over its values, and the counts
    are three sums over the cells.
    """
    kinds = {"n_procedures": "booked_procedure", "n_raters": "procedural_consultant", "n_studies": "study_id"}
    places = ", ".join(f"struct('{kind}' as _kind, cast({column} as string) as _value)" for kind, column in kinds.items())
    cells = ratings.selectExpr(f"inline(array({places}))").distinct()
    return cells.agg(*[F.expr(f"count_if(_kind = '{kind}') as {kind}") for kind in kinds])


def model_eligibility(ratings: DataFrame, min_raters: int = 8, both_sexes: bool = True) -> DataFrame:
    """Procedures with enough ratings and, if asked, at least one male and one female patient.

    A procedure with a missing sex fails the sex test. Both tests come from one
    grouping instead of an intersection of two.
    """
    counted = ratings.groupBy("booked_procedure").agg(
        F.expr("count(*) as num_of_raters"),
        F.expr("if(count(sex) = count(*), count_if(sex = 'M'), null) as male_count"),
        F.expr("if(count(sex) = count(*), count_if(sex = 'F'), null) as female_count"),
    ).filter(f"num_of_raters >= {min_raters}")
    return counted.filter("male_count >= 1 and female_count >= 1") if both_sexes else counted
