"""Input of the regression models."""

from itertools import product

from pyspark.sql import DataFrame, functions as F

from acuity import schema as S
from acuity.functions.scalars import age_group, urgent_outcome
from acuity.operators.raters import model_eligibility

# Levels in model order: the first of each is the base level.
SEXES = ["F", "M"]
MODEL_AGES = ["adult", "elderly", "paeds"]


def model_frame(ratings: DataFrame, min_raters: int = 8, both_sexes: bool = True) -> DataFrame:
    """Rating rows of the eligible procedures with outcome and age group."""
    eligible = model_eligibility(ratings, min_raters, both_sexes).select("booked_procedure")
    trauma = ["trauma"] if "trauma" in ratings.columns else []
    return ratings.join(eligible, "booked_procedure", "left_semi").selectExpr(
        "booked_procedure", "sex", f"{age_group('age')} as age_gp",
        f"{urgent_outcome('emerg_priority_collapse')} as urgent_yn", *trauma)


def frame_cells(ratings: DataFrame, min_raters: int = 8, both_sexes: bool = True) -> DataFrame:
    """``model_frame`` counted: its columns and ``n``, the number of equal rows.

    The ratings are read once and counted per procedure, sex, age group, outcome
    (and trauma) before they are shuffled; a procedure has a few dozen of these
    cells, and whether it is eligible is a sum over them.
    """
    keys = ["booked_procedure", "sex", "age_gp", "urgent_yn", *(["trauma"] if "trauma" in ratings.columns else [])]
    counted = ratings.withColumns({"age_gp": F.expr(age_group("age")), "urgent_yn": F.expr(urgent_outcome("emerg_priority_collapse"))}).groupBy(
        *keys).agg(F.expr("count(*) as n"))
    inside = "over (partition by booked_procedure)"
    judged = counted.filter("booked_procedure is not null").selectExpr(
        "*", f"sum(n) {inside} as _n", f"sum(if(sex is null, n, 0)) {inside} as _unknown",
        f"sum(if(sex = 'M', n, 0)) {inside} as _male", f"sum(if(sex = 'F', n, 0)) {inside} as _female")
    kept = judged.filter(f"_n >= {min_raters}")
    if both_sexes:
        kept = kept.filter("_unknown = 0 and _male >= 1 and _female >= 1")
    return kept.select(*keys, "n")


def cells(with_trauma: bool) -> list[tuple]:
    """Covariate combinations (sex, age group, trauma) in a fixed order."""
    return list(product(SEXES, MODEL_AGES, [False, True] if with_trauma else [None]))


def _in_cell(cell: tuple) -> str:
    sex, age, trauma = cell
    inside = f"sex = '{sex}' and age_gp = '{age}'"
    return inside if trauma is None else f"{inside} and coalesce(trauma, false) = {trauma}"


def model_cells(ratings: DataFrame, min_raters: int = 8, both_sexes: bool = True,
                with_trauma: bool = False, event: str = S.NOT_URGENT) -> DataFrame:
    """Sufficient statistics: one row per eligible procedure, trials and events per covariate cell.

    Eligibility and counts come from the same grouping, so the ratings are read
    once and only a fixed number of counters per procedure is shuffled. Rows
    with a missing sex or age count for eligibility and are left out of the cells.
    """
    marked = ratings.withColumns({
        "age_gp": F.expr(age_group("age")),
        "_event": F.expr(f"{urgent_outcome('emerg_priority_collapse')} = '{event}'"),
    })
    counters = ["count(*) as num_of_raters", "count(sex) as _known",
                "count_if(sex = 'M') as _male", "count_if(sex = 'F') as _female"]
    for j, cell in enumerate(cells(with_trauma)):
        counters += [f"count_if({_in_cell(cell)}) as n{j}", f"count_if(_event and {_in_cell(cell)}) as y{j}"]
    kept = (marked.groupBy("booked_procedure").agg(*map(F.expr, counters))
            .filter(f"num_of_raters >= {min_raters}"))
    if both_sexes:
        kept = kept.filter("_known = num_of_raters and _male >= 1 and _female >= 1")
    return kept.drop("_known", "_male", "_female")


def cells_long(wide: DataFrame, with_trauma: bool = False) -> DataFrame:
    """Non-empty cells, one row each."""
    rows = ", ".join(
        f"struct('{sex}' as sex, '{age}' as age_gp, {f'{trauma} as trauma, ' if with_trauma else ''}n{j} as n, y{j} as y)"
        for j, (sex, age, trauma) in enumerate(cells(with_trauma)))
    return wide.selectExpr("booked_procedure", f"inline(array({rows}))").filter("n > 0")


def sample_size(wide: DataFrame, with_trauma: bool = False) -> DataFrame:
    """One row: eligible procedures, their ratings, and how many of these have the covariates and enter the model."""
    used = " + ".join(f"n{j}" for j in range(len(cells(with_trauma))))
    return wide.agg(F.expr("count(*) as n_procedures"), F.expr("coalesce(sum(num_of_raters), 0) as n_ratings"),
                    F.expr(f"coalesce(sum({used}), 0) as n_modelled"))
