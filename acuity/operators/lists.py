"""Urgency lists: one row per booked procedure.

Every list is a projection of level counts per procedure. The counts are a
plain aggregate with a fixed number of counters per procedure, so rows are
combined before the shuffle and a very frequent procedure costs no more than
a rare one. Several lists (by age, by sex) are counted side by side from the
same cells of procedure and age: one pass over the ratings, however many lists.
"""

from pyspark.sql import DataFrame, functions as F

from acuity import schema as S
from acuity.functions.interval import exact_interval, interval_text
from acuity.functions.ordinal import agreement, consensus
from acuity.functions.scalars import literal, percent

COUNTS = [f"n_{level.strip('<hrs')}" for level in S.LEVELS]  # n_1 n_4 n_8 n_24 n_72
TOTAL = " + ".join(COUNTS)
FOLDED_COUNTS = [f"({COUNTS[0]} + {COUNTS[1]})", *COUNTS[2:]]  # counts on the four-level scale
LIST_COLUMNS = [
    "booked_procedure", *S.LEVELS, "Agreement", "Consensus", "urgent_total_pcnt", "urgent_total_pcnt_CI",
    "urgent_surgery_by_agmnt", "urgent_surgery_by_cnsus", "proc_n", "trauma", "primary_proc",
]


OLDEST = "_oldest"  # name of the column with the largest age of all ratings


def age_bounds(ratings: DataFrame) -> DataFrame:
    """One row with the smallest and largest age."""
    return ratings.agg(F.expr("min(age) as age_min"), F.expr("max(age) as age_max"))


def in_age_range(age_lower: float | None = None, age_upper: float | str | None = None, closed_upper: bool = False) -> str:
    """SQL text of ``age_lower <= age < age_upper``; a missing age is outside. ``age_upper`` may be a column."""
    inside = ["age is not null" if age_lower is None else f"age >= {float(age_lower)}D"]
    if age_upper is not None:
        bound = age_upper if isinstance(age_upper, str) else f"{float(age_upper)}D"
        inside.append(f"age {'<=' if closed_upper else '<'} {bound}")
    return " and ".join(inside)


def default_age_range(age_lower: float | None = None, age_upper: float | None = None, closed_upper: bool = False) -> str:
    """``in_age_range`` with the bound of the data, column ``OLDEST``, where none is given.

    An open upper bound is the largest age of all ratings, so the oldest
    patients are left out unless ``closed_upper`` is set.
    """
    return in_age_range(age_lower, OLDEST if age_upper is None and not closed_upper else age_upper, closed_upper)


def with_oldest(cells: DataFrame) -> DataFrame:
    """Grouped rows with the largest of their ages in column ``OLDEST``.

    The maximum is a scalar subquery over the same grouping. It names every
    column, so that nothing is pruned and Spark reuses the shuffle of the
    grouping: the ratings are read once.
    """
    rest = ", ".join(f"`{c}`" for c in cells.columns if c != "age")
    return cells.withColumn(OLDEST, cells.agg(F.expr(f"max(struct(age, {rest})).age")).scalar())


def same_day(ratings: DataFrame) -> DataFrame:
    return ratings.filter(f"admit_to_book_pd = '{S.SAME_DAY}'")


def _counters(trauma: str, member: str = "true") -> dict[str, str]:
    """Aggregates of one list: a count per level and two flags."""
    counts = {n: f"count_if({member} and emerg_priority_collapse = {literal(level)})" for level, n in zip(S.LEVELS, COUNTS)}
    flags = {name: f"bool_or({member} and coalesce({flag}, false))"
             for name, flag in (("trauma", trauma), ("primary_proc", "primary_proc"))}
    return counts | flags


def _trauma(cohort: str) -> str:
    if cohort not in ("trauma", "all patients"):
        raise ValueError(f"cohort must be 'trauma' or 'all patients', not {cohort!r}")
    return "true" if cohort == "trauma" else "trauma"


def level_counts(ratings: DataFrame, cohort: str = "trauma") -> DataFrame:
    """Counts per level, wide, with the flags; procedures without any rated booking are absent."""
    counters = [F.expr(f"{c} as {n}") for n, c in _counters(_trauma(cohort)).items()]
    return ratings.groupBy("booked_procedure").agg(*counters).filter(f"{TOTAL} > 0")


def age_cells(ratings: DataFrame, cohort: str = "trauma", keys: tuple[str, ...] = ("age",)) -> DataFrame:
    """Counts and flags of the same-day ratings per procedure and age (and other ``keys``), with ``OLDEST``.

    There are at most a few hundred ages, so cells are combined before the
    shuffle as well as procedures would be. The oldest age is that of all ratings, same day or not.
    """
    inside = f"coalesce(admit_to_book_pd = {literal(S.SAME_DAY)}, false)"
    counters = [F.expr(f"{c} as {n}") for n, c in _counters(_trauma(cohort), inside).items()]
    return with_oldest(ratings.groupBy("booked_procedure", *keys).agg(*counters))


def level_counts_by_list(ratings: DataFrame, members: dict[str, str], cohort: str = "trauma") -> DataFrame:
    """``level_counts`` of several lists in one pass over the ratings, stacked with ``list_name``.

    ``members`` gives for each list a SQL condition on ``age``, ``OLDEST`` and
    ``sex``; lists may overlap.
    """
    keys = ("age", "sex") if any("sex" in m for m in members.values()) else ("age",)
    cells = age_cells(ratings, cohort, keys)
    marked = cells.selectExpr("*", *[f"coalesce({m}, false) as _in_{i}" for i, m in enumerate(members.values())])
    names = [*COUNTS, "trauma", "primary_proc"]
    sums = [f"sum(if(_in_{i}, {n}, 0)) as {n}_{i}" if n in COUNTS else f"bool_or(_in_{i} and {n}) as {n}_{i}"
            for i in range(len(members)) for n in names]
    stack = ", ".join(
        f"struct({literal(name)} as list_name, {', '.join(f'{n}_{i} as {n}' for n in names)})"
        for i, name in enumerate(members))
    wide = marked.groupBy("booked_procedure").agg(*map(F.expr, sums))
    return wide.selectExpr("booked_procedure", f"inline(array({stack}))").filter(f"{TOTAL} > 0")


def urgent_levels(urgency: int) -> int:
    """How many levels count as urgent within ``urgency`` hours."""
    if urgency not in S.URGENCY_WINDOWS:
        raise ValueError(f"urgency must be one of {list(S.URGENCY_WINDOWS)}, not {urgency!r}")
    return S.URGENCY_WINDOWS[urgency]


def with_percents(counts: DataFrame, percent_digits: int | None = 1) -> DataFrame:
    """Adds ``proc_n`` and one percent column per level, named after the level."""
    shares = [f"{percent(n, TOTAL, percent_digits)} as `{level}`" for level, n in zip(S.LEVELS, COUNTS)]
    return counts.selectExpr("*", f"{TOTAL} as proc_n", *shares)


def with_ordinal(counts: DataFrame) -> DataFrame:
    return counts.selectExpr("*", f"{agreement(FOLDED_COUNTS)} as Agreement", f"{consensus(FOLDED_COUNTS)} as Consensus")


def with_urgent_percent(listed: DataFrame, urgency: int = 4) -> DataFrame:
    """Share booked within the window: the sum of the level percents, as displayed."""
    share = " + ".join(f"`{level}`" for level in S.LEVELS[:urgent_levels(urgency)])
    return listed.withColumn("urgent_total_pcnt", F.expr(share))


def with_interval(listed: DataFrame, urgency: int = 4) -> DataFrame:
    """Exact 95 % interval of the urgent share, from the counts themselves."""
    hits = F.expr(" + ".join(COUNTS[:urgent_levels(urgency)]))
    return (listed.withColumn("_ci", exact_interval(hits, F.expr(TOTAL)))
            .withColumn("urgent_total_pcnt_CI", F.expr(interval_text("_ci"))).drop("_ci"))


def by_agreement(agreement_threshold: float) -> str:
    return f"coalesce(urgent_total_pcnt >= {float(agreement_threshold)}D, false)"


def by_consensus(agreement_threshold: float, consensus_threshold: float) -> str:
    """More than half of the ratings, short of agreement, and raters who disagree."""
    return (f"coalesce(urgent_total_pcnt < {float(agreement_threshold)}D and urgent_total_pcnt > 50 "
            f"and Consensus < {float(consensus_threshold)}D, false)")


def classify(counts: DataFrame, agreement_threshold: float, consensus_threshold: float,
             urgency: int = 4, percent_digits: int | None = 1) -> DataFrame:
    """Level counts to the finished list."""
    listed = with_urgent_percent(with_ordinal(with_percents(counts, percent_digits)), urgency)
    flagged = listed.selectExpr(
        "*", f"{by_agreement(agreement_threshold)} as urgent_surgery_by_agmnt",
        f"{by_consensus(agreement_threshold, consensus_threshold)} as urgent_surgery_by_cnsus")
    front = [c for c in counts.columns if c == "list_name"]
    return with_interval(flagged, urgency).selectExpr(*front, *[f"`{c}`" for c in LIST_COLUMNS])


def procedure_urgency(ratings: DataFrame, agreement_threshold: float, consensus_threshold: float,
                      urgency: int = 4, age_lower: float | None = None, age_upper: float | None = None,
                      cohort: str = "all patients", percent_digits: int | None = 1,
                      closed_upper: bool = False) -> DataFrame:
    """The list of procedures: percents, agreement, consensus, interval and class of each.

    ``cohort="trauma"`` marks every procedure as trauma; ``"all patients"``
    marks those with at least one trauma rating and needs a ``trauma`` column.
    """
    inside = default_age_range(age_lower, age_upper, closed_upper)
    if OLDEST in inside:
        counts = level_counts_by_list(ratings, {"_": inside}, cohort).drop("list_name")
    else:
        counts = level_counts(same_day(ratings).filter(inside), cohort)
    return classify(counts, agreement_threshold, consensus_threshold, urgency, percent_digits)


def age_members() -> dict[str, str]:
    """Conditions of the full list and the three age lists, with their default bounds."""
    return {
        "full": default_age_range(),
        "adult": in_age_range(S.ADULT_FROM, S.ELDERLY_FROM),
        "paeds": in_age_range(None, S.ADULT_FROM),
        "elderly": default_age_range(S.ELDERLY_FROM),
    }


def sex_members() -> dict[str, str]:
    return {"male": f"{default_age_range()} and sex = 'M'", "female": f"{default_age_range()} and sex = 'F'"}


def urgency_lists(ratings: DataFrame, members: dict[str, str], agreement_threshold: float = 75,
                  consensus_threshold: float = 0.7, urgency: int = 4, cohort: str = "trauma",
                  percent_digits: int | None = 1) -> DataFrame:
    """Several lists at once, stacked with ``list_name``."""
    counts = level_counts_by_list(ratings, members, cohort)
    return classify(counts, agreement_threshold, consensus_threshold, urgency, percent_digits)
