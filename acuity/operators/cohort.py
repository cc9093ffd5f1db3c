"""Trauma cohort from diagnosis codes."""

from pyspark.sql import Column, DataFrame, functions as F

from acuity import schema as S
from acuity.functions.scalars import code_stem, is_injury, is_mechanism, not_in, one_of


def diagnosis_codes(study: DataFrame, zero_pad: bool = False) -> DataFrame:
    """Long lower-case diagnosis codes that survive the exclusion, with injury / mechanism flags.

    ``position`` is the place of the code in the wide row.
    """
    columns = S.diagnosis_columns(study.columns)
    places = ", ".join(f"'{c}', {i}" for i, c in enumerate(columns, 1))
    return (study.selectExpr("study_id", *[f"lower(`{c}`) as `{c}`" for c in columns])
            .unpivot(["study_id"], columns, "diagnosis_code", "code")
            .filter("code <> ''")
            .withColumn("short_idc", F.expr(code_stem("code")))
            .filter(not_in("short_idc", S.excluded_stems(zero_pad)))
            .selectExpr("study_id", f"map({places})[diagnosis_code] as position", "code", "short_idc",
                        f"{is_injury('code')} as trauma_by_inj", f"{is_mechanism('code')} as trauma_by_mech"))


def _code_flag(column: str, stems: list[str]) -> str:
    """True / False for a code that survives the exclusion, null for no code.

    A stem is a character and two digits, so comparing the first three
    characters with the three-character stems is the stem test without a
    regular expression.
    """
    head = f"lower(left(`{column}`, 3))"
    kept = f"not {one_of(head, ['', *[s for s in stems if len(s) == 3]])}"
    return f"case when {kept} then {one_of(f'lower(left(`{column}`, 1))', S.INJURY_LETTERS + S.MECHANISM_LETTERS)} end"


def row_trauma_flag(columns: list[str], mode: str = "first", zero_pad: bool = False) -> Column:
    """Trauma status of one wide row; null if no code survives.

    ``first`` looks at the first surviving code only, ``any`` at all of them.
    The test runs inside the row, so the table is neither unpivoted nor
    shuffled for it.
    """
    flags = [_code_flag(c, S.excluded_stems(zero_pad)) for c in columns]
    if mode == "first":
        return F.expr(f"coalesce({', '.join(flags)})")
    if mode == "any":
        # greatest() skips nulls and true is the larger value
        return F.expr(f"greatest({', '.join(flags)})" if len(flags) > 1 else flags[0])
    raise ValueError(f"mode must be 'first' or 'any', not {mode!r}")


def trauma_cohort(study: DataFrame, mode: str = "first", zero_pad: bool = False,
                  row_order: str | None = "episode_number") -> DataFrame:
    """Distinct ``study_id`` of trauma studies.

    Rows are reduced to one flag before they are grouped. With several rows per
    study, ``first`` means the first row in ``row_order`` that has a surviving
    code; rows without an order come last, and of rows with equal order the one
    with the smallest codes, place by place, is first. Pass ``row_order=None``
    if a study is one row: then nothing is shuffled.
    """
    columns = S.diagnosis_columns(study.columns)
    flag = row_trauma_flag(columns, mode, zero_pad)
    if row_order is None or row_order not in study.columns:
        return study.filter(flag).select("study_id")
    first = F.struct(F.col(row_order).isNull(), F.col(row_order),
                     F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    rows = study.select("study_id", first.alias("_order"), flag.alias("_flag")).filter("_flag is not null")
    per_study = "min(struct(_order, _flag))._flag" if mode == "first" else "bool_or(_flag)"
    return rows.groupBy("study_id").agg(F.expr(f"{per_study} as _flag")).filter("_flag").select("study_id")


def keep_cohort(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the studies in ``ids``, marked as trauma patients."""
    return df.join(ids, "study_id", "left_semi").withColumn("trauma_pt", F.lit(True))


def flag_cohort(df: DataFrame, ids: DataFrame, flag: str = "trauma") -> DataFrame:
    """All rows, with a flag for the studies in ``ids``.

    The ids are made distinct on the join key, so the join keeps the number of
    rows and reuses that shuffle.
    """
    marked = ids.select("study_id").distinct().withColumn(flag, F.lit(True))
    return df.join(marked, "study_id", "left").withColumn(flag, F.expr(f"coalesce({flag}, false)"))
