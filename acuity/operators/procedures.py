"""From wide episodes to labelled, booked procedures."""

from pyspark.sql import DataFrame, Window, functions as F

from acuity import schema as S
from acuity.functions.scalars import percent
from acuity.operators.bookings import first_row
from acuity.operators.codes import drop_excluded
from acuity.operators.frequency import freq_table


def unpivot_procedures(study: DataFrame, keep: list[str]) -> DataFrame:
    """One row per coded procedure; empty places are dropped.

    Laid out with ``inline``: Spark recognises two equal layouts, so a table
    that a plan names twice is joined and shuffled once (not so with ``unpivot``).
    """
    columns = S.procedure_code_columns(study.columns)
    places = ", ".join(f"struct('{c}' as proc_num, `{c}` as achi_proc_code)" for c in columns)
    return (study.selectExpr(*[f"`{c}`" for c in keep], f"inline(array({places}))")
            .filter("achi_proc_code is not null")
            .withColumn("primary_proc", F.expr("proc_num = 'coded_primary_procedure'")))


def procedure_check_sheet(study: DataFrame, codes: DataFrame) -> DataFrame:
    """Sheet for the reviewer: procedures with their text and an empty ``correct`` column."""
    rows = unpivot_procedures(study, ["study_id", "planned_procedure"]).drop("proc_num")
    text = codes.select("achi_proc_code", "procedure_text")
    return (rows.withColumn("correct", F.lit(None).cast("string"))
            .join(text, "achi_proc_code", "left")
            .select("study_id", "planned_procedure", "achi_proc_code", "primary_proc", "correct", "procedure_text"))


def one_label_per_code(labels: DataFrame) -> DataFrame:
    """Sheet rows of one code in one study become one label.

    A code may be listed twice in a study. A ``yes`` wins over a ``no``, which
    wins over a blank; the code is primary if the winning rows include the
    primary one. This keeps the label join at one match per row.

    Few codes are listed twice, so rows are dealt out first and grouped where
    they arrive: grouping them before the shuffle too fills memory and spares no row.
    """
    rank = "case correct when 'yes' then 4 when 'no' then 2 else 0 end + if(primary_proc, 1, 0)"
    ranked = labels.selectExpr("study_id", "achi_proc_code", f"{rank} as _rank").repartition("study_id", "achi_proc_code")
    return (ranked.groupBy("study_id", "achi_proc_code").agg(F.expr("max(_rank) as _best"))
            .selectExpr("study_id", "achi_proc_code",
                        "case when _best >= 4 then 'yes' when _best >= 2 then 'no' end as correct",
                        "_best % 2 = 1 as primary_proc"))


def attach_labels(study: DataFrame, labels: DataFrame, keep: list[str], site: int | None = None,
                  excluded: DataFrame | None = None) -> DataFrame:
    """Long ratings with their label; procedures without one keep null labels.

    ``excluded`` codes are dropped before the label join.
    """
    rows = unpivot_procedures(study, keep).drop("primary_proc")
    if excluded is not None:
        rows = drop_excluded(rows, excluded)
    places = ", ".join(f"'{c}', {i}" for i, c in enumerate(S.procedure_code_columns(study.columns)))
    out = (rows.withColumn("proc_no", F.expr(f"map({places})[proc_num]")).drop("proc_num")
           .join(one_label_per_code(labels), ["study_id", "achi_proc_code"], "left")
           .withColumnRenamed("achi_proc_code", "booked_procedure"))
    return out if site is None else out.withColumn("site", F.lit(site))


def with_unique_id(rows: DataFrame, order: list[str]) -> DataFrame:
    """``study_id_unique``: the study, the ``order`` values and a number among equal rows, as text.

    Numbering only rows that are equal in ``order`` keeps the key unique and
    needs neither one task for the table nor one for a study with many rows.
    """
    keys = ["study_id", *order]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    text = ", ".join(f"coalesce(cast({c} as string), '')" for c in keys)
    return (rows.withColumn("_n", number)
            .withColumn("study_id_unique", F.expr(f"concat_ws('_', {text}, cast(_n as string))")).drop("_n"))


def labelled_procedures(ratings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Ratings whose procedure was confirmed, one per study, record and procedure."""
    keys = [c for c in ("study_id", "record_id", "booked_procedure") if c in ratings.columns]
    order = order or [c for c in ("episode_number", "proc_no") if c in ratings.columns]
    return first_row(ratings.filter("correct = 'yes'"), keys, order)


def label_recapture(ratings: DataFrame) -> DataFrame:
    """Frequency of ``pri_capt`` over studies whose primary code was labelled wrong.

    ``pri_capt`` is true if an additional code of the study was labelled
    correct, false if all were labelled wrong, and missing (left out of the
    table) if none was correct and some have no label. One grouping answers all
    three questions, so the table is not joined with itself.
    """
    per_study = ratings.groupBy("study_id").agg(
        F.expr("bool_or(coalesce(primary_proc and correct = 'no', false)) as wrong"),
        F.expr("count_if(not primary_proc) as extras"),
        F.expr("count_if(not primary_proc and correct = 'yes') as yes"),
        F.expr("count_if(not primary_proc and correct is null) as blank"),
    ).filter("wrong and extras > 0")
    captured = "case when yes > 0 then true when blank = 0 then false end as pri_capt"
    return freq_table(per_study.selectExpr(captured), "pri_capt")


def booked_columns(study: DataFrame, columns: list[str]) -> DataFrame:
    """Codes of several columns under one another, in one pass; empty places stay as missing codes."""
    places = ", ".join(f"`{c}`" for c in columns)
    return study.selectExpr("study_id", f"explode(array({places})) as booked_procedure")


def booked_set(matches: DataFrame | list[DataFrame], excluded: DataFrame) -> DataFrame:
    """Union of matched procedures (primary and planned), without duplicates and excluded codes."""
    first, *rest = [m.select("study_id", "booked_procedure") for m in (matches if isinstance(matches, list) else [matches])]
    for other in rest:
        first = first.unionByName(other)
    banned = excluded.select(F.col(excluded.columns[0]).alias("booked_procedure"))
    # the code set is small, so it goes first and the shuffle of distinct() sees fewer rows
    return first.join(banned, "booked_procedure", "left_anti").distinct()


def procedures_per_study(booked: DataFrame) -> DataFrame:
    return booked.groupBy("study_id").agg(F.count("booked_procedure").alias("n_procedures"))


def most_procedures(booked: DataFrame) -> DataFrame:
    """One row: the largest number of procedures in a study, and the number of studies."""
    return procedures_per_study(booked).agg(
        F.max("n_procedures").alias("max_procedures"), F.count("*").alias("n_studies"))


def missing_booked(booked: DataFrame) -> DataFrame:
    """One row: how many rows lack a booked procedure, and their share in percent."""
    counted = booked.agg(F.expr("count(*) as n_rows"), F.expr("count_if(booked_procedure is null) as n_missing"))
    return counted.selectExpr("*", f"{percent('n_missing', 'n_rows')} as pct_missing")


def drop_missing_booked(booked: DataFrame) -> DataFrame:
    return booked.dropna(subset=["booked_procedure"])
