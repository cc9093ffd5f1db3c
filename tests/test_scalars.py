import hashlib

import pytest

from acuity import schema as S
from acuity.functions import scalars as f


def test_booking_period_edges(evaluate):
    got = evaluate(f.booking_period("x"), "double", [-5.0, 24.0, 24.5, 168.0, 168.01, None])
    assert got == ["same day", "same day", "same week", "same week", "over 1 week", None]


def test_hours_keep_fractions(spark):
    df = spark.sql("select timestamp'2020-01-02 00:30:00' as b, timestamp'2020-01-01 00:00:00' as a")
    assert df.selectExpr(f.hours_between("b", "a")).first()[0] == 24.5


def test_collapse_priority(evaluate):
    texts = ["B-2hrs Highly critical organ/limb threat", "<=4hrs-Organ or limb threatening", "x", None]
    assert evaluate(f.collapse_priority("x"), "string", texts) == ["<1hr", "<4hrs", None, None]
    known = [t for texts in S.PRIORITY_LEVELS.values() for t in texts]
    assert len(known) == 12
    assert None not in evaluate(f.collapse_priority("x"), "string", known)


def test_level_rank_and_fold(evaluate):
    values = ["<72hrs", "<1hr", "x", None]
    assert evaluate(f.level_rank("x"), "string", values) == [5, 1, None, None]
    assert evaluate(f.fold_top_level("x"), "string", ["<1hr", "<4hrs", "<8hrs", None]) == ["<4hrs", "<4hrs", "<8hrs", None]


def test_pseudonym_hashes_missing_names(evaluate):
    got = evaluate(f.rater_pseudonym("x"), "string", ["a", None])
    assert got == [hashlib.md5(b"a").hexdigest(), hashlib.md5(b"NA").hexdigest()]


def test_code_stem(evaluate):
    assert evaluate(f.code_stem("x"), "string", ["s72.1", "t36", "z", "y6", None]) == ["s72", "t36", "", "", None]


def test_not_in_keeps_null(evaluate):
    assert evaluate(f.not_in("x", ["a"]), "string", ["a", "b", None]) == [False, True, True]


def test_specialty(evaluate):
    names = ["A SN SN", "Colorectal SN", "Gynaecology", "Orthopaedics", None]
    assert evaluate(f.remove_first("x", " SN"), "string", names) == ["A SN", "Colorectal", "Gynaecology", "Orthopaedics", None]
    assert evaluate(f.specialty_group("x"), "string", names) == ["A SN", "General Surgery", "Obs/Gynae", "Orthopaedics", None]


def test_age_group(evaluate):
    assert evaluate(f.age_group("x"), "double", [15.9, 16.0, 64.9, 65.0, None]) == ["paeds", "adult", "adult", "elderly", None]


def test_urgent_outcome(evaluate):
    assert evaluate(f.urgent_outcome("x"), "string", ["<1hr", "<8hrs", None]) == ["urgent", "not urgent", "not urgent"]


@pytest.mark.parametrize("part, whole, digits, expected", [
    (1, 3, 1, 33.3), (2, 3, 1, 66.7), (1, 16, 1, 6.2), (3, 16, 1, 18.8), (1, 3, None, 100 / 3), (1, 0, 1, None), (5, 8, 0, 62.0)])
def test_percent_is_half_even(spark, part, whole, digits, expected):
    got = spark.sql(f"select {f.percent(f'{part}L', f'{whole}L', digits)}").first()[0]
    assert got == expected


def test_excluded_stems():
    literal, padded = S.excluded_stems(), S.excluded_stems(zero_pad=True)
    assert len(literal) == len(padded) == len(set(literal))
    assert {"y6", "y7", "u4", "u6", "u7"} == set(literal) - set(padded)
    assert {"t36", "t65", "t74", "t98", "y10", "y98", "u92", "x49"} <= set(literal)
    assert not {"t66", "t73", "t79", "y20", "u77", "x50"} & set(literal)


def test_listed_codes():
    assert len(S.EXCLUDED_CODES) == len(set(S.EXCLUDED_CODES)) == 29


def test_column_patterns():
    columns = ["study_id", "planned_procedure", "primary_procedure", "additional_procedure_1", "coded_primary_procedure",
               "Additional_Procedure_2", "principle_diagnosis", "additional_diagnosis_1"]
    assert S.procedure_code_columns(columns) == ["coded_primary_procedure", "additional_procedure_1", "Additional_Procedure_2"]
    assert S.diagnosis_columns(columns) == ["principle_diagnosis", "additional_diagnosis_1"]
