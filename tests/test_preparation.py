"""Bookings, codes, cohort, procedures and labels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from acuity.operators import bookings, codes, cohort, procedures as proc, text_match
from acuity.sources import readers, writers


def ids(df, column="study_id"):
    return sorted(r[column] for r in df.collect())


STUDY = ("study_id string, age double, admit_dt_tm timestamp, emerg_book_dt_tm timestamp, case_date date, "
         "episode_number long, booked_procedure string, emerg_priority string, procedural_consultant string")


def case(study="a", age=40.0, hours=1.0, day=1, episode=1, booked="p", priority="C-4hrs Critical", rater="r"):
    admit = dt.datetime(2020, 1, 1)
    return (study, age, admit, None if hours is None else admit + dt.timedelta(hours=hours),
            None if day is None else dt.date(2020, 1, day), episode, booked, priority, rater)


def test_first_case(rows):
    df = rows(STUDY, case(day=2, episode=1), case(day=1, episode=2), case(day=None, episode=0))
    assert [r.episode_number for r in bookings.first_case_per_admission(df).collect()] == [2]


def test_first_case_null_age_is_one_group(rows):
    df = rows(STUDY, case(age=None, episode=2), case(age=None, episode=1))
    assert [r.episode_number for r in bookings.first_case_per_admission(df).collect()] == [1]


def test_prepare_bookings(rows):
    df = rows(STUDY, case("a", hours=24.0), case("b", hours=24.5), case("c", hours=-3.0, priority="x", rater=None),
              case("d", hours=None))
    got = {r.study_id: r for r in bookings.prepare_bookings(df).collect()}
    assert sorted(got) == ["a", "c"]
    assert got["a"].emerg_priority_collapse == "<4hrs" and got["c"].emerg_priority_collapse is None
    assert got["a"].procedural_consultant != "r" and got["c"].procedural_consultant is not None


def test_first_case_does_not_depend_on_layout(spark, rows):
    values = [case(f"s{i % 50}", day=1 + i % 3, episode=i) for i in range(600)]
    first = {tuple(r) for r in bookings.first_case_per_admission(rows(STUDY, *values)).collect()}
    again = bookings.first_case_per_admission(rows(STUDY, *values[::-1]).repartition(5)).collect()
    assert first == {tuple(r) for r in again}


def test_first_row_limits_groups_before_the_shuffle(spark, rows):
    plan = bookings.first_case_per_admission(rows(STUDY, case()))._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange hashpartitioning")[::-1], plan
    assert after.count("WindowGroupLimit") == 2 and "Partial" in before[0]


CODES = "achi_proc_code string, procedure_text string, block_number int, block_text string"


def test_excluded_codes(rows):
    numbers = [1785, 1786, 1800, 1801, 1820, 1923, 1939, 1940, 2016, 2017]
    texts = ["Ventilatory support", "ventilatory support", None]
    table = rows(CODES, *[(f"b{n}", "", n, "x") for n in numbers], *[(f"t{i}", "", 1, t) for i, t in enumerate(texts)])
    got = codes.excluded_procedure_codes(table, listed=["z", "b1786"])
    assert ids(got, "achi_proc_code") == sorted(["b1786", "b1800", "b1820", "b1923", "b1940", "b2016", "t0", "z"])


def test_blank_and_drop_excluded(rows):
    wide = rows("study_id string, coded_primary_procedure string, additional_procedure_1 string", ("a", "x", "y"), ("b", "y", None))
    excluded = rows("achi_proc_code string", ("x",))
    assert [tuple(r) for r in codes.blank_excluded(wide, excluded).orderBy("study_id").collect()] == [("a", None, "y"), ("b", "y", None)]
    long = proc.unpivot_procedures(wide, ["study_id"])
    assert sorted(r.achi_proc_code for r in codes.drop_excluded(long, excluded).collect()) == ["y", "y"]


DIAG = "study_id string, episode_number long, principle_diagnosis string, additional_diagnosis_1 string"


def test_surviving_codes(rows):
    df = rows(DIAG, *[(str(i), 1, c, None) for i, c in enumerate(["S72", "T36.1", "Z", "Y06", None, ""])])
    assert ids(cohort.diagnosis_codes(df), "code") == ["s72", "y06", "z"]
    assert ids(cohort.diagnosis_codes(df, zero_pad=True), "code") == ["s72", "z"]


@pytest.mark.parametrize("order", [None, "episode_number"])
def test_first_and_any(rows, order):
    df = rows(DIAG, ("a", 1, "I10", "S72"), ("b", 1, "S72", "I10"), ("c", 1, "T81", "S72"), ("d", 1, "", None))
    assert ids(cohort.trauma_cohort(df, "first", row_order=order)) == ["b", "c"]
    assert ids(cohort.trauma_cohort(df, "any", row_order=order)) == ["a", "b", "c"]


def test_first_row_with_a_code_decides(rows):
    df = rows(DIAG, ("a", 2, "I10", None), ("a", 1, "S72", None), ("b", 1, "T81", None), ("b", 2, "S72", None),
              ("c", 1, "I10", None), ("c", 2, "S72", None))
    assert ids(cohort.trauma_cohort(df, "first")) == ["a", "b"]
    assert ids(cohort.trauma_cohort(df, "any")) == ["a", "b", "c"]


def test_mechanism_letters(rows):
    df = rows(DIAG, *[(c, 1, c, None) for c in ["U50", "V01", "W19", "X59", "Y20"]])
    assert ids(cohort.trauma_cohort(df)) == ["U50", "V01", "W19", "X59"]


def test_row_flag_equals_long_codes(rows):
    """The in-row test and the unpivoted codes give the same cohort."""
    letters, numbers = "STUVWXYZt", ["06", "20", "36", "45", "66", "74", "80", "99"]
    values = [(f"{a}{n}", 1, f"{a}{n}", None) for a in letters for n in numbers]
    df = rows(DIAG, *values)
    for pad in (False, True):
        long = cohort.diagnosis_codes(df, pad).filter("trauma_by_inj or trauma_by_mech")
        assert ids(long) == ids(cohort.trauma_cohort(df, "any", pad))


def test_cohort_flags(rows):
    df, some = rows("study_id string", ("a",), ("b",)), rows("study_id string", ("a",))
    assert [tuple(r) for r in cohort.keep_cohort(df, some).collect()] == [("a", True)]
    assert sorted(tuple(r) for r in cohort.flag_cohort(df, some).collect()) == [("a", True), ("b", False)]


LABELS = "study_id string, achi_proc_code string, correct string, primary_proc boolean"


def test_one_label_per_code(rows):
    df = rows(LABELS, ("a", "p", "no", True), ("a", "p", "yes", False), ("a", "q", None, True), ("a", "r", "no", None),
              ("a", "r", None, True), ("a", "s", "yes", True), ("a", "s", "yes", False))
    got = {r.achi_proc_code: (r.correct, r.primary_proc) for r in proc.one_label_per_code(df).collect()}
    assert got == {"p": ("yes", False), "q": (None, True), "r": ("no", False), "s": ("yes", True)}


WIDE = ("study_id string, record_id string, episode_number long, planned_procedure string, coded_primary_procedure string, "
        "additional_procedure_1 string")


def test_labels_join_and_distinct(rows):
    wide = rows(WIDE, ("a", "1", 1, "text", "p", "q"), ("a", "1", 2, "text", "q", "p"), ("a", "2", 3, "text", "p", None))
    labels = rows(LABELS, ("a", "p", "yes", True), ("a", "q", "no", False))
    rated = proc.attach_labels(wide, labels, ["study_id", "record_id", "episode_number"], site=1234)
    assert rated.count() == 5 and {r.site for r in rated.collect()} == {1234}
    kept = sorted((r.record_id, r.booked_procedure, r.episode_number) for r in proc.labelled_procedures(rated).collect())
    assert kept == [("1", "p", 1), ("2", "p", 3)]


def test_check_sheet_round_trip(spark, rows, tmp_path):
    wide = rows(WIDE, ("a", "1", 1, "text", "p", None))
    table = rows(CODES, ("p", "Repair", 1, "x"))
    sheet = proc.procedure_check_sheet(wide, table)
    row = sheet.first()
    assert tuple(row) == ("a", "text", "p", True, None, "Repair")
    filled = sheet.withColumn("correct", F.lit("yes"))
    writers.write_label_sheet(filled, str(tmp_path / "sheet"))
    back = readers.read_labels(spark, str(tmp_path / "sheet"))
    assert back.columns == ["study_id", "achi_proc_code", "correct", "primary_proc"]
    assert tuple(back.first()) == ("a", "p", "yes", True)


def test_recapture_null_rules(rows):
    """Any yes -> captured; only wrong ones -> not captured; blank without yes -> left out."""
    typed = "study_id string, primary_proc boolean, correct string"
    groups = {"a": ["no", None], "b": ["yes", None], "c": ["no"], "d": []}
    values = [(s, True, "no") for s in groups] + [(s, False, c) for s, cs in groups.items() for c in cs] + [("e", False, "yes")]
    got = {r.pri_capt: (r.n, r.prop) for r in proc.label_recapture(rows(typed, *values)).collect()}
    assert got == {True: (1, 50.0), False: (1, 50.0)}


def test_booked_set_and_sizes(rows):
    typed = "study_id string, booked_procedure string"
    booked = proc.booked_set([rows(typed, ("a", "p"), ("a", "q"), ("b", None)), rows(typed, ("a", "p"), ("a", "x"))],
                             rows("achi_proc_code string", ("x",)))
    assert sorted((r[1], r[0] or "") for r in booked.select("booked_procedure", "study_id").collect()) == [("a", "p"), ("a", "q"), ("b", "")]
    assert {r.study_id: r.n_procedures for r in proc.procedures_per_study(booked).collect()} == {"a": 2, "b": 0}
    assert tuple(proc.most_procedures(booked).first()) == (2, 2)
    assert tuple(proc.missing_booked(booked).first()) == (3, 1, 33.3)
    assert proc.drop_missing_booked(booked).count() == 2


def test_unique_ids(rows):
    df = rows("study_id string, n int", ("1", 12), ("11", 2), ("1", 12), ("1", None))
    got = [r.study_id_unique for r in proc.with_unique_id(df, ["n"]).collect()]
    assert len(set(got)) == 4


def test_text_match(rows):
    texts = rows("study_id int, text string", (1, "Open REDUCTION of the left femur; reduction!"), (2, "nothing shared"), (3, "wound"))
    recorded = rows("study_id int, code string", (1, "b"), (1, "a"), (1, "c"), (2, "a"), (3, "d"))
    table = rows("code string, code_text string", ("a", "Reduction of femur"), ("b", "femur, reduction"), ("c", "the left"),
                 ("d", "of the"))
    pairs = {(r.study_id, r.code): (r.code_words, r.common_words)
             for r in text_match.common_words(texts, recorded, table).collect()}
    assert pairs == {(1, "a"): (2, 2), (1, "b"): (2, 2), (1, "c"): (1, 1), (2, "a"): (2, 0), (3, "d"): (0, 0)}
    best = text_match.best_match(text_match.common_words(texts, recorded, table)).collect()
    assert [tuple(r) for r in best] == [(1, "a", 2)]


def test_study_readers(spark, rows, tmp_path):
    wide = rows("study_id string, age double, admit_dt_tm timestamp, case_date date, episode_number long, additional_procedure_7 string",
                ("a", 1.5, dt.datetime(2020, 1, 1, 3), dt.date(2020, 1, 2), 4, "30001-00"))
    wide.write.option("header", True).csv(str(tmp_path / "csv"))
    writers.write_stage(wide, str(tmp_path / "parquet"))
    from_csv = readers.read_study(spark, str(tmp_path / "csv"), "csv")
    assert from_csv.dtypes == wide.dtypes and from_csv.first() == wide.first()
    assert readers.read_study(spark, str(tmp_path / "parquet")).first() == wide.first()
    assert readers.read_stage(spark, str(tmp_path / "parquet")).first() == wide.first()


def test_code_table_readers(spark, rows, tmp_path):
    rows("achi_proc_code string, procedure_text string, block_number int, block_text string, procedure_chapter string, "
         "procedure_sub_chapter string, icd10_ver string", ("p", "t", 5, "b", "c", "s", "11")
         ).write.option("header", True).csv(str(tmp_path / "p"))
    assert readers.read_procedure_codes(spark, str(tmp_path / "p"), "csv").first().block_number == 5
    rows("four_dgt_no string, four_dgt_text string, three_dgt_no string, three_dgt_text string, diagnosis_chapter string, "
         "diagnosis_subchapter string", ("s72.1", "a", "s72", "b", "c", "d")).write.parquet(str(tmp_path / "d"))
    assert readers.read_diagnosis_codes(spark, str(tmp_path / "d")).first().three_dgt_no == "s72"


def test_csv_parts_are_bound_by_name(spark, tmp_path):
    folder = tmp_path / "study"
    folder.mkdir()
    (folder / "a.csv").write_text("study_id,sex,age\n1,F,50\n2,M,\n")
    (folder / "b.csv").write_text("study_id,age,sex,additional_procedure_9\n3,60,M,x\n")
    (folder / "c.csv").write_text("study_id,sex,age\n4,F,70\n")
    got = {r.study_id: (r.sex, r.age, r.additional_procedure_9) for r in readers.read_study(spark, str(folder), "csv").collect()}
    assert got == {"1": ("F", 50.0, None), "2": ("M", None, None), "3": ("M", 60.0, "x"), "4": ("F", 70.0, None)}


def test_a_malformed_line_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("study_id,sex,age\n1,F,fifty\n")
    with pytest.raises(Exception):
        readers.read_study(spark, str(tmp_path), "csv").collect()


def test_cohort_keeps_studies_without_an_order(rows):
    typed = "study_id string, episode_number long, principle_diagnosis string, additional_diagnosis_1 string"
    df = rows(typed, ("a", None, "S72", None), ("b", None, "S72", None), ("b", 1, "K35", None), ("c", 1, "S72", None), ("c", 1, "K35", None),
              ("d", None, "K35", None))
    assert {r.study_id for r in cohort.trauma_cohort(df).collect()} == {"a"}  # of equal orders K35 is before S72
    assert {r.study_id for r in cohort.trauma_cohort(df, "any").collect()} == {"a", "b", "c"}


def test_best_of_all_codes(spark, rows):
    from acuity.operators.text_match import best_codes, common_words
    texts = rows("study_id long, text string", (1, "open repair of the femur"), (1, "wrist"), (2, "nothing"), (3, None), (4, "FEMUR, wrist repair"))
    codes = rows("code long, code_text string", (7, "repair of femur"), (3, "repair of wrist"), (5, "wrist repair open"), (9, None), (None, "femur"))
    want = {(1, 5, 2), (1, 3, 1), (4, 3, 2)}
    assert {tuple(r) for r in best_codes(texts, codes).collect()} == want
    assert {tuple(r) for r in best_codes(texts, codes.unionAll(codes)).collect()} == want
    assert best_codes(texts, codes.filter("false")).collect() == []


def test_large_code_table_and_a_frequent_word(spark):
    """Twelve thousand codes, and a word that every text has: joined by a shuffle that splits the word."""
    from acuity.operators.text_match import best_codes
    texts = spark.range(0, 30_000, 1, 6).selectExpr("id as study_id", "concat('repair w', id % 12000, ' x', id % 700) as text")
    codes = spark.range(0, 12_000, 1, 3).selectExpr("id as code", "concat(if(id % 4000 = 0, 'repair w', 'w'), id, ' other x', id % 700) as code_text")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = best_codes(texts, codes)
        got = {r.study_id: (r.booked_procedure, r.common_words) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "skew=true" in plan and "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    by_word = {}
    coded = {c: {f"w{c}", "other", f"x{c % 700}", *(["repair"] if c % 4000 == 0 else [])} for c in range(12_000)}
    for c, found_words in coded.items():
        for w in found_words:
            by_word.setdefault(w, []).append(c)
    for i in range(0, 30_000, 97):
        mine = {"repair", f"w{i % 12000}", f"x{i % 700}"}
        near = {c for w in mine for c in by_word.get(w, [])}
        best = min((-len(coded[c] & mine), c) for c in near)
        assert got[i] == (best[1], -best[0])
    assert len(got) == 30_000


def exchanges(df):
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blanking_takes_one_pass_for_any_number_of_columns(rows):
    names = ["coded_primary_procedure", *[f"additional_procedure_{i}" for i in range(1, 8)]]
    typed = ", ".join(["study_id string", *[f"{n} int" for n in names], "note string"])
    data = [(f"s{i}", *[(i * 7 + k) % 23 if (i + k) % 5 else None for k in range(8)], "n") for i in range(60)] * 2
    excluded = rows("achi_proc_code int", *[(c,) for c in (3, 9, 9, 22)], (None,))
    want = sorted(str((r[0], *[None if v in (3, 9, 22) else v for v in r[1:9]], "n")) for r in data)
    wide = rows(typed, *data)
    for most in (10_000, 2):
        got = codes.blank_excluded(wide, excluded, most_listed=most)
        assert got.columns == wide.columns and got.dtypes == wide.dtypes
        assert sorted(str(tuple(r)) for r in got.collect()) == want
        assert exchanges(got) <= (0 if most > 2 else 5)
    assert codes.blank_excluded(wide, excluded.filter("false")).collect() == wide.collect()
    assert codes.blank_excluded(wide.select("study_id", "note"), excluded).columns == ["study_id", "note"]


def test_blanking_packs_whole_numbers(spark, rows):
    """More codes than may be listed one by one go to the rows packed; far-apart, negative and extreme ones are exact."""
    low, high = -(1 << 63), (1 << 63) - 1
    listed = [*range(0, 4000, 2), -1, -64, -1025, 10**15, low, high]
    values = [*range(-1100, 4100), 10**15, 10**15 + 1, 10**15 - 1024, low, low + 1, high, high - 1, None]
    wide = spark.createDataFrame([(i, v, values[-1 - i]) for i, v in enumerate(values)],
                                 "study_id long, coded_primary_procedure long, additional_procedure_1 long")
    excluded = rows("achi_proc_code long", *[(c,) for c in listed], (None,))
    want = {(i, *[None if v in set(listed) else v for v in (a, values[-1 - i])]) for i, a in enumerate(values)}
    for most, shuffles in ((100, False), (0, True)):
        got = codes.blank_excluded(wide, excluded, most_listed=most)
        assert {tuple(r) for r in got.collect()} == want and got.dtypes == wide.dtypes
        assert (exchanges(got) > 0) == shuffles


def test_a_layout_named_twice_is_shuffled_once(spark):
    """Long procedures joined with the oldest age of themselves: one layout, one grouping of labels."""
    wide = spark.range(200).selectExpr("id % 50 as study_id", "id as coded_primary_procedure", "id % 7 as additional_procedure_1", "id % 90 as age")
    sheet = proc.unpivot_procedures(wide, ["study_id"]).withColumn("correct", F.lit("yes"))
    long = proc.attach_labels(wide, sheet, ["study_id", "age"])
    cells = long.groupBy("booked_procedure", "age").agg(F.expr("count(*) as n"))
    df = cells.withColumn("oldest", cells.agg(F.expr("max(struct(age, booked_procedure, n)).age")).scalar())
    assert {(r.n > 0, r.oldest) for r in df.collect()} == {(True, 89)}
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [booked_procedure" in final
    plan = proc.one_label_per_code(sheet)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and plan.index("partial_max") < plan.index("REPARTITION_BY_COL")  # grouped where rows arrive


def test_hand_off_is_whole_or_as_before(spark, rows, tmp_path):
    path = str(tmp_path / "stage")
    writers.write_stage(rows("a int", (1,)), path)
    started = readers.read_stage(spark, path)
    with pytest.raises(Exception):
        writers.write_stage(spark.range(4).selectExpr("cast(if(id = 3, raise_error('lost'), id) as int) as a"), path)
    assert [r.a for r in readers.read_stage(spark, path).collect()] == [1]
    writers.write_stage(rows("a int", (2,)), path)
    assert [r.a for r in readers.read_stage(spark, path).collect()] == [2] and [r.a for r in started.collect()] == [1]
    for k in (3, 4):
        writers.write_stage(readers.read_stage(spark, path).selectExpr(f"{k} as a"), path)  # reads what it replaces
    assert [r.a for r in readers.read_stage(spark, path).collect()] == [4]
    assert len([f for f in (tmp_path / "stage").iterdir() if f.name.startswith("rows-")]) == 2
