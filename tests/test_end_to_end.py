"""The whole way from a CSV of raw bookings to written lists, on hand-made bookings."""

import datetime as dt

from pyspark.sql import functions as F

from acuity.operators import bookings, codes, cohort, compare, lists, procedures
from acuity.sources import readers, writers

COLUMNS = ("study_id string, sex string, age double, admit_dt_tm timestamp, emerg_book_dt_tm timestamp, case_date date, "
           "planned_procedure string, emerg_priority string, procedural_consultant string, episode_number long, "
           "coded_primary_procedure string, additional_procedure_1 string, principle_diagnosis string, additional_diagnosis_1 string")
PRIORITIES = ["A-1hr Life threatening incl obstetric", "C-4hrs Critical", "D-8hrs Urgent", "F-72hrs Non-Urgent"]


def test_from_bookings_to_lists(spark, rows, tmp_path):
    start = dt.datetime(2020, 1, 1)
    raw = []
    for i in range(240):
        hours = 200 if i % 12 == 0 else i % 24
        diagnosis = "S72.1" if i % 4 else "I10"
        procedure = ["nail", "plate", "scan"][i % 3]
        priority = PRIORITIES[i % 2] if procedure == "nail" else PRIORITIES[i // 3 % 4]
        raw.append((f"s{i}", "MF"[i % 2], float(i % 90), start, start + dt.timedelta(hours=hours), dt.date(2020, 1, 2), "text",
                    priority, f"c{i % 7}", i, procedure, "cast" if i % 5 == 0 else None, diagnosis, None))
    rows(COLUMNS, *raw).write.option("header", True).csv(str(tmp_path / "bookings"))
    rows("achi_proc_code string, procedure_text string, block_number int, block_text string",
         ("nail", "Nail", 1, "x"), ("plate", "Plate", 1, "x"), ("cast", "Cast", 1, "x"), ("scan", "Scan", 1950, "x")
         ).write.option("header", True).csv(str(tmp_path / "codes"))

    study = bookings.prepare_bookings(readers.read_study(spark, str(tmp_path / "bookings"), "csv"))
    writers.write_stage(study, str(tmp_path / "stage"))
    study = readers.read_stage(spark, str(tmp_path / "stage"))
    assert study.count() == 220  # twenty were booked too late
    table = spark.read.option("header", True).csv(str(tmp_path / "codes")).withColumn("block_number", F.expr("cast(block_number as int)"))
    trauma = cohort.keep_cohort(study, cohort.trauma_cohort(study))
    writers.write_label_sheet(procedures.procedure_check_sheet(trauma, table).withColumn("correct", F.expr(
        "if(achi_proc_code = 'cast', 'no', 'yes')")), str(tmp_path / "sheet"))
    labels = readers.read_labels(spark, str(tmp_path / "sheet"))
    keep = ["study_id", "episode_number", "age", "sex", "procedural_consultant", "emerg_priority_collapse", "admit_to_book_pd"]
    long = procedures.attach_labels(trauma, labels, keep)
    rated = codes.drop_excluded(long, codes.excluded_procedure_codes(table), "booked_procedure")
    ratings = procedures.labelled_procedures(rated)

    expected = [r for r in raw if r[12] == "S72.1" and r[4] - r[3] <= dt.timedelta(hours=24) and r[10] != "scan"]
    assert ratings.count() == len(expected)
    full = {r.booked_procedure: r for r in lists.procedure_urgency(ratings, 75, 0.7, cohort="trauma").collect()}
    oldest = max(r[2] for r in expected)
    for name in ("nail", "plate"):
        mine = [r for r in expected if r[10] == name and r[2] < oldest]
        assert full[name].proc_n == len(mine)
        share = sum(r[7] in PRIORITIES[:2] for r in mine) / len(mine)
        assert abs(full[name].urgent_total_pcnt - 100 * share) <= 0.11
    assert set(full) == {"nail", "plate"} and full["nail"].urgent_surgery_by_agmnt

    by_age = lists.urgency_lists(ratings, lists.age_members())
    writers.write_lists(compare.published_lists(by_age, table), str(tmp_path / "lists"), "csv")
    published = spark.read.option("header", True).csv(str(tmp_path / "lists"))
    assert published.filter("list_name = 'full list by agreement' and achi_code = 'nail'").count() == 1


def test_named_lists(rows):
    got = compare.named_lists({"one": rows("a int, b int", (1, 2)), "two": rows("a int", (3,))}).collect()
    assert sorted((r.list_name, r.a, r.b) for r in got) == [("one", 1, 2), ("two", 3, None)]
