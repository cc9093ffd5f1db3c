"""Registered queries: SQL oracle, reference counts, plan shape."""

import os
import re

import pytest

import __spark_entry__ as entry
from acuity.operators import lists
from acuity.plans import tables
from acuity.plans.oracle import ORACLE
from acuity.plans.queries import QUERIES
from tests.oracle_check import compare, connect

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_contract(spark):
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)
    assert set(QUERIES) == set(ORACLE)
    assert entry.entry(spark).columns[:1] == ["booked_procedure"]


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", list(ORACLE))
def test_plan_has_no_product_and_no_python_rows(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # row-at-a-time Python
    # a window or exchange into one task is fine for a total or a sorted report, never for rows
    for above in re.findall(r"Exchange SinglePartition.*\n(.*)", plan):
        assert "Aggregate" in above or "Scan parquet" in above, above


def final_plan(df):
    """The plan that ran, without the initial plans that AQE prints below it."""
    df.collect()
    kept, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if hidden is not None and (depth >= hidden or "== Initial Plan" in line):
            continue
        hidden = depth if "== Initial Plan" in line else None
        if hidden is None:
            kept.append(line)
    return "\n".join(kept)


DEFAULT_BOUNDS = ["procedure_urgency", "class_cross_table", "level_boxplot_stats", "urgent_list_agreement", "age_range_default_bounds",
                  "cutoff_density", "threshold_sweep", "all_patients_trauma_flag"]


@pytest.mark.parametrize("name", DEFAULT_BOUNDS)
def test_default_bounds_cost_no_second_pass(spark, name):
    """The oldest age comes from the shuffle of the list itself."""
    plan = final_plan(QUERIES[name](spark, SMALL))
    assert plan.count("FileScan parquet [l_") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("name", [*DEFAULT_BOUNDS, "age_group_lists", "age_group_diff", "sex_lists", "published_lists", "published_sex_lists",
                                  "urgent_specialty_freq", "specialty_lists", "demographics", "booked_set_union"])
def test_building_a_query_runs_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    QUERIES[name](spark, SMALL)
    # reading a Parquet footer is no job of the query
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"build-{name}")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tables_read = 9
    assert len(jobs) <= tables_read and all(len(j.stageIds) == 1 for j in jobs)


@pytest.mark.parametrize("name", ["model_cells_whole_cohort", "rater_counts", "level_counts_wide", "demographics", "booked_set_union"])
def test_ratings_are_read_once(spark, name):
    assert final_plan(QUERIES[name](spark, SMALL)).count("FileScan parquet [l_") == 1


def test_demographics_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(QUERIES["demographics"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\n[ :]*(?:\+- )?Exchange hashpartitioning", plan)) <= 9 and plan.count("FileScan parquet [l_") == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["level_counts_wide"](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert not any("l_shipdate" in s or "l_suppkey" in s or "o_custkey" in s for s in schemas)
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan


def test_known_counts(spark):
    """Class sizes of the full list without age or period limits, and cohort sizes."""
    rows = tables.ratings(spark, MEDIUM).selectExpr("* except (admit_to_book_pd)", "'same day' as admit_to_book_pd", "false as trauma")
    listed = lists.procedure_urgency(rows, 75, 0.7, percent_digits=None, closed_upper=True)
    agreed, consensus = listed.filter("urgent_surgery_by_agmnt").count(), listed.filter("urgent_surgery_by_cnsus").count()
    assert (agreed, consensus, listed.count()) == (851, 731, 2000)
    assert QUERIES["trauma_first_code"](spark, MEDIUM).count() == 3222
    assert QUERIES["trauma_any_code"](spark, MEDIUM).count() == 8722
    assert QUERIES["diagnosis_codes_long"](spark, MEDIUM).count() == 52167
    assert QUERIES["excluded_codes"](spark, MEDIUM).count() == 934
