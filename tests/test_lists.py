"""Urgency lists, comparison, sweeps, distributions, profiles."""

import pytest

from acuity import schema as S
from acuity.operators import compare, demographics as demo, distribution as dist, lists, raters, sweep
from acuity.operators.frequency import freq_table, most_frequent_first
from acuity.sources import writers

RATING = ("study_id long, booked_procedure string, procedural_consultant string, age double, sex string, specialty string, "
          "emerg_priority_collapse string, admit_to_book_pd string, primary_proc boolean, trauma boolean")


def rating(booked, level, n=1, age=40.0, sex="M", rater="r", primary=False, trauma=False, period="same day", study=1, specialty="s"):
    return [(study, booked, rater, age, sex, specialty, level, period, primary, trauma)] * n


def spread(booked, counts, **more):
    return [r for level, n in zip(S.LEVELS, counts) for r in rating(booked, level, n, **more)]


def by_key(df, *columns):
    return {r["booked_procedure"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_list_of_one_procedure(rows):
    data = spread("p", [1, 2, 3, 0, 0], primary=True) + spread("q", [0, 0, 0, 0, 4], trauma=True) + rating("z", None, 3)
    got = lists.procedure_urgency(rows(RATING, *data), 75, 0.7, age_lower=0, age_upper=110)
    assert got.columns == lists.LIST_COLUMNS
    p = {r.booked_procedure: r for r in got.collect()}
    assert sorted(p) == ["p", "q"]  # z has no level at all
    assert [p["p"][level] for level in S.LEVELS] == [16.7, 33.3, 50.0, 0.0, 0.0]
    assert (p["p"].urgent_total_pcnt, p["p"].proc_n, p["p"].urgent_total_pcnt_CI) == (50.0, 6, "12 to 88")
    assert (p["p"].primary_proc, p["p"].trauma, p["q"].primary_proc, p["q"].trauma) == (True, False, False, True)


def test_cohort_sets_the_flag(rows):
    df = rows(RATING, *spread("p", [1, 0, 0, 0, 0]))
    assert lists.procedure_urgency(df, 75, 0.7, age_upper=99, cohort="trauma").first().trauma is True
    with pytest.raises(ValueError):
        lists.procedure_urgency(df, 75, 0.7, cohort="some")


def test_only_same_day_and_age(rows):
    data = rating("p", "<1hr", period="same week") + rating("p", "<4hrs", age=None) + rating("p", "<8hrs", age=16.0) + rating("p", "<24hrs", age=15.9)
    got = lists.procedure_urgency(rows(RATING, *data), 75, 0.7, age_upper=16)
    assert [r.proc_n for r in got.collect()] == [1]


@pytest.mark.parametrize("closed, kept", [(False, [5.0, 40.0]), (True, [5.0, 40.0, 90.0])])
def test_default_age_bound(rows, closed, kept):
    df = rows(RATING, *[r for a in (5.0, 40.0, 90.0, None) for r in rating("p", "<1hr", age=a)])
    cells = lists.with_oldest(df.groupBy("age").count())
    assert sorted(r.age for r in cells.filter(lists.default_age_range(closed_upper=closed)).collect()) == kept
    assert tuple(lists.age_bounds(df).first()) == (5.0, 90.0)


def test_age_bound_comes_from_unfiltered_rows(rows):
    """The oldest patient sets the bound even if the booking itself is not a same-day one."""
    df = rows(RATING, *rating("p", "<1hr", age=80.0), *rating("p", "<1hr", age=90.0, period="same week"))
    assert lists.procedure_urgency(df, 75, 0.7).first().proc_n == 1


def test_classes(spark):
    values = [(75.0, 0.1), (74.9, 0.69), (74.9, 0.70), (50.0, 0.1), (50.1, 0.1), (None, None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, urgent_total_pcnt double, Consensus double")
    got = df.orderBy("i").selectExpr(lists.by_agreement(75), lists.by_consensus(75, 0.7)).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, False), (False, True), (False, False)]


@pytest.mark.parametrize("urgency, expected", [(1, 20.0), (4, 40.0), (8, 60.0), (24, 80.0), (72, 100.0)])
def test_urgency_windows(rows, urgency, expected):
    df = rows(RATING, *spread("p", [1, 1, 1, 1, 1]))
    assert lists.procedure_urgency(df, 75, 0.7, urgency, age_upper=99).first().urgent_total_pcnt == expected


def test_unknown_window(rows):
    with pytest.raises(ValueError):
        lists.procedure_urgency(rows(RATING, *spread("p", [1, 1, 1, 1, 1])), 75, 0.7, 12)


def test_percents_sum_to_100(rows):
    df = rows(RATING, *[r for i in range(30) for r in spread(f"p{i}", [i % 4, i % 3, 1, i % 5, i % 7])])
    for r in lists.with_percents(lists.level_counts(df)).collect():
        assert sum(r[level] for level in S.LEVELS) == pytest.approx(100, abs=0.25)


def test_list_does_not_depend_on_layout(rows):
    data = [r for i in range(20) for r in spread(f"p{i}", [i % 4, i % 3, 1, i % 5, i % 7], age=float(i))]
    one = lists.procedure_urgency(rows(RATING, *data), 75, 0.7).collect()
    two = lists.procedure_urgency(rows(RATING, *data[::-1]).repartition(7), 75, 0.7).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


@pytest.fixture(scope="module")
def many(spark):
    """Two hundred procedures, one of them with a third of all rows."""
    data = []
    for i in range(200):
        for age in (5.0, 30.0, 50.0, 70.0, 96.0):
            counts = [(i + int(age)) % 3, (i * 7 + int(age)) % 5, i % 2, (i * 3 + int(age)) % 4, i % 3]
            data += spread(f"p{i:03d}", counts, age=age, sex="MF"[(i + int(age)) % 2], primary=i % 4 == 0)
    data += [r for age in (5.0, 50.0, 70.0) for r in spread("p000", [700, 300, 200, 50, 20], age=age)]
    return spark.createDataFrame(data, RATING).repartition(6).cache()


def test_lists_side_by_side_equal_single_lists(many):
    stacked = lists.urgency_lists(many, lists.age_members() | lists.sex_members())
    single = {
        "full": lists.procedure_urgency(many, 75, 0.7, cohort="trauma"),
        "paeds": lists.procedure_urgency(many, 75, 0.7, age_upper=16, cohort="trauma"),
        "adult": lists.procedure_urgency(many, 75, 0.7, age_lower=16, age_upper=65, cohort="trauma"),
        "elderly": lists.procedure_urgency(many, 75, 0.7, age_lower=65, cohort="trauma"),
        "male": lists.procedure_urgency(many.filter("sex = 'M'"), 75, 0.7, age_upper=96, cohort="trauma"),
        "female": lists.procedure_urgency(many.filter("sex = 'F'"), 75, 0.7, age_upper=96, cohort="trauma"),
    }
    for name, expected in single.items():
        got = stacked.filter(stacked.list_name == name).drop("list_name")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())), name


@pytest.fixture(scope="module")
def code_text(many):
    return many.selectExpr("booked_procedure as achi_proc_code", "concat('text ', booked_procedure) as procedure_text",
                           "'block' as block_text").distinct()


def test_differences_equal_anti_joins(many, code_text):
    stacked = lists.urgency_lists(many, lists.age_members())
    listed = compare.urgent_list(compare.with_code_text(stacked, code_text))
    full = listed.filter("list_name = 'full'").drop("list_name")
    at_once = compare.with_code_text(compare.list_differences(stacked), code_text).withColumnRenamed("booked_procedure", "achi_code")
    for group in ("adult", "elderly", "paeds"):
        pair = compare.compare_lists(full, listed.filter(f"list_name = '{group}'").drop("list_name"), group)
        got = at_once.filter(f"diff_name = '{compare.DIFFERENCE_NAMES[group]}'").select(pair.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pair.collect()))
        assert pair.count() > 0


def test_compare_lists_partitions_the_symmetric_difference(rows):
    typed = "achi_code string, urgent_total_pcnt double"
    got = compare.compare_lists(rows(typed, ("a", 1.0), ("b", 1.0), (None, 1.0)), rows(typed, ("b", 2.0), ("c", 2.0), (None, 2.0)), "elderly")
    assert {r.achi_code: r.procedure_list for r in got.collect()} == {"a": "not specific to elderly", "c": "elderly patients only"}


def test_published_lists(spark, many, code_text, tmp_path):
    stacked = lists.urgency_lists(many, lists.age_members())
    published = compare.published_lists(stacked, code_text)
    urgent = compare.urgent_list(compare.with_code_text(stacked, code_text))
    counts = {r.list_name: r["count"] for r in published.groupBy("list_name").count().collect()}
    assert counts["full list by agreement"] == urgent.filter("list_name = 'full'").count()
    assert counts["diff proc bw paeds and full"] == compare.list_differences(stacked, ["paeds"]).count()
    names = {n for d in (compare.AGREEMENT_NAMES, compare.CONSENSUS_NAMES, compare.DIFFERENCE_NAMES) for n in d.values()}
    assert len(names) == 11 and set(counts) <= names
    writers.write_lists(published, str(tmp_path / "lists"))
    back = spark.read.parquet(str(tmp_path / "lists"))
    assert back.count() == published.count() and set(back.columns) == set(published.columns)


def test_sweep_equals_single_lists(many):
    listed = lists.procedure_urgency(many, 75, 0.7)
    got = {(r.a_th, r.c_th): (r.n_by_agreement, r.n_by_consensus) for r in sweep.threshold_sweep(listed).collect()}
    assert len(got) == 12
    for (a, c), counts in list(got.items())[::4]:
        again = lists.procedure_urgency(many, a, c)
        assert counts == (again.filter("urgent_surgery_by_agmnt").count(), again.filter("urgent_surgery_by_cnsus").count())
    nothing = sweep.threshold_sweep(listed, [101], [0.0]).first()
    assert (nothing.n_by_agreement, nothing.n_by_consensus) == (0, 0)


def test_cutoffs_and_levels(many):
    flagged = sweep.consensus_cutoffs(lists.procedure_urgency(many, 75, 0.7))
    for cut in sweep.CUTOFFS:
        expected = lists.procedure_urgency(many, 80, cut).filter("urgent_surgery_by_cnsus").count()
        assert flagged.filter(flagged.cons_cutoff == cut).count() == expected
    long = dist.levels_long(flagged, ["booked_procedure", "cons_cutoff"])
    assert long.count() == 5 * flagged.count()


def test_rater_counts(rows):
    data = rating("p", "<1hr", rater="a") + rating("p", "<1hr", rater="a", age=50.0) + rating("p", "<1hr", rater=None, age=50.0)
    data += rating("q", "<1hr", age=None) + rating("q", "<1hr", age=1.0) + rating("r", "<1hr", age=1.0) + rating("r", "<1hr", age=2.0, rater="b")
    got = by_key(raters.rater_counts(rows(RATING, *data)), "num_of_raters", "num_of_unique_raters", "age")
    assert got == {"p": (3, 2, 50.0), "q": (2, 1, None), "r": (2, 2, 1.5)}
    counts = raters.rater_count_of_counts(raters.rater_counts(rows(RATING, *data)))
    assert [tuple(r) for r in counts.collect()] == [(2, 2), (1, 1)]


def test_distinct_sizes_count_missing(rows):
    data = rating("p", "<1hr", rater="a") + rating("q", "<1hr", rater=None, study=2) + rating(None, "<1hr", study=2)
    assert tuple(raters.distinct_sizes(rows(RATING, *data)).first()) == (3, 3, 2)


def test_both_sexes(rows):
    data = [r for p, sexes in {"a": "MF", "b": "MM", "c": ["M", "F", None]}.items() for s in sexes for r in rating(p, "<1hr", sex=s)]
    assert by_key(raters.model_eligibility(rows(RATING, *data), 1), "num_of_raters") == {"a": 2}
    assert len(by_key(raters.model_eligibility(rows(RATING, *data), 3, both_sexes=False), "num_of_raters")) == 1


def test_freq_tables(rows):
    df = rows("a string, b string", ("x", "u"), ("x", "v"), ("x", "u"), ("y", "u"), (None, "u"), ("x", None))
    assert {r.a: (r.n, r.prop) for r in freq_table(df, "a").collect()} == {"x": (4, 80.0), "y": (1, 20.0)}
    assert {(r.a, r.b): (r.n, r.prop) for r in freq_table(df, "a", "b").collect()} == {
        ("x", "u"): (2, 66.7), ("x", "v"): (1, 33.3), ("y", "u"): (1, 100.0)}
    assert [r.a for r in most_frequent_first(freq_table(df, "a")).collect()] == ["x", "y"]


def test_quartiles_are_linear(rows):
    df = rows("v double", (1.0,), (2.0,), (3.0,), (10.0,), (None,))
    r = dist.numeric_profile(df, ["v"]).first()
    assert (r.N, r.missing, r["25 centile"], r["median"], r["75 centile"], r["min"], r["max"]) == (4, 0.2, 1.75, 2.5, 4.75, 1.0, 10.0)
    assert (r["mean"], r.sd, r.IQR) == (4.0, pytest.approx(4.082483), 3.0)


def test_boxplot_and_distribution(rows):
    levels = ", ".join(f"`{level}` double" for level in S.LEVELS)
    df = rows(f"booked_procedure string, {levels}", *[(str(i), float(v), 0.0, 0.0, 0.0, 0.0) for i, v in enumerate([1, 2, 3, 4, 5, 50])])
    box = {r.urgency: r for r in dist.level_boxplot_stats(df).collect()}["<1hr"]
    assert (box.whisker_low, box.q25, box["median"], box.q75, box.whisker_high, box.n_outliers) == (1.0, 2.25, 3.5, 4.75, 5.0, 1)
    table = {r.urgency: r for r in dist.level_distribution(df).collect()}["<1hr"]
    assert (table.median_pct, table.IQR_pct) == (3.5, 2.5)


def bins(df, width):
    return {(r.bin_from, r.bin_to): r.n for r in dist.histogram(df, "v", width).collect()}


def test_histogram_is_right_closed_and_counts_every_row(rows):
    assert bins(rows("v double", (0.0,), (5.0,), (5.1,), (10.0,), (None,), (23.0,)), 5) == {
        (0.0, 5.0): 2, (5.0, 10.0): 2, (10.0, 15.0): 0, (15.0, 20.0): 0, (20.0, 25.0): 1, (None, None): 1}
    assert bins(rows("v int", (-1,), (5,), (55,), (101,)), 50) == {(-50.0, 0.0): 1, (0.0, 50.0): 1, (50.0, 100.0): 1, (100.0, 150.0): 1}
    assert bins(rows("v int", (5,), (6,)), 5) == {(5.0, 10.0): 2} and bins(rows("v int", (5,)), 5) == {(5.0, 10.0): 1}
    assert bins(rows("v int", (None,)), 5) == {(None, None): 1} and bins(rows("v int"), 5) == {}


def test_quartiles_by_rank_equal_the_plain_ones(spark, rows):
    import numpy as np
    rng = np.random.default_rng(0)
    data = [("a", float(v)) for v in rng.normal(size=501)] + [("b", float(v)) for v in rng.integers(0, 4, 400)] + [("c", 1.0), ("d", None)]
    counts = dist.value_counts(rows("k string, v double", *data), ["k"], "v")
    got = {r.k: list(r.q) for r in dist.quartiles(counts, "k", "v").collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        assert got[k] == pytest.approx(np.quantile([v for g, v in data if g == k], [0.25, 0.5, 0.75]))


def test_density_integrates_to_one(rows):
    df = rows("k string, pcnt double", *[("a", float(v)) for v in (40, 45, 50, 50, 60)], ("b", 50.0), ("c", 30.0), ("c", 30.0))
    got = dist.level_density(df, ["k"], points=1001).groupBy("k").sum("density").collect()
    assert {r.k: r["sum(density)"] * 0.1 for r in got} == pytest.approx({"a": 1, "b": 1, "c": 1}, abs=1e-3)


def test_demographics(rows):
    typed = "study_id string, booked_procedure string, age double, sex string, asa string, specialty string, emerg_priority_collapse string, n int"
    df = rows(typed, *[(s, p, 1.0, "M", "1", "x", "<1hr", n) for s, p, n in
                       [("a", "p", 1), ("b", "q", 2), ("b", "p", 1), ("c", "r", 1), ("d", "p", 1), ("e", None, 1)]])
    def trauma(cohort):
        got = demo.demographics(df, ["n"], "study_id = 'a'", "study_id in ('a', 'd')", cohort)
        return {r.study_id: r.trauma for r in got.collect()}
    assert trauma(False) == {"b": True, "c": False, "d": True, "e": False} and trauma(True) == {"a": True}


def test_urgent_specialties(rows):
    data = rating("p", "<1hr", 5, specialty="Colorectal SN") + rating("p", "<1hr", specialty="Upper GI") + rating("q", "<1hr", specialty="ENT")
    got = demo.urgent_specialty_freq(rows(RATING, *data, *rating("z", "<1hr")), rows("achi_code string", ("p",), ("q",))).collect()
    assert [(r.specialty, r.n, r.prop) for r in got] == [("General Surgery", 2, 66.7), ("ENT", 1, 33.3)]


def test_lists_of_any_group_can_be_compared(rows):
    data = [r for sex in "MF" for i in range(4) for r in rating("p" if sex == "M" else "q", "<1hr", sex=sex, study=i)]
    members = {"full": "sex is not null", "male": "sex = 'M'", "left handed": "false"}
    stacked = lists.urgency_lists(rows(RATING, *data), members)
    got = compare.list_differences(stacked, ["male", "left handed"]).collect()
    assert {(r.diff_name, r.procedure_list, r.booked_procedure) for r in got} == {
        ("diff proc bw male and full", "not specific to male patients", "q"),
        ("diff proc bw left handed and full", "not specific to left handed patients", "p"),
        ("diff proc bw left handed and full", "not specific to left handed patients", "q")}
    one = compare.urgent_list(compare.with_code_text(stacked.filter("list_name = 'male'"), rows("achi_proc_code string, procedure_text string, block_text string"))).drop("list_name")
    assert compare.compare_lists(one, one, "left handed").collect() == []


def test_one_comparison_reads_the_ratings_like_the_lists(spark):
    from acuity.plans import queries
    folder = "/root/testdata/sf0.001"
    def scans(name, table):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        return sum("Relation [" in line and {"lineitem": "l_orderkey#", "orders": "o_orderkey#"}[table] in line for line in plan.splitlines())
    for name in ("age_group_compare", "sex_group_compare"):
        assert 0 < scans(name, "lineitem") <= scans("age_group_lists", "lineitem")
        assert scans(name, "orders") <= scans("age_group_lists", "orders")


def test_exact_distributions_hold_no_level_in_a_task(spark):
    """Any number of different percents: the same values as by one window per level, by ranks over all tasks."""
    import random
    rng = random.Random(4)
    levels = [f"`{level}`" for level in S.LEVELS]
    data = [(f"p{i}", *[rng.choice([rng.random() * 100, 50.0, None]) for _ in levels]) for i in range(400)]
    listed = spark.createDataFrame(data, "booked_procedure string, " + ", ".join(f"{level} double" for level in levels)).repartition(7)

    def near(a, b):
        a, b = (sorted(map(tuple, df.collect()), key=str) for df in (a, b))
        assert len(a) == len(b) > 0 and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))
    near(dist.level_distribution(listed, exact=True), dist.level_distribution(listed))
    near(dist.level_boxplot_stats(listed, exact=True), dist.level_boxplot_stats(listed))
    long = dist.levels_long(listed).filter("pcnt is not null")
    near(dist.level_density(long, ["urgency"], exact=True).orderBy("urgency", "x"), dist.level_density(long, ["urgency"]).orderBy("urgency", "x"))
    for df in (dist.level_distribution(listed, exact=True), dist.level_boxplot_stats(listed, exact=True), dist.level_density(long, ["urgency"], exact=True)):
        windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
        assert windows and all("_part#" in line or "sum(_n#" in line for line in windows)  # per task, or over one row per task and level
    assert dist.level_distribution(listed.filter("false"), exact=True).collect() == []
