"""Registered queries: every operator of the package on the whole test tables."""

import uuid

from pyspark.sql import DataFrame, functions as F

from acuity import schema as S
from acuity.functions import scalars
from acuity.operators import (bookings, cohort, codes as code_ops, compare, demographics as demo, distribution as dist,
                              lists, mixed_logit, model_data, procedures as proc, raters, sweep, text_match)
from acuity.operators.frequency import freq_table
from acuity.plans import tables as t
from acuity.sources import readers, writers

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, so that the order of float sums does not show."""
    return df.selectExpr(*[f"round(`{c}`, 6) as `{c}`" if c in columns else f"`{c}`" for c in df.columns])


def shown3(df: DataFrame, *columns: str) -> DataFrame:
    """Three decimals, for results of an iteration."""
    return df.selectExpr(*[f"round(`{c}`, 3) as `{c}`" if c in columns else f"`{c}`" for c in df.columns])


# --- bookings ----------------------------------------------------------------
@query
def booking_period_freq(spark, sf):
    return freq_table(bookings.with_booking_period(t.event_bookings(spark, sf)), "admit_to_book_pd")


@query
def first_case_per_admission(spark, sf):
    first = bookings.prepare_bookings(t.cases(spark, sf), t.CASE_ORDER, t.ORDER_PRIORITIES)
    return first.select("study_id", "age", "case_date", "episode_number", "booked_procedure",
                        "procedural_consultant", "emerg_priority_collapse")


@query
def priority_collapse_counts(spark, sf):
    level = f"{scalars.collapse_priority('emerg_priority', t.ORDER_PRIORITIES)} as emerg_priority_collapse"
    counted = freq_table(t.study(spark, sf).selectExpr(level), "emerg_priority_collapse")
    return counted.selectExpr("*", f"{scalars.level_rank('emerg_priority_collapse')} as level_rank")


@query
def rater_pseudonym(spark, sf):
    return t.table(spark, sf, "supplier").selectExpr("s_suppkey", f"{scalars.rater_pseudonym('s_name')} as rater")


# --- codes and cohort --------------------------------------------------------
def _excluded(spark, sf):
    return code_ops.excluded_procedure_codes(t.codes(spark, sf), t.EXCLUDED_PART_TYPES, t.EXCLUDED_PART_SIZES,
                                             t.EXCLUDED_PART_KEYS)


@query
def excluded_codes(spark, sf):
    return _excluded(spark, sf)


@query
def null_out_excluded(spark, sf):
    wide = t.episodes(spark, sf).select("study_id", "episode_number", "coded_primary_procedure",
                                        "additional_procedure_1", "additional_procedure_2")
    return code_ops.blank_excluded(wide, _excluded(spark, sf))


@query
def diagnosis_codes_long(spark, sf):
    return cohort.diagnosis_codes(t.study(spark, sf))


@query
def trauma_first_code(spark, sf):
    return cohort.trauma_cohort(t.study(spark, sf), "first", row_order=None)


@query
def trauma_any_code(spark, sf):
    return cohort.trauma_cohort(t.study(spark, sf), "any", row_order=None)


@query
def trauma_any_code_padded(spark, sf):
    return cohort.trauma_cohort(t.study(spark, sf), "any", zero_pad=True, row_order=None)


@query
def trauma_first_code_by_patient(spark, sf):
    """Several admissions per id: the first admission with a surviving code decides."""
    rows = t.study(spark, sf).withColumnsRenamed({"study_id": "episode_number", "patient": "study_id"})
    return cohort.trauma_cohort(rows, "first")


@query
def trauma_cohort_ties(spark, sf):
    """Several admissions per id; some have no order, others share one."""
    rows = t.study(spark, sf).withColumnRenamed("study_id", "_key").withColumnRenamed("patient", "study_id")
    return cohort.trauma_cohort(rows.withColumn("episode_number", F.expr("if(_key % 3 = 0, null, cast(_key % 2 as bigint))")), "first")


@query
def trauma_cohort_semi(spark, sf):
    lines = t.table(spark, sf, "lineitem").selectExpr("l_orderkey as study_id", "l_linenumber", "l_partkey", "l_suppkey",
                                                      "l_extendedprice")
    return cohort.keep_cohort(lines, trauma_first_code(spark, sf))


@query
def cohort_flag_freq(spark, sf):
    """Cases inside and outside the cohort."""
    lines = t.table(spark, sf, "lineitem").selectExpr("l_orderkey as study_id")
    return freq_table(cohort.flag_cohort(lines, trauma_first_code(spark, sf)), "trauma")


@query
def folded_level_freq(spark, sf):
    level = scalars.collapse_priority("emerg_priority", t.ORDER_PRIORITIES)
    return freq_table(t.study(spark, sf).selectExpr(f"{scalars.fold_top_level(level)} as level"), "level")


# --- files: written, then read by the readers ---------------------------------
def _new_folder(spark):
    return f"{writers.shared_folder(spark)}/acuity-query-{uuid.uuid4().hex}"


@query
def study_from_csv(spark, sf):
    """Admissions as two CSV parts whose columns differ in order and number."""
    rows = t.study(spark, sf).selectExpr("cast(study_id as string) as study_id", "age", "sex", "admit_dt_tm", "principle_diagnosis",
                                         "additional_diagnosis_1")
    folder = _new_folder(spark)
    first, second = rows.filter("sex = 'F'"), rows.filter("sex = 'M'").select("sex", "study_id", "principle_diagnosis", "age")
    for part in (first, second):
        part.write.mode("append").option("header", True).csv(folder)
    return readers.read_study(spark, folder, "csv").select(rows.columns).withColumn("admit_dt_tm", F.to_date("admit_dt_tm"))


@query
def procedure_codes_from_csv(spark, sf):
    folder = _new_folder(spark)
    t.codes(spark, sf).selectExpr("cast(achi_proc_code as string) as achi_proc_code", "block_number", "procedure_text").write.option(
        "header", True).csv(folder)
    return readers.read_procedure_codes(spark, folder, "csv")


@query
def diagnosis_codes_from_parquet(spark, sf):
    folder = _new_folder(spark)
    names = [f.name for f in S.DIAGNOSIS_CODES]
    t.table(spark, sf, "nation").selectExpr("cast(n_nationkey as string) as three_dgt_no", "n_name as three_dgt_text",
                                            *[f"cast(null as string) as {n}" for n in names if not n.startswith("three")]).write.parquet(folder)
    return readers.read_diagnosis_codes(spark, folder)


@query
def label_sheet_round_trip(spark, sf):
    """The sheet as CSV, filled in, read back."""
    folder = _new_folder(spark)
    sheet = t.labels(spark, sf).selectExpr("cast(study_id as string) as study_id", "cast(achi_proc_code as string) as achi_proc_code",
                                           "correct", "primary_proc", "'ignored' as note")
    writers.write_label_sheet(sheet, folder)
    return readers.read_labels(spark, folder)


@query
def stage_hand_off(spark, sf):
    """Labelled rows of one site through the hand-off table."""
    folder = _new_folder(spark)
    writers.write_stage(proc.attach_labels(t.episodes(spark, sf), t.labels(spark, sf), ["study_id", "episode_number"], site=3), folder)
    return readers.read_stage(spark, folder)


# --- procedures and labels ---------------------------------------------------
@query
def procedure_check_sheet(spark, sf):
    return proc.procedure_check_sheet(t.episodes(spark, sf), t.codes(spark, sf))


def _labelled(spark, sf, keep=("study_id", "episode_number")):
    return proc.attach_labels(t.episodes(spark, sf), t.labels(spark, sf), list(keep))


@query
def labels_attached(spark, sf):
    return _labelled(spark, sf)


@query
def label_primary_freq(spark, sf):
    return freq_table(_labelled(spark, sf), "primary_proc")


@query
def label_correct_freq(spark, sf):
    return freq_table(_labelled(spark, sf), "primary_proc", "correct")


@query
def label_recapture(spark, sf):
    return proc.label_recapture(_labelled(spark, sf))


@query
def labelled_procedures(spark, sf):
    return proc.labelled_procedures(_labelled(spark, sf))


@query
def unique_row_ids(spark, sf):
    rows = _labelled(spark, sf).select("study_id", "booked_procedure", "episode_number", "proc_no")
    return proc.with_unique_id(rows, ["episode_number", "proc_no", "booked_procedure"])


@query
def text_common_words(spark, sf):
    return text_match.common_words(*t.free_texts(spark, sf))


@query
def text_best_match(spark, sf):
    return text_match.best_match(text_common_words(spark, sf))


def _planned(spark, sf):
    return t.table(spark, sf, "conversations").selectExpr("conv_id as study_id", "text")


def _primary(spark, sf):
    return t.table(spark, sf, "documents").selectExpr("doc_id as study_id", "text")


def _item_codes(spark, sf):
    return t.table(spark, sf, "benchmark").selectExpr("item_id as code", "text as code_text")


@query
def text_code_match(spark, sf):
    """The best of all code texts for every primary text."""
    return text_match.best_codes(_primary(spark, sf), _item_codes(spark, sf))


@query
def booked_set_from_text(spark, sf):
    """Primary and planned texts matched with the whole code table, without excluded codes."""
    codes = _item_codes(spark, sf)
    excluded = codes.filter("code_text rlike 'q'").select("code")
    return proc.booked_set([text_match.best_codes(texts, codes) for texts in (_primary(spark, sf), _planned(spark, sf))], excluded)


def _booked(spark, sf):
    coded = proc.booked_columns(t.episodes(spark, sf), ["coded_primary_procedure", "additional_procedure_2"])
    return proc.booked_set(coded, _excluded(spark, sf))


@query
def booked_set_union(spark, sf):
    return _booked(spark, sf)


@query
def procedures_per_study(spark, sf):
    return proc.procedures_per_study(_booked(spark, sf))


@query
def most_procedures(spark, sf):
    return proc.most_procedures(_booked(spark, sf))


@query
def missing_booked(spark, sf):
    return proc.missing_booked(_booked(spark, sf))


@query
def booked_not_missing(spark, sf):
    return proc.drop_missing_booked(_booked(spark, sf))


# --- raters and levels -------------------------------------------------------
@query
def rater_counts(spark, sf):
    return raters.rater_counts(t.ratings(spark, sf))


@query
def rater_count_of_counts(spark, sf):
    return raters.rater_count_of_counts(raters.rater_counts(t.ratings(spark, sf)))


@query
def distinct_sizes(spark, sf):
    return raters.distinct_sizes(t.ratings(spark, sf))


@query
def level_freq(spark, sf):
    return freq_table(t.ratings(spark, sf), "booked_procedure", "emerg_priority_collapse")


@query
def level_counts_wide(spark, sf):
    return lists.level_counts(t.ratings(spark, sf)).drop("trauma")


def _percents(spark, sf):
    return lists.with_percents(lists.level_counts(t.ratings(spark, sf)))


@query
def level_percent_wide(spark, sf):
    return _percents(spark, sf).select("booked_procedure", "proc_n", *[f"`{level}`" for level in S.LEVELS])


@query
def ordinal_consensus(spark, sf):
    listed = lists.with_ordinal(lists.level_counts(t.ratings(spark, sf)))
    return shown(listed.select("booked_procedure", "Consensus"), "Consensus")


@query
def ordinal_agreement(spark, sf):
    listed = lists.with_ordinal(lists.level_counts(t.ratings(spark, sf)))
    return shown(listed.select("booked_procedure", "Agreement"), "Agreement")


@query
def urgent_percent_by_window(spark, sf):
    out = _percents(spark, sf)
    for hours in S.URGENCY_WINDOWS:
        out = lists.with_urgent_percent(out, hours).withColumnRenamed("urgent_total_pcnt", f"within_{hours}")
    windows = [f"within_{hours}" for hours in S.URGENCY_WINDOWS]
    return shown(out.select("booked_procedure", *windows), *windows)


@query
def exact_binomial_ci(spark, sf):
    listed = lists.with_interval(lists.level_counts(t.ratings(spark, sf)))
    return listed.select("booked_procedure", "urgent_total_pcnt_CI")


# --- lists -------------------------------------------------------------------
def _flagged_ratings(spark, sf):
    """Ratings with the trauma status of their admission, decided before admissions and cases are joined."""
    admissions = t.study(spark, sf)
    diagnoses = S.diagnosis_columns(admissions.columns)
    flag = F.coalesce(cohort.row_trauma_flag(diagnoses), F.lit(False))
    return t.ratings(spark, sf, admissions.withColumn("trauma", flag).drop(*diagnoses))


def _full_list(spark, sf, **options):
    return lists.procedure_urgency(_flagged_ratings(spark, sf), 75, 0.7, **options)


def _list_shown(listed):
    return shown(listed, *S.LEVELS, "Agreement", "Consensus", "urgent_total_pcnt")


@query
def procedure_urgency(spark, sf):
    return _list_shown(compare.with_code_text(_full_list(spark, sf), t.codes(spark, sf)))


@query
def procedure_urgency_8h_exact(spark, sf):
    """Other window, exact percents, all ages."""
    return _list_shown(_full_list(spark, sf, urgency=8, percent_digits=None, closed_upper=True))


@query
def all_patients_trauma_flag(spark, sf):
    return freq_table(_full_list(spark, sf).select("trauma"), "trauma")


@query
def all_patients_primary_freq(spark, sf):
    return freq_table(_full_list(spark, sf).select("primary_proc"), "primary_proc")


def _trauma_ratings(spark, sf):
    """Confirmed procedures of trauma studies, from wide episodes: cohort, exclusions, labels."""
    keep = ["study_id", "episode_number", "age", "sex", "procedural_consultant", "l_extendedprice", "emerg_priority_collapse",
            "admit_to_book_pd"]
    trauma = cohort.keep_cohort(t.episodes(spark, sf), trauma_first_code(spark, sf))
    # one fixed way to join: chosen while it runs, it may differ for the oldest age, and the cells would be counted twice
    rows = proc.attach_labels(trauma, t.labels(spark, sf), keep, excluded=_excluded(spark, sf).hint("shuffle_hash"))
    return proc.labelled_procedures(rows, ["episode_number", "proc_no", "procedural_consultant", "l_extendedprice"])


@query
def trauma_urgency(spark, sf):
    """From wide episodes to the trauma list."""
    return _list_shown(lists.procedure_urgency(_trauma_ratings(spark, sf), 75, 0.7, age_lower=0, age_upper=110, cohort="trauma"))


@query
def class_cross_table(spark, sf):
    return freq_table(_full_list(spark, sf), "urgent_surgery_by_agmnt", "urgent_surgery_by_cnsus")


@query
def level_distribution(spark, sf):
    return shown(dist.level_distribution(_full_list(spark, sf)), "median_pct", "IQR_pct", "one_quantile_pcnt",
                 "three_quantile_pcnt")


@query
def level_boxplot_stats(spark, sf):
    return shown(dist.level_boxplot_stats(_full_list(spark, sf)), "whisker_low", "q25", "median", "q75", "whisker_high")


def _exact_list(spark, sf):
    return _full_list(spark, sf, percent_digits=None)


@query
def level_distribution_exact(spark, sf):
    """Of percents that are not rounded: quartiles by rank over all tasks."""
    return shown(dist.level_distribution(_exact_list(spark, sf), exact=True), "median_pct", "IQR_pct", "one_quantile_pcnt",
                 "three_quantile_pcnt")


@query
def level_boxplot_exact(spark, sf):
    return shown(dist.level_boxplot_stats(_exact_list(spark, sf), exact=True), "whisker_low", "q25", "median", "q75", "whisker_high")


@query
def level_density_exact(spark, sf):
    return shown(dist.level_density(dist.levels_long(_exact_list(spark, sf)), ["urgency"], exact=True), "density")


@query
def urgent_list_agreement(spark, sf):
    listed = compare.with_code_text(_full_list(spark, sf), t.codes(spark, sf))
    return shown(compare.urgent_list(listed), "urgent_total_pcnt")


@query
def urgent_list_consensus(spark, sf):
    listed = compare.with_code_text(_full_list(spark, sf), t.codes(spark, sf))
    return shown(compare.urgent_list(listed, "urgent_surgery_by_cnsus"), "urgent_total_pcnt")


@query
def urgent_list_freqs(spark, sf):
    """Trauma and primary-procedure shares of both urgent lists."""
    rows = _full_list(spark, sf)
    flags = "inline(array(struct('urgent_surgery_by_agmnt' as class, urgent_surgery_by_agmnt as _in), " \
            "struct('urgent_surgery_by_cnsus' as class, urgent_surgery_by_cnsus as _in)))"
    urgent = rows.selectExpr("trauma", "primary_proc", flags).filter("_in")
    return freq_table(urgent, "class", "trauma", "primary_proc")


@query
def age_range_default_bounds(spark, sf):
    ages = lists.with_oldest(t.ratings(spark, sf).groupBy("age").agg(F.expr("count(*) as n")))
    inside = lists.default_age_range()
    return ages.agg(F.expr(f"coalesce(sum(if({inside}, n, 0)), 0) as n_inside"), F.expr(f"max(if({inside}, age, null)) as oldest_inside"),
                    F.expr("min(age) as age_min"), F.expr("max(age) as age_max"))


def _age_lists(spark, sf):
    rows = _trauma_ratings(spark, sf)
    return lists.urgency_lists(rows, lists.age_members())


@query
def age_group_lists(spark, sf):
    return _list_shown(_age_lists(spark, sf))


@query
def age_group_diff(spark, sf):
    differences = compare.list_differences(_age_lists(spark, sf))
    listed = compare.with_code_text(differences, t.codes(spark, sf)).withColumnRenamed("booked_procedure", "achi_code")
    return shown(listed.select("diff_name", "procedure_list", *compare.PUBLISHED), "urgent_total_pcnt")


def _compared(spark, sf, group, members):
    """The list of a group against the full one: both stacked from one pass over the ratings."""
    listed = lists.urgency_lists(_trauma_ratings(spark, sf), {"full": lists.default_age_range(), group: members[group]})
    differences = compare.with_code_text(compare.list_differences(listed, [group]), t.codes(spark, sf))
    named = differences.withColumnRenamed("booked_procedure", "achi_code").select(*compare.PUBLISHED, "procedure_list")
    return shown(named, "urgent_total_pcnt")


@query
def age_group_compare(spark, sf):
    return _compared(spark, sf, "elderly", lists.age_members())


@query
def sex_group_compare(spark, sf):
    return _compared(spark, sf, "female", lists.sex_members())


@query
def age_group_diff_trauma_freq(spark, sf):
    return freq_table(compare.list_differences(_age_lists(spark, sf)), "diff_name", "procedure_list", "trauma")


@query
def age_group_diff_primary_freq(spark, sf):
    return freq_table(compare.list_differences(_age_lists(spark, sf)), "diff_name", "procedure_list", "primary_proc")


def _sex_lists(spark, sf):
    members = {"full": lists.default_age_range(), **lists.sex_members()}
    return lists.urgency_lists(_trauma_ratings(spark, sf), members)


@query
def sex_lists(spark, sf):
    return _list_shown(_sex_lists(spark, sf))


@query
def sex_list_compare(spark, sf):
    """Procedures urgent in one of the full and the male or female list only."""
    differences = compare.list_differences(_sex_lists(spark, sf), ["male", "female"])
    return freq_table(differences, "diff_name", "procedure_list", "primary_proc")


@query
def published_sex_lists(spark, sf):
    return shown(compare.published_lists(_sex_lists(spark, sf), t.codes(spark, sf), ["male", "female"]), "urgent_total_pcnt")


@query
def published_lists(spark, sf):
    return shown(compare.published_lists(_age_lists(spark, sf), t.codes(spark, sf)), "urgent_total_pcnt")


@query
def written_lists(spark, sf):
    """The published lists as one folder per list, read back."""
    folder = _new_folder(spark)
    writers.write_lists(compare.published_lists(_age_lists(spark, sf), t.codes(spark, sf)), folder)
    return shown(spark.read.parquet(folder), "urgent_total_pcnt")


# --- thresholds --------------------------------------------------------------
@query
def threshold_sweep(spark, sf):
    return sweep.threshold_sweep(_full_list(spark, sf))


@query
def consensus_cutoffs_long(spark, sf):
    flagged = sweep.consensus_cutoffs(_full_list(spark, sf))
    return shown(dist.levels_long(flagged, ["booked_procedure", "cons_cutoff"]), "pcnt")


@query
def cutoff_density(spark, sf):
    long = dist.levels_long(sweep.consensus_cutoffs(_full_list(spark, sf)), ["booked_procedure", "cons_cutoff"])
    return shown(dist.level_density(long, ["cons_cutoff", "urgency"]), "density")


# --- demographics ------------------------------------------------------------
@query
def age_profile(spark, sf):
    values = ["mean", "sd", "median", "IQR", "25 centile", "75 centile"]
    return shown(dist.numeric_profile(t.study(spark, sf), ["age"]), *values)


@query
def age_histogram(spark, sf):
    return dist.histogram(t.study(spark, sf), "age", 5)


@query
def price_profile(spark, sf):
    """A variable with nearly as many values as rows."""
    values = ["mean", "sd", "median", "IQR", "25 centile", "75 centile"]
    lines = t.table(spark, sf, "lineitem").selectExpr("cast(l_extendedprice as double) as price", "cast(l_quantity as double) as quantity")
    profile = dist.numeric_profile(lines, ["price", "quantity"])
    return profile.selectExpr(*[f"round(`{c}`, 2) as `{c}`" if c in values else f"`{c}`" for c in profile.columns])


@query
def hours_histogram(spark, sf):
    """Hours from order to shipping with missing values; all rows are in one of the bins or missing."""
    rows = t.cases(spark, sf).selectExpr("if(l_linenumber = 3, null, timestampdiff(DAY, admit_dt_tm, emerg_book_dt_tm)) as days")
    return dist.histogram(rows, "days", 7)


def _demographics(spark, sf, inside=False):
    """Flags and specialty belong to the admission and are decided before it meets its cases."""
    admissions = t.study(spark, sf)
    diagnoses = S.diagnosis_columns(admissions.columns)
    flagged = admissions.withColumns({"first_code": cohort.row_trauma_flag(diagnoses), "any_code": cohort.row_trauma_flag(diagnoses, "any")})
    rows = t.ratings(spark, sf, t.with_specialty(flagged.drop(*diagnoses), spark, sf))
    return demo.demographics(rows, t.CASE_ORDER, "first_code and correct = 'yes'", "any_code", inside)


@query
def demographics(spark, sf):
    return _demographics(spark, sf)


@query
def trauma_demographics(spark, sf):
    return _demographics(spark, sf, inside=True)


@query
def demographic_freqs(spark, sf):
    return demo.demographic_freqs(_demographics(spark, sf), ["asa", "trauma", "sex", "emerg_priority_collapse"])


@query
def trauma_demographic_freqs(spark, sf):
    return demo.demographic_freqs(_demographics(spark, sf, inside=True), ["asa", "trauma", "sex", "emerg_priority_collapse"])


@query
def demographic_age_profile(spark, sf):
    values = ["mean", "sd", "median", "IQR", "25 centile", "75 centile"]
    return shown(dist.numeric_profile(_demographics(spark, sf), ["age"]), *values)


@query
def demographic_age_histogram(spark, sf):
    return dist.histogram(_demographics(spark, sf), "age", 5)


@query
def demographic_specialty_freq(spark, sf):
    return demo.specialty_freq(_demographics(spark, sf))


@query
def specialty_freq(spark, sf):
    return demo.specialty_freq(t.with_specialty(t.study(spark, sf), spark, sf))


@query
def urgent_specialty_freq(spark, sf):
    rows = t.with_specialty(t.ratings(spark, sf), spark, sf)
    urgent = _full_list(spark, sf).filter("urgent_surgery_by_agmnt").selectExpr("booked_procedure as achi_code")
    return demo.urgent_specialty_freq(rows, urgent)


@query
def specialty_lists(spark, sf):
    return compare.named_lists({
        compare.SPECIALTY_NAMES["urgent"]: urgent_specialty_freq(spark, sf),
        compare.SPECIALTY_NAMES["study"]: specialty_freq(spark, sf),
    })


# --- models ------------------------------------------------------------------
MIN_RATERS = 8


def _model_cells(spark, sf):
    return model_data.model_cells(_trauma_ratings(spark, sf), MIN_RATERS)


@query
def model_eligibility(spark, sf):
    return raters.model_eligibility(t.ratings(spark, sf))


@query
def model_frame_freq(spark, sf):
    frame = model_data.frame_cells(t.ratings(spark, sf), min_raters=20, both_sexes=False)
    return freq_table(frame, "age_gp", "urgent_yn", weight="n")


@query
def model_cells(spark, sf):
    return model_data.cells_long(_model_cells(spark, sf))


@query
def model_cells_whole_cohort(spark, sf):
    return model_data.cells_long(_whole_cohort_cells(spark, sf), with_trauma=True)


@query
def model_sample_size(spark, sf):
    return model_data.sample_size(_model_cells(spark, sf))


@query
def fixed_effect_odds(spark, sf):
    return mixed_logit.fixed_effect_odds(_model_cells(spark, sf))


def _fits(cells, *terms, **options):
    """Models on the same cell counts, which are written once and deleted after the fits."""
    counts = mixed_logit.prepare_counts(cells)
    try:
        return [mixed_logit.random_intercept_logit(counts, term, **options) for term in terms]
    finally:
        writers.remove(counts)


def _whole_cohort_cells(spark, sf):
    return model_data.model_cells(_flagged_ratings(spark, sf), 20, both_sexes=False, with_trauma=True)


def _odds(spark, sf, terms):
    return mixed_logit.odds_ratios(spark, *_fits(_model_cells(spark, sf), terms))


def _whole_cohort_odds(spark, sf, terms):
    return mixed_logit.odds_ratios(spark, *_fits(_whole_cohort_cells(spark, sf), terms, with_trauma=True))


@query
def random_intercept_odds(spark, sf):
    return _odds(spark, sf, "main")


@query
def interaction_odds(spark, sf):
    return _odds(spark, sf, "interaction")


@query
def whole_cohort_odds(spark, sf):
    return _whole_cohort_odds(spark, sf, "main")


@query
def whole_cohort_interaction_odds(spark, sf):
    return _whole_cohort_odds(spark, sf, "interaction")


def _icc(spark, fit):
    values = (fit.tau ** 2, mixed_logit.icc(fit), mixed_logit.icc(fit, latent=True))
    return spark.createDataFrame([tuple(round(v, 3) for v in values)], "variance double, icc double, icc_latent double")


@query
def icc(spark, sf):
    return _icc(spark, *_fits(_model_cells(spark, sf), "null"))


@query
def whole_cohort_icc(spark, sf):
    return _icc(spark, *_fits(_whole_cohort_cells(spark, sf), "null", with_trauma=True))


def _lrt(spark, fits):
    table = mixed_logit.compare_models(spark, *fits)
    return shown3(table, "AIC", "BIC", "log_lik", "deviance", "chisq", "p_value")


@query
def model_lrt(spark, sf):
    return _lrt(spark, _fits(_model_cells(spark, sf), "null", "main"))


@query
def whole_cohort_lrt(spark, sf):
    return _lrt(spark, _fits(_whole_cohort_cells(spark, sf), "null", "main", with_trauma=True))
