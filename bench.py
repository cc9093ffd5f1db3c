"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default 8),
``BENCH_RUNS`` (default 2) timed runs after one warm-up; the best run counts.
``BENCH_QUERIES`` names other queries, or ``all``.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from acuity.plans.queries import QUERIES

HEADLINE = [
    "booking_period_freq", "first_case_per_admission", "diagnosis_codes_long", "trauma_first_code", "trauma_any_code",
    "null_out_excluded", "procedure_check_sheet", "labelled_procedures", "label_recapture", "text_common_words",
    "booked_set_union", "rater_counts", "level_counts_wide", "ordinal_agreement", "exact_binomial_ci",
    "procedure_urgency", "trauma_urgency", "level_distribution", "level_boxplot_stats", "age_group_lists",
    "age_group_diff", "published_lists", "threshold_sweep", "cutoff_density", "age_profile", "demographics",
    "urgent_specialty_freq", "model_cells", "random_intercept_odds", "model_lrt",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split() or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name](spark, sf_dir))
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "sum of best query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
