"""The star-schema test tables seen as bookings, codes, labels and ratings.

Every frame is a lazy projection or join of the given tables; nothing is
sampled or cached.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from acuity.functions.scalars import booking_period, collapse_priority, hours_between
from acuity.operators.procedures import unpivot_procedures

ORDER_PRIORITIES = {
    "<1hr": ["1-URGENT"],
    "<4hrs": ["2-HIGH"],
    "<8hrs": ["3-MEDIUM"],
    "<24hrs": ["4-NOT SPECIFIED"],
    "<72hrs": ["5-LOW"],
}
SEGMENT_SPECIALTIES = {
    "HOUSEHOLD": "Gynaecology",
    "MACHINERY": "Colorectal SN",
    "BUILDING": "Upper GI SN SN",
    "AUTOMOBILE": "Orthopaedics SN",
}
EXCLUDED_PART_TYPES = "SMALL|PROMO"
EXCLUDED_PART_SIZES = [(41, 50)]
EXCLUDED_PART_KEYS = [7, 11, 13, 10**12]
CASE_ORDER = ["l_linenumber", "booked_procedure", "procedural_consultant", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # all hour arithmetic on the tables' zone-less timestamps is in UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _diagnosis(k: int, prime: int) -> str:
    code = (f"concat(char(65 + (o_orderkey * {prime} + o_custkey) % 26), "
            f"lpad(cast((o_orderkey + {k} * 37 * o_custkey) % 100 as string), 2, '0'))")
    if k != 2:
        return code
    return f"case when o_custkey % 5 = 0 then null when o_custkey % 7 = 0 then '' else {code} end"


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per admission, from orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as study_id", "cast((o_custkey * 7) % 97 as double) as age",
        "if(o_custkey % 2 = 0, 'F', 'M') as sex", "o_orderstatus as asa", "o_custkey as patient",
        "o_orderdate as admit_dt_tm", "o_orderpriority as emerg_priority",
        f"{_diagnosis(1, 3)} as principle_diagnosis", f"{_diagnosis(2, 5)} as additional_diagnosis_1",
        f"{_diagnosis(3, 7)} as additional_diagnosis_2", f"{_diagnosis(4, 11)} as additional_diagnosis_3")


def with_specialty(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    names = " ".join(f"when '{segment}' then '{text}'" for segment, text in SEGMENT_SPECIALTIES.items())
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as patient", f"case c_mktsegment {names} else c_mktsegment end as specialty")
    return rows.join(customers, "patient")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as study_id", "l_partkey as booked_procedure", "l_suppkey as procedural_consultant",
        "l_linenumber", "l_extendedprice", "cast(l_linenumber as bigint) as episode_number",
        "l_shipdate as emerg_book_dt_tm", "to_date(l_shipdate) as case_date")


def cases(spark: SparkSession, sf_dir: str, admissions: DataFrame | None = None) -> DataFrame:
    """One row per booked case: an order line with its admission (``study`` or columns added to it)."""
    return _lines(spark, sf_dir).join(study(spark, sf_dir) if admissions is None else admissions, "study_id")


def ratings(spark: SparkSession, sf_dir: str, admissions: DataFrame | None = None) -> DataFrame:
    """Cases with an urgency level, skewed by procedure so that all classes occur."""
    level = (f"if((study_id * 31 + l_linenumber * 17) % 100 < booked_procedure % 100, "
             f"if(study_id % 3 = 0, '<1hr', '<4hrs'), {collapse_priority('emerg_priority', ORDER_PRIORITIES)})")
    return cases(spark, sf_dir, admissions).selectExpr(
        "*", f"{level} as emerg_priority_collapse",
        f"{booking_period(hours_between('emerg_book_dt_tm', 'admit_dt_tm'))} as admit_to_book_pd",
        "l_linenumber = 1 as primary_proc", f"{_label('booked_procedure + study_id')} as correct")


def _label(key: str) -> str:
    return f"case when ({key}) % 11 = 0 then null when ({key}) % 4 = 0 then 'no' else 'yes' end"


def _wide(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("booked_procedure", "coded_primary_procedure").selectExpr(
        "*", "procedural_consultant as additional_procedure_1",
        "if(l_linenumber % 3 <> 0, procedural_consultant * 20 + l_linenumber, null) as additional_procedure_2")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as wide rows with three coded procedures."""
    return _wide(ratings(spark, sf_dir)).withColumn("planned_procedure", F.expr("concat(asa, ' ', emerg_priority)"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled-in sheet for the episodes. A label needs no admission data, so orders are not read."""
    rows = unpivot_procedures(_wide(_lines(spark, sf_dir)), ["study_id"])
    return rows.selectExpr("study_id", "achi_proc_code", f"{_label('achi_proc_code + study_id')} as correct", "primary_proc")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as achi_proc_code", "p_name as procedure_text", "p_size as block_number", "p_type as block_text",
        "p_brand as procedure_chapter")


def event_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bookings: admission is the first event of the user."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts as emerg_book_dt_tm")
    first = events.groupBy("user_id").agg(F.expr("min(emerg_book_dt_tm) as admit_dt_tm"))
    return events.join(first, "user_id")


def free_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as free text of a study, benchmark items as code texts, three codes per study."""
    documents = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id as code", "text as code_text")
    sized = documents.select("doc_id", items.agg(F.count("*")).scalar().alias("size"))
    recorded = sized.selectExpr("doc_id as study_id", "explode(array_distinct(array(doc_id % size, "
                                "(doc_id * 7 + 3) % size, (doc_id * 13 + 5) % size))) as code")
    return documents.selectExpr("doc_id as study_id", "text"), recorded, items
