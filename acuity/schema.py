"""Column types and fixed vocabularies of the booking data model."""

from pyspark.sql import types as T

# --- fixed values: urgency levels, most urgent first -------------------------
LEVELS = ["<1hr", "<4hrs", "<8hrs", "<24hrs", "<72hrs"]
# Scale used for agreement and consensus: the first two levels count as one.
FOLDED_LEVELS = ["<4hrs", "<8hrs", "<24hrs", "<72hrs"]
# Hours accepted by the ``urgency`` argument -> how many levels count as urgent.
URGENCY_WINDOWS = {1: 1, 4: 2, 8: 3, 24: 4, 72: 5}

# --- fixed values: raw theatre priorities -> urgency level -------------------
PRIORITY_LEVELS = {
    "<1hr": [
        "<=15minutes-Immediate life threatening",
        "A-1hr Life threatening incl obstetric",
        "<=1hr-Life threatening conditions",
        "B-2hrs Highly critical organ/limb threat",
    ],
    "<4hrs": ["<=4hrs-Organ or limb threatening", "C-4hrs Critical"],
    "<8hrs": ["<=8hrs-Non-critical but emergent", "D-8hrs Urgent"],
    "<24hrs": ["<=24hrs-Non critical, non-emergent", "E-24hrs Semi-Urgent"],
    "<72hrs": ["<=72hrsCannot discharge before procedure", "F-72hrs Non-Urgent"],
}

# --- fixed values: booking periods, outcome, age groups ----------------------
SAME_DAY, SAME_WEEK, OVER_WEEK = "same day", "same week", "over 1 week"
URGENT, NOT_URGENT = "urgent", "not urgent"
AGE_GROUPS = ["paeds", "adult", "elderly"]
ADULT_FROM, ELDERLY_FROM = 16, 65

# --- fixed values: specialties reported under one name -----------------------
SPECIALTY_GROUPS = {
    "Obs/Gynae": ["Obs/Gynae", "Gynaecology"],
    "General Surgery": ["Colorectal", "Upper GI", "Breast/Endo", "Liver Surgery", "Paediatric"],
}
SPECIALTY_SUFFIX = " SN"

# --- fixed values: procedure codes that are never a booked operation ---------
EXCLUDED_BLOCK_TEXT = "anaesthesia|Airway management|Ventilatory support|Vascular access device"
EXCLUDED_BLOCK_RANGES = [(1820, 1923), (1940, 2016), (1786, 1800)]
EXCLUDED_CODES = [
    "13706-02", "13706-05", "13882-01", "13882-02", "18270-00", "18274-01", "36800-00", "60503-00",
    "90022-00", "92062-00", "92209-00", "92209-01", "92209-02",
    "95550-01", "95550-02", "95550-03", "95550-04", "95550-05", "95550-06", "95550-07", "95550-08",
    "95550-09", "95550-10", "95550-11", "95550-12", "95550-13", "95550-14", "95550-15", "95550-16",
]

# --- fixed values: diagnosis stems that do not count as trauma (inclusive) ---
EXCLUDED_STEM_RANGES = {
    "t": [(36, 50), (51, 65), (74, 74), (78, 78), (80, 88), (90, 98)],
    "y": [(6, 7), (10, 19), (36, 37), (40, 98)],
    "u": [(4, 4), (6, 7), (78, 92)],
    "x": [(40, 49)],
}
INJURY_LETTERS = ["s", "t"]
MECHANISM_LETTERS = ["u", "v", "w", "x"]


def excluded_stems(zero_pad: bool = False) -> list[str]:
    """Stems left out of the trauma definition.

    Stems of real codes always have two digits. With ``zero_pad=False`` the low
    numbers are written without a leading zero (``y6``) and so match nothing,
    which is how published results were produced; ``zero_pad=True`` makes
    ``y06 y07 u04 u06 u07`` effective.
    """
    width = 2 if zero_pad else 1
    return [
        f"{letter}{number:0{width}d}"
        for letter, ranges in EXCLUDED_STEM_RANGES.items()
        for low, high in ranges
        for number in range(low, high + 1)
    ]


# --- table types -------------------------------------------------------------
STUDY_TYPES = {
    "study_id": T.StringType(),
    "sex": T.StringType(),
    "asa": T.StringType(),
    "age": T.DoubleType(),
    "admit_dt_tm": T.TimestampType(),
    "emerg_book_dt_tm": T.TimestampType(),
    "case_date": T.DateType(),
    "episode_start_date": T.DateType(),
    "specialty": T.StringType(),
    "planned_procedure": T.StringType(),
    "primary_procedure": T.StringType(),
    "emerg_priority": T.StringType(),
    "procedural_consultant": T.StringType(),
    "episode_number": T.LongType(),
    "record_id": T.StringType(),
    "coded_primary_procedure": T.StringType(),
    "principle_diagnosis": T.StringType(),
    "admit_to_book_pd": T.StringType(),
    "emerg_priority_collapse": T.StringType(),
}

PROCEDURE_CODES = T.StructType([
    T.StructField("achi_proc_code", T.StringType()),
    T.StructField("procedure_text", T.StringType()),
    T.StructField("block_number", T.IntegerType()),
    T.StructField("block_text", T.StringType()),
    T.StructField("procedure_chapter", T.StringType()),
    T.StructField("procedure_sub_chapter", T.StringType()),
    T.StructField("icd10_ver", T.StringType()),
])

DIAGNOSIS_CODES = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("four_dgt_no", "four_dgt_text", "three_dgt_no", "three_dgt_text",
                 "diagnosis_chapter", "diagnosis_subchapter")
])

LABELS = T.StructType([
    T.StructField("study_id", T.StringType()),
    T.StructField("achi_proc_code", T.StringType()),
    T.StructField("correct", T.StringType()),
    T.StructField("primary_proc", T.BooleanType()),
])


def diagnosis_columns(columns: list[str]) -> list[str]:
    """Diagnosis columns in table order; their number is open-ended."""
    return [c for c in columns if "diagnosis" in c.lower()]


def procedure_code_columns(columns: list[str]) -> list[str]:
    """Coded procedure columns: the primary code, then every numbered column.

    ``planned_procedure`` and ``primary_procedure`` are free text and have no
    part after the word, so ``_procedure_`` does not catch them.
    """
    primary = [c for c in columns if c.lower() == "coded_primary_procedure"]
    return primary + [c for c in columns if "_procedure_" in c.lower()]
