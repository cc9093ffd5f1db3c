"""Free-text procedures compared with code texts: of the whole code table, or of the codes recorded for the same study."""

from pyspark.sql import DataFrame, functions as F

from acuity.functions.scalars import literal

# Words that say nothing about a procedure. A parameter of every function here.
STOPWORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with"]


def words(text: str, stopwords: list[str] = STOPWORDS) -> str:
    """SQL text: distinct lower-case words of a whole text, without stopwords."""
    removed = ", ".join(map(literal, ["", *stopwords]))
    return rf"array_except(split(lower({text}), r'[^\p{{L}}\p{{N}}]+'), array({removed}))"


def common_words(study_text: DataFrame, study_codes: DataFrame, codes: DataFrame,
                 stopwords: list[str] = STOPWORDS) -> DataFrame:
    """Number of words shared by a study's free text and each code recorded for it.

    ``study_text`` (study_id, text), ``study_codes`` (study_id, code) and
    ``codes`` (code, code_text). A text meets only its own study's codes, so the
    work is one row per recorded code: no word is joined with all its
    occurrences, and no text with all codes.
    """
    coded = study_codes.join(
        codes.selectExpr("code", f"{words('code_text', stopwords)} as _code_words"), "code")
    texts = study_text.selectExpr("study_id", f"{words('text', stopwords)} as _words")
    return (coded.join(texts, "study_id")
            .selectExpr("study_id", "code", "size(_code_words) as code_words",
                        "coalesce(size(array_intersect(_code_words, _words)), 0) as common_words"))


def best_match(matches: DataFrame) -> DataFrame:
    """Per study the code with most common words (then the smaller code); no shared word, no match."""
    best = F.expr("min(struct(-common_words as _order, code)) as _best")
    return (matches.filter("common_words > 0").groupBy("study_id").agg(best)
            .selectExpr("study_id", "_best.code as booked_procedure", "-_best._order as common_words"))


def best_codes(texts: DataFrame, codes: DataFrame, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """Per text of (study_id, text) the code of (code, code_text) with most common words: study_id, booked_procedure, common_words.

    Words of texts are joined with words of codes, common words are added up per
    text and code, first in the task that joined them, and the best code of a
    text is taken last. Neither table passes through the driver. Both sides are
    dealt out by word for this join alone, so Spark splits a frequent word over
    several tasks; a small code table is broadcast by its size instead.

    Texts without a shared word are absent; of several texts of a study each has
    its row; ties go to the smaller code. Rows with the same code are one code
    with the words of all of them; a null code or text matches nothing.
    """
    coded = (codes.filter("code is not null").selectExpr("code as booked_procedure", f"explode({words('code_text', stopwords)}) as _word").distinct())
    split = texts.withColumn("_row", F.monotonically_increasing_id()).selectExpr(
        "study_id", "_row", f"explode({words('text', stopwords)}) as _word")
    common = split.join(coded, "_word").groupBy("_row", "booked_procedure").agg(
        F.expr("count(*) as common_words"), F.first("study_id").alias("study_id"))
    best = F.expr("min(struct(-common_words as _order, booked_procedure, study_id)) as _best")
    return common.groupBy("_row").agg(best).selectExpr(
        "_best.study_id as study_id", "_best.booked_procedure as booked_procedure", "-_best._order as common_words")
