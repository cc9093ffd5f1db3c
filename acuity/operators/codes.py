"""Procedure codes that never count as a booked operation."""

from pyspark.sql import Column, DataFrame, functions as F

from acuity import schema as S
from acuity.functions.scalars import literal
from acuity.sources.writers import materialize


def excluded_procedure_codes(codes: DataFrame,
                             text_pattern: str = S.EXCLUDED_BLOCK_TEXT,
                             block_ranges: list[tuple[int, int]] = S.EXCLUDED_BLOCK_RANGES,
                             listed: list[str] = S.EXCLUDED_CODES,
                             code: str = "achi_proc_code") -> DataFrame:
    """Distinct codes from block text, block number and a fixed list, as one column."""
    by_block = [f"block_number between {low} and {high}" for low, high in block_ranges]
    found = codes.filter(" or ".join([f"block_text rlike {literal(text_pattern)}", *by_block])).select(code)
    if listed:
        extra = codes.sparkSession.createDataFrame([(c,) for c in listed], [code])
        found = found.unionByName(extra.select(F.col(code).cast(codes.schema[code].dataType)))
    return found.distinct()


WHOLE = ("tinyint", "smallint", "int", "bigint")
CODES_PER_ROW = 1024  # 16 whole numbers of 64 bits


def _row_of(code: str) -> str:
    return f"shiftright(cast({code} as bigint), 10)"


def _word_of(code: str) -> str:
    return f"cast(shiftright(cast({code} as bigint), 6) & 15 as int)"


def _bit_of(code: str) -> str:
    return f"cast(cast({code} as bigint) & 63 as int)"


def _packed(code: str) -> Column:
    """Aggregate: the bits of neighbouring codes as an array of words."""
    word = f"bit_or(if({_word_of(code)} = {{}}, shiftleft(1L, {_bit_of(code)}), 0L))"
    return F.expr(f"array({', '.join(word.format(i) for i in range(CODES_PER_ROW // 64))})")


def blank_excluded(study: DataFrame, excluded: DataFrame, columns: list[str] | None = None,
                   most_listed: int = 100_000) -> DataFrame:
    """Excluded codes become null in every coded procedure column of the wide table.

    A set of up to ``most_listed`` rows (13 MB at most; it is written and counted first) is
    sent to the rows: one scan of the study and no shuffle, whatever the number
    of columns. Codes that are whole numbers are packed for this, ``CODES_PER_ROW`` neighbours
    to a row, a bit each; others have a row each. A larger set stays where it is: the rows are written once with a
    number, their codes laid out below one another in one pass, and the places of
    excluded ones come back as one row per study row, so that the number of
    shuffles does not depend on the number of columns either. Codes of different
    types are compared as text. For the long form, drop the rows with ``drop_excluded`` instead:
    nulls are dropped there anyway.
    """
    names = columns or S.procedure_code_columns(study.columns)
    if not names:
        return study
    kind = excluded.schema[0].dataType.simpleString()
    kind = kind if all(study.schema[n].dataType.simpleString() == kind for n in names) else "string"
    listed = materialize(excluded.select(F.col(excluded.columns[0]).cast(kind).alias("_code")).filter("_code is not null").distinct())
    if kind in WHOLE:
        small = materialize(listed.groupBy(F.expr(_row_of("_code")).alias("_key")).agg(_packed("_code").alias("_bits")))
        key, hit = _row_of("`{0}`"), f"getbit(_bits[{_word_of('`{0}`')}], {_bit_of('`{0}`')}) = 1"
    else:
        small = listed.withColumnRenamed("_code", "_key")
        key, hit = f"cast(`{{0}}` as {kind})", "_key is not null"
    if small.count() <= most_listed:
        out = study
        for name in names:
            out = (out.join(F.broadcast(small), F.expr(f"{key.format(name)} = _key"), "left")
                   .withColumn(name, F.expr(f"if(coalesce({hit.format(name)}, false), null, `{name}`)")).drop(*small.columns))
        return out.select(*[f"`{c}`" for c in study.columns])
    numbered = materialize(study.withColumn("_row", F.monotonically_increasing_id()))
    places = ", ".join(f"struct({i} as _place, cast(`{n}` as {kind}) as _code)" for i, n in enumerate(names))
    found = (numbered.selectExpr("_row", f"inline(array({places}))").filter("_code is not null")
             .join(listed, "_code", "left_semi").groupBy("_row").agg(F.expr("collect_set(_place) as _places")))
    blank = {n: F.expr(f"if(coalesce(array_contains(_places, {i}), false), null, `{n}`)") for i, n in enumerate(names)}
    return numbered.join(found, "_row", "left").withColumns(blank).select(*[f"`{c}`" for c in study.columns])


def drop_excluded(procedures: DataFrame, excluded: DataFrame, code: str = "achi_proc_code") -> DataFrame:
    """Anti join of long procedures with the code set."""
    return procedures.join(excluded.select(F.col(excluded.columns[0]).alias(code)), code, "left_anti")
