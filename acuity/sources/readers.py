"""Readers of the input tables. Types are fixed by name; nothing is inferred from values."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from acuity import schema as S
from acuity.sources.writers import current_version


def _first_line(spark: SparkSession, file: str) -> str:
    """The header of one file, through the file system that Spark uses for it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def _csv(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame:
    """CSV parts with a header each, columns bound by name.

    Parts may order their columns differently or have different ones: files are
    grouped by their header line and each group is read with its own columns;
    a column that a part lacks is null there. The driver looks at first lines only. A line that does not fit its header or a
    type is an error.
    """
    groups: dict[str, list[str]] = {}
    for file in spark.read.text(path).inputFiles():
        groups.setdefault(_first_line(spark, file), []).append(file)
    parts = []
    for header in sorted(groups):
        files = groups[header]
        names = spark.read.option("header", True).csv(files[0]).columns
        typed = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        parts.append(spark.read.schema(typed).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(files))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in types.items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_study(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bookings, one row per booked case, with any number of numbered code columns."""
    if fmt == "csv":
        return _csv(spark, path, S.STUDY_TYPES)
    df = spark.read.format(fmt).load(current_version(spark, path))
    return df.select([F.col(f"`{n}`").cast(S.STUDY_TYPES.get(n, T.StringType())).alias(n) for n in df.columns])


def read_procedure_codes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _typed(spark, path, fmt, S.PROCEDURE_CODES)


def read_diagnosis_codes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _typed(spark, path, fmt, S.DIAGNOSIS_CODES)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The filled-in label sheet (CSV). Extra columns of the sheet are ignored."""
    types = {f.name: f.dataType for f in S.LABELS}
    sheet = _csv(spark, path, types)
    return sheet.select(*[F.col(n) if n in sheet.columns else F.lit(None).cast(t).alias(n) for n, t in types.items()])


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Hand-off table written by ``write_stage``."""
    return spark.read.parquet(current_version(spark, path))


def _typed(spark, path, fmt, typed):
    if fmt == "csv":
        types = {f.name: f.dataType for f in typed}
        found = _csv(spark, path, types)
        return found.select(*[F.col(n) if n in found.columns else F.lit(None).cast(t).alias(n) for n, t in types.items()])
    return spark.read.format(fmt).schema(typed).load(path)
