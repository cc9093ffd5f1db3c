"""Sinks: the stage hand-off, the label sheet, the named lists."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


PREFIX = "acuity-table-"


POINTER = "_current"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str:
    """The folder that holds the rows of a hand-off table: the one its pointer names, or ``path`` itself without a pointer."""
    pointer, files = _file_system(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return path
    stream = files.open(pointer)
    try:
        return f"{path}/{spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, 'UTF-8')).readLine()}"
    finally:
        stream.close()


def write_stage(df: DataFrame, path: str) -> None:
    """Parquet for the next stage, whole or not at all.

    Rows go to a new folder below ``path``; when all are there, the pointer file
    is replaced by one rename. Until then, and if the job dies, readers see the
    table as it was. The version before stays for readers that have started;
    older ones are deleted.
    """
    spark = df.sparkSession
    before = current_version(spark, path)
    version = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    draft, files = _file_system(spark, f"{path}/{POINTER}-{version}")
    stream = files.create(draft)
    stream.write(bytearray(version.encode()))
    stream.close()
    pointer, _ = _file_system(spark, f"{path}/{POINTER}")
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(
        files.makeQualified(draft), files.makeQualified(pointer), options)
    keep = {version, before.rsplit("/", 1)[1]}
    for found in files.listStatus(pointer.getParent()):
        if found.getPath().getName().startswith("rows-") and found.getPath().getName() not in keep:
            files.delete(found.getPath(), True)


def write_label_sheet(sheet: DataFrame, path: str) -> None:
    """CSV parts with a header, to be filled in by a reviewer."""
    sheet.write.mode("overwrite").option("header", True).csv(path)


def write_lists(lists: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One directory per list. The rebalance hint keeps files even: AQE splits a big list."""
    writer = lists.hint("rebalance", "list_name").write.mode("overwrite").partitionBy("list_name")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A folder every executor can reach: the given one, ``spark.checkpoint.dir``, or the checkpoint folder.

    Where none is set, local masters, whose executors share the machine, get a
    new one; on a cluster that is an error.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="acuity-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, folder: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write a derived table once to the shared folder and read it from there.

    For aggregates used by many jobs: the later jobs do not repeat the work and
    do not depend on the executors that did it.
    """
    path = f"{shared_folder(df.sparkSession, folder)}/{PREFIX}{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and no later job reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if path.rsplit("/", 1)[1].startswith(PREFIX):
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
