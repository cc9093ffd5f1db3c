import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC")
               .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """``rows("a int, b string", (1, "x"), ...)`` -> DataFrame."""
    def make(typed, *values):
        return spark.createDataFrame(list(values), typed)
    return make


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of one SQL expression over a column ``x`` of the given type."""
    def run(expression, typed, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typed}")
        return [r[0] for r in df.orderBy("i").selectExpr(expression).collect()]
    return run
