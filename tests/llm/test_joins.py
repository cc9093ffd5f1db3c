"""The join with a grouping: same rows, both sides dealt out for it, a frequent key split."""

from pyspark.sql import functions as F

from acuity.llm.joins import join_grouped


def test_rows_and_split(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 12).selectExpr("if(id % 3 = 0, 7L, id) as k", "cast(id % 5 as string) as s", "id")
        grouped = rows.groupBy("k", "s").agg(F.count("*").alias("n"))
        joined = join_grouped(rows, grouped, ["k", "s"])
        assert joined.columns == ["k", "s", "id", "n"]
        assert joined.agg(F.count("*"), F.sum("n")).first() == rows.join(grouped, ["k", "s"]).agg(F.count("*"), F.sum("n")).first()
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
