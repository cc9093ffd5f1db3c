"""Connected components of an edge table, by alternating star contractions.

Every round is two joins on keys; nothing is gathered on the driver but two
sums per round that tell whether the edges still change.
"""

from pyspark.sql import DataFrame, functions as F

from acuity.llm import store
from acuity.llm.joins import join_grouped


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node ``m`` among u and all its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    return join_grouped(edges, least, ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down)
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(joined.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least node of the component of u; the least node itself has no row.

    ``edges`` has long columns u and v; direction, repeats and loops do not
    matter. An empty table gives an empty one.
    """
    now = store.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now
        before, old = mark, now
        now = store.write(_small_star(_large_star(now)))
        store.remove(old)
