"""Distributions: of level percents over procedures, and of numeric study variables.

Quantiles of level percents and densities work on value counts. Percents shown
with one decimal have at most 1001 values, so what reaches one task is bounded
by the value range and not by the number of rows. Quartiles of any other
variable are found by rank in a range-partitioned sort. Group statistics are
attached with windows over the value counts; the input is never joined with
itself and so is read once.
"""

from pyspark.sql import DataFrame, functions as F

from acuity import schema as S


def levels_long(listed: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One row per procedure and level: ``urgency``, ``pcnt``."""
    ids = ids or ["booked_procedure"]
    levels = [f"`{level}`" for level in S.LEVELS]
    return listed.select(*ids, *levels).unpivot(ids, levels, "urgency", "pcnt")


def value_counts(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    return long.groupBy(*keys, value).agg(F.expr("count(*) as n"))


def _quartiles(value: str) -> str:
    """q25, median and q75 as an array, linear between order statistics. For values with few distinct numbers."""
    return f"percentile({value}, array(0.25, 0.5, 0.75), n)"


def quartiles(counts: DataFrame, keys: str | list[str], value: str) -> DataFrame:
    """``keys`` and array ``q`` of the quartiles of value counts, linear between order statistics.

    Counts are sorted over all tasks; running counts come from the totals of
    the tasks before and a running sum inside each task. So a variable with as
    many values as rows is as good as one with few.
    """
    keys = [keys] if isinstance(keys, str) else keys
    by = ", ".join(keys)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counts.filter(f"{value} is not null").select(*keys, value, "n")
              .repartitionByRange(parts, *keys, value).withColumn("_part", F.expr("spark_partition_id()")))
    # one row per task and group
    totals = ranged.groupBy(*keys, "_part").agg(F.expr("sum(n) as _n")).selectExpr(
        *keys, "_part", f"sum(_n) over (partition by {by}) as _all",
        f"coalesce(sum(_n) over (partition by {by} order by _part rows between unbounded preceding and 1 preceding), 0) as _before")
    placed = (ranged.withColumn("_upto", F.expr(f"sum(n) over (partition by {by}, _part order by {value})"))
              .join(totals, [*keys, "_part"]).selectExpr(*keys, value, "_all", "_before + _upto - n as _from", "_before + _upto as _to"))

    def at(rank):
        return f"max(if(_from <= {rank} and {rank} < _to, {value}, null))"
    ranks = [f"({p}D * (_all - 1))" for p in (0.25, 0.5, 0.75)]
    ends = [at(f"{end}{r}") for r in ranks for end in ("floor", "ceil")]
    found = placed.groupBy(*keys).agg(F.expr("max(_all) as _all"), *[F.expr(f"{e} as _v{i}") for i, e in enumerate(ends)])
    between = [f"_v{2 * i} + ({r} - floor{r}) * (_v{2 * i + 1} - _v{2 * i})" for i, r in enumerate(ranks)]
    return found.selectExpr(*keys, f"array({', '.join(between)}) as q")


def group_statistics(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per group of value counts: ``n_values``, ``mean``, ``sd`` and quartiles ``q`` of the known values.

    Sums are combined before they are shuffled and quartiles come from
    ``quartiles``, so no task holds a group, however many values it has.
    """
    known = counts.filter(f"{value} is not null")
    means = known.groupBy(*keys).agg(F.expr("sum(n) as n_values"), F.expr(f"sum(n * {value}) / sum(n) as mean"))
    squares = known.join(means, keys).groupBy(*keys).agg(F.expr(f"{_squares(value)} as _squares"))
    return (means.join(squares, keys).join(quartiles(known, keys, value), keys)
            .selectExpr(*keys, "n_values", "mean", "sqrt(try_divide(_squares, n_values - 1)) as sd", "q"))


def level_distribution(listed: DataFrame, exact: bool = False) -> DataFrame:
    """Median, interquartile range and quartiles of each level's percent over procedures.

    ``exact`` is for lists whose percents are not rounded: these may have as many
    values as there are procedures, which are then ranked over all tasks.
    """
    counts = value_counts(levels_long(listed), ["urgency"], "pcnt")
    q = quartiles(counts, "urgency", "pcnt") if exact else counts.groupBy("urgency").agg(F.expr(f"{_quartiles('pcnt')} as q"))
    return q.selectExpr("urgency", "q[1] as median_pct", "q[2] - q[0] as IQR_pct", "q[0] as one_quantile_pcnt",
                        "q[2] as three_quantile_pcnt")


def level_boxplot_stats(listed: DataFrame, exact: bool = False) -> DataFrame:
    """Box, whiskers (furthest values within 1.5 IQR of the box) and outlier count per level; ``exact`` as for ``level_distribution``."""
    counts = value_counts(levels_long(listed), ["urgency"], "pcnt")
    if exact:
        boxed = counts.join(quartiles(counts, "urgency", "pcnt"), "urgency", "left")
    else:
        boxed = counts.withColumn("q", F.expr(f"{_quartiles('pcnt')} over (partition by urgency)"))
    inside = "pcnt between q[0] - 1.5e0 * (q[2] - q[0]) and q[2] + 1.5e0 * (q[2] - q[0])"
    return boxed.groupBy("urgency").agg(
        F.expr(f"min(if({inside}, pcnt, null)) as whisker_low"),
        F.expr("first(q[0]) as q25"), F.expr("first(q[1]) as median"), F.expr("first(q[2]) as q75"),
        F.expr(f"max(if({inside}, pcnt, null)) as whisker_high"),
        F.expr(f"sum(if({inside}, 0, n)) as n_outliers"),
    )


def _with_mean(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``n_values`` and ``mean`` of the known values of each group."""
    group = f"over (partition by {', '.join(keys)})"
    known = f"if({value} is null, 0, n)"
    return counts.selectExpr("*", f"sum({known}) {group} as n_values",
                             f"try_divide(sum(n * {value}) {group}, sum({known}) {group}) as mean")


def _squares(value: str) -> str:
    """Sum of squared distances from the mean."""
    return f"sum(n * ({value} - mean) * ({value} - mean))"


def numeric_profile(df: DataFrame, variables: list[str]) -> DataFrame:
    """N, share missing, mean, sd, quartiles, range of numeric columns; one row per variable.

    All but the quartiles are sums that are combined before they are shuffled.
    """
    long = df.selectExpr(*[f"cast({v} as double) as {v}" for v in variables]).unpivot([], variables, "Variable", "value")
    sums = long.groupBy("Variable").agg(
        F.expr("count(value) as N"), F.expr("count_if(value is null) / count(*) as missing"), F.expr("avg(value) as mean"),
        F.expr("stddev_samp(value) as sd"), F.expr("min(value) as min"), F.expr("max(value) as max"))
    q = quartiles(value_counts(long, ["Variable"], "value"), "Variable", "value")
    return sums.join(q, "Variable", "left").selectExpr(
        "Variable", "N", "missing", "mean", "sd", "q[1] as median", "q[2] - q[0] as IQR",
        "q[0] as `25 centile`", "q[2] as `75 centile`", "min", "max")


def histogram(df: DataFrame, variable: str, width: float) -> DataFrame:
    """Counts per bin ``(bin_from, bin_to]`` of all values, at multiples of ``width``; the first bin includes its lower end.

    Bins reach from the smallest to the largest value; empty ones have a row.
    Missing values are counted in a row without ends. The input is read once:
    bins are counted first, and their range comes from the counts.
    """
    place = f"cast(ceil({variable} / {float(width)}D) as bigint) - 1 as _bin"
    on_edge = f"coalesce({variable} = ceil({variable} / {float(width)}D) * {float(width)}D, false) as _edge"
    counted = df.selectExpr(place, on_edge).groupBy("_bin", "_edge").agg(F.expr("count(*) as n"))
    # a lowest bin that only holds its upper end becomes the lower end of the next one
    least = counted.agg(F.expr("min(if(_bin is null, null, struct(_bin, _edge, n)))")).scalar()
    bins = counted.withColumn("_least", least).selectExpr("if(_bin = _least._bin and _least._edge, _bin + 1, _bin) as _bin", "n")
    every = bins.agg(F.expr("min(_bin) as a"), F.expr("max(_bin) as b")).filter("a is not null").selectExpr(
        "explode(sequence(a, b)) as _bin", "0L as n")
    return bins.unionAll(every).groupBy("_bin").agg(F.expr("sum(n) as n")).selectExpr(
        f"_bin * {float(width)}D as bin_from", f"(_bin + 1) * {float(width)}D as bin_to", "n")


def level_density(long: DataFrame, keys: list[str], value: str = "pcnt",
                  low: float = 0.0, high: float = 100.0, points: int = 101, exact: bool = False) -> DataFrame:
    """Gaussian kernel density per key on an even grid.

    The bandwidth is 0.9 * min(sd, IQR / 1.34) * n ** -0.2; if that spread is 0
    the standard deviation, then 1, takes its place. Each distinct value meets
    each grid point once, weighted by its count, and the products are summed
    before they are shuffled. ``exact`` is for values that are not rounded: the
    statistics of a group then come from sums and ranks over all tasks, and
    groups without any known value are absent.
    """
    counts = value_counts(long, keys, value)
    if exact:
        spread = counts.join(group_statistics(counts, keys, value), keys)
    else:
        group = f"over (partition by {', '.join(keys)})"
        spread = _with_mean(counts, keys, value).selectExpr("*", f"{_quartiles(value)} {group} as q").withColumn(
            "sd", F.expr(f"sqrt(try_divide({_squares(value)} {group}, n_values - 1))"))
    robust = "least(coalesce(sd, 0), (q[2] - q[0]) / 1.34e0)"
    width = f"case when {robust} > 0 then {robust} when sd > 0 then sd else 1e0 end"
    step = (high - low) / (points - 1)
    grid = f"explode(transform(sequence(0, {points - 1}), i -> {float(low)}D + i * {step}D)) as x"
    kernel = f"exp(-pow((x - {value}) / bw, 2) / 2) / (bw * sqrt(2 * pi()))"
    return (spread.selectExpr(*keys, value, "n", "n_values", f"0.9e0 * {width} * pow(n_values, -0.2e0) as bw")
            .selectExpr("*", grid)
            .groupBy(*keys, "x").agg(F.expr(f"sum(n * {kernel}) / first(n_values) as density")))
