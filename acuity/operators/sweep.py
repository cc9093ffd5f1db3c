"""How the classes depend on the thresholds."""

from pyspark.sql import DataFrame, functions as F

from acuity.operators.lists import by_agreement, by_consensus

# --- fixed values: thresholds examined by default ----------------------------
AGREEMENT_GRID = [75, 80, 90]
CONSENSUS_GRID = [0.6, 0.65, 0.7, 0.9]
CUTOFF_AGREEMENT = 80
CUTOFFS = [0.6, 0.65, 0.7, 0.75]


def threshold_sweep(listed: DataFrame, a_th: list[float] = AGREEMENT_GRID,
                    c_th: list[float] = CONSENSUS_GRID) -> DataFrame:
    """Number of procedures in each class for every pair of thresholds.

    Percent and consensus do not depend on thresholds, so the whole grid is one
    aggregate of conditional counts over one list; the list is neither
    recomputed nor multiplied by the grid.
    """
    pairs = [(a, c) for c in c_th for a in a_th]
    counts = listed.agg(
        *[F.expr(f"count_if({by_agreement(a)}) as a{i}") for i, a in enumerate(a_th)],
        *[F.expr(f"count_if({by_consensus(a, c)}) as p{j}") for j, (a, c) in enumerate(pairs)],
    )
    rows = ", ".join(
        f"struct({float(a)}D as a_th, {float(c)}D as c_th, a{a_th.index(a)} as n_by_agreement, p{j} as n_by_consensus)"
        for j, (a, c) in enumerate(pairs))
    return counts.selectExpr(f"inline(array({rows}))")


def consensus_cutoffs(listed: DataFrame, agreement_threshold: float = CUTOFF_AGREEMENT,
                      cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """Procedures flagged by consensus, repeated for each cut-off that flags them."""
    hits = ", ".join(f"if({by_consensus(agreement_threshold, c)}, {float(c)}D, null)" for c in cutoffs)
    return listed.withColumn("cons_cutoff", F.expr(f"explode(array({hits}))")).filter("cons_cutoff is not null")
