"""Projection, comparison and publication of lists."""

from pyspark.sql import DataFrame, functions as F

from acuity.functions.scalars import literal

# --- fixed values: labels and names of the published lists -------------------
NOT_SPECIFIC = {
    "adult": "not specific to adults",
    "elderly": "not specific to elderly",
    "paeds": "not specific to paediatrics",
}
ONLY = {
    "adult": "adult patients only",
    "elderly": "elderly patients only",
    "paeds": "paediatric patients only",
}
AGREEMENT_NAMES = {
    "full": "full list by agreement",
    "adult": "adult list by agreement",
    "paeds": "paeds list by agreement",
    "elderly": "elderly list by agreement",
}
CONSENSUS_NAMES = {
    "full": "addiional proc by consensus",
    "adult": "adult addit proc by consensus",
    "paeds": "paeds addit proc by consensus",
    "elderly": "elderly addit proc by consensus",
}
DIFFERENCE_NAMES = {
    "adult": "diff proc bw adult and full",
    "elderly": "diff proc bw elderly and full",
    "paeds": "diff proc bw paeds and full",
}
SPECIALTY_NAMES = {"urgent": "urgent speciality list", "study": "study db specialty list"}
PUBLISHED = ["achi_code", "procedure_text", "block_text", "trauma", "primary_proc",
             "urgent_total_pcnt", "urgent_total_pcnt_CI"]



def not_specific(group: str) -> str:
    return NOT_SPECIFIC.get(group, f"not specific to {group} patients")


def only(group: str) -> str:
    return ONLY.get(group, f"{group} patients only")


def agreement_name(group: str) -> str:
    return AGREEMENT_NAMES.get(group, f"{group} list by agreement")


def consensus_name(group: str) -> str:
    return CONSENSUS_NAMES.get(group, f"{group} addit proc by consensus")


def difference_name(group: str) -> str:
    return DIFFERENCE_NAMES.get(group, f"diff proc bw {group} and full")


def with_code_text(listed: DataFrame, codes: DataFrame) -> DataFrame:
    text = codes.selectExpr("achi_proc_code as booked_procedure", "procedure_text", "block_text")
    return listed.join(text, "booked_procedure", "left")


def urgent_list(listed: DataFrame, flag: str = "urgent_surgery_by_agmnt") -> DataFrame:
    """Published columns of the procedures with ``flag``."""
    front = [c for c in listed.columns if c == "list_name"]
    return (listed.filter(flag).withColumnRenamed("booked_procedure", "achi_code")
            .select(*front, *PUBLISHED))


def compare_lists(full: DataFrame, group: DataFrame, group_name: str) -> DataFrame:
    """Procedures on one of two published lists only, labelled by ``procedure_list``.

    Keys are matched null-safe: a row without a code equals another one.
    """
    def only_in(left, right, label):
        keys = right.select(F.col("achi_code").alias("_key"))
        return (left.join(keys, left["achi_code"].eqNullSafe(F.col("_key")), "left_anti")
                .withColumn("procedure_list", F.lit(label)))
    return only_in(group, full, only(group_name)).unionByName(
        only_in(full, group, not_specific(group_name)), allowMissingColumns=True)


def _urgent_on(lists: DataFrame) -> DataFrame:
    """Adds ``_on``: the names of all lists on which the procedure is urgent by agreement.

    The lists of a procedure already sit in one partition after counting, so the
    window adds a local sort and no shuffle; it sees one row per list.
    """
    return lists.withColumn("_on", F.expr(
        "collect_set(if(urgent_surgery_by_agmnt, list_name, null)) over (partition by booked_procedure)"))


def _difference(group: str) -> str:
    """SQL text: label of a row in the comparison of ``group`` with the full list, else null."""
    return (f"case when not urgent_surgery_by_agmnt then null "
            f"when list_name = {literal(group)} and not array_contains(_on, 'full') then {literal(only(group))} "
            f"when list_name = 'full' and not array_contains(_on, {literal(group)}) then {literal(not_specific(group))} end")


def list_differences(lists: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """All comparisons with the full list at once, from the stacked lists.

    Same rows as ``compare_lists`` for every group, without recomputing or
    joining any list.
    """
    options = ", ".join(f"struct({literal(difference_name(g))} as diff_name, {_difference(g)} as procedure_list)"
                        for g in groups or list(ONLY))
    return (_urgent_on(lists).selectExpr("*", f"inline(array({options}))")
            .filter("procedure_list is not null").drop("_on"))


def published_lists(lists: DataFrame, codes: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The published lists as one table with ``list_name``: eleven for the full list and the three age groups.

    ``groups`` are the names of the stacked lists to set against ``full``, ages by
    default. Every stacked row names the lists it goes to; the table is built in one
    pass and can be written with ``partitionBy("list_name")``.
    """
    groups = groups or list(ONLY)
    targets = [
        f"struct(if({flag} and list_name = {literal(group)}, {literal(name(group))}, null) as _name, cast(null as string) as procedure_list)"
        for flag, name in (("urgent_surgery_by_agmnt", agreement_name), ("urgent_surgery_by_cnsus", consensus_name))
        for group in ["full", *groups]
    ] + [
        f"struct(if({_difference(group)} is not null, {literal(difference_name(group))}, null) as _name, {_difference(group)} as procedure_list)"
        for group in groups
    ]
    named = (_urgent_on(lists).selectExpr("*", f"inline(array({', '.join(targets)}))")
             .filter("_name is not null").drop("list_name"))
    return (with_code_text(named, codes).withColumnsRenamed({"booked_procedure": "achi_code", "_name": "list_name"})
            .select("list_name", *PUBLISHED, "procedure_list"))


def named_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """Any tables under one another with ``list_name``; columns a table lacks are null."""
    (name, out), *rest = lists.items()
    out = out.withColumn("list_name", F.lit(name))
    for name, df in rest:
        out = out.unionByName(df.withColumn("list_name", F.lit(name)), allowMissingColumns=True)
    return out
