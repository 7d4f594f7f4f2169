"""Profiles, distributions and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.numbers import percent


def share_table(rows: DataFrame, value: str) -> DataFrame:
    """Counts and shares of all rows."""
    counted = rows.groupBy(value).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total")))).select(value, "n", F.round(percent(F.col("n"), F.col("total")), 6).alias("share"))


def matrix_with_totals(rows: DataFrame, down: str, across: str, values: list) -> DataFrame:
    """Counts of ``across`` values for each ``down`` value, a total column and a total row."""
    cells = [F.count_if(F.col(across) == v).alias(str(v)) for v in values]
    return rows.cube(down).agg(*cells, F.count("*").alias("total"), F.grouping(down).alias("_g")).withColumn(down, F.when(F.col("_g") == 1, "Total").otherwise(F.col(down))).drop("_g")


def dense_domain_counts(domain: DataFrame, rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Counts for every value of the allowed domain, zeros kept, with the total of its parent."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    dense = domain.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.join(dense.groupBy(parent).agg(F.sum("n").alias("parent_total")), parent)


def reuse_histogram(rows: DataFrame, source: str) -> DataFrame:
    """How many sources are used how often."""
    return rows.groupBy(source).agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("sources"))


def group_profile(rows: DataFrame, group: str, item: str, size: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("items"), F.count_distinct(item).alias("distinct_items"), F.min(size).alias("smallest"), F.max(size).alias("largest"), F.median(size).alias("middle"), F.sum(size).alias("total"))


def field_profile(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Presence, coverage and type of each field, in one pass."""
    total = F.count("*")
    stats = rows.agg(total.alias("total"), *[F.count(F.col(f)).alias(f) for f in fields])
    kinds = dict(rows.dtypes)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), F.lit(kinds[f]).alias("type")) for f in fields]))
    return stats.select("total", each.alias("x")).select("x.field", "x.present", "x.type", F.round(percent(F.col("x.present"), F.col("total")), 6).alias("coverage"))


def first_seen_mode(rows: DataFrame, group: str, value: str, order: Column) -> DataFrame:
    """Most frequent value; a tie goes to the value seen first."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("seen")).alias("s"))).alias("m")).select(group, F.col(f"m.{value}").alias("mode"), "m.n")


def continuity(rows: DataFrame, component: str, number: str) -> DataFrame:
    """Duplicates, gaps and bounds of the numbers in each component, without a global sort."""
    per = rows.groupBy(component, number).agg(F.count("*").alias("c"))
    return per.groupBy(component).agg(F.sum("c").alias("n"), F.min(number).alias("first"), F.max(number).alias("last"), F.count_if(F.col("c") > 1).alias("duplicated"), (F.max(number) - F.min(number) + 1 - F.count("*")).alias("absent"))


def pair_shares(rows: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """Count and share of each condition and of its complement, long form."""
    stats = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in pairs.items()])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("yes"), (F.col("total") - F.col(name)).alias("no")) for name in pairs]))
    return stats.select("total", each.alias("x")).select("x.*", F.round(percent(F.col("x.yes"), F.col("total")), 6).alias("yes_share"))


def count_codes(rows: DataFrame, codes: Column, name: str = "code") -> DataFrame:
    """Rows for each of the rule codes that they carry.

    The outer form keeps the optimizer from adding a filter on the array, which would evaluate every rule twice.
    """
    return rows.select(F.explode_outer(codes).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def stage_rollup(stages: DataFrame, task: str, order: str, progress: str, status: str) -> DataFrame:
    """Mean progress and the stage to show: the first running one, else the first unfinished, else the last."""
    rank = F.when(F.col(status) == "running", 0).when(F.col(status) != "done", 1).otherwise(2)
    place = F.when(rank == 2, -F.col(order)).otherwise(F.col(order))
    return stages.groupBy(task).agg(F.round(F.avg(progress), 6).alias("percent"), F.min_by(order, F.struct(rank.alias("r"), place.alias("p"))).alias("current"), F.count_if(F.col(status) == "done").alias("done"), F.count("*").alias("stages"))


def running_offsets(rows: DataFrame, bundle: str, order: str, size: str) -> DataFrame:
    """First and last position of each part in its bundle: a running sum of sizes."""
    upto = W.partitionBy(bundle).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("end_page", F.sum(size).over(upto)).withColumn("start_page", F.col("end_page") - F.col(size) + 1)
