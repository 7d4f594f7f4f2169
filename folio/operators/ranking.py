"""Ranked selections: quotas, top-k with fallback, interleaving, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(rows: DataFrame, group: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps only k rows of a group before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def top_k_with_fallback(rows: DataFrame, group: str, k: int, score: str, *order: Column) -> DataFrame:
    """The first ``k`` rows with a positive score; where a group has none, the first ``k`` of all."""
    has = W.partitionBy(group)
    ranked = rows.withColumn("_best", F.max(score).over(has)).where((F.col(score) > 0) | (F.col("_best") <= 0)).drop("_best")
    return top_k(ranked, group, k, F.desc(score), *order)


def stratified_quota(rows: DataFrame, key: str, preferred: str, target: int, share: float, *order: Column) -> DataFrame:
    """``target`` rows: first the preferred stratum's quota, then others, then the preferred stratum's overflow.

    Ranks come from one sort of the candidates (a target-sized report), limited before it where possible.
    """
    quota = int(-(-target * share // 1))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(preferred).orderBy(*order))).where(F.col("_r") <= target)
    tier = F.when(F.col(preferred) & (F.col("_r") <= quota), 0).when(~F.col(preferred), 1).otherwise(2)
    final = ranked.withColumn("tier", tier)
    return final.orderBy("tier", "_r", key).limit(target).drop("_r")


def hardness(rows: DataFrame, rules: dict[str, tuple[int, Column]]) -> DataFrame:
    """Additive score and the names of the rules that hold."""
    total = F.lit(0)
    for points, condition in rules.values():
        total = total + F.when(condition, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(condition, name) for name, (_, condition) in rules.items()]))
    return rows.withColumn("score", total).withColumn("reasons", reasons)


def recommended(rows: DataFrame, key: str, new: str, score: str, target: int) -> DataFrame:
    """All new rows, filled up to ``target`` by the others of highest score."""
    fresh = rows.where(new)
    room = F.greatest(F.lit(0), F.lit(target) - F.count("*"))
    old = rows.where(~F.col(new)).orderBy(F.desc(score), key).limit(target)
    ranked = old.withColumn("_r", F.row_number().over(W.orderBy(F.desc(score), key)))  # at most target rows
    picked = ranked.crossJoin(F.broadcast(fresh.agg(room.alias("_room")))).where("_r <= _room").drop("_r", "_room")
    return fresh.unionByName(picked)


def interleave(rows: DataFrame, group: str, weights: dict[str, int], *order: Column, pattern: int = 20) -> DataFrame:
    """Weighted round robin: of each round of ``pattern`` places a group takes as many as its weight, evenly spread."""
    share = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(group)]
    ranked = rows.where(share.isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)
    return ranked.withColumn("slot", (F.col("_r").cast("double") + 0.5) * pattern / share).drop("_r")


def renumber(rows: DataFrame, group: str, step: int, *order: Column) -> DataFrame:
    """Positions step, 2 step, ... in each group."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(*order)) * step)


def move_to(rows: DataFrame, group: str, key: str, moved: Column, place: int, *order: Column) -> DataFrame:
    """Positions after the row that ``moved`` marks went to the place (from 0); others keep their order."""
    others = W.partitionBy(group, moved.alias("_m")).orderBy(*order)
    rank = F.row_number().over(others) - 1
    new = F.when(moved, place).otherwise(rank + F.when(rank >= place, 1).otherwise(0))
    return rows.withColumn("place", new)


def complete_triangles(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(x, y, z, weight) of pairs that all three exist, x < y < z."""
    e = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.col(weight).alias("w"))
    two = e.alias("p").join(e.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"), (F.col("p.w") + F.col("q.w")).alias("w2"))
    return two.join(e.select(F.col("x").alias("y"), F.col("y").alias("z"), "w"), ["y", "z"]).select("x", "y", "z", (F.col("w2") + F.col("w")).alias("weight"))
