"""Strict keyed joins: guards that fail inside the job, so nothing is collected to find a violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fail_if_any(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """``df``, unless ``bad`` has a row: then the job fails. Costs one aggregate over ``bad``."""
    check = bad.agg(F.count("*").alias("_bad")).select(F.when(F.col("_bad") > 0, F.raise_error(F.concat(F.lit(f"{message}: "), F.col("_bad").cast("string"), F.lit(" rows")))).otherwise(F.lit(True)).alias("_fine"))
    return df.crossJoin(F.broadcast(check)).where("_fine").drop("_fine")  # one row


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``; the job fails if a key occurs twice."""
    return _fail_if_any(df, df.groupBy(*keys).count().where("count > 1"), f"duplicate {', '.join(keys)}")


def require_known(df: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """``df``; the job fails if it has a key that ``reference`` lacks."""
    return _fail_if_any(df, df.join(reference, list(keys), "left_anti"), f"unknown {', '.join(keys)}")


def require_total(df: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """``df``; the job fails if it lacks a key of ``reference``."""
    return _fail_if_any(df, reference.join(df, list(keys), "left_anti"), f"missing {', '.join(keys)}")


def require_single(df: DataFrame, column: str) -> DataFrame:
    """``df``; the job fails if the column has more than one value. Null is a value."""
    c = F.col(column)
    seen = df.agg(F.min(c).alias("least"), F.max(c).alias("most"), F.count(c).alias("filled"), F.count("*").alias("n"))
    return _fail_if_any(df, seen.where("least <> most or filled > 0 and filled < n"), f"mixed {column}")


def key_differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).union(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def bind_predictions(gold: DataFrame, predictions: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Every gold row with its prediction; a missing one has the status ``missing``.

    Duplicate or unknown prediction keys fail the job.
    """
    strict = require_known(require_unique(predictions, key), gold, key)
    return gold.join(strict, key, "left").withColumn(status, F.coalesce(status, F.lit("missing")))


def union_disjoint(parts: dict[str, DataFrame], *keys: str, tag: str = "component") -> DataFrame:
    """Union tagged by part; a key in two parts fails the job."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return require_unique(out, *keys)


def unambiguous(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key no other row has."""
    return df.join(df.groupBy(*keys).count().where("count = 1").drop("count"), list(keys))


def match_two_level(refs: DataFrame, gold: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """``value`` of the gold row with the same ``exact`` key, else of the only one with the same ``loose`` key."""
    first = gold.select(*exact, F.col(value).alias("_exact"))
    second = unambiguous(gold, *loose).select(*loose, F.col(value).alias("_loose"))
    joined = refs.join(first, exact, "left").join(second, loose, "left")
    return joined.withColumn("matched", F.coalesce("_exact", "_loose")).withColumn("level", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose").otherwise("none")).drop("_exact", "_loose")


def null_safe_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) where a key is on one side only or a bound field differs; nulls are equal to nulls."""
    a = left.select(key, *[F.col(f).cast("string").alias(f"_l_{f}") for f in fields], F.lit(True).alias("_left"))
    b = right.select(key, *[F.col(f).cast("string").alias(f"_r_{f}") for f in fields], F.lit(True).alias("_right"))
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    codes = F.array(
        F.when(F.col("_left").isNull(), "only_right"), F.when(F.col("_right").isNull(), "only_left"), *[F.when(both & ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")), f) for f in fields]
    )
    return a.join(b, key, "full_outer").select(key, F.explode(F.array_compact(codes)).alias("field"))


def range_lookup(points: DataFrame, ranges: DataFrame, bundle: str, point: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points (whole numbers) with the ranges of their bundle that hold them; how is inner or left.

    A range of fewer than 2 ** k numbers lies in at most two adjacent cells of that width, so a point meets only the ranges
    in its own cell of each width that its bundle has: no scan of a bundle's ranges. Each point is looked up once, however
    many rows ask for it; ranges may overlap.
    """
    first, last = F.col(start).cast("long"), F.col(end).cast("long")
    level = F.coalesce(F.length(F.bin(F.try_subtract(last, first))), F.lit(63))  # 2 ** level is the next power above last - first
    cell = lambda c, k: F.expr(f"shiftright({c}, {k})")
    r = ranges.where(first <= last).select(F.col(bundle).alias("_b"), F.struct(*ranges.columns).alias("_r"), first.alias("_s"), last.alias("_e"), level.alias("_k"))
    r = r.withColumn("_c", F.explode(F.array_distinct(F.array(cell("_s", "_k"), cell("_e", "_k")))))
    asked = points.select(F.col(bundle).alias("_b"), F.col(point).cast("long").alias("_p")).where("_b is not null and _p is not null").distinct()
    widths = r.select("_b", "_k").distinct()
    cells = asked.join(widths, "_b").withColumn("_c", cell("_p", "_k"))
    found = cells.join(r, ["_b", "_k", "_c"]).where("_p between _s and _e").select("_b", "_p", "_r")
    rest = [c for c in ranges.columns if c != bundle]
    on = (points[bundle] == found["_b"]) & (points[point].cast("long") == found["_p"])
    return points.join(found, on, how).select(*[points[c] for c in points.columns], *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_wins(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key: one aggregate with partial results instead of a sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_of_tiers(tiers: dict[str, DataFrame], key: str) -> DataFrame:
    """Of each key the row of the first tier that has it, and that tier."""
    out = None
    for rank, (name, df) in enumerate(tiers.items()):
        part = df.withColumn("tier", F.lit(name)).withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in (key, "_rank")]
    best = out.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
