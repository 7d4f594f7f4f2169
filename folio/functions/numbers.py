"""Scalar arithmetic: safe ratios, scores, confidence limits and whole-answer quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

Z95 = 1.959963984540054
QUANTITY = r"^([-+]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*(%|[A-Za-zµμ°][A-Za-zµμ°%\s/·*._-]*)?$"


def safe_ratio(n: Column, d: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d), F.lit(empty))


def percent(n: Column, d: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(n.cast("double") * 100, d), F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return safe_ratio(p * r * 2, p + r)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a share; (0, 0) without cases."""
    share = F.try_divide(k.cast("double"), n)
    spread = F.sqrt(F.try_divide(share * (1 - share), n) + F.try_divide(F.lit(z * z), 4 * n * n)) * z
    middle = share + F.try_divide(F.lit(z * z), 2 * n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    limit = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / scale))).otherwise(0.0)
    return limit(middle - spread), limit(middle + spread)


def quantity(c: Column) -> Column:
    """Struct (value, unit) of an answer that is one number with a short unit, else null."""
    bare = F.regexp_replace(F.translate(text(c), " −", " -"), r"(?U)^\s+|\s+$", "")
    unit = F.trim(F.regexp_extract(bare, QUANTITY, 2))
    value = F.replace(F.regexp_extract(bare, QUANTITY, 1), F.lit(","), F.lit("")).try_cast("double")
    fine = (F.length(bare) <= 64) & bare.rlike(QUANTITY) & (F.size(F.split(unit, r"\s+")) <= 3)
    short = F.translate(F.lower(F.regexp_replace(unit, r"\s+", "")), "μ·", "µ*")
    return F.when(fine & value.isNotNull(), F.struct(value.alias("value"), short.alias("unit")))


def quantities_match(reference: Column, prediction: Column, rel: float = 1e-4, tol: float = 1e-6) -> Column:
    """Whether both are scalars of one unit and near enough; false if either is none."""
    a, b = quantity(reference), quantity(prediction)
    near = F.abs(a["value"] - b["value"]) <= F.greatest(F.lit(tol), F.abs(a["value"]) * rel)
    return F.coalesce((a["unit"] == b["unit"]) & near, F.lit(False))


def difficulty(success_percent: Column) -> Column:
    return F.when(success_percent <= 40, "hard").when(success_percent <= 60, "medium").otherwise("easy")


def progress_percent(done: Column, total: Column) -> Column:
    """Bounded percent; nothing to do is done."""
    return F.when(total <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), done.cast("double") * 100 / F.nullif(total, F.lit(0)))))


def backoff_seconds(failures: Column) -> Column:
    """Doubling delay: 2 ** n up to n = 8, at most 300."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(failures, F.lit(8))))


def render_dpi(area_points: Column, requested: int = 144, megapixels: float = 180.0, least: int = 36) -> Column:
    """Resolution under which all pages fit the pixel budget."""
    fits = F.floor(72 * F.sqrt(F.try_divide(F.lit(megapixels * 1e6), area_points)))
    return F.greatest(F.lit(least), F.least(F.lit(requested), fits)).cast("int")


def usage_cost(prompt: Column, completion: Column, per_million_in: float, per_million_out: float) -> Column:
    return (prompt * per_million_in + completion * per_million_out) / 1e6


def to_number_words(c: Column) -> Column:
    """Numerals and percents that stand in a text, as doubles."""
    found = F.regexp_extract_all(text(c), F.lit(r"([-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")))
