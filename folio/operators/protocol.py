"""Evaluation protocol, resume and storage rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.numbers import quantities_match, quantity
from folio.functions.text import fold_text, is_refusal, looks_like_error, loose_text


def requirements(mode: Column, answer: Column) -> Column:
    """Struct (structured, evidence) that a mode asks of an item: pages only of answerable ones with a document."""
    document = mode.isin("pdf", "pdf_pages")
    return F.struct(document.alias("structured"), (document & ~is_refusal(answer)).alias("evidence"))


def refuse_locked(options: list[str], locked: set[str]) -> list[str]:
    """Options of a run, without a leading ``--``; one that the protocol fixes is refused."""
    given = options[1:] if options[:1] == ["--"] else list(options)
    for option in given:
        if option.partition("=")[0] in locked:
            raise ValueError(f"the protocol fixes {option.partition('=')[0]}")
    return given


def direct_match(reference: Column, prediction: Column) -> Column:
    """Verdict that needs no judge: exact, refusal, numeric or blank; else needs_judge."""
    scalars = quantity(reference).isNotNull() & quantity(prediction).isNotNull()
    return (
        F.when(fold_text(prediction) == "", "blank")
        .when(loose_text(reference) == loose_text(prediction), "exact")
        .when(is_refusal(reference, exact=False) != is_refusal(prediction, exact=False), "refusal_mismatch")
        .when(scalars & quantities_match(reference, prediction), "numeric")
        .when(scalars, "numeric_mismatch")
        .otherwise("needs_judge")
    )


def first_failure(*checks: tuple[Column, str]) -> Column:
    """Code of the first check that fails, else ok."""
    out = None
    for bad, code in checks:
        out = F.when(bad, code) if out is None else out.when(bad, code)
    return out.otherwise("ok")


def must_rerun(status: Column, output: Column, errors_only: bool) -> Column:
    """Whether a stored row is processed again on resume."""
    broken = status.isNull() | (status == "failed") | looks_like_error(output)
    return broken if errors_only else broken | (F.trim(F.coalesce(output, F.lit(""))) == "")


def bound_class(low: Column, high: Column, published: Column) -> Column:
    """What bounds say about a published percent at two decimals."""
    shown = lambda c: F.bround(c, 2)
    return F.when(shown(high) < shown(published), "PROVEN_MISMATCH").when(shown(low) > shown(published), "PROVEN_MISMATCH").when((shown(low) == shown(published)) & (shown(high) == shown(published)), "DISPLAY_MATCH").otherwise("UNSCORED")


def prefer_new_prefixes(rows: DataFrame, group: str, prefix: str, limit: int, *order: Column) -> DataFrame:
    """Up to ``limit`` rows of each group: the best of each prefix first, then the rest."""
    ranked = rows.withColumn("_p", F.row_number().over(W.partitionBy(group, prefix).orderBy(*order)))
    place = F.row_number().over(W.partitionBy(group).orderBy((F.col("_p") > 1).cast("int"), *order))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).drop("_p")


def spread_subsets(rows: DataFrame, group: str, key: str, page: str, least: int, limit: int) -> DataFrame:
    """Pairs of items of a group by how far apart their pages lie, widest first, ``limit`` a group.

    No pair is among the best if ``limit`` others with one of its ends are better, so only rows are paired that can be:
    of each page the ``limit + 1`` smallest keys, below the pages that ``limit + 1`` keys begin with, above those that as
    many end with (one of these keys may be the other end itself), and of equal rows ``limit``.
    """
    known = rows.select(group, F.col(key).alias("_k"), F.col(page).alias("_p")).dropna()
    small = W.partitionBy(group, "_p").orderBy("_k")
    first = known.groupBy(group, "_p", "_k").agg(F.least(F.count("*"), F.lit(limit)).cast("int").alias("_n")).withColumn("_i", F.row_number().over(small)).where(F.col("_i") <= limit + 1)
    reach = known.groupBy(group, "_k").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))

    def bound(c: Column) -> DataFrame:
        place = F.row_number().over(W.partitionBy(group).orderBy(c))
        return reach.withColumn("_i", place).where(F.col("_i") <= limit + 1).where(F.col("_i") == limit + 1).select(group, F.col("_low").alias("_most"), F.col("_high").alias("_least"))

    each = first.select(group, "_p", "_k", F.explode(F.array_repeat(F.lit(1), F.col("_n"))).alias("_copy"))
    low = each.join(bound(F.asc("_low")).select(group, "_most"), group, "left").where("_most is null or _p <= _most").select(group, F.col("_k").alias("x"), F.col("_p").alias("px"))
    high = each.join(bound(F.desc("_high")).select(group, "_least"), group, "left").where("_least is null or _p >= _least").select(group, F.col("_k").alias("y"), F.col("_p").alias("py"))
    pairs = low.join(high, group).where("px < py and x <> y or px = py and x < y").withColumn("span", F.col("py") - F.col("px")).where(F.col("span") >= least)
    best = W.partitionBy(group).orderBy(F.desc("span"), "a", "b")
    return pairs.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "span").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def quotas(categories: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """A quota between two numbers that the category's hash decides."""
    return categories.withColumn("quota", (F.pmod(F.xxhash64(key), F.lit(high - low + 1)) + low).cast("int"))


def import_missing(current: DataFrame, found: DataFrame, key: str, valid: Column) -> DataFrame:
    """Current rows and the valid found ones whose key is not there yet."""
    fresh = found.where(valid).join(current, key, "left_anti")
    return current.withColumn("origin", F.lit("current")).unionByName(fresh.withColumn("origin", F.lit("imported")))


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Current rows with changed ones replaced and new ones added."""
    return current.join(changes, key, "left_anti").unionByName(changes)


def apply_edits(items: DataFrame, edits: DataFrame, key: str, sha: str) -> DataFrame:
    """Edits with their outcome: applied where the expected content hash is the current one, else stale; unknown without an item."""
    current = items.select(key, F.col(sha).alias("_now"))
    joined = edits.join(current, key, "left")
    return joined.withColumn("outcome", F.when(F.col("_now").isNull(), "unknown").when(F.col("_now") == F.col("expected"), "applied").otherwise("stale")).drop("_now")


def verify_cache(cache: DataFrame, key: str, recomputed: Column, label: Column, recorded: str) -> DataFrame:
    """Cache rows whose key or label does not follow from their content."""
    codes = F.array_compact(F.array(F.when(F.col(key) != recomputed, "key_mismatch"), F.when(~label.eqNullSafe(F.col(recorded)), "label_mismatch")))
    return cache.withColumn("problems", codes).where(F.size("problems") > 0)


def new_positions(current: DataFrame, added: DataFrame, position: str, step: int, *order: Column) -> DataFrame:
    """Added rows at positions after the last current one."""
    last = current.agg(F.coalesce(F.max(position), F.lit(0)).alias("_last"))
    ranked = added.withColumn("_r", F.row_number().over(W.orderBy(*order)))
    return ranked.crossJoin(F.broadcast(last)).withColumn(position, F.col("_last") + F.col("_r") * step).drop("_r", "_last")
