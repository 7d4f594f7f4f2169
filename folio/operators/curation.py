"""Acceptance, replacement, alias resolution and classification operators of dataset curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import fold_text
from folio.operators import graph
from folio.operators.contracts import codes, rule


def accept_by_both(candidates: DataFrame, first: DataFrame, second: DataFrame, key: str, keep: str = "keep") -> DataFrame:
    """Candidates with the decision of two reviewers: accepted, first_rejected, second_rejected or unreviewed."""
    a, b = first.select(key, F.col(keep).alias("_a")), second.select(key, F.col(keep).alias("_b"))
    both = candidates.join(a, key, "left").join(b, key, "left")
    state = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unreviewed").when(~F.col("_a"), "first_rejected").when(~F.col("_b"), "second_rejected").otherwise("accepted")
    return both.withColumn("state", state).drop("_a", "_b")


def accept_distinct(accepted: DataFrame, key: str, question: str, *order: Column) -> DataFrame:
    """Accepted rows without near-duplicates of earlier accepted ones, in the stated order."""
    return graph.keep_distinct(accepted, key, question, *order)


def first_of_each_question(rows: DataFrame, question: str, *order: Column) -> DataFrame:
    """One row of each folded question: the first in order."""
    rest = rows.columns
    best = rows.groupBy(fold_text(F.col(question)).alias("_q")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in rest])


def capped(rows: DataFrame, group: str, cap: int, *order: Column) -> DataFrame:
    """At most ``cap`` rows of each group, and what was left out as a flag."""
    return rows.withColumn("within", F.row_number().over(W.partitionBy(group).orderBy(*order)) <= cap)


def replacement_reasons(pages: Column, gap: int, leaked: Column, steps: Column, solved_by: Column, models: int) -> Column:
    """Why an item must be replaced."""
    return codes(
        rule(F.size(pages) < 2, "fewer_than_two_evidence_pages"),
        rule(F.coalesce(F.array_max(pages) - F.array_min(pages), F.lit(0)) < gap, "no_non_adjacent_source_evidence_selection"),
        rule(F.coalesce(leaked, F.lit(False)), "source_or_final_answer_leaked_in_question"),
        rule(F.coalesce(steps, F.lit(0)) < 2, "missing_answer_visible_intermediate_fact_chain"),
        rule(F.coalesce(solved_by, F.lit(0)) >= models, "all_required_models_answered_correctly_without_pdf"),
    )


def resolve_aliases(wanted: DataFrame, assets: DataFrame, key: str, aliases: str) -> DataFrame:
    """Wanted ids with their asset: the current id, else the only asset that lists it as an alias, else ambiguous or missing."""
    direct = assets.select(F.col(key).alias("wanted"), F.col(key).alias("_direct"))
    listed = assets.select(F.explode(aliases).alias("wanted"), F.col(key).alias("_id")).groupBy("wanted").agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias("_alias"))
    both = wanted.join(direct, "wanted", "left").join(listed, "wanted", "left")
    how = F.when(F.col("_direct").isNotNull(), "current").when(F.col("_n") == 1, "alias").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return both.select(*wanted.columns, F.coalesce("_direct", F.when(F.col("_n") == 1, F.col("_alias"))).alias("asset"), how.alias("how"))


def groups_with_span(rows: DataFrame, group: str, item: str, page: str, least: int) -> DataFrame:
    """Groups in which pages of two different items lie at least that far apart.

    The widest pair of different items is found from each item's bounds: only the two lowest minima and the two highest
    maxima matter, so nothing is joined with itself.
    """
    bounds = rows.groupBy(group, item).agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    ends = bounds.groupBy(group).agg(
        F.min(F.struct("lo", item)).alias("a"), F.max(F.struct("hi", item)).alias("b"), F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("lo")), 2, 1).alias("lo2"), F.slice(F.sort_array(F.collect_list("hi"), asc=False), 2, 1).alias("hi2")
    )
    apart = F.when(F.col(f"a.{item}") != F.col(f"b.{item}"), F.col("b.hi") - F.col("a.lo")).otherwise(F.greatest(F.col("b.hi") - F.col("lo2")[0], F.col("hi2")[0] - F.col("a.lo")))
    return ends.where((F.col("n") > 1) & (apart >= least)).select(group, apart.alias("span"))


def first_match(c: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """Name of the first pattern that the folded text matches."""
    folded, out = fold_text(c), None
    for name, pattern in patterns:
        out = F.when(folded.rlike(pattern), name) if out is None else out.when(folded.rlike(pattern), name)
    return out.otherwise(default)


def all_matches(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """Names of all patterns that the folded text matches."""
    folded = fold_text(c)
    return F.array_compact(F.array(*[F.when(folded.rlike(p), name) for name, p in patterns]))


def path_class(path: Column) -> Column:
    """Asset class of a relative path by folder and stem."""
    stem = F.element_at(F.split(path, "/"), -1)
    return F.when(path.startswith("cross/") | stem.startswith("bundle_"), "cross_pdf").when(path.startswith("source/"), "source_paper").otherwise("single_paper")


def claim_order(units: DataFrame, key: str, worker: str, workers: int) -> DataFrame:
    """Order in which a worker tries units: the sorted list rotated to a start that its hash decides."""
    ranked = units.withColumn("_r", F.row_number().over(W.orderBy(key)) - 1)
    n = F.count("*").over(W.partitionBy())
    start = F.pmod(F.conv(F.left(F.sha2(F.lit(worker), 256), F.lit(8)), 16, 10).cast("long"), n)
    return ranked.withColumn("turn", F.pmod(F.col("_r") - start, n)).drop("_r")


def remap_pages(rows: DataFrame, mapping: DataFrame, key: str, page: str) -> DataFrame:
    """Rows with pages replaced by a mapping of (key, page) to new_page; others stay, with a flag."""
    joined = rows.join(F.broadcast(mapping) if mapping.isLocal() else mapping, [key, page], "left")
    return joined.select(*[c for c in rows.columns if c != page], F.coalesce("new_page", F.col(page)).alias(page), F.col("new_page").isNotNull().alias("changed"))


def balanced_pick(rows: DataFrame, key: str, kind: str, bundle: str, target: int, per_bundle: int) -> list:
    """Keys picked one by one, each time of the kind picked least so far, at most ``per_bundle`` of a bundle.

    Sequential by definition; it reads, for each kind, the rows that can matter. Of a kind and bundle these are the first
    ``per_bundle``: when a later one's turn comes, the bundle is used up. Of a kind they are the first 2 * ``target``: at
    most ``target`` rows are picked, and those refused lie in used-up bundles, which have at most ``target`` rows of it.
    """
    kinds = [r[0] for r in rows.select(kind).distinct().orderBy(kind).collect()]
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(kind, bundle).orderBy(key))).where(F.col("_r") <= per_bundle).drop("_r")
    queues = {k: first.where(F.col(kind) == k).orderBy(key).limit(target * 2).collect() for k in kinds}
    counts, used, out = dict.fromkeys(kinds, 0), {}, []
    while len(out) < target and any(queues.values()):
        k = min((k for k in kinds if queues[k]), key=lambda x: (counts[x], x))
        row = queues[k].pop(0)
        if used.get(row[bundle], 0) < per_bundle:
            out.append(row[key])
            used[row[bundle]] = used.get(row[bundle], 0) + 1
            counts[k] += 1
    return out
