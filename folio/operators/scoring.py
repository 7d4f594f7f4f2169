"""Evidence and answer scores over fixed denominators, cohorts, bounds and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.numbers import f1, percent, safe_ratio, wilson
from folio.functions.pages import page_agreement


def page_sets(rows: DataFrame, key: str, page: str, gold: Column, predicted: Column) -> DataFrame:
    """Gold and predicted page sets of each item: both in one shuffle on the key."""
    return rows.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(gold, F.col(page)))).alias("gold_pages"),
        F.array_sort(F.collect_set(F.when(predicted, F.col(page)))).alias("pred_pages"),
    )


def score_items(items: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Every item with its page agreement; an item without rows has two empty sets."""
    empty = F.array().cast("array<int>")
    joined = items.join(pages, key, "left").withColumn("gold_pages", F.coalesce("gold_pages", empty)).withColumn("pred_pages", F.coalesce("pred_pages", empty))
    return joined.withColumn("e", page_agreement(F.col("gold_pages"), F.col("pred_pages")))


def fixed_denominator(scored: DataFrame, group: str, denominator: int, total: str = "All") -> DataFrame:
    """Means over a stated denominator, not the rows present, for each group and for all."""
    d = F.lit(float(denominator))
    rows = scored.select(group, "e.*", F.size("pred_pages").alias("pn"))
    return rows.cube(group).agg(
        F.count("*").alias("n"),
        F.round(F.sum("precision") * 100 / d, 6).alias("ep"),
        F.round(F.sum("recall") * 100 / d, 6).alias("er"),
        F.round(F.sum("f1") * 100 / d, 6).alias("ef"),
        (F.sum("pn") / d).alias("ap"),
        F.sum("exact").alias("ex"),
    ).withColumn(group, F.coalesce(group, F.lit(total)))


def breakdowns(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Exact-match counts by each grouping alone, in one pass: (dimension, value, n, exact)."""
    stacked = scored.select("e.exact", F.explode(F.array(*[F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("value")) for g in groups])).alias("g"))
    return stacked.groupBy("g.dimension", "g.value").agg(F.count("*").alias("n"), F.sum("exact").alias("exact"), F.round(percent(F.sum("exact"), F.count("*")), 6).alias("percent"))


def micro_evidence(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 from summed set sizes."""
    sums = scored.agg(F.sum("e.common").alias("common"), F.sum(F.size("gold_pages")).alias("gold"), F.sum(F.size("pred_pages")).alias("pred"))
    p, r = safe_ratio(F.col("common"), F.col("pred")), safe_ratio(F.col("common"), F.col("gold"))
    return sums.select("common", "gold", "pred", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1(p, r), 9).alias("f1"))


def refusal_confusion(rows: DataFrame, group: str | None = None, gold: str = "gold_refusal", predicted: str = "pred_refusal") -> DataFrame:
    """TP, FP, FN, TN of refusals with precision, recall, F1 of both classes and their mean."""
    g, p = F.col(gold), F.col(predicted)
    counted = (rows.groupBy(group) if group else rows.groupBy()).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    precision, recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    back = f1(safe_ratio(F.col("tn"), F.col("tn") + F.col("fn")), safe_ratio(F.col("tn"), F.col("tn") + F.col("fp")))
    one = f1(precision, recall)
    return counted.select(*([group] if group else []), "tp", "fp", "fn", "tn", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(one, 9).alias("f1"), F.round((one + back) / 2, 9).alias("macro_f1"))


def cohort_accuracy(subjects: DataFrame, details: DataFrame, key: str, cohort: str, correct: str) -> DataFrame:
    """Accuracy whose denominators come from the subjects: a subject without detail is not correct; outsiders don't count."""
    joined = subjects.join(details.select(key, correct), key, "left")
    hit = F.coalesce(F.col(correct).cast("int"), F.lit(0))
    return joined.groupBy(cohort).agg(F.count("*").alias("subjects"), F.count_if(F.col(correct).isNull()).alias("missing"), F.sum(hit).alias("correct"), F.round(percent(F.sum(hit), F.count("*")), 6).alias("accuracy"))


def evidence_weighted(items: DataFrame, first: DataFrame, second: DataFrame, key: str, group: str) -> DataFrame:
    """Joint correctness counts 1, or one half where the item is right without the document too."""
    rows = items.join(first, key, "left").join(second, key, "left")
    joint = F.coalesce("joint_correct", F.lit(False))
    weight = F.when(joint & F.coalesce("closed_correct", F.lit(False)), 0.5).when(joint, 1.0).otherwise(0.0)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(weight).alias("weighted"), F.round(percent(F.sum(weight), F.count("*")), 6).alias("score"))


def paired_comparison(left: DataFrame, right: DataFrame, key: str, correct: str) -> DataFrame:
    """Two runs on their common items: accuracies and discordant counts."""
    rows = left.select(key, F.col(correct).cast("boolean").alias("l")).join(right.select(key, F.col(correct).cast("boolean").alias("r")), key)
    return rows.agg(F.count("*").alias("paired"), F.count_if("l").alias("left_correct"), F.count_if("r").alias("right_correct"), F.count_if(F.col("l") & ~F.col("r")).alias("only_left"), F.count_if(~F.col("l") & F.col("r")).alias("only_right"))


def accuracy_bounds(rows: DataFrame, correct: str, group: str) -> DataFrame:
    """Least, greatest and, without pending judgments, exact accuracy; null is pending."""
    c = F.col(correct).cast("int")
    n, sure, open_ = F.count("*"), F.sum(F.coalesce(c, F.lit(0))), F.count_if(c.isNull())
    return rows.groupBy(group).agg(n.alias("n"), open_.alias("pending"), F.round(percent(sure, n), 6).alias("least"), F.round(percent(sure + open_, n), 6).alias("most"), F.when(open_ == 0, F.round(percent(sure, n), 6)).alias("exact"))


def three_denominators(rows: DataFrame, legal: str, judged: str, correct: str) -> DataFrame:
    """Correct rows over all, over legal and over judged ones."""
    hit = F.count_if(F.coalesce(F.col(correct), F.lit(False)))
    return rows.agg(F.count("*").alias("total"), F.count_if(legal).alias("legal"), F.count_if(judged).alias("judged"), hit.alias("correct"), F.round(percent(hit, F.count("*")), 6).alias("of_total"), F.round(percent(hit, F.count_if(legal)), 6).alias("of_legal"), F.round(percent(hit, F.count_if(judged)), 6).alias("of_judged"))


def wilson_by_group(rows: DataFrame, group: str, success: Column) -> DataFrame:
    counted = rows.groupBy(group).agg(F.count_if(success).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select(group, "k", "n", F.round(percent(F.col("k"), F.col("n")), 6).alias("share"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def summary_differences(left: DataFrame, right: DataFrame, key: str, metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Cells of two summaries that differ by more than the tolerance, long form."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("c")).select(key, "c.*")
    return long(left, "a").join(long(right, "b"), [key, "metric"]).where(F.abs(F.col("a") - F.col("b")) > tolerance)


def display_matches(calculated: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two values show the same two decimals; halves go to the even digit."""
    shown = lambda c: F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
    return calculated.join(published, keys).select(*keys, shown(F.col("value")).alias("shown"), shown(F.col("published")).alias("expected")).withColumn("matches", F.col("shown") == F.col("expected"))


def weighted_reaggregate(summary: DataFrame, group: str, samples: str, metric: str) -> DataFrame:
    """Means of subset means, weighted by their samples."""
    total = F.sum(samples)
    return summary.groupBy(group).agg(total.alias("samples"), F.round(safe_ratio(F.sum(F.col(metric) * F.col(samples)), total), 9).alias("mean"))


def agreement_matrix(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of each pair of verdicts, its agreement and review tier."""
    l, r = F.col(left), F.col(right)  # noqa: E741
    tier = F.when((l == 1) & (r == 1), "both_keep").when((l == 0) & (r == 0), "both_drop").otherwise("adjudicate")
    return rows.groupBy(left, right).agg(F.count("*").alias("n")).withColumn("agree", (l == r).cast("int")).withColumn("tier", tier)


def all_models_correct(dataset: DataFrame, verdicts: DataFrame, key: str, model: str, correct: str, models: int) -> DataFrame:
    """Items that not every one of ``models`` got right; unjudged items stay."""
    solved = verdicts.where(F.col(correct)).groupBy(key).agg(F.count_distinct(model).alias("m")).where(F.col("m") >= models)
    return dataset.join(solved, key, "left_anti")


def rate_gate(rows: DataFrame, model: str, illegal: Column, limit: float) -> DataFrame:
    """Models whose illegal share is over the limit."""
    return rows.groupBy(model).agg(F.count("*").alias("n"), F.count_if(illegal).alias("illegal")).withColumn("rate", F.round(percent(F.col("illegal"), F.col("n")), 6)).where(F.col("rate") > limit)
