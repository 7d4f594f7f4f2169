"""Guards, profiles and assembly of datasets: units, gold contracts, bundles, checkpoints, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import UNANSWERABLE, content_text, fold_text, text
from folio.operators.contracts import codes, rule

# What a gold item's fields may hold.
QUESTION_TYPES = ("Literal", "Inferential")
MODALITIES = ("text", "image", "table", "formula")


def gold_codes(items: DataFrame) -> DataFrame:
    """(qa_id, codes) of gold rows (qa_id, task, question, answer, pages, page_count, question_type, category, modalities).

    The rules of a release: filled texts, pages of the document, known types and modalities, a refusal if and only if no
    page is cited, ids unique.
    """
    bare = lambda c: F.trim(text(F.col(c)))
    refused, cited = F.col("answer") == UNANSWERABLE, F.coalesce(F.size("pages"), F.lit(0)) > 0
    found = codes(
        rule(F.col("pages").isNull() | F.exists("pages", lambda p: (p < 1) | (p > F.col("page_count"))), "invalid_pages"),
        rule((bare("question") == "") | (bare("answer") == ""), "empty_text"),
        rule(~F.coalesce(F.col("question_type").isin(*QUESTION_TYPES), F.lit(False)) | (bare("category") == ""), "invalid_classification"),
        rule((F.coalesce(F.size("modalities"), F.lit(0)) < 1) | F.exists("modalities", lambda m: ~m.isin(*MODALITIES)), "invalid_modalities"),
        rule((F.col("task") == UNANSWERABLE) & (~refused | cited), "noncanonical_refusal"),
        rule((F.col("task") != UNANSWERABLE) & (refused | ~cited), "answerable_contract"),
        rule(F.col("_n") > 1, "duplicate_id"),
    )
    return items.withColumn("_n", F.count("*").over(W.partitionBy("qa_id"))).select("qa_id", found.alias("codes"))


def release_codes(items: DataFrame, bundles: DataFrame, documents: int) -> DataFrame:
    """(item, codes) of a release's items (item, bundle, question, answer, pages, docs) against ``bundles(bundle, page_count, actual)``."""
    first = W.partitionBy("_q").orderBy("item")
    rows = items.join(bundles, "bundle", "left").withColumn("_q", fold_text(F.col("question")))
    rows = rows.withColumn("_r", F.when(F.col("_q") != "", F.row_number().over(first)))
    docs = F.size(F.array_distinct("docs"))
    found = codes(
        rule(F.col("page_count").isNull(), "missing_bundle"),
        rule(F.col("page_count") != F.col("actual"), "page_count_mismatch"),
        rule((F.col("_q") == "") | (F.trim(text(F.col("answer"))) == ""), "blank_question_or_answer"),
        rule(F.col("_r") > 1, "duplicate_question"),
        rule((F.size("pages") == 0) | F.exists("pages", lambda p: (p < 1) | (p > F.col("actual"))), "invalid_evidence_pages"),
        rule(docs < 2, "not_cross_document"),
        rule((docs >= 2) & (docs < documents), "not_in_all_documents"),
    )
    return rows.select("item", found.alias("codes"))


def separation_codes(question: Column, answer: Column, sources: Column, pages: Column, gap: int) -> Column:
    """Codes of a hard item: its answer or a source's stands in the question, or its pages lie too close together."""
    q, a = content_text(question), content_text(answer)
    inside = F.exists(sources, lambda s: (F.length(content_text(s)) >= 5) & F.contains(q, content_text(s)))
    return codes(
        rule((F.length(a) >= 4) & F.contains(q, a), "answer_leaked"),
        rule(F.coalesce(inside, F.lit(False)), "source_answer_leaked"),
        rule(F.coalesce(F.array_max(pages) - F.array_min(pages), F.lit(0)) < gap, "pages_too_close"),
    )


def reusable(checkpoints: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Every current key and whether its checkpoint has no errors and was made from the same content."""
    saved = checkpoints.select(key, F.col(fingerprint).alias("_f"), F.col("errors").alias("_e"))
    fine = F.coalesce((F.col("_f") == F.col(fingerprint)) & (F.size("_e") == 0), F.lit(False))
    return current.join(saved, key, "left").select(key, fine.alias("reusable"))


def supported_facts(reviews: DataFrame) -> DataFrame:
    """Facts by document from kept or fixed reviews ``(bundle, qa_id, decision, support)`` with their place."""
    kept = reviews.where(F.col("decision").isin("KEEP", "FIX"))
    rows = kept.select("bundle", "qa_id", F.posexplode("support").alias("place", "s"))
    return rows.where(F.trim(text(F.col("s.fact"))) != "").select("bundle", "qa_id", "place", F.col("s.doc").alias("doc"), F.col("s.page").alias("page"), F.trim("s.fact").alias("fact"))


def bundle_contexts(base: DataFrame, reviews: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Bundles that all three tables know, with the columns of all."""
    return base.join(reviews, key).join(manifest, key)


def candidate_counts(candidates: DataFrame, bundle: str, docs: str) -> DataFrame:
    """Candidates of each bundle by the number of source documents."""
    return candidates.groupBy(bundle, F.size(F.array_distinct(docs)).alias("documents")).agg(F.count("*").alias("n"))


def clean_items(items: DataFrame, unit: str, *order: Column) -> DataFrame:
    """Multiple-choice items and plain-number answers of each unit, renumbered QA1 on."""
    kept = items.where((F.size("options") > 0) | F.col("answer").rlike(r"^\s*-?\d+(?:\.\d+)?\s*$"))
    place = F.row_number().over(W.partitionBy(unit).orderBy(*order))
    return kept.withColumn("qa_id", F.concat(F.lit("QA"), place.cast("string")))


def wide_reviews(reviews: DataFrame, key: str, providers: list[str], least: float) -> DataFrame:
    """One row an item: each provider's decision and confidence, and the tier that they give."""
    of = lambda c, p: F.max(F.when(F.col("provider") == p, F.col(c)))
    wide = reviews.groupBy(key).agg(*[x for p in providers for x in (of("decision", p).alias(f"{p}_decision"), of("confidence", p).alias(f"{p}_confidence"))])
    keeps = sum(F.coalesce((F.col(f"{p}_decision") == "KEEP").cast("int"), F.lit(0)) for p in providers)
    sure = F.least(*[F.coalesce(f"{p}_confidence", F.lit(0.0)) for p in providers]) >= least
    tier = F.when((keeps == len(providers)) & sure, "strict").when(keeps == len(providers), "unsure").when(keeps > 0, "split").otherwise("rejected")
    return wide.withColumn("tier", tier)


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(place, line) of a Markdown table: header, rule, then a line for each row in the order of the columns."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = rows.select(F.lit(2).alias("place"), cells.alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "| " + " | ".join("---" for _ in columns) + " |")]
    return rows.sparkSession.createDataFrame(head, "place int, line string").union(body)


def chart_artifact(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, series): a JSON array of points in the order of ``x``."""
    points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return rows.groupBy(group).agg(F.to_json(points).alias("series"))


def stage_progress(body: Column) -> Column:
    """Struct (percent, status) of a progress file's JSON text: bounded, done at 100, failed if it has an error."""
    done, total = (F.get_json_object(body, f"$.{k}").try_cast("double") for k in ("done", "total"))
    percent = F.when(total <= 0, 100.0).when(done.isNotNull() & total.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), done * 100 / F.nullif(total, F.lit(0.0)))))
    failed = F.get_json_object(body, "$.error").isNotNull()
    return F.struct(percent.alias("percent"), F.when(failed, "failed").when(percent.isNull(), "unknown").when(percent >= 100, "done").otherwise("running").alias("status"))


def checkpoint_interval(items: Column, least: int = 10, most: int = 500) -> Column:
    """A hundredth of the items, between two bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(items / 100))).cast("int")
