"""Contracts of generated items and of releases as rule columns, and the tables a release is put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import UNANSWERABLE, content_text, fold_text, key_terms, squash_space, text
from folio.operators.contracts import codes, rule

# Shapes of a question that asks two things, and of a summary that finds no common theme.
PARALLEL = (r"\b(respectively|first,? .*second|for each document)\b", r"\bwhat\b[^?]{0,260}\band\s+(?:how|what|which|determine|does|is)\b")
INCOHERENT = (
    r"\black(?:s|ing)? (?:a |any )?(?:common|coherent|shared)",
    r"\bno (?:clear |meaningful )?(?:common|scientific|thematic)",
    r"\bunrelated\b",
    r"\bdisparate\b",
    r"\blimited (?:common|thematic|scientific)",
    r"\bdo not share\b",
    r"\bacross different domains\b",
    r"\bdifferent domains\b",
)
# Components of the scoring table whose task names them.
PLAIN_TASKS = ("General", "Unanswerable")


def is_parallel_question(question: Column) -> Column:
    """Whether a question asks two things side by side."""
    folded = fold_text(question)
    return folded.rlike(PARALLEL[0]) | folded.rlike(PARALLEL[1])


def is_coherent(summary: Column) -> Column:
    """Whether a bundle's summary is filled and does not deny a common theme."""
    folded = fold_text(summary)
    out = folded != ""
    for pattern in INCOHERENT:
        out = out & ~folded.rlike(pattern)
    return out


def leaks(answer: Column, question: Column, least: int) -> Column:
    """Whether the folded answer of at least ``least`` characters stands in the folded question."""
    folded = content_text(answer)
    return (F.length(folded) >= least) & F.contains(content_text(question), folded)


def cross_item_codes(question: Column, answer: Column, docs: Column, pages: Column, kind: Column, kinds: list[str], facts: Column) -> Column:
    """Static codes of a cross-document candidate; null lists count as missing."""
    n_docs = F.size(F.array_distinct(docs))
    return codes(
        rule((content_text(question) == "") | (content_text(answer) == ""), "empty_question_or_answer"),
        rule(leaks(answer, question, 5), "answer_leakage"),
        rule(~F.coalesce(n_docs.isin(2, 3), F.lit(False)), "invalid_source_document_count"),
        rule(F.coalesce(F.size(F.array_distinct(pages)), F.lit(0)) < 2, "insufficient_evidence_pages"),
        rule(~F.coalesce(kind.isin(*kinds), F.lit(False)), "invalid_reasoning_type"),
        rule(facts.isNull(), "missing_intermediate_facts"),
    )


def generated_item_codes(question: Column, answer: Column, sources: Column, known: Column, least: int, most: int, longest: int = 300, fewest_words: int = 8) -> Column:
    """Codes of a generated single-document item by its texts and source ids; ``known`` are the paper's own ids."""
    n = F.coalesce(F.size(F.array_distinct(sources)), F.lit(0))
    words = F.size(F.regexp_extract_all(text(answer), F.lit(r"(?U)(\w+)"), 1))
    return codes(
        rule(squash_space(question) == "", "empty_question"),
        rule(squash_space(answer) == "", "empty_answer"),
        rule(F.length(squash_space(answer)) > longest, "answer_too_long"),
        rule(~n.between(least, most), "invalid_source_qa_count"),
        rule(F.size(F.array_except(sources, known)) > 0, "unknown_source_qa_id"),
        rule(text(question).rlike(r"(?i)\bQA\s*\d+\b"), "question_mentions_qa_id"),
        rule(text(answer).rlike(r"(?i)\bQA\s*\d+\b"), "answer_mentions_qa_id"),
        rule(words < fewest_words, "answer_too_short_for_intermediate_facts"),
        rule(leaks(answer, question, 4), "answer_leaked_in_question"),
    )


def is_noop(corrected: list[Column], original: list[Column], new_pages: Column, old_pages: Column) -> Column:
    """Whether a correction names something and changes nothing: texts equal when folded, pages equal as sets."""
    sets = lambda p: F.array_sort(F.array_distinct(F.coalesce(p, F.array().cast("array<int>"))))
    named = F.coalesce(F.size(new_pages), F.lit(0)) > 0
    same = ~named | (sets(new_pages) == sets(old_pages))
    for new, old in zip(corrected, original, strict=True):
        filled = text(new) != ""
        named, same = named | filled, same & (~filled | (fold_text(new) == fold_text(old)))
    return named & same


def fact_diagnostics(facts: Column, inferences: Column, declared: Column, answer: Column) -> Column:
    """Struct of the counts of filled facts and inferences, the answer's words, the best overlap, and whether they do."""
    filled = lambda xs: F.filter(xs, lambda x: squash_space(x) != "")
    bridges = F.concat(filled(facts), filled(F.coalesce(declared, F.array().cast("array<string>"))))
    own = key_terms(answer, 3)
    overlap = F.coalesce(F.array_max(F.transform(bridges, lambda b: F.size(F.array_intersect(own, key_terms(b, 3))))), F.lit(0))
    words = F.size(F.filter(F.split(squash_space(answer), " "), lambda w: w != ""))
    n_facts, n_inferences = F.size(filled(facts)), F.size(filled(inferences))
    valid = (n_facts >= 2) & (n_inferences >= 1) & (words >= 8) & (overlap >= 2)
    return F.struct(n_facts.alias("fact_steps"), n_inferences.alias("inference_steps"), words.alias("answer_words"), overlap.alias("max_overlap"), valid.alias("valid"))


def full_coverage_candidates(candidates: DataFrame, sources: DataFrame, key: str, docs: int) -> DataFrame:
    """First valid candidate of each id whose pages lie in all ``docs`` documents of its bundle.

    ``candidates(bundle, place, key, question, answer, pages)``; ``sources(bundle, doc, first, last)`` are page ranges. A
    candidate with a page in no document is not valid.
    """
    fine = candidates.where((F.trim(text(F.col("question"))) != "") & (F.trim(text(F.col("answer"))) != "") & (F.size("pages") > 0) & F.forall("pages", lambda p: F.coalesce(p >= 1, F.lit(False))))
    cited = fine.select("bundle", key, "place", F.explode(F.array_distinct("pages")).alias("page"))
    mapped = cited.join(sources, "bundle").where(F.col("page").between(F.col("first"), F.col("last")))  # a bundle has few documents
    covered = mapped.groupBy("bundle", key, "place").agg(F.count_distinct("doc").alias("n"), F.count_distinct("page").alias("pages")).where(F.col("n") == docs)
    sized = fine.select("bundle", key, "place", F.size(F.array_distinct("pages")).alias("cited"))
    good = covered.join(sized, ["bundle", key, "place"]).where("pages = cited")
    return good.groupBy("bundle", key).agg(F.min("place").alias("place"))


def selection_prediction(answer: Column, pages: Column, page_count: Column) -> Column:
    """Struct (answer, pages, changed, problem) of a model's page selection; ``problem`` is null for a legal one."""
    bare, ordered = F.trim(text(answer)), F.array_sort(F.array_distinct(pages))
    problem = (
        F.when(bare == "", "answer_pre must be a non-empty string")
        .when(pages.isNull() | F.exists(pages, lambda p: p.isNull()), "evidence_pages must be an integer list")
        .when(F.exists(pages, lambda p: (p < 1) | (p > page_count)), "evidence_pages must be within the PDF")
        .when((bare == UNANSWERABLE) & (F.size(ordered) > 0), "Unanswerable requires empty evidence_pages")
        .when((bare != UNANSWERABLE) & (F.size(ordered) == 0), "An answer requires at least one evidence page")
    )
    return F.struct(bare.alias("answer"), ordered.alias("pages"), (pages != ordered).alias("changed"), problem.alias("problem"))


def final_dataset_codes(items: DataFrame, key: str, question: str, verdicts: DataFrame, providers: int, least: float) -> DataFrame:
    """(key, code) of what keeps items out of a final dataset: questions blank or repeated, reviewers missing or unsure.

    ``verdicts(key, provider, decision, confidence)``. The first of equal questions (by key) is not repeated.
    """
    folded = fold_text(F.col(question))
    first = W.partitionBy("_q").orderBy(key)
    rows = items.select(key, folded.alias("_q")).withColumn("_r", F.when(F.col("_q") != "", F.row_number().over(first)))
    kept = (F.col("decision") == "KEEP") & (F.col("confidence") >= least)
    said = verdicts.groupBy(key).agg(F.count_distinct("provider").alias("_n"), F.coalesce(F.bool_and(F.col("decision") == "KEEP"), F.lit(False)).alias("_keep"), F.coalesce(F.bool_and(kept | (F.col("decision") != "KEEP")), F.lit(False)).alias("_sure"))
    both = rows.join(said, key, "left")
    found = codes(
        rule(F.col("_q") == "", "empty_question"),
        rule(F.col("_r") > 1, "duplicate_question"),
        rule(F.coalesce("_n", F.lit(0)) < providers, "missing_validation"),
        rule(~F.col("_keep"), "not_kept"),
        rule(F.col("_keep") & ~F.col("_sure"), "confidence_below_threshold"),
    )
    return both.select(key, F.explode_outer(found).alias("code")).where("code is not null")


def ablation_codes(variants: DataFrame, base: DataFrame) -> DataFrame:
    """(variant, codes) of leave-one-page-out variants against their base items.

    ``variants(variant, item, removed, question, answer, pages, shown)``, ``base(item, question, answer, pages)``.
    """
    b = base.select("item", *[F.col(c).alias(f"b_{c}") for c in ("question", "answer", "pages")])
    both = variants.join(b, "item", "left")
    shown = F.array_remove(F.col("b_pages"), F.col("removed"))
    found = codes(
        rule(F.col("variant") != F.concat(F.col("item").cast("string"), F.lit("__drop_p"), F.col("removed").cast("string")), "variant_id_mismatch"),
        rule(F.col("b_pages").isNull(), "base_missing"),
        rule(F.col("question") != F.col("b_question"), "question_mismatch"),
        rule(F.col("answer") != F.col("b_answer"), "answer_mismatch"),
        rule(F.col("pages") != F.col("b_pages"), "evidence_mismatch"),
        rule(~F.array_contains("b_pages", F.col("removed")), "removed_page_is_no_evidence"),
        rule(F.col("shown") != shown, "shown_pages_mismatch"),
    )
    return both.select("variant", found.alias("codes"))


def supported_items(support: DataFrame, sources: DataFrame) -> DataFrame:
    """Support rows (bundle, doc, page, fact) with the document's own page number and paper.

    ``sources(bundle, doc, first, paper)``: the document begins at page ``first`` of its bundle.
    """
    return support.join(sources, ["bundle", "doc"]).select("bundle", "doc", "page", (F.col("page") - F.col("first") + 1).alias("source_page"), "paper", F.trim("fact").alias("fact"))


def provenance_mismatches(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items (item, source_ids, pages) whose pages are not the union of their sources' (source, pages), with both."""
    cited = items.select("item", F.explode("source_ids").alias("source")).join(sources.select("source", F.col("pages").alias("p")), "source")
    rebuilt = cited.select("item", F.explode("p").alias("page")).groupBy("item").agg(F.array_sort(F.collect_set("page")).alias("rebuilt"))
    both = items.select("item", F.array_sort("pages").alias("pages")).join(rebuilt, "item", "left").withColumn("rebuilt", F.coalesce("rebuilt", F.array().cast("array<int>")))
    return both.where(F.col("pages") != F.col("rebuilt"))


def clear_unanswerable(items: DataFrame, answer: str, lists: list[str], numbers: list[str]) -> DataFrame:
    """Items with the evidence of unanswerable ones emptied, and the names of the fields that changed."""
    refused = fold_text(F.col(answer)) == UNANSWERABLE.lower()
    empty = {c: F.array().cast(items.schema[c].dataType) for c in lists} | {c: F.lit(0).cast(items.schema[c].dataType) for c in numbers}
    changed = F.array_compact(F.array(*[F.when(refused & F.col(c).isNotNull() & (F.col(c) != e), F.lit(c)) for c, e in empty.items()]))
    out = items.withColumn("changed", changed)
    return out.withColumns({c: F.when(refused & F.col(c).isNotNull(), e).otherwise(F.col(c)) for c, e in empty.items()})


def apply_modalities(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Items with the decided modalities and what they were; the job fails at an item without a decision."""
    joined = items.join(decisions.select(key, F.col("modalities").alias("_new")), key, "left")
    new = F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("no modality decision for "), F.col(key).cast("string"))).cast("array<string>"))
    return joined.withColumns({"previous": F.col("modalities"), "modalities": new}).drop("_new")


def rewrite_paths(rows: DataFrame, path: str, mapping: DataFrame, *within: str) -> DataFrame:
    """Rows with old paths replaced by new ones of ``mapping(*within, old, new)``; others stay.

    With ``within``, a path is replaced only in rows of the mapping's key: the same path may have another new one elsewhere.
    """
    m = mapping.select(*[F.col(c).alias(f"_m_{c}") for c in within], F.col("old").alias("_old"), F.col("new").alias("_new"))
    on = F.col(path).eqNullSafe(F.col("_old"))
    for c in within:
        on = on & (F.col(c) == F.col(f"_m_{c}"))
    return rows.join(m, on, "left").withColumn(path, F.coalesce("_new", path)).select(*rows.columns)


def exact_candidates(rows: DataFrame, gold: DataFrame, document: str, question: str, key: str) -> DataFrame:
    """(row, candidates) of the gold keys with the same document and folded question, in order; none is an empty list."""
    g = gold.select(document, fold_text(F.col(question)).alias("_q"), F.col(key).alias("_k")).groupBy(document, "_q").agg(F.array_sort(F.collect_set("_k")).alias("candidates"))
    out = rows.withColumn("_q", fold_text(F.col(question))).join(g, [document, "_q"], "left")
    return out.withColumn("candidates", F.coalesce("candidates", F.array().cast(g.schema["candidates"].dataType))).drop("_q")


def dataset_of(dataset: Column, task: Column, plain: str) -> Column:
    """The stated dataset, else the plain one of a plain task; the job fails for any other."""
    return F.when(text(dataset) != "", dataset).when(task.isin(*PLAIN_TASKS), plain).otherwise(F.raise_error(F.lit("a task of several components needs its dataset")).cast("string"))
