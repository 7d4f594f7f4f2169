"""What binds a run to its inputs, envelopes of model responses, payloads of prompts, records of runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.hashing import content_id, json_text
from folio.functions.text import fold_text, text
from folio.operators.contracts import assert_clean, codes, rule
from folio.operators.guards import require_known, require_single, require_total, require_unique

# Synonyms of reasoning types.
REASONING_ALIASES = {
    "calculation": "multi_step_calculation",
    "intersection_of_constraints": "constraint_intersection",
    "causal_inference": "causal_chain",
    "comparative_inference": "comparison",
    "comparison_inference": "comparison",
}
# Fields of an inference row that can change a verdict.
BINDING_FIELDS = (
    "evaluated_model",
    "question",
    "correct_answer",
    "model_output",
    "raw_model_output",
    "raw_model_output_sha256",
    "generation_audit",
    "generation_status",
    "deterministic_normalizations",
    "type",
    "input_mode",
    "require_structured_output",
    "require_evidence_pages",
    "reference_evidence_pages",
    "page_input_policy",
    "prompt_style",
    "shown_pdf_pages",
    "total_pdf_pages",
    "max_pdf_pages",
    "protocol_fingerprint",
    "qa_source_sha256",
    "pdf_corpus_sha256",
    "pdf_sha256",
)
# Fields of a candidate that a reviewer sees, and those of a hard one beside them.
CANDIDATE_FIELDS = ("question", "answer", "source_qa_ids", "reasoning_type", "relation", "derivation")
HARD_FIELDS = (
    "reasoning_focus",
    "derived_conclusion",
    "intermediate_facts",
    "source_necessity_tests",
    "source_evidence_pages",
    "construction_key_evidence_pages",
    "evidence_span",
    "hard_construction_quality_check",
)


def provider_name(provider: Column, model: Column, aliases: dict[str, str]) -> Column:
    """The stated provider, else the model's; a row with neither fails the job."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("no provider for model "), text(model)))
    return F.coalesce(F.nullif(provider, F.lit("")), F.try_element_at(known, model), unknown)


def reasoning_type(value: Column) -> Column:
    """Struct (kind, original): the canonical type, and the text that stood there if it was a synonym."""
    known = F.create_map(*[F.lit(x) for pair in REASONING_ALIASES.items() for x in pair])
    bare = F.trim(text(value))
    kind = F.coalesce(F.try_element_at(known, bare), bare)
    return F.struct(kind.alias("kind"), F.when(kind != bare, bare).alias("original"))


def relation_templates(roles: Column, shared: Column) -> Column:
    """Sorted relations that the facts' role sets (an array of arrays) support; none without shared terms."""
    count = lambda r: F.size(F.filter(roles, lambda x: F.array_contains(x, r)))
    some = {r: count(r) > 0 for r in ("limitation", "requirement", "metric_label", "method", "producer", "consumer", "transfer")}
    bound = some["limitation"] | some["requirement"]
    conflict = some["limitation"] & some["requirement"]
    metric = (some["limitation"] & (count("metric_label") >= 2)) | (some["metric_label"] & (some["method"] | some["requirement"]))
    moved = some["transfer"] & bound
    found = F.array_compact(
        F.array(
            rule(some["producer"] & some["consumer"], "adjacent_module_dependency"),
            rule(conflict | metric | moved, "compatibility_judgment"),
            rule(count("hierarchy") >= 2, "component_hierarchy"),
            rule(conflict, "conflict_resolution"),
            rule(moved, "method_transfer"),
            rule(metric, "metric_reasoning"),
        )
    )
    return F.when(F.coalesce(F.size(shared), F.lit(0)) > 0, found).otherwise(F.array().cast("array<string>"))


def prompt(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by that value, in one pass: braces inside a value stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[text(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def binding_hash(rows: DataFrame) -> Column:
    """Hash of the JSON object of all binding fields with sorted keys; a column that ``rows`` lacks counts as null."""
    cells = [F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in sorted(BINDING_FIELDS)]
    return F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)


def judge_values(rows: DataFrame, paper: str, qa: str, run: dict[str, str]) -> DataFrame:
    """(paper, qa, binding) of inference rows that a judge's run may use.

    The job fails at a row of another protocol, source or mode than ``run`` states, and if rows mix document corpora.
    """
    wanted = {k: str(run.get(k) or "").strip() for k in ("protocol_fingerprint", "qa_source_sha256", "input_mode")}
    if not all(wanted.values()):
        raise ValueError("incomplete metadata of a judge's run")
    kept = rows.where(~F.col(paper).startswith("__"))
    wrong = codes(*[rule(~F.col(k).eqNullSafe(F.lit(v)), f"other_{k}") for k, v in wanted.items()])
    one = require_single(assert_clean(kept, wrong, "inference row"), "pdf_corpus_sha256")
    return one.select(paper, qa, binding_hash(rows).alias("inference_binding_sha256"))


def inference_values(papers: DataFrame, hashes: DataFrame, key: str, run: dict, documents: bool) -> DataFrame:
    """Every paper with the values that its rows must hold: those of the run and, with documents, the paper's hash.

    The job fails unless ``hashes(key, pdf_sha256)`` has each paper once and no other.
    """
    if not str(run.get("protocol_fingerprint") or "").strip():
        raise ValueError("a run without a fingerprint")
    wanted = papers.where(~F.col(key).startswith("__")).select(key).distinct()
    if documents:
        rows = wanted.join(require_known(require_total(require_unique(hashes, key), wanted, key), wanted, key).select(key, "pdf_sha256"), key)
    else:
        rows = wanted.withColumn("pdf_sha256", F.lit(None).cast("string"))
    return rows.withColumns({k: F.lit(v) for k, v in run.items()})


def pinned(existing: DataFrame, current: DataFrame, key: str, *fields: str) -> DataFrame:
    """Current manifests to write: new ones, and those that are as they were; a change of a field fails the job."""
    old = existing.select(key, F.lit(True).alias("_old"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = current.join(old, key, "left")
    changed = codes(*[rule(F.col("_old") & ~F.col(f).eqNullSafe(F.col(f"_{f}")), f"changed_{f}") for f in fields])
    return assert_clean(rows, changed, "manifest").select(key, *fields)


def manifest_codes(body: Column, source: Column, expected: dict[str, Column], needed: tuple[str, ...]) -> Column:
    """Codes of a judge's manifest (JSON text): its version, source and metadata, and that provider and settings agree.

    ``expected`` are values of the metadata; ``needed`` are fields of it that must be filled.
    """
    at = lambda path: F.get_json_object(body, f"$.{path}")
    empty = ("", "{}", "[]", "0", "false")
    provider, config = at("metadata.judge_provider_identity.provider_name"), at("metadata.judge_config.judge_provider_name")
    return codes(
        rule(F.coalesce(at("version").try_cast("int"), F.lit(0)) < 2, "old_manifest"),
        rule(~at("source_sha256").eqNullSafe(source), "source_mismatch"),
        *[rule(~at(f"metadata.{k}").eqNullSafe(v), f"{k}_mismatch") for k, v in expected.items()],
        *[rule(at(f"metadata.{k}").isNull() | at(f"metadata.{k}").isin(*empty), f"no_{k}") for k in needed],
        rule(~provider.eqNullSafe(config), "provider_mismatch"),
    )


def record_codes(structured: Column, evidence: Column, wanted: Column, shown: Column, reference: Column) -> Column:
    """Codes of an inference record whose flags or pages contradict ``wanted``, the struct (structured, evidence) of its mode."""
    none = lambda pages: F.coalesce(F.size(pages), F.lit(0)) == 0
    asked = wanted["structured"]
    return codes(
        rule(F.coalesce(structured, F.lit(False)) != asked, "structured_mismatch"),
        rule(F.coalesce(evidence, F.lit(False)) != wanted["evidence"], "evidence_mismatch"),
        rule(asked & none(shown), "no_shown_pages"),
        rule(asked & wanted["evidence"] & none(reference), "no_gold_pages"),
        rule(asked & ~wanted["evidence"] & ~none(reference), "gold_pages_of_refusal"),
    )


def rescorable(question: Column, gold_question: Column, sent: Column, path: Column, aliases: Column, pages: Column, gold_pages: Column, sha: Column, asset_sha: Column) -> Column:
    """Whether a changed reference may be scored anew: the model's inputs are the same.

    ``sent`` holds the flags that gold was sent; each must be false. ``aliases`` are the asset's paths, null without an
    asset. Pages and hash count only where the row states them.
    """
    stated = lambda c, want: c.isNull() | F.coalesce(c == want, F.lit(False))
    inside = ~F.array_contains(F.split(path, "/"), "..")
    known = F.exists(aliases, lambda a: (path == a) | F.endswith(path, F.concat(F.lit("/"), a)))
    unsent = F.forall(sent, lambda s: F.coalesce(~s, F.lit(False)))
    return F.coalesce((question == gold_question) & unsent & inside & known & stated(pages, gold_pages) & stated(sha, asset_sha), F.lit(False))


def response_shape(body: Column, bundle: Column) -> Column:
    """Struct (response, notes): a lone item is wrapped as a response of its bundle; all else stays as it is."""
    keys = F.json_object_keys(body)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    lone = has("question") & has("answer") & ~has("items") & ~has("bundle_id")
    wrapped = F.concat(F.lit('{"bundle_id":'), json_text(bundle), F.lit(',"items":['), body, F.lit("]}"))
    return F.struct(F.when(lone, wrapped).otherwise(body).alias("response"), codes(rule(lone, "wrapped_single_item_response")).alias("notes"))


def response_codes(responses: DataFrame, key: str, body: str, id_field: str) -> DataFrame:
    """(key, item_index, codes) of responses: a row for the envelope (null index) and one for each item.

    Items are tried in the order of key and place; of those without other faults that ask the same question, the first
    counts. A body that is no JSON has no id and no items.
    """
    parsed = responses.select(key, F.try_parse_json(body).alias("v")).select(
        key, F.try_variant_get("v", f"$.{id_field}", "string").alias("id"), F.try_variant_get("v", "$.items", "array<variant>").alias("items")
    )
    envelope = codes(rule(~F.col("id").eqNullSafe(F.col(key).cast("string")), f"{id_field}_mismatch"), rule(F.col("items").isNull(), "items_not_list"))
    field = lambda k: F.trim(text(F.try_variant_get("item", f"$.{k}", "string")))
    rows = parsed.select(key, F.posexplode("items").alias("item_index", "item"))
    rows = rows.select(key, "item_index", F.schema_of_variant("item").startswith("OBJECT").alias("fits"), field("question").alias("q"), field("answer").alias("a"))
    own = codes(rule(~F.col("fits"), "item_not_object"), rule(F.col("fits") & ((F.col("q") == "") | (F.col("a") == "")), "empty_question_or_answer"))
    rows = rows.select(key, "item_index", fold_text(F.col("q")).alias("q"), own.alias("codes"))
    place = F.struct(key, "item_index")
    first = F.min(F.when(F.size("codes") == 0, place)).over(W.partitionBy("q"))
    repeated = (F.size("codes") == 0) & (first != place)
    items = rows.withColumn("codes", F.when(repeated, F.array(F.lit("duplicate_question"))).otherwise(F.col("codes")))
    return parsed.select(key, F.lit(None).cast("int").alias("item_index"), envelope.alias("codes")).union(items.select(key, "item_index", "codes"))


def _covered(pages: Column, sources: Column) -> Column:
    """Sorted numbers of the documents whose merged range holds a page."""
    hit = F.filter(sources, lambda s: F.exists(pages, lambda p: p.between(s["merged_start"], s["merged_end"])))
    return F.array_sort(F.array_distinct(F.transform(hit, lambda s: s["doc_number"])))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the array ``_s`` of their bundle's documents: a few a bundle."""
    one = F.struct("doc_number", "merged_start", "merged_end")
    return rows.join(sources.groupBy("bundle").agg(F.array_sort(F.collect_list(one)).alias("_s")), "bundle", "left")


def fulltext_codes(items: DataFrame, sources: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(bundle, qa_id, pages, codes) of items (bundle, question, answer, reasoning_type, docs, doc_count, pages, fact_docs).

    Every document of the bundle must be named, hold evidence and give a fact. ``qa_id`` is bound to bundle and question.
    """
    rows = _with_sources(items, sources)
    question, answer = F.trim(text(F.col("question"))), F.trim(text(F.col("answer")))
    n = F.coalesce(F.size("_s"), F.lit(0))
    expected = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    distinct = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    fits = (F.size("pages") > 0) & F.forall("pages", lambda p: p.isNotNull())
    covered = F.when(fits & (n > 0), _covered(F.col("pages"), F.col("_s"))).otherwise(F.array().cast("array<int>"))
    found = codes(
        rule((question == "") | (answer == ""), "empty_question_or_answer"),
        rule((F.length(answer) >= 5) & F.contains(F.lower(question), F.lower(answer)), "answer_leakage"),
        rule(~F.coalesce(F.col("reasoning_type").isin(*kinds), F.lit(False)), "invalid_reasoning_type"),
        rule(~distinct("docs").eqNullSafe(expected), "source_docs_do_not_cover_bundle"),
        rule(~F.col("doc_count").eqNullSafe(n), "wrong_source_document_count"),
        rule(~F.coalesce(fits, F.lit(False)), "invalid_evidence_pages"),
        rule(~covered.eqNullSafe(expected), "evidence_does_not_cover_all_sources"),
        rule(~distinct("fact_docs").eqNullSafe(expected), "intermediate_facts_do_not_cover_all_sources"),
    )
    return rows.select("bundle", content_id("FTQA_", F.col("bundle").cast("string"), question).alias("qa_id"), distinct("pages").alias("pages"), found.alias("codes"))


def challenge_candidates(rows: DataFrame, sources: DataFrame, parallel: str, documents: int = 3) -> DataFrame:
    """Candidates that hold all a challenge item needs, normalized; the others are no candidates.

    ``rows``: (bundle, candidate_id, question, answer, conclusion, failures, pages, support), where ``failures`` has a text for
    each document left out and ``support`` is an array of (doc_number, page, fact). Support on other pages than the
    candidate's, in another document than stated or without a fact is dropped; what is left must cover every document.
    ``parallel`` matches questions that merely join others.
    """
    bare = lambda c: F.trim(text(F.col(c)))
    wanted = F.sequence(F.lit(1), F.lit(documents))
    filled = [bare(c) != "" for c in ("candidate_id", "question", "answer", "conclusion")]
    ablated = (F.size("failures") >= documents) & F.forall("failures", lambda f: F.trim(text(f)) != "")
    paged = (F.size("pages") > 0) & F.forall("pages", lambda p: F.coalesce(p >= 1, F.lit(False)))
    good = F.filter(
        "support",
        lambda s: F.coalesce(F.array_contains("pages", s["page"]) & (F.trim(text(s["fact"])) != "") & (_covered(F.array(s["page"]), F.col("_s")) == F.array(s["doc_number"])), F.lit(False)),
    )
    kept = _with_sources(rows, sources).where(ablated & paged & ~bare("question").rlike(parallel) & (_covered(F.col("pages"), F.col("_s")) == wanted))
    for fine in filled:
        kept = kept.where(fine)
    kept = kept.withColumn("support", good).where(F.array_sort(F.array_distinct(F.transform("support", lambda s: s["doc_number"]))) == wanted)
    trimmed = {c: bare(c) for c in ("candidate_id", "question", "answer")}
    return kept.withColumns({**trimmed, "pages": F.array_sort(F.array_distinct("pages"))}).drop("_s")


def bundle_text(sources: DataFrame) -> DataFrame:
    """(bundle, text): the documents' texts in their order, each under a line with its number and title and one with its pages."""
    head = F.concat(F.lit("\n######## DOC "), F.col("doc_number").cast("string"), F.lit(": "), text(F.col("title")), F.lit(" ########\npaper_id="), text(F.col("paper")))
    span = F.concat(F.lit("; merged physical pages "), F.col("merged_start").cast("string"), F.lit("-"), F.col("merged_end").cast("string"), F.lit("\n"))
    block = F.struct("doc_number", F.concat(head, span, text(F.col("text"))).alias("b"))
    return sources.groupBy("bundle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "").alias("text"))


def evidence_page_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(bundle, page, doc_number, source_page) of the distinct pages that items with more than text need.

    A page in no document's range fails the job.
    """
    more = F.size(F.array_except("modalities", F.array(F.lit("text")))) > 0
    pages = items.where(more).select("bundle", F.explode("pages").alias("page")).distinct()
    s = sources.select(F.col("bundle").alias("_b"), "doc_number", "merged_start", "merged_end")
    rows = pages.join(s, (F.col("bundle") == F.col("_b")) & F.col("page").between(F.col("merged_start"), F.col("merged_end")), "left")
    rows = assert_clean(rows, codes(rule(F.col("doc_number").isNull(), "unmapped_page")), "evidence page")
    return rows.select("bundle", "page", "doc_number", (F.col("page") - F.col("merged_start") + 1).alias("source_page"))


def prompt_sources(items: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Facts and document numbers of source items, never their pages; only those of ``wanted(source_qa_id)`` if given."""
    kept = items if wanted is None else items.join(wanted, "source_qa_id", "left_semi")
    return kept.select("source_qa_id", "question", "answer", "source_doc_numbers")


def candidate_payload(items: DataFrame, hard: bool = False) -> DataFrame:
    """The fields of candidates that a reviewer sees; one that ``items`` lacks is null."""
    fields = CANDIDATE_FIELDS + (HARD_FIELDS if hard else ())
    return items.select(F.col("qa_id").cast("string").alias("qa_id"), *[F.col(f) if f in items.columns else F.lit(None).cast("string").alias(f) for f in fields])


def search_complete(completed: Column, target: Column, status: Column, exhausted: Column, rounds: Column) -> Column:
    """Whether a run has its target; the job fails at a run that has searched all its rounds without reaching it."""
    over = (status == "search_space_exhausted") & (exhausted >= rounds)
    message = F.concat(F.lit("search_space_exhausted: accepted="), completed.cast("string"), F.lit("/"), target.cast("string"))
    return F.when(completed >= target, True).when(over, F.raise_error(message).cast("boolean")).otherwise(False)


def completed_tasks(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(task, completed): all its paths exist, or its state file has the expected status.

    ``tasks``: (task, paths, state_path, expected), null for ``completed``; ``files``: (path, status), each path once.
    """
    known = require_unique(files, "path")
    there = known.select("path", F.lit(True).alias("there"))
    paths = tasks.select("task", F.explode(F.array_distinct("paths")).alias("path")).join(there, "path", "left")
    whole = paths.groupBy("task").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole"))
    rows = tasks.join(whole, "task", "left").join(files.select(F.col("path").alias("state_path"), "status"), "state_path", "left")
    state = F.col("status") == F.coalesce("expected", F.lit("completed"))
    return rows.select("task", (F.coalesce("whole", F.lit(False)) | F.coalesce(state, F.lit(False))).alias("completed"))


def audit_rows(rows: DataFrame, action: Column, target_type: str, target: Column, actor: Column, at: Column, details: Column) -> DataFrame:
    """Audit events to append; the id is a hash of the event, so an append that is repeated adds none."""
    body = F.to_json(details)
    key = content_id("AU_", action, target.cast("string"), actor.cast("string"), at.cast("string"), body)
    return rows.select(key.alias("audit_id"), action.alias("action"), F.lit(target_type).alias("target_type"), target.cast("string").alias("target_id"), actor.cast("string").alias("actor"), body.alias("details"))


def incident_rows(rows: DataFrame, task: Column, category: Column, message: Column, log: Column, most: int = 20000) -> DataFrame:
    """Incidents to append, each with the end of its task's log."""
    return rows.select(task.alias("task"), category.alias("category"), message.alias("message"), F.right(text(log), F.lit(most)).alias("log_tail"))


def recorded_scores(items: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Percentages of each model over fixed denominators, from items (model, task, present, correct, precision, recall, f1, pages).

    An item that is not present counts as wrong and as no pages.
    """
    n = sum(sizes.values())
    hit = lambda c: F.count_if(c & (F.col("correct") == 1))
    mean = lambda c, scale: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) * scale / n
    parts = [(100.0 * hit(F.col("task") == t) / size).alias(t) for t, size in sizes.items()]
    pages = [mean("precision", 100).alias("e_precision"), mean("recall", 100).alias("e_recall"), mean("f1", 100).alias("e_f1"), mean("pages", 1).alias("a_pages")]
    return items.where(F.col("present") == 1).groupBy("model").agg((100.0 * hit(F.lit(True)) / n).alias("all"), *parts, *pages)


def overview(items: DataFrame, answerable: Column, cross: Column, modalities: str, pages: str, distinct: dict[str, str]) -> DataFrame:
    """(place, metric, n): counts of a release's items in a fixed order, then distinct values of the columns of ``distinct``."""
    kinds, spread = F.size(F.array_distinct(modalities)), F.size(F.array_distinct(pages))
    counts = {
        "items": F.count("*"),
        "answerable": F.count_if(answerable),
        "unanswerable": F.count_if(~answerable),
        "single_document": F.count_if(~cross),
        "cross_document": F.count_if(cross),
        "single_modality": F.count_if(kinds == 1),
        "multi_modality": F.count_if(kinds > 1),
        "cross_page": F.count_if(spread > 1),
        "no_modality": F.count_if(F.coalesce(kinds, F.lit(0)) == 0),
        **{name: F.count_distinct(c) for name, c in distinct.items()},
    }
    one = items.agg(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("metric"), v.alias("n")) for i, (k, v) in enumerate(counts.items())]).alias("m"))
    return one.select(F.inline("m"))
