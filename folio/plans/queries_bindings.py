"""Queries of run bindings, response envelopes, prompt payloads and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import bindings, protocol
from folio.operators.aggregates import count_codes
from folio.sources import scans

from .registry import Tables, query

PROVIDERS = {f"m{i}": f"provider{i}" for i in range(4)}
KINDS = ("calculation", " causal_inference ", "comparison", "comparative_inference", "other", "intersection_of_constraints", "comparison_inference")
ROLES = ("limitation", "requirement", "metric_label", "method", "producer", "consumer", "hierarchy", "transfer")
PROMPT = "{dataset_id}: is {model_answer} an answer to {question}, as {correct} is?"
RANGES = ((1, 1, 10), (2, 11, 20), (3, 21, 30))


def text(c: str) -> Column:
    return F.col(c).cast("string")


@query("select p_partkey, case when p_size % 3 = 0 then p_brand else 'provider' || (p_size % 4) end as provider from part")
def provider_names(t: Tables) -> DataFrame:
    stated = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, "")
    return t.part.select("p_partkey", bindings.provider_name(stated, F.concat(F.lit("m"), (F.col("p_size") % 4).cast("string")), PROVIDERS).alias("provider"))


@query(f"""with v as (select p_partkey, trim({list(KINDS)}[p_partkey % {len(KINDS)} + 1]) bare from part), k as (select *, case bare when 'calculation' then 'multi_step_calculation' when 'causal_inference' then 'causal_chain'
 when 'comparative_inference' then 'comparison' when 'comparison_inference' then 'comparison' when 'intersection_of_constraints' then 'constraint_intersection' else bare end as kind from v)
select p_partkey, kind, case when kind <> bare then bare end as original from k""")
def reasoning_types(t: Tables) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    return t.part.select("p_partkey", bindings.reasoning_type(value).alias("r")).select("p_partkey", "r.kind", "r.original")


@query(f"""with c as (select p_partkey, {', '.join(f'(((p_partkey >> {i}) & 1) + (((p_size * 7) >> {i}) & 1)) as {r}' for i, r in enumerate(ROLES))} from part),
f as (select p_partkey, p_partkey % 5 > 0 shared, limitation > 0 and requirement > 0 conflict, limitation > 0 and metric_label > 1 or metric_label > 0 and ("method" > 0 or requirement > 0) metric,
 transfer > 0 and (limitation > 0 or requirement > 0) moved, producer > 0 and consumer > 0 adjacent, hierarchy > 1 nested from c)
select p_partkey, case when shared then concat_ws('+', case when adjacent then 'adjacent_module_dependency' end, case when conflict or metric or moved then 'compatibility_judgment' end, case when nested then 'component_hierarchy' end,
 case when conflict then 'conflict_resolution' end, case when moved then 'method_transfer' end, case when metric then 'metric_reasoning' end) else '' end as templates from f""")
def relation_suggestions(t: Tables) -> DataFrame:
    held = lambda c: F.array_compact(F.array(*[F.when(F.shiftright(c, i).bitwiseAND(F.lit(1)) == 1, r) for i, r in enumerate(ROLES)]))
    roles = F.array(held(F.col("p_partkey")), held(F.col("p_size") * 7))
    shared = F.when(F.col("p_partkey") % 5 > 0, F.array(F.lit("t")))
    return t.part.select("p_partkey", F.array_join(bindings.relation_templates(roles, shared), "+").alias("templates"))


@query("select p_partkey, p_brand || ': is {correct}' || p_name || ' an answer to ' || p_type || ', as ' || p_name || ' is?' as prompt from part")
def judge_prompts(t: Tables) -> DataFrame:
    given = F.concat(F.lit("{correct}"), F.col("p_name"))
    return t.part.select("p_partkey", bindings.prompt(PROMPT, dataset_id=F.col("p_brand"), question=F.col("p_type"), correct=F.col("p_name"), model_answer=given).alias("prompt"))


CELLS = {
    "question": "'\"' || p_name || '\"'",
    "correct_answer": "'\"' || p_type || '\"'",
    "input_mode": "'\"pdf\"'",
    "protocol_fingerprint": "'\"f\"'",
    "qa_source_sha256": "'\"s\"'",
    "pdf_corpus_sha256": "'\"c\"'",
    "shown_pdf_pages": "'[' || p_size || ',1]'",
    "max_pdf_pages": "p_size",
    "require_structured_output": "case when p_size % 2 = 0 then 'true' else 'false' end",
}
BODY = " || ',' || ".join(f"'\"{f}\":' || {CELLS.get(f, chr(39) + 'null' + chr(39))}" for f in sorted(bindings.BINDING_FIELDS))


@query(f"select p_brand as paper, p_partkey as qa, sha256('{{' || {BODY} || '}}') as inference_binding_sha256 from part")
def judge_value_contract(t: Tables) -> DataFrame:
    fixed = {"input_mode": "pdf", "protocol_fingerprint": "f", "qa_source_sha256": "s"}
    rows = t.part.select(
        F.col("p_brand").alias("paper"),
        F.col("p_partkey").alias("qa"),
        F.col("p_name").alias("question"),
        F.col("p_type").alias("correct_answer"),
        F.array("p_size", F.lit(1)).alias("shown_pdf_pages"),
        F.col("p_size").alias("max_pdf_pages"),
        (F.col("p_size") % 2 == 0).alias("require_structured_output"),
        *[F.lit(v).alias(k) for k, v in {**fixed, "pdf_corpus_sha256": "c"}.items()],
    )
    return bindings.judge_values(rows, "paper", "qa", fixed)


@query("select n_name as paper, sha256(n_name) as pdf_sha256, 'f' as protocol_fingerprint, 'pdf' as input_mode, 64 as max_pdf_pages from nation")
def inference_value_contract(t: Tables) -> DataFrame:
    hashes = t.nation.select(F.col("n_name").alias("paper"), F.sha2("n_name", 256).alias("pdf_sha256"))
    marks = t.region.select(F.concat(F.lit("__"), F.col("r_name")).alias("paper"))
    return bindings.inference_values(hashes.select("paper").union(marks), hashes, "paper", {"protocol_fingerprint": "f", "input_mode": "pdf", "max_pdf_pages": 64}, True)


@query("select n_nationkey, n_name, n_regionkey from nation")
def pinned_manifests(t: Tables) -> DataFrame:
    return bindings.pinned(t.nation.where("n_nationkey % 2 = 0"), t.nation, "n_nationkey", "n_name", "n_regionkey")


@query("""with c as (select unnest(list_concat(list_concat(case when p_partkey % 3 = 0 then ['old_manifest'] else [] end, case when p_partkey % 5 = 0 then ['source_mismatch'] else [] end), list_concat(list_concat(case when p_size % 2 = 0 then ['stage_mismatch'] else [] end,
 case when p_partkey % 7 = 0 then ['no_judge_config'] else [] end), case when p_size % 3 > 0 or p_partkey % 7 = 0 then ['provider_mismatch'] else [] end))) as code from part) select code, count(*) n from c group by code""")
def judge_manifests(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    config = F.when(k % 7 > 0, F.struct(F.concat(F.lit("m"), (size % 3).cast("string")).alias("judge_provider_name")))
    metadata = F.struct(F.when(size % 2 == 1, "judge").otherwise("inference").alias("stage"), config.alias("judge_config"), F.struct(F.lit("m0").alias("provider_name")).alias("judge_provider_identity"))
    body = F.to_json(F.struct(F.when(k % 3 > 0, 2).alias("version"), F.when(k % 5 > 0, F.col("p_name")).alias("source_sha256"), metadata.alias("metadata")))
    return count_codes(t.part, bindings.manifest_codes(body, F.col("p_name"), {"stage": F.lit("judge")}, ("judge_config", "judge_provider_identity")))


@query("""with x as (select p_partkey k, p_size % 3 > 0 doc, p_size % 3 > 0 and p_partkey % 4 <> 0 ev from part),
c as (select unnest(list_concat(list_concat(case when doc <> (k % 5 > 0) then ['structured_mismatch'] else [] end, case when ev <> (k % 3 > 0) then ['evidence_mismatch'] else [] end), list_concat(case when doc and k % 7 = 0 then ['no_shown_pages'] else [] end,
 list_concat(case when doc and ev and k % 2 = 0 then ['no_gold_pages'] else [] end, case when doc and not ev and k % 2 = 1 then ['gold_pages_of_refusal'] else [] end)))) as code from x) select code, count(*) n from c group by code""")
def record_contract(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    wanted = protocol.requirements(F.when(F.col("p_size") % 3 > 0, "pdf").otherwise("question_only"), F.when(k % 4 == 0, "Unanswerable").otherwise("a"))
    pages = lambda c: F.when(c, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return count_codes(t.part, bindings.record_codes(k % 5 > 0, k % 3 > 0, wanted, pages(k % 7 > 0), pages(k % 2 == 1)))


@query("select p_partkey, p_partkey % 5 > 0 and p_partkey % 7 > 0 and p_partkey % 4 < 2 and not (p_size % 2 = 1 and p_partkey % 11 = 0) as rescorable from part")
def rescorable_rows(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    own = F.concat(F.lit("data/pdfs/"), text("p_partkey"), F.lit(".pdf"))
    path = F.concat(F.element_at(F.array(*map(F.lit, ("x/", "", "../", "a"))), (k % 4 + 1).cast("int")), own)
    fine = bindings.rescorable(
        F.when(k % 5 > 0, "q").otherwise("r"), F.lit("q"), F.array(F.lit(False), k % 7 == 0), path, F.array(F.lit("legacy.pdf"), own),
        F.when(size % 2 == 1, size), F.when(k % 11 == 0, size + 1).otherwise(size), F.lit(None).cast("string"), F.lit("h"),
    )
    return t.part.select("p_partkey", fine.alias("rescorable"))


LONE = """'{"question":"' || p_name || '","answer":"a"'"""


@query(f"""select p_partkey, case p_partkey % 4 when 0 then '{{"bundle_id":"' || p_brand || '","items":[' || {LONE} || '}}]}}' when 1 then '{{"items":[]}}' when 2 then '{{"question":"q"}}' else {LONE} || ',"bundle_id":"b"}}' end as response,
 case when p_partkey % 4 = 0 then 'wrapped_single_item_response' else '' end as notes from part""")
def response_shapes(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    lone = F.concat(F.lit('{"question":"'), F.col("p_name"), F.lit('","answer":"a"'))
    body = F.when(k == 0, F.concat(lone, F.lit("}"))).when(k == 1, '{"items":[]}').when(k == 2, '{"question":"q"}').otherwise(F.concat(lone, F.lit(',"bundle_id":"b"}')))
    return t.part.select("p_partkey", bindings.response_shape(body, F.col("p_brand")).alias("s")).select("p_partkey", "s.response", F.array_join("s.notes", ",").alias("notes"))


@query("""with o as (select distinct l_orderkey k from lineitem), i as (select 'q' || (l_partkey % 500) q, l_linenumber % 5 > 0 fine from lineitem where l_orderkey % 11 > 0)
select 'bundle_id_mismatch' as code, count(*) n from o where k % 7 = 0 union all select 'items_not_list', count(*) from o where k % 11 = 0
union all select 'empty_question_or_answer', count(*) from i where not fine union all select 'duplicate_question', count(*) - count(distinct q) from i where fine""")
def response_envelopes(t: Tables) -> DataFrame:
    one = F.struct("l_linenumber", F.concat(F.lit("q"), (F.col("l_partkey") % 500).cast("string")).alias("question"), F.when(F.col("l_linenumber") % 5 > 0, "a").otherwise(" ").alias("answer"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("bundle")).agg(F.array_sort(F.collect_list(one)).alias("items"))
    stated = F.when(F.col("bundle") % 7 == 0, "x").otherwise(text("bundle")).alias("bundle_id")
    body = F.when(F.col("bundle") % 11 == 0, F.to_json(F.struct(stated, F.lit("none").alias("items")))).otherwise(F.to_json(F.struct(stated, "items")))
    return count_codes(bindings.response_codes(rows.select("bundle", body.alias("body")), "bundle", "body", "bundle_id"), F.col("codes"))


def ranges(t: Tables) -> DataFrame:
    """Three documents of ten pages for each of 25 bundles."""
    spans = F.array(*[F.struct(F.lit(d).alias("doc_number"), F.lit(a).alias("merged_start"), F.lit(z).alias("merged_end")) for d, a, z in RANGES])
    return t.nation.select(F.col("n_nationkey").cast("int").alias("bundle"), F.inline(spans))


def bundle() -> Column:
    return (F.col("l_orderkey") % 25).cast("int").alias("bundle")


def page() -> Column:
    return (F.col("l_linenumber") * 4).cast("int")


@query("""with l as (select l_orderkey k, l_linenumber * 4 p, l_suppkey % 3 + 1 d, l_linenumber % 3 f from lineitem),
g as (select k, count(distinct (p - 1) // 10) np, count(distinct d) nd, count(distinct f) nf from l group by k),
c as (select unnest(list_concat(list_concat(case when k % 23 = 0 then ['empty_question_or_answer'] else [] end, case when k % 19 = 0 and k % 23 > 0 then ['answer_leakage'] else [] end), list_concat(list_concat(case when k % 13 = 0 then ['invalid_reasoning_type'] else [] end,
 case when nd < 3 then ['source_docs_do_not_cover_bundle'] else [] end), list_concat(list_concat(case when k % 9 = 0 then ['wrong_source_document_count'] else [] end, case when k % 29 = 0 then ['invalid_evidence_pages'] else [] end),
 list_concat(case when np < 3 or k % 29 = 0 then ['evidence_does_not_cover_all_sources'] else [] end, case when nf < 3 then ['intermediate_facts_do_not_cover_all_sources'] else [] end))))) as code from g) select code, count(*) n from c group by code""")
def fulltext_contract(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    items = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_set((F.col("l_suppkey") % 3 + 1).cast("int")).alias("docs"), F.collect_set(page()).alias("p"), F.collect_set((F.col("l_linenumber") % 3 + 1).cast("int")).alias("fact_docs")
    )
    items = items.select(
        bundle(),
        "docs",
        "fact_docs",
        F.when(k % 29 == 0, F.array().cast("array<int>")).otherwise(F.col("p")).alias("pages"),
        F.when(k % 19 == 0, "Is it ANSWER or not?").otherwise("What is it?").alias("question"),
        F.when(k % 23 == 0, " ").otherwise("answer").alias("answer"),
        F.when(k % 13 == 0, "x").otherwise("comparison").alias("reasoning_type"),
        F.when(k % 9 == 0, 2).otherwise(3).alias("doc_count"),
    )
    return count_codes(bindings.fulltext_codes(items, ranges(t), ("comparison",)), F.col("codes"))


@query("""with l as (select l_orderkey k, l_linenumber * 4 p, (l_linenumber * 4 - 1) // 10 d, l_suppkey % 10 > 0 and l_returnflag <> 'R' good from lineitem),
g as (select k, count(distinct p) pages, count(distinct d) nd, count(distinct d) filter (good) ns, count(*) filter (good) support from l group by k)
select k::varchar as candidate_id, pages, support from g where nd = 3 and ns = 3 and k % 13 > 0 and k % 17 > 0""")
def challenge_normalized(t: Tables) -> DataFrame:
    k, true = F.col("l_orderkey"), F.floor((page() - 1) / 10).cast("int") + 1
    one = F.struct(F.when(F.col("l_suppkey") % 10 > 0, true).otherwise(true % 3 + 1).alias("doc_number"), page().alias("page"), F.when(F.col("l_returnflag") != "R", " f ").otherwise(" ").alias("fact"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(page()).alias("pages"), F.collect_list(one).alias("support"))
    rows = rows.select(
        bundle(),
        "pages",
        "support",
        F.concat(F.lit(" "), k.cast("string")).alias("candidate_id"),
        F.when(k % 17 == 0, "What are a and b, respectively?").otherwise("Why?").alias("question"),
        F.lit("a").alias("answer"),
        F.lit("c").alias("conclusion"),
        F.array(F.lit("x"), F.lit("y"), F.when(k % 13 > 0, "z")).alias("failures"),
    )
    found = bindings.challenge_candidates(rows, ranges(t), "(?i)respectively")
    return found.select("candidate_id", F.size("pages").cast("long").alias("pages"), F.size("support").cast("long").alias("support"))


@query("""select n_regionkey as bundle, string_agg(chr(10) || '######## DOC ' || n_nationkey || ': ' || n_name || ' ########' || chr(10) || 'paper_id=p' || n_nationkey || '; merged physical pages ' || (n_nationkey * 10 + 1) || '-' || (n_nationkey * 10 + 10) || chr(10) || lower(n_name), '' order by n_nationkey) as text from nation group by 1""")
def bundle_texts(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    rows = t.nation.select(F.col("n_regionkey").alias("bundle"), n.alias("doc_number"), F.col("n_name").alias("title"), F.concat(F.lit("p"), n.cast("string")).alias("paper"), (n * 10 + 1).alias("merged_start"), (n * 10 + 10).alias("merged_end"), F.lower("n_name").alias("text"))
    return bindings.bundle_text(rows)


@query("select distinct (l_orderkey % 25)::int as bundle, (l_linenumber * 4)::int as page, ((l_linenumber * 4 - 1) // 10 + 1)::int as doc_number, ((l_linenumber * 4 - 1) % 10 + 1)::int as source_page from lineitem where l_returnflag <> 'R'")
def evidence_pages_by_source(t: Tables) -> DataFrame:
    modalities = F.when(F.col("l_returnflag") == "R", F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("table")))
    return bindings.evidence_page_sources(t.lineitem.select(bundle(), modalities.alias("modalities"), F.array(page()).alias("pages")), ranges(t))


@query("select p_partkey as source_qa_id, p_name as question, p_type as answer, (p_size % 3) || ',' || (p_size % 2) as docs from part where p_partkey in (select s_suppkey from supplier)")
def prompt_source_items(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").alias("source_qa_id"), F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.array(F.col("p_size") % 3, F.col("p_size") % 2).alias("source_doc_numbers"), F.col("p_size").alias("page"))
    found = bindings.prompt_sources(items, t.supplier.select(F.col("s_suppkey").alias("source_qa_id")))
    return found.select("source_qa_id", "question", "answer", F.array_join(F.transform("source_doc_numbers", lambda x: x.cast("string")), ",").alias("docs"))


@query("select p_partkey::varchar as qa_id, p_name as question, p_type as answer, p_brand as relation, true as no_derivation, p_size as evidence_span from part")
def candidate_payloads(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").alias("qa_id"), F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.col("p_brand").alias("relation"), F.col("p_size").alias("evidence_span"), F.lit("x").alias("other"))
    return bindings.candidate_payload(items, hard=True).select("qa_id", "question", "answer", "relation", F.isnull("derivation").alias("no_derivation"), "evidence_span")


@query("select p_partkey, p_size >= 20 as complete from part")
def search_progress(t: Tables) -> DataFrame:
    status = F.when(F.col("p_size") % 2 == 0, "search_space_exhausted").otherwise("running")
    return t.part.select("p_partkey", bindings.search_complete(F.col("p_size"), F.lit(20), status, F.lit(1), F.lit(2)).alias("complete"))


@query("""with f as (select c_custkey k from customer where c_custkey % 3 > 0) select c_custkey as task, a.k is not null and b.k is not null or case when c_nationkey % 2 = 0 then 'completed' else 'running' end = case when c_custkey % 5 = 0 then 'running' else 'completed' end as completed
 from customer left join f a on a.k = c_custkey left join f b on b.k = c_custkey + 1""")
def task_completion(t: Tables) -> DataFrame:
    path = lambda c: F.concat(F.lit("f"), c.cast("string"))
    state = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    files = t.customer.where("c_custkey % 3 > 0").select(path(F.col("c_custkey")).alias("path"), F.lit(None).cast("string").alias("status"))
    files = files.union(t.nation.select(state("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "completed").otherwise("running")))
    k = F.col("c_custkey")
    tasks = t.customer.select(k.alias("task"), F.array(path(k), path(k + 1)).alias("paths"), state("c_nationkey").alias("state_path"), F.when(k % 5 == 0, "running").alias("expected"))
    return bindings.completed_tasks(tasks, files)


@query("""with x as (select *, '{"priority":"' || o_orderpriority || '","key":' || o_orderkey || '}' as details from orders)
select 'AU_' || left(sha256(o_orderstatus || chr(0) || o_orderkey || chr(0) || o_custkey || chr(0) || (o_orderkey + 1) || chr(0) || details), 16) as audit_id, o_orderstatus as action, 'order' as target_type, o_orderkey::varchar as target_id, o_custkey::varchar as actor, details from x""")
def audit_events(t: Tables) -> DataFrame:
    details = F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key"))
    return bindings.audit_rows(t.orders, F.col("o_orderstatus"), "order", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") + 1, details)


@query("select doc_id as task, lang as category, source as message, right(coalesce(text, ''), 200) as log_tail from documents")
def task_incidents(t: Tables) -> DataFrame:
    return bindings.incident_rows(t.documents, F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text"), 200)


@query("""select l_returnflag as model, round(count(*) filter (l_partkey % 2 = 1) / 12.0, 6)::double as "all", round(count(*) filter (l_partkey % 2 = 1 and l_linenumber % 2 = 0) / 10.0, 6)::double as "General", round(count(*) filter (l_partkey % 2 = 1 and l_linenumber % 2 = 1) / 2.0, 6)::double as "Reasoning",
 round(sum(l_linenumber % 3) / 12.0, 6)::double as e_precision, round(sum(l_linenumber % 4) / 12.0, 6)::double as e_recall, round(sum(l_linenumber % 5) / 12.0, 6)::double as e_f1, round(sum(l_linenumber) / 1200.0, 6)::double as a_pages from lineitem where l_suppkey % 5 > 0 group by 1""")
def recorded_tables(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    task = F.when(n % 2 == 0, "General").otherwise("Reasoning")
    flags = {"task": task, "present": (F.col("l_suppkey") % 5 > 0).cast("int"), "correct": F.col("l_partkey") % 2, "precision": n % 3, "recall": n % 4, "f1": n % 5, "pages": n}
    found = bindings.recorded_scores(t.lineitem.select(F.col("l_returnflag").alias("model"), *[c.alias(k) for k, c in flags.items()]), {"General": 1000, "Reasoning": 200})
    return found.select("model", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query("""with m as (select p_partkey % 4 > 0 a, p_size > 25 c, p_size % 2 = p_size % 3 one, p_partkey % 2 = p_partkey % 5 page, p_brand from part), v as (select count(*) items, count(*) filter (a) answerable, count(*) filter (not a) unanswerable, count(*) filter (not c) single_document, count(*) filter (c) cross_document,
 count(*) filter (one) single_modality, count(*) filter (not one) multi_modality, count(*) filter (not page) cross_page, 0::bigint no_modality, count(distinct p_brand) brands from m)
select unnest(range(10))::int as place, unnest(['items', 'answerable', 'unanswerable', 'single_document', 'cross_document', 'single_modality', 'multi_modality', 'cross_page', 'no_modality', 'brands']) as metric,
 unnest([items, answerable, unanswerable, single_document, cross_document, single_modality, multi_modality, cross_page, no_modality, brands]) as n from v""")
def release_overview(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    items = t.part.select("p_partkey", "p_size", "p_brand", F.array(size % 2, size % 3).alias("m"), F.array(k % 2, k % 5).alias("p"))
    return bindings.overview(items, k % 4 > 0, size > 25, "m", "p", {"brands": "p_brand"})


@query("select n_regionkey::varchar as path, n_name as unit_id, n_nationkey as key from nation where n_nationkey % 3 > 0 and n_nationkey % 4 > 0")
def paper_scan(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    name = F.concat(F.when(n % 3 == 0, "__").otherwise(""), F.col("n_name"))
    cell = F.concat(F.lit('"'), name, F.lit('":'), F.when(n % 4 == 0, "[1]").otherwise(F.concat(F.lit('{"key":'), n.cast("string"), F.lit("}"))))
    values = t.nation.groupBy(text("n_regionkey").alias("path")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(cell), ","), F.lit("}")).alias("value"))
    return scans.paper_items(values).select("path", "unit_id", F.try_variant_get("unit", "$.key", "long").alias("key"))


@query("select (n_nationkey % 4)::varchar as id, max(n_regionkey * 100 + n_nationkey)::bigint as key from nation group by 1")
def manifest_lookup(t: Tables) -> DataFrame:
    row = F.struct((F.col("n_nationkey") % 4).alias("id"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("key"))
    values = t.nation.groupBy(text("n_regionkey").alias("path")).agg(F.to_json(F.array_sort(F.collect_list(row), lambda a, b: (a["key"] - b["key"]).cast("int"))).alias("value"))
    rows = scans.manifest_rows(values.withColumn("place", F.lit(0).cast("long")))
    return rows.select("id", F.get_json_object("row", "$.key").cast("long").alias("key"))


@query("""select r_name as big_class, left(n_name, 1) as custom_subclass, n_name as official, row_number() over (order by r_name, left(n_name, 1), n_name)::int - 1 as place, 'cat:' || n_name || ' AND submittedDate:[2020 TO 2024]' as search from nation join region on n_regionkey = r_regionkey""")
def category_searches(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("big_class"), F.left("n_name", F.lit(1)).alias("custom_subclass"), F.col("n_name").alias("official"))
    return scans.processing_order(rows).withColumn("search", scans.category_search(F.col("official"), "2020", "2024"))
