"""Field resolution of items: the same JSON text is read by variants here and by DuckDB's JSON functions there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import items
from folio.operators import evaluation

from .queries_text import squash
from .registry import Tables, query

#: An item of each order; ~ stands for a backslash.
ITEM = """replace('{"question": " What is  ' || o_orderpriority || ' of ' || o_custkey || '?"'
 || case o_orderkey % 4 when 0 then ', "answer": " ' || o_orderpriority || '  x"' when 1 then ', "gold_answer": null, "reference_answer": "r' || o_custkey || '"' when 2 then ', "reference_answer": ' || o_custkey else '' end
 || case o_custkey % 4 when 0 then ', "evidence_pages": [' || (o_custkey % 7) || ', 3, ' || (o_custkey % 7) || ', "Page 5"]' when 1 then ', "gold_evidence_pages": "PDF_PAGE_4, 2"' when 2 then ', "evidence_pages": null, "gold_evidence_pages": [9]' else '' end
 || case o_orderkey % 3 when 0 then ', "item_uid": "", "uid": " u' || o_orderkey || '"' when 1 then ', "item_uid": "i' || o_orderkey || '"' else '' end
 || case o_custkey % 5 when 0 then ', "paper": "", "doc_id": "d' || o_custkey || '"' when 1 then ', "paper_id": "p' || o_custkey || '", "pdf_path": "a/' || o_custkey || '.pdf"' when 2 then ', "merged_pdf_path": "m.pdf", "is_answerable": false' else '' end
 || case o_orderkey % 6 when 0 then ', "evidence_pages_pre": [], "evidence_pages_pre_raw": "Page 7"' when 1 then ', "evidence_pages_pre": [2, 1]' when 2 then ', "evidence_pages_pre_raw": {"pages": [8]}' when 3 then ', "response": "see {~"evidence_pages~": [6, 6, 1]}"' when 4 then ', "pred_evidence_pages": []' else '' end
 || case o_custkey % 6 when 0 then ', "type": " MCQ "' when 1 then ', "options": [{"id": "A", "text": "x' || o_orderkey || '"}, {"id": "b ", "text": "y"}], "answer_id": "' || case o_orderkey % 3 when 0 then 'a' when 1 then 'B' else 'C' end || '"' when 2 then ', "options": []' else '' end
 || case when o_orderkey % 5 < 2 then ', "answer_pre": " said  x"' else '' end
 || '}', '~', chr(92))"""
J = f"j as (select *, ({ITEM})::json j from orders)"


def _items(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.expr(ITEM).alias("raw"))
    return rows.withColumn("m", items.fields(F.parse_json("raw")))


def _m() -> Column:
    return F.col("m")


def said(key: str) -> str:
    return squash(f"coalesce(j ->> '$.{key}', '')")


GOLD = "case " + " ".join(f"when json_exists(j, '$.{k}') then {said(k)}" for k in items.GOLD_ANSWERS) + " else '' end"


@query(f"with {J} select o_orderkey, {GOLD} as answer, case when json_exists(j, '$.answer') then 'answer' when json_exists(j, '$.gold_answer') then 'gold_answer' when json_exists(j, '$.reference_answer') then 'reference_answer' else 'missing' end as source from j")
def gold_answers(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.gold_answer(_m()).alias("g")).select("o_orderkey", "g.answer", "g.source")


GOLD_PAGES = "case o_custkey % 4 when 0 then case o_custkey % 7 when 0 then '3,5' when 3 then '3,5' when 5 then '5,3' else (o_custkey % 7) || ',3,5' end when 1 then '4,2' else '' end"


@query(f"select o_orderkey, {GOLD_PAGES} as pages, case o_custkey % 4 when 0 then 'evidence_pages' when 1 then 'gold_evidence_pages' when 2 then 'evidence_pages' else 'missing' end as source from orders")
def gold_page_sets(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.gold_pages(F.col("raw")).alias("g")).select("o_orderkey", F.array_join("g.pages", ",").alias("pages"), "g.source")


PREDICTED = "case o_orderkey % 6 when 0 then '7' when 1 then '2,1' when 2 then '8' when 3 then '6,1' else '' end"


@query(f"""select o_orderkey, {PREDICTED} as pages, case o_orderkey % 6 when 0 then 'evidence_pages_pre_raw_fallback' when 1 then 'evidence_pages_pre' when 2 then 'evidence_pages_pre_raw' when 3 then 'response:jsonish_evidence_pages' when 4 then 'pred_evidence_pages' else 'missing' end as source from orders""")
def predicted_page_sets(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.predicted_pages(F.col("raw")).alias("g")).select("o_orderkey", F.array_join("g.pages", ",").alias("pages"), "g.source")


UID = "trim(coalesce(nullif(j ->> '$.item_uid', ''), j ->> '$.uid', ''))"


@query(f"with {J} select o_orderkey, {UID} as uid from j")
def item_uids(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.item_uid(_m()).alias("uid"))


@query(f"""with {J}, k as (select o_orderkey, case when o_custkey % 2 = 0 then ' ' else o_custkey::varchar end unit, {UID} uid, {squash("j ->> '$.question'")} q from j)
select o_orderkey, case when trim(unit) <> '' then 'unitqa::' || unit || '::' || o_orderkey when uid <> '' then 'uid::' || uid else 'question_sha256::' || sha256(q) end as key,
 case when trim(unit) <> '' then 'unit_id+qa_id' when uid <> '' then 'item_uid' else 'question_sha256' end as method from k""")
def alignment_keys(t: Tables) -> DataFrame:
    unit = F.when(F.col("o_custkey") % 2 == 0, " ").otherwise(F.col("o_custkey").cast("string"))
    return _items(t).select("o_orderkey", items.alignment_key(F.lit("orders"), unit, F.col("o_orderkey"), _m()).alias("k")).select("o_orderkey", "k.*")


UNIT = "'{\"paper_id\": \"unit' || (o_custkey % 3) || '\", \"pdf_path_resolved\": \"' || case when o_custkey % 3 = 0 then '' else 'r.pdf' end || '\"}'"


def _unit() -> Column:
    return items.fields(F.parse_json(F.expr(UNIT)))


def _coalesced(keys: tuple[str, ...], default: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x} ->> '$.{k}', '')" for x in ("j", "u") for k in keys) + f", {default})"


@query(f"with {J}, u as (select *, ({UNIT})::json u from j) select o_orderkey, {_coalesced(items.UNIT_NAMES, 'o_custkey::varchar')} as paper from u")
def paper_display(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.paper_or_unit(F.col("o_custkey"), _unit(), _m()).alias("paper"))


@query(f"with {J}, u as (select *, ({UNIT})::json u from j) select o_orderkey, {_coalesced(items.PDF_PATHS, repr(''))} as path from u")
def pdf_path_display(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.pdf_path(_unit(), _m()).alias("path"))


@query(f"with {J} select o_orderkey, case when json_exists(j, '$.is_answerable') then j ->> '$.is_answerable' when {GOLD} = '' then '' else '1' end as answerable from j")
def answerable_display(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.answerable_display(_m(), items.gold_answer(_m())["answer"]).alias("answerable"))


@query("select event_id, case event_id % 4 when 0 then true when 1 then (event_id % 7) in (0, 2, 4, 6) else false end as unanswerable from events")
def unanswerable_gold(t: Tables) -> DataFrame:
    gold = F.when(F.col("event_id") % 4 == 0, "  UNanswerable ").otherwise(F.col("event_type"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("0", "1", "False", "yes", " NO ", "true", "0.4")]), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", items.is_unanswerable_gold(gold, F.when(F.col("event_id") % 4 == 1, said)).alias("unanswerable"))


@query(f"with {J} select o_orderkey, case when json_exists(j, '$.gold_answer') then j ->> '$.gold_answer' when json_exists(j, '$.reference_answer') then j ->> '$.reference_answer' else 'none' end as value from j")
def first_existing_field(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.first_existing(_m(), ("gold_answer", "reference_answer"), F.lit("none")).alias("value"))


@query(f"with {J} select o_orderkey, case when lower(trim(j ->> '$.type')) = 'mcq' or json_array_length(j -> '$.options') > 0 then 'mcq' else 'fill' end as kind from j")
def question_kinds(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", items.question_kind(_m()).alias("kind"))


CHOSEN = "case when o_custkey % 6 = 1 and o_orderkey % 3 = 0 then 'A' when o_custkey % 6 = 1 and o_orderkey % 3 = 1 then 'b ' end"


@query(f"select o_orderkey, {CHOSEN} as chosen from orders")
def selected_options(t: Tables) -> DataFrame:
    options = F.try_variant_get(_m()["options"], "$", items.OPTIONS)
    return _items(t).select("o_orderkey", items.selected_option(options, items.value(_m(), "answer_id"))["id"].alias("chosen"))


@query("select o_orderkey, case when o_custkey % 6 <> 1 then null when o_orderkey % 3 = 0 then 'x' || o_orderkey when o_orderkey % 3 = 1 then 'y' else 'C' end as answer from orders")
def effective_answers(t: Tables) -> DataFrame:
    options = F.try_variant_get(_m()["options"], "$", items.OPTIONS)
    return _items(t).select("o_orderkey", items.effective_answer(options, items.value(_m(), "answer_id")).alias("answer"))


EVIDENCE = ("evidence_pages", "gold_evidence_pages", "evidence_pages_pre", "evidence_pages_pre_raw", "pred_evidence_pages")


@query(f"with {J} select o_orderkey, array_to_string(list_sort(list_filter(json_keys(j), lambda k: k not in {EVIDENCE})), ',') as kept from j")
def compact_items(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", F.array_join(F.array_sort(F.map_keys(items.without_fields(_m(), EVIDENCE))), ",").alias("kept"))


@query(f"with {J}, k as (select o_orderkey, list_sort(json_keys(j)) k from j) select o_orderkey, array_to_string(list_concat(list_filter(['question', 'answer', 'evidence_pages'], lambda x: list_contains(k, x)), list_filter(k, lambda x: x not in ('question', 'answer', 'evidence_pages'))), ',') as fields from k")
def ordered_items(t: Tables) -> DataFrame:
    return _items(t).select("o_orderkey", F.array_join(items.core_first(F.array_sort(F.map_keys(_m())), ("question", "answer", "evidence_pages")), ",").alias("fields"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_brand || '.v1' else 'results_' || p_brand end as model from part")
def model_names(t: Tables) -> DataFrame:
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("out/judge_"), "p_brand", F.lit(".v1.json"))).otherwise(F.concat(F.lit("results_"), "p_brand", F.lit(".json")))
    return t.part.select("p_partkey", items.model_name(path).alias("model"))


@query("select p_partkey, case p_size when 4 then 'small model' when 8 then 'large model' else p_size::varchar end as shown from part")
def display_models(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", items.display_name(F.col("p_size").cast("string"), {"4": "small model", "8": "large model"}).alias("shown"))


@query("select o_orderkey, case when o_custkey % 5 = 0 then o_orderstatus = 'F' when o_custkey % 3 = 0 then false else o_orderkey % 4 <> 1 and o_orderkey % 7 <> 0 end as legal from orders")
def legal_evidence(t: Tables) -> DataFrame:
    flag = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderstatus") == "F")
    method = F.when(F.col("o_custkey") % 3 != 0, "json").when(F.col("o_custkey") % 2 == 0, "invalid_json")
    answer = F.when(F.col("o_orderkey") % 4 == 1, " ").otherwise("x")
    found = F.when(F.col("o_orderkey") % 7 != 0, F.array(F.lit(1)))
    return t.orders.select("o_orderkey", items.legal_evidence(flag, method, answer, found).alias("legal"))


@query("select o_orderkey, o_orderpriority as gold from orders")
def canonical_gold(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", items.canonical_gold(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")), F.col("o_orderkey")).alias("gold"))


STATUS = "case when o_orderkey % 9 = 0 then 'missing' when o_orderkey % 9 = 1 then 'technical_failure' else 'illegal' end"


@query(f"""select o_orderkey, case when o_orderkey % 9 < 2 then {STATUS} when o_custkey % 5 = 0 then 'technical_failure' else 'legal' end as status,
 case when o_orderkey % 9 < 2 or o_custkey % 5 = 0 then '' else o_orderpriority end as answer from orders""")
def recovered_predictions(t: Tables) -> DataFrame:
    record = F.to_json(F.struct(F.when(F.col("o_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("  "))).alias("answer_pre")))
    rows = t.orders.select("o_orderkey", F.expr(STATUS).alias("status"), record.alias("record"))
    return evaluation.recover_predictions(rows, "status", "record").select("o_orderkey", "status", "answer")


@query(f"""with {J}, r as (select o_orderkey, {GOLD} gold, string_split({GOLD_PAGES}, ',') g, string_split({PREDICTED}, ',') p, o_custkey % 4 = 3 no_pages, o_orderkey % 4 = 3 no_gold, o_orderkey % 5 >= 2 blank from j),
s as (select *, list_filter(g, lambda x: x <> '') gs, list_filter(p, lambda x: x <> '') ps from r), e as (select *, len(list_intersect(gs, ps)) n from s)
select o_orderkey, case when blank then 'technical_failure' when no_gold then 'technical_failure_missing_gold_answer' else 'evaluated' end as status,
 (not no_pages and list_sort(gs) = list_sort(ps))::int as evidence_correct,
 round(case when no_pages then 0 when len(gs) = 0 and len(ps) = 0 then 1 when len(gs) + len(ps) = 0 then 0 else 2e0 * n / (len(gs) + len(ps)) end, 9) as evidence_f1 from e""")
def evaluated_items(t: Tables) -> DataFrame:
    out = evaluation.evaluate_items(_items(t).withColumn("unit_id", F.lit("u")), "raw", "unit_id", "o_orderkey")
    return out.select("o_orderkey", "status", "evidence_correct", F.round("evidence_f1", 9).alias("evidence_f1"))


NEST = """'{"a": {"paper_id": "P' || p_partkey || '", "list": [{"question": "q' || p_size || '", "answer": 1}, {"deep": {"question": "d", "answer": null, "source_paper_id": "S"}}, {"question": 5, "answer": 2}]}, "question": "top"}'"""


@query("select p_partkey, r.paper, r.question from part, (values (1, 'q'), (2, 'd')) as k(i, q), lateral (select case i when 1 then 'P' || p_partkey else 'S' end as paper, case i when 1 then 'q' || p_size else 'd' end as question) r")
def item_refs(t: Tables) -> DataFrame:
    return evaluation.item_refs(t.part.select("p_partkey", F.expr(NEST).alias("raw")), "p_partkey", "raw").select("p_partkey", "paper", "question")
