"""Release queries: item contracts, hashes, service state, and corrections, with varied inputs from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import hashing, text
from folio.operators import release, service
from folio.operators.aggregates import count_codes

from .queries_text import CONTENT, squash
from .registry import Tables, query


def folded(x: str) -> str:
    return squash(f"lower({x})")


PARALLEL_SQL = " or ".join(f"regexp_matches(q, '{p}')" for p in release.PARALLEL)
ASKED = "case c_custkey % 4 when 0 then 'What is ' || c_name || ', and which is ' || c_mktsegment || '?' when 1 then 'Compare  both Respectively ' || c_name when 2 then 'First, ' || c_name || ' second' else 'What is ' || c_name || '?' end"


@query(f"with x as (select c_custkey, {folded(ASKED)} q from customer) select c_custkey, {PARALLEL_SQL} as parallel from x")
def parallel_questions(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", release.is_parallel_question(F.expr(ASKED)).alias("parallel"))


SUMMARY = "case p_partkey % 6 when 0 then 'These lack a common ' || p_type when 1 then p_name || ' is Unrelated to the rest' when 2 then '  ' when 3 then 'limited  scientific link of ' || p_brand when 4 then 'across different domains' else p_name || ' share ' || p_type end"


@query("with x as (select p_partkey, " + folded(SUMMARY) + " s from part) select p_partkey, s <> '' and not (" + " or ".join(f"regexp_matches(s, '{p}')" for p in release.INCOHERENT) + ") as coherent from x")
def coherent_bundles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", release.is_coherent(F.expr(SUMMARY)).alias("coherent"))


@query(f"""with s as (select l_orderkey k, list_sort(list_distinct(list(l_linenumber))) p, list_distinct(list(l_suppkey % 4)) d, min(l_returnflag) m from lineitem group by 1),
x as (select s.*, o_orderpriority a, case when o_custkey % 5 = 0 then 'is it ' || lower(o_orderpriority) || '?' when o_custkey % 5 = 1 then ' ' else 'which?' end q, o_custkey % 7 > 0 facts from s join orders on k = o_orderkey),
c as (select unnest(list_concat(list_concat(case when q = ' ' then ['empty_question_or_answer'] else [] end, case when contains({CONTENT.format(x='q')}, {CONTENT.format(x='a')}) then ['answer_leakage'] else [] end),
 list_concat(list_concat(case when len(d) in (2, 3) then [] else ['invalid_source_document_count'] end, case when len(p) < 2 then ['insufficient_evidence_pages'] else [] end),
 list_concat(case when m in ('A', 'N') then [] else ['invalid_reasoning_type'] end, case when facts then [] else ['missing_intermediate_facts'] end)))) as code from x) select code, count(*) n from c group by code""")
def static_errors(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("p"), F.collect_set(F.col("l_suppkey") % 4).alias("d"), F.min("l_returnflag").alias("m"))
    x = s.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    q = F.expr("case when o_custkey % 5 = 0 then 'is it ' || lower(o_orderpriority) || '?' when o_custkey % 5 = 1 then ' ' else 'which?' end")
    facts = F.when(F.col("o_custkey") % 7 > 0, F.array(F.lit("f")))
    return count_codes(x, release.cross_item_codes(q, F.col("o_orderpriority"), F.col("d"), F.col("p"), F.col("m"), ["A", "N"], facts))


@query(f"""with s as (select l_orderkey k, list_distinct(list(l_linenumber::varchar)) i from lineitem group by 1), x as (select s.*, c_name || case when o_custkey % 4 = 0 then ' see qa 12' else '?' end q, case when o_custkey % 6 = 0 then '' when o_custkey % 6 = 1 then c_name else repeat(c_mktsegment || ' ', (o_custkey % 40)::int) end a from s join orders on k = o_orderkey join customer on o_custkey = c_custkey),
c as (select unnest(list_concat(list_concat(case when trim(a) = '' then ['empty_answer'] else [] end, case when length({squash('a')}) > 300 then ['answer_too_long'] else [] end),
 list_concat(list_concat(case when len(i) between 2 and 5 then [] else ['invalid_source_qa_count'] end, case when list_contains(i, '7') or list_contains(i, '6') then ['unknown_source_qa_id'] else [] end),
 list_concat(list_concat(case when contains(q, 'qa 12') then ['question_mentions_qa_id'] else [] end, case when len(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+')) < 8 then ['answer_too_short_for_intermediate_facts'] else [] end),
  case when length({CONTENT.format(x='a')}) >= 4 and contains({CONTENT.format(x='q')}, {CONTENT.format(x='a')}) then ['answer_leaked_in_question'] else [] end)))) as code from x) select code, count(*) n from c group by code""")
def generated_item_contract(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("i"))
    x = s.join(t.orders, "o_orderkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    q = F.expr("c_name || case when o_custkey % 4 = 0 then ' see qa 12' else '?' end")
    a = F.expr("case when o_custkey % 6 = 0 then '' when o_custkey % 6 = 1 then c_name else repeat(c_mktsegment || ' ', cast(o_custkey % 40 as int)) end")
    return count_codes(x, release.generated_item_codes(q, a, F.col("i"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: n.cast("string")), 2, 5))


@query("""with x as (select o_orderkey k, o_custkey % 4 m, o_orderpriority p from orders) select k as o_orderkey, case m when 0 then true when 1 then false when 2 then false else k % 2 = 0 end as noop from x""")
def correction_noops(t: Tables) -> DataFrame:
    m, p = F.col("o_custkey") % 4, F.col("o_orderpriority")
    new_text = F.when(m == 0, F.concat(F.lit("  "), F.lower(p))).when(m == 1, F.concat(p, F.lit("!"))).otherwise("")
    new_pages = F.when(m == 3, F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(2), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3))))
    return t.orders.select("o_orderkey", release.is_noop([new_text], [p], new_pages, F.array(F.lit(1), F.lit(2))).alias("noop"))


@query("""with x as (select l_orderkey k, count(*) filter (l_linestatus = 'F') f, count(*) filter (l_linestatus = 'O') i, count(*) n from lineitem group by 1)
select k as item, f as fact_steps, i as inference_steps, n * 3 as answer_words, f >= 2 and i >= 1 and n * 3 >= 8 as valid from x""")
def fact_steps(t: Tables) -> DataFrame:
    word = F.concat(F.lit("alpha beta "), F.lower("l_returnflag"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_list(F.when(F.col("l_linestatus") == "F", word).otherwise(" ")).alias("f"), F.collect_list(F.when(F.col("l_linestatus") == "O", "so").otherwise("")).alias("i"), F.array_join(F.collect_list(word), " ").alias("a"))
    d = release.fact_diagnostics(F.col("f"), F.col("i"), F.lit(None).cast("array<string>"), F.col("a"))
    return rows.select("item", d.alias("d")).select("item", F.col("d.fact_steps").cast("long").alias("fact_steps"), F.col("d.inference_steps").cast("long").alias("inference_steps"), F.col("d.answer_words").cast("long").alias("answer_words"), "d.valid")


@query("""with p as (select l_orderkey % 500 b, l_partkey % 20 k, l_orderkey place, l_linenumber page from lineitem), c as (select b, k, place, list_distinct(list(page)) pages from p group by all),
d as (select *, len(list_distinct([case when x <= 2 then 1 when x <= 4 then 2 when x <= 6 then 3 end for x in pages])) n, list_max(pages) top from c) select b as bundle, k as candidate, min(place) as place from d where n = 3 and top <= 6 group by 1, 2""")
def three_document_candidates(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy((F.col("l_orderkey") % 500).alias("bundle"), (F.col("l_partkey") % 20).alias("candidate"), F.col("l_orderkey").alias("place")).agg(F.collect_list("l_linenumber").alias("pages"))
    c = c.select("*", F.lit("q").alias("question"), F.lit("a").alias("answer"))
    docs = t.spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 5, 6)], "doc int, first int, last int")
    sources = c.select("bundle").distinct().join(F.broadcast(docs))
    return release.full_coverage_candidates(c, sources, "candidate", 3)


@query("""with p as (select l_orderkey k, list(l_linenumber order by l_shipdate, l_linenumber) pages, o_orderstatus s from lineitem join orders on l_orderkey = o_orderkey group by all)
select k as item, array_to_string(list_sort(list_distinct(pages)), ',') as pages, pages <> list_sort(list_distinct(pages)) as changed, case when s = 'P' then 'answer_pre must be a non-empty string' when list_max(pages) > 6 then 'evidence_pages must be within the PDF' when s = 'F' then 'Unanswerable requires empty evidence_pages' end as problem from p""")
def page_selections(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber"))), lambda x: x["l_linenumber"]).alias("pages"))
    rows = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    answer = F.when(F.col("o_orderstatus") == "P", " ").when(F.col("o_orderstatus") == "F", " Unanswerable ").otherwise("x")
    got = rows.select(F.col("l_orderkey").alias("item"), release.selection_prediction(answer, F.col("pages"), F.lit(6)).alias("r"))
    return got.select("item", F.array_join("r.pages", ",").alias("pages"), "r.changed", "r.problem")


@query(f"""with q as (select doc_id, {folded('text')} q from documents), r as (select *, row_number() over (partition by q order by doc_id) r from q),
v as (select doc_id, unnest([quality, 1 - toxic]) x, doc_id % 10 c from labels), s as (select doc_id, count(*) n, bool_and(x = 1) keep from v group by 1),
c as (select r.doc_id, unnest(list_concat(list_concat(case when q = '' then ['empty_question'] else [] end, case when q <> '' and r > 1 then ['duplicate_question'] else [] end),
 list_concat(case when n is null then ['missing_validation'] else [] end, list_concat(case when not keep then ['not_kept'] else [] end, case when keep and r.doc_id % 10 < 3 then ['confidence_below_threshold'] else [] end)))) as code from r left join s using (doc_id))
select code, count(*) n from c group by code""")
def final_dataset_contract(t: Tables) -> DataFrame:
    sure = (F.col("doc_id") % 10).cast("double")
    decide = lambda c: F.when(c == 1, "KEEP").otherwise("DROP").alias("decision")
    a = t.labels.select("doc_id", F.lit("a").alias("provider"), decide(F.col("quality")), sure.alias("confidence"))
    b = t.labels.select("doc_id", F.lit("b").alias("provider"), decide(1 - F.col("toxic")), sure.alias("confidence"))
    return release.final_dataset_codes(t.documents, "doc_id", "text", a.union(b), 2, 3.0).groupBy("code").agg(F.count("*").alias("n"))


@query("""with b as (select l_orderkey i, list_sort(list_distinct(list(l_linenumber))) p from lineitem group by 1), v as (select i, p, unnest([1, 2, 3]) r from b),
c as (select unnest(list_concat(list_concat(case when i % 11 = 0 then ['variant_id_mismatch'] else [] end, case when i % 5 = 0 then ['base_missing'] else [] end),
 list_concat(list_concat(case when i % 5 > 0 and i % 3 = 0 then ['question_mismatch'] else [] end, case when i % 5 > 0 and not list_contains(p, r) then ['removed_page_is_no_evidence'] else [] end), case when i % 5 > 0 and i % 7 = 0 and list_contains(p, r) then ['shown_pages_mismatch'] else [] end))) as code from v)
select code, count(*) n from c group by code""")
def ablation_contract(t: Tables) -> DataFrame:
    base = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("pages")).select("item", F.lit("q").alias("question"), F.lit("a").alias("answer"), "pages")
    v = base.withColumn("removed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    i = F.col("item")
    shown = F.when(i % 7 == 0, F.col("pages")).otherwise(F.array_remove("pages", F.col("removed")))
    name = F.concat(i.cast("string"), F.when(i % 11 == 0, "_").otherwise("__drop_p"), F.col("removed").cast("string"))
    v = v.select(name.alias("variant"), "item", "removed", F.when(i % 3 == 0, "other").otherwise("q").alias("question"), "answer", "pages", shown.alias("shown"))
    return count_codes(release.ablation_codes(v, base.where("item % 5 > 0")), F.col("codes"))


@query("select l_orderkey as bundle, l_linenumber as page, l_linenumber - (l_suppkey % 3) * 2 as source_page, 'paper' || (l_suppkey % 3) as paper from lineitem")
def evidence_items(t: Tables) -> DataFrame:
    support = t.lineitem.select(F.col("l_orderkey").alias("bundle"), (F.col("l_suppkey") % 3).alias("doc"), F.col("l_linenumber").cast("long").alias("page"), F.concat(F.lit(" "), "l_returnflag").alias("fact"))
    sources = t.orders.select(F.col("o_orderkey").alias("bundle"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("doc")).select("bundle", "doc", (F.col("doc") * 2 + 1).alias("first"), F.concat(F.lit("paper"), F.col("doc").cast("string")).alias("paper"))
    return release.supported_items(support, sources).select("bundle", "page", "source_page", "paper")


@query("""with i as (select l_orderkey item, list_distinct(list(l_suppkey)) s from lineitem group by 1), x as (select item, unnest(s) u from i), r as (select item, list_sort(list_distinct(flatten(list([u % 6, u % 4])))) p from x group by 1)
select item, array_to_string(p, ',') as rebuilt from r where item % 3 = 0""")
def provenance_audit(t: Tables) -> DataFrame:
    sources = t.supplier.select(F.col("s_suppkey").alias("source"), F.array_distinct(F.array(F.col("s_suppkey") % 6, F.col("s_suppkey") % 4)).alias("pages"))
    i = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_suppkey").alias("source_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("l_suppkey") % 6, F.col("l_suppkey") % 4))))).alias("pages"))
    i = i.withColumn("pages", F.when(F.col("item") % 3 == 0, F.concat("pages", F.array(F.lit(99).cast("long")))).otherwise(F.col("pages")))
    return release.provenance_mismatches(i, sources).select("item", F.array_join("rebuilt", ",").alias("rebuilt"))


@query("""select o_orderkey, case when o_custkey % 3 = 0 then 0 else 2 end as n_pages, case when o_custkey % 3 = 0 then 0 else o_custkey end as span, case when o_custkey % 3 = 0 then case when o_custkey = 0 then 'evidence_pages' else 'evidence_pages,evidence_span' end else '' end as changed from orders""")
def unanswerable_sync(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, " UNanswerable").otherwise("x").alias("answer"), F.array(F.lit(1), F.lit(2)).alias("evidence_pages"), F.col("o_custkey").alias("evidence_span"))
    out = release.clear_unanswerable(rows, "answer", ["evidence_pages"], ["evidence_span"])
    return out.select("o_orderkey", F.size("evidence_pages").alias("n_pages"), F.col("evidence_span").alias("span"), F.array_join("changed", ",").alias("changed"))


@query("select previous, modalities, count(*) n from (select p_brand as previous, p_type as modalities from part) group by 1, 2")
def modality_decisions(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.array("p_brand").alias("modalities"))
    out = release.apply_modalities(rows, t.part.select("p_partkey", F.array("p_type").alias("modalities")), "p_partkey")
    return out.groupBy(F.col("previous")[0].alias("previous"), F.col("modalities")[0].alias("modalities")).agg(F.count("*").alias("n"))


@query("select page_id, case when page_id % 3 = 0 then 'assets/' || page_id || '.pdf' else url end as path from pages")
def rewritten_paths(t: Tables) -> DataFrame:
    new = F.concat(F.lit("assets/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("new")
    mapping = t.pages.where("page_id % 3 = 0").select("page_id", F.col("url").alias("old"), new).distinct()  # pages may share a URL
    return release.rewrite_paths(t.pages.select("page_id", F.col("url").alias("path")), "path", mapping, "page_id").select("page_id", "path")


@query(f"""with g as (select source, {folded('text')} q, list_sort(list(doc_id)) c from documents where doc_id % 2 = 0 group by all) select d.doc_id, coalesce(array_to_string(g.c, ','), '') as candidates from documents d left join g on g.source = d.source and g.q = {folded('d.text')}""")
def exact_candidates(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "text")
    out = release.exact_candidates(rows, rows.where("doc_id % 2 = 0"), "source", "text", "doc_id")
    return out.select("doc_id", F.array_join("candidates", ",").alias("candidates"))


@query("select o_orderkey, case when o_custkey % 2 = 0 then 'd' || o_custkey else 'plain' end as dataset from orders")
def dataset_names(t: Tables) -> DataFrame:
    stated = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("d"), F.col("o_custkey").cast("string")))
    return t.orders.select("o_orderkey", release.dataset_of(stated, F.when(F.col("o_custkey") % 3 == 0, "General").otherwise("Unanswerable"), "plain").alias("dataset"))


QUOTED = "'\"' || replace(replace({x}, chr(10), '\\n'), '\"', '\\\"') || '\"'"


@query(f"select conv_id, turn, sha256('{{\"answer\":' || {QUOTED.format(x='text')} || ',\"question\":\"' || role || '\"}}') as hash from conversations")
def question_answer_hashes(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", hashing.object_hash({"question": F.col("role"), "answer": F.col("text")}).alias("hash"))


@query(f"select conv_id, turn, sha256('[\"' || role || '\",' || {QUOTED.format(x='text')} || ',\"' || turn || '\"]') as hash from conversations")
def row_bindings(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", hashing.list_hash(F.col("role"), F.col("text"), F.col("turn").cast("string")).alias("hash"))


@query("select c_custkey, sha256('{\"answer\": \"' || c_mktsegment || '\", \"evidence_pages\": null, \"question\": \"' || c_name || '\"}') as fingerprint from customer")
def item_fingerprints(t: Tables) -> DataFrame:
    parts = {"question": F.col("c_name"), "answer": F.col("c_mktsegment"), "evidence_pages": F.lit(None).cast("string")}
    return t.customer.select("c_custkey", hashing.object_hash(parts, spaced=True).alias("fingerprint"))


@query("select n_regionkey, sha256('[' || string_agg('[\"' || n_name || '\",\"' || sha256(n_name) || '\"]', ',' order by n_name) || ']') as corpus from nation group by 1")
def corpus_hashes(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(hashing.manifest_hash(F.col("n_name"), F.sha2("n_name", 256)).alias("corpus"))


@query("select c_custkey, left(sha256(c_custkey || ':' || c_mktsegment), 32) as id from customer")
def assignment_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", hashing.assignment_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("id"))


@query("""with s as (select event_id, user_id, ts + interval 1 hour expires from events), now as (select max(ts) n from events) select event_id, c_mktsegment as segment from s, now, customer where expires > n and user_id = c_custkey""")
def live_sessions(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now")).first()["now"]
    sessions = t.events.select("event_id", F.col("user_id").alias("c_custkey"), (F.col("ts") + F.expr("interval 1 hour")).alias("expires"))
    return service.live_users(sessions, t.customer, "c_custkey", F.lit(now)).select("event_id", F.col("c_mktsegment").alias("segment"))


@query("""with h as (select o_custkey o, o_orderpriority g, o_orderkey % 100 a, o_orderkey % 100 + 1 b from orders where o_orderkey % 50 = 1), w as (select distinct c_custkey o, '1-URGENT' g, c_custkey % 200 a, c_custkey % 200 + 2 b from customer)
select o as owner, a as first, case when exists (select 1 from h where h.g = w.g and h.o <> w.o and w.a <= h.b and w.b >= h.a) then 'conflict' else 'inserted' end as outcome from w""")
def assignment_inserts(t: Tables) -> DataFrame:
    held = t.orders.where("o_orderkey % 50 = 1").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("set"), (F.col("o_orderkey") % 100).alias("first"), (F.col("o_orderkey") % 100 + 1).alias("last"))
    wanted = t.customer.select(F.col("c_custkey").alias("owner"), F.lit("1-URGENT").alias("set"), (F.col("c_custkey") % 200).alias("first"), (F.col("c_custkey") % 200 + 2).alias("last")).distinct()
    return service.insert_assignments(held, wanted, "owner", "set").select("owner", "first", "outcome")


@query("select o_custkey, count(*) n, count(*) filter (o_orderpriority = 'new') fresh from (select o_custkey, o_orderpriority from orders where o_custkey % 10 <> 0 union all select c_custkey, 'new' from customer where c_custkey % 10 = 0) group by 1")
def replaced_members(t: Tables) -> DataFrame:
    members = t.orders.select("o_custkey", "o_orderpriority")
    changes = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("new").alias("o_orderpriority"))
    return service.replace_members(members, changes, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "new").alias("fresh"))


@query("select (select count(*) from orders where o_custkey % 4 <> 0) as parents, (select count(*) from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 4 <> 0) as children")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.orders.where("o_custkey % 4 = 0").select("o_orderkey")
    parents, children = service.cascade_delete(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), gone, "o_orderkey")
    return parents.agg(F.count("*").alias("parents")).join(children.agg(F.count("*").alias("children")))  # one row each


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey % 3 = 0")
def restored_rows(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    buried = service.bury(rows, "c_custkey", rows.where("c_custkey % 3 = 0").select("c_custkey"))
    return service.restore(buried, "c_custkey long, c_name string, c_acctbal double")


@query("select user_id, event_id, place::int as place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) place from events) where place <= 3")
def log_snapshot(t: Tables) -> DataFrame:
    return service.newest_lines(t.events, "user_id", 3, F.col("ts"), F.col("event_id")).select("user_id", "event_id", "place")


@query("""select p_partkey, case when p_partkey % 5 = 0 then 'gpu' when contains(lower(p_name || p_type), 'high_vram') then 'gpu_high_vram' when p_partkey % 5 = 1 then 'gpu_high_vram' when p_partkey % 5 = 2 then 'gpu' else 'cpu' end as lane from part""")
def resource_classes(t: Tables) -> DataFrame:
    command = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 5 == 1, " HIGH_VRAM --gpu").when(F.col("p_partkey") % 5 == 2, " run --GPUs 2").otherwise(""))
    return t.part.select("p_partkey", service.resource_class(F.when(F.col("p_partkey") % 5 == 0, " GPU "), command).alias("lane"))


@query("""with l as (select conv_id, turn, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from conversations)
select conv_id, turn, sha256(string_agg(case when trim(x) = '' or contains(x, 'progress_percent=') then x else '[progress_scope=' || conv_id || ' progress_percent=' || turn || '.50% progress_basis=current_stage_snapshot] ' || x end, chr(10) order by i)) as log from l group by 1, 2""")
def annotated_logs(t: Tables) -> DataFrame:
    log = service.annotate_progress(F.col("text"), F.col("turn") + 0.5, F.col("conv_id").cast("string"))
    return t.conversations.select("conv_id", "turn", F.sha2(log, 256).alias("log"))


@query(f"""with l as (select conv_id, list(text order by turn) x from conversations group by 1), q as (select conv_id, {CONTENT.format(x="coalesce(x[1], '')")} q, [{CONTENT.format(x='y')} for y in [string_split(z, '.')[1] for z in x]] a from l)
select conv_id, len(list_filter(a, lambda y: length(y) >= 4 and contains(q, y)))::int as leaked from q""")
def source_leaks(t: Tables) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = t.conversations.groupBy("conv_id").agg(turns.alias("x"))
    question = F.col("x")[0]
    found = F.filter("x", lambda z: text.answer_leaks(question, F.split(z, r"\.")[0]))
    return rows.select("conv_id", F.size(found).alias("leaked"))
