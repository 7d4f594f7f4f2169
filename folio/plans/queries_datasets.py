"""Dataset queries: gold and release contracts, checkpoints, packets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import hashing
from folio.operators import datasets, reports
from folio.operators.aggregates import count_codes

from .queries_text import CONTENT, squash
from .registry import Tables, query


def folded(x: str) -> str:
    return squash(f"lower({x})")


@query("""with l as (select l_orderkey k, list_distinct(list(l_linenumber)) p, list_distinct(list(l_returnflag)) m from lineitem group by 1),
x as (select k, case when o_custkey % 4 = 0 then 'Unanswerable' else 'General' end task, case when o_custkey % 4 = 0 and k % 3 > 0 or k % 17 = 0 then 'Unanswerable' when k % 19 = 0 then ' ' else 'a' end answer, case when o_custkey % 4 = 0 and k % 5 > 0 then [] else p end pages, m from l join orders on k = o_orderkey),
c as (select unnest(list_concat(list_concat(case when len(list_filter(pages, lambda v: v > 6)) > 0 then ['invalid_pages'] else [] end, case when trim(answer) = '' then ['empty_text'] else [] end),
 list_concat(list_concat(case when k % 13 = 0 then ['invalid_classification'] else [] end, case when list_contains(m, 'R') then ['invalid_modalities'] else [] end),
 list_concat(case when task = 'Unanswerable' and (answer <> 'Unanswerable' or len(pages) > 0) then ['noncanonical_refusal'] else [] end, case when task = 'General' and (answer = 'Unanswerable' or len(pages) = 0) then ['answerable_contract'] else [] end)))) as code from x) select code, count(*) n from c group by code""")
def gold_contract(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("qa_id")).agg(F.collect_set("l_linenumber").alias("p"), F.collect_set(F.expr("case l_returnflag when 'R' then 'sound' when 'A' then 'text' else 'table' end")).alias("modalities"))
    x = lines.join(t.orders, F.col("qa_id") == F.col("o_orderkey"))
    refusal = F.col("o_custkey") % 4 == 0
    k = F.col("qa_id")
    x = x.withColumns(
        {
            "task": F.when(refusal, "Unanswerable").otherwise("General"),
            "question": F.lit("q"),
            "answer": F.when((refusal & (k % 3 > 0)) | (k % 17 == 0), "Unanswerable").when(k % 19 == 0, " ").otherwise("a"),
            "pages": F.when(refusal & (k % 5 > 0), F.array().cast("array<int>")).otherwise(F.col("p")),
            "page_count": F.lit(6),
            "question_type": F.when(k % 13 == 0, "Other").otherwise("Literal"),
            "category": F.lit("c"),
        }
    )
    return count_codes(datasets.gold_codes(x), F.col("codes"))


@query(f"""with q as (select doc_id, {folded('text')} q, source b, n_chars % 9 p, [doc_id % 2, doc_id % 3, doc_id % 5] d from documents), r as (select *, row_number() over (partition by q order by doc_id) r, len(list_distinct(d)) n from q),
c as (select unnest(list_concat(list_concat(list_concat(case when b = 'src1' then ['missing_bundle'] else [] end, case when b = 'src2' then ['page_count_mismatch'] else [] end), case when q = '' then ['blank_question_or_answer'] else [] end),
 list_concat(list_concat(case when q <> '' and r > 1 then ['duplicate_question'] else [] end, case when p < 1 or b <> 'src1' and p > case when b = 'src2' then 5 else 6 end then ['invalid_evidence_pages'] else [] end),
 list_concat(case when n < 2 then ['not_cross_document'] else [] end, case when n = 2 then ['not_in_all_documents'] else [] end)))) as code from r) select code, count(*) n from c group by code""")
def release_contract(t: Tables) -> DataFrame:
    d = t.documents
    rows = d.select(F.col("doc_id").alias("item"), F.col("source").alias("bundle"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.col("n_chars") % 9).alias("pages"), F.array(F.col("doc_id") % 2, F.col("doc_id") % 3, F.col("doc_id") % 5).alias("docs"))
    bundles = d.where("source <> 'src1'").select(F.col("source").alias("bundle")).distinct().withColumns({"page_count": F.lit(6), "actual": F.when(F.col("bundle") == "src2", 5).otherwise(6)})
    return count_codes(datasets.release_codes(rows, bundles, 3), F.col("codes"))


@query(f"""with l as (select conv_id, list(text order by turn) x, max(turn) m from conversations group by 1), q as (select conv_id, m, {CONTENT.format(x="coalesce(x[1], '')")} q, {CONTENT.format(x="string_split(coalesce(x[1], ''), '.')[1]")} a, [{CONTENT.format(x='y')} for y in x] s from l),
c as (select unnest(list_concat(case when length(a) >= 4 and contains(q, a) then ['answer_leaked'] else [] end, list_concat(case when len(list_filter(s, lambda y: length(y) >= 5 and contains(q, y))) > 0 then ['source_answer_leaked'] else [] end, case when m < 3 then ['pages_too_close'] else [] end))) as code from q) select code, count(*) n from c group by code""")
def hard_item_contract(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x"), F.max("turn").alias("m"))
    question = F.coalesce(F.col("x")[0], F.lit(""))
    found = datasets.separation_codes(question, F.split(question, r"\.")[0], F.col("x"), F.array(F.lit(0), F.col("m")), 3)
    return count_codes(rows, found)


@query("select doc_id, doc_id % 3 <> 0 and doc_id % 4 <> 0 and doc_id % 5 <> 0 as reusable from documents")
def checkpoint_reuse(t: Tables) -> DataFrame:
    current = t.documents.select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    saved = current.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return datasets.reusable(saved, current, "doc_id", "fingerprint")


@query("select l_orderkey % 100 as bundle, l_suppkey % 3 as doc, count(*) n, sum(l_linenumber)::bigint pages from lineitem where l_orderkey % 4 < 2 and l_returnflag <> 'R' group by 1, 2")
def review_facts(t: Tables) -> DataFrame:
    one = F.struct((F.col("l_suppkey") % 3).alias("doc"), F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("fact"))
    decision = F.element_at(F.array(*[F.lit(x) for x in ("KEEP", "FIX", "DROP", "MAYBE")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    reviews = t.lineitem.groupBy((F.col("l_orderkey") % 100).alias("bundle"), F.col("l_orderkey").alias("qa_id"), decision.alias("decision")).agg(F.collect_list(one).alias("support"))
    return datasets.supported_facts(reviews).groupBy("bundle", "doc").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


@query("select s_nationkey as bundle, count(*) n from supplier join nation on s_nationkey = n_nationkey join (select distinct c_nationkey from customer where c_acctbal > 0) on c_nationkey = s_nationkey group by 1")
def bundle_contexts(t: Tables) -> DataFrame:
    base = t.supplier.select(F.col("s_nationkey").alias("bundle"), "s_suppkey")
    reviews = t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("bundle")).distinct()
    return datasets.bundle_contexts(base, reviews, t.nation.select(F.col("n_nationkey").alias("bundle"), "n_name"), "bundle").groupBy("bundle").agg(F.count("*").alias("n"))


@query("with i as (select l_orderkey k, l_orderkey % 50 b, count(distinct l_suppkey % 4)::int d from lineitem group by 1, 2) select b as bundle, d as documents, count(*) n from i group by 1, 2")
def candidate_counts(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", (F.col("l_orderkey") % 50).alias("bundle")).agg(F.collect_list(F.col("l_suppkey") % 4).alias("docs"))
    return datasets.candidate_counts(rows, "bundle", "docs")


@query("select o_custkey as unit, o_orderkey, 'QA' || row_number() over (partition by o_custkey order by o_orderkey) as qa_id from orders where o_orderkey % 3 = 0 or o_custkey % 2 = 0")
def cleaned_items(t: Tables) -> DataFrame:
    answer = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(" -"), F.col("o_custkey").cast("string"), F.lit(".5 "))).otherwise("1 of 2")
    rows = t.orders.select(F.col("o_custkey").alias("unit"), "o_orderkey", answer.alias("answer"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")).alias("options"))
    return datasets.clean_items(rows, "unit", F.col("o_orderkey")).select("unit", "o_orderkey", "qa_id")


@query("""select doc_id, case when quality = 1 then 'KEEP' else 'DROP' end as a_decision, case when doc_id % 2 = 0 then case when toxic = 0 then 'KEEP' else 'DROP' end end as b_decision,
 case when quality = 1 and toxic = 0 and doc_id % 2 = 0 then case when doc_id % 10 >= 4 then 'strict' else 'unsure' end when quality = 1 or toxic = 0 and doc_id % 2 = 0 then 'split' else 'rejected' end as tier from labels""")
def review_ledger(t: Tables) -> DataFrame:
    say = lambda c: F.when(c, "KEEP").otherwise("DROP").alias("decision")
    sure = ((F.col("doc_id") % 10) / 10).alias("confidence")
    a = t.labels.select("doc_id", F.lit("a").alias("provider"), say(F.col("quality") == 1), sure)
    b = t.labels.where("doc_id % 2 = 0").select("doc_id", F.lit("b").alias("provider"), say(F.col("toxic") == 0), sure)
    return datasets.wide_reviews(a.union(b), "doc_id", ["a", "b"], 0.4).select("doc_id", "a_decision", "b_decision", "tier")


@query("select 0 as place, '| n_name | n_regionkey |' as line union all select 1, '| --- | --- |' union all select 2, '| ' || n_name || ' | ' || n_regionkey || ' |' from nation")
def markdown_table(t: Tables) -> DataFrame:
    return datasets.markdown_rows(t.nation, ["n_name", "n_regionkey"])


@query("select event_type, '[' || string_agg('{\"x\":' || u || ',\"y\":' || n || '}', ',' order by u) || ']' as series from (select event_type, user_id % 20 u, count(*) n from events group by 1, 2) group by 1")
def chart_series(t: Tables) -> DataFrame:
    rows = t.events.groupBy("event_type", (F.col("user_id") % 20).alias("u")).agg(F.count("*").alias("n"))
    return datasets.chart_artifact(rows, "event_type", "u", "n")


@query("""select c_custkey, case when c_custkey % 7 = 0 then null when c_nationkey = 0 then 100.0 else least(100.0, (c_custkey % 30) * 100.0 / c_nationkey) end::double as percent,
 case when c_custkey % 11 = 0 then 'failed' when c_custkey % 7 = 0 then 'unknown' when c_nationkey = 0 or c_custkey % 30 >= c_nationkey then 'done' else 'running' end as status from customer""")
def progress_files(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 30).alias("done"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("total"), F.when(F.col("c_custkey") % 11 == 0, "x").alias("error")))
    return t.customer.select("c_custkey", datasets.stage_progress(body).alias("p")).select("c_custkey", "p.percent", "p.status")


@query("select p_brand, least(500, greatest(10, ceil(count(*) * 37 / 100.0)))::int as every from part group by 1")
def checkpoint_intervals(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", datasets.checkpoint_interval(F.col("n") * 37).alias("every"))


@query("select o_orderstatus as status, count(*) n, max(o_orderkey) as last from orders group by 1")
def checkpoint_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@query("select n_regionkey, sha256('[' || string_agg('[\"' || n_name || '\",\"' || sha256('{\"answer\":\"' || n_name || '\",\"question\":\"' || n_nationkey || '\"}') || '\"]', ',' order by n_name) || ']') as hash from nation group by 1")
def dataset_hashes(t: Tables) -> DataFrame:
    one = hashing.object_hash({"question": F.col("n_nationkey").cast("string"), "answer": F.col("n_name")})
    return t.nation.select("n_regionkey", "n_name", one.alias("h")).groupBy("n_regionkey").agg(hashing.manifest_hash(F.col("n_name"), F.col("h")).alias("hash"))


@query("""select p_partkey, case when p_size % 5 in (0, 1) then 's' when p_size % 5 in (2, 3) then 'e' else 'a' end as category from part""")
def reasoning_categories(t: Tables) -> DataFrame:
    roles = F.create_map(*[F.lit(x) for kv in {"r0": "structural", "r1": "structural", "r2": "empirical", "r3": "empirical", "r4": "analytical"}.items() for x in kv])
    kind = F.concat(F.lit("r"), (F.col("p_size") % 5).cast("string"))
    return t.part.select("p_partkey", reports.category_for({"c": ["s", "e", "a"]}, F.lit("c"), roles[kind]).alias("category"))


@query("""select p_brand as category, p_type as kind, count(*) items, count(distinct p_name) papers, count(*) filter (p_size > 25) hard from part group by 1, 2""")
def category_statistics(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("kind")).agg(F.count("*").alias("items"), F.count_distinct("p_name").alias("papers"), F.count_if(F.col("p_size") > 25).alias("hard"))
