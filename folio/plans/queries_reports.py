"""Report queries: reconciliation, summaries, payloads, selections and structured outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import pages, text
from folio.operators import aggregates, reports
from folio.operators.aggregates import count_codes

from .queries_text import CONTENT
from .registry import Tables, query


@query("""with g as (select doc_id, source s, lang l from documents where doc_id % 7 <> 0), r as (select doc_id, case when doc_id % 5 = 0 then 'x' else source end s, case when doc_id % 3 = 0 then null else lang end l from documents where doc_id % 4 <> 0),
c as (select unnest(case when r.doc_id is null then ['missing_result'] when g.doc_id is null then ['unknown_result'] else list_concat(case when g.s is distinct from r.s then ['source_mismatch'] else [] end, case when g.l is distinct from r.l then ['lang_mismatch'] else [] end) end) as code from g full join r on g.doc_id = r.doc_id)
select code, count(*) n from c group by code""")
def reconciled_results(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "lang")
    results = d.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return count_codes(reports.reconcile(d.where("doc_id % 7 <> 0"), results, "doc_id", ["source", "lang"]), F.col("codes"))


@query("""with r as (select quality = 1 ok, lang, source from documents join labels using (doc_id)), x as (select 'all' as dimension, null as value, ok from r union all select 'lang', lang, ok from r union all select 'source', source, ok from r)
select dimension, value, count(*) n, count(*) filter (ok) correct, round(count(*) filter (ok) * 100e0 / count(*), 6) as percent from x group by 1, 2""")
def model_metrics(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select("lang", "source", (F.col("quality") == 1).alias("ok"))
    return reports.accuracy_by(rows, "ok", "lang", "source").withColumn("percent", F.round("percent", 6))


@query("select n_name as discipline, count(*) n, count(*) filter (o_orderstatus = 'F') correct, round(count(*) filter (o_orderstatus = 'F') * 100e0 / count(*), 6) as percent from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def discipline_accuracy(t: Tables) -> DataFrame:
    subjects = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))  # small sides: the planner broadcasts them by size
    rows = t.orders.join(subjects, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("discipline"))
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("correct"))
    return out.withColumn("percent", F.round(F.col("correct") * 100.0 / F.col("n"), 6))


@query("select o_orderpriority as model, count(*) filter (o_orderstatus = 'F') as \"F\", count(*) filter (o_orderstatus = 'O') as \"O\", count(*) filter (o_orderstatus = 'P') as \"P\" from orders group by 1")
def baseline_statuses(t: Tables) -> DataFrame:
    return reports.status_table(t.orders.withColumnRenamed("o_orderpriority", "model"), "model", "o_orderstatus", ["F", "O", "P"])


@query("""with e as (select case when length(event_type) > 5 then event_type || '_' || user_id % 4 else event_type end label, count(*)::double n, sum(value) v from events group by 1),
m as (select label, case when contains(label, '_') then string_split(label, '_')[1] else label end as mode, string_split(label, '_')[-1] as model, n, v from e)
select label as evaluation, mode, model, 'n' as metric, round(n, 6) as value from m union all select label, mode, model, 'v', round(v, 6) from m""")
def metric_table(t: Tables) -> DataFrame:
    label = F.when(F.length("event_type") > 5, F.concat("event_type", F.lit("_"), (F.col("user_id") % 4).cast("string"))).otherwise(F.col("event_type"))
    e = t.events.groupBy(label.alias("label")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    return reports.metric_rows(e, "label", ["n", "v"]).withColumn("value", F.round("value", 6))


@query("select event_type as method, count(*) as selected, count(*) filter (value > 10) completed, count(*) filter (value > 10 and user_id % 2 = 0) correct from events group by 1")
def method_summary(t: Tables) -> DataFrame:
    return reports.method_summary(t.events.withColumnRenamed("event_type", "method"), "method", F.col("value") > 10, F.col("user_id") % 2 == 0)


@query("select 'customer' as dataset, count(distinct c_nationkey) units, count(*) items from customer union all select 'supplier', count(distinct s_nationkey), count(*) from supplier")
def dataset_catalog(t: Tables) -> DataFrame:
    return reports.catalog({"customer": t.customer.select(F.col("c_nationkey").alias("unit")), "supplier": t.supplier.select(F.col("s_nationkey").alias("unit"))}, "unit")


@query("select l_orderkey as item, max(l_linenumber) - min(l_linenumber) as span, count(distinct l_suppkey) docs from lineitem group by 1 order by docs desc, span desc, item desc limit 40")
def old_selection(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg((F.max("l_linenumber") - F.min("l_linenumber")).alias("span"), F.count_distinct("l_suppkey").alias("docs"))
    return reports.hardest(rows, 40, F.col("docs"), F.col("span"), F.col("item"))


@query("""with r as (select p_partkey, p_type, row_number() over (partition by p_brand order by p_size desc, p_partkey) place, p_brand from part)
select p_brand as kind, p_partkey, place::int as place from r where place <= case p_brand when 'Brand#11' then 30 when 'Brand#12' then 25 when 'Brand#13' then 20 else 0 end""")
def reserved_quotas(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("kind"), "p_partkey", "p_size")
    return reports.quota_reservation(rows, "kind", {"Brand#11": 30, "Brand#12": 25, "Brand#13": 20}, F.desc("p_size"), F.col("p_partkey")).select("kind", "p_partkey", "place")


@query("""with x as (select doc_id, 'bad' r from labels where quality = 0 union select doc_id, 'toxic' from labels where toxic = 1 union select doc_id, 'long' from documents where n_chars > 2000)
select doc_id, string_agg(r, ',' order by r) as reasons from x group by 1""")
def calibration_reasons(t: Tables) -> DataFrame:
    picked = {"bad": t.labels.where("quality = 0"), "toxic": t.labels.where("toxic = 1"), "long": t.documents.where("n_chars > 2000")}
    return reports.selection_reasons(picked, "doc_id").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("""select state, count(*) n from (select case when v.doc_id is null then 'missing' when s.doc_id is null then 'orphan' when s.doc_id % 5 = 0 then 'stale' else 'same' end state
from (select doc_id from documents where doc_id % 3 <> 0) v full join (select doc_id from documents where doc_id % 4 <> 0) s on v.doc_id = s.doc_id) group by state""")
def release_views(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text")
    sources = d.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return reports.changed_views(d.where("doc_id % 3 <> 0"), sources, "doc_id", "text").groupBy("state").agg(F.count("*").alias("n"))


@query("""with i as (select l_orderkey item, list_sort(list_distinct(list(l_linenumber))) p, list_distinct(list(l_suppkey % 2)) d, list_sort(list_distinct(list(l_returnflag))) m from lineitem group by 1)
select item, o_orderstatus <> 'F' as answerable, len(d) > 1 as cross_document, len(p) > 1 as multi_page, len(m) > 1 as multimodal, array_to_string(p, '|') as page_list, array_to_string(m, '|') as modality_list from i join orders on item = o_orderkey""")
def item_flags(t: Tables) -> DataFrame:
    i = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_list("l_linenumber").alias("p"), F.collect_list(F.col("l_suppkey") % 2).alias("d"), F.collect_list("l_returnflag").alias("m"))
    rows = i.join(t.orders, F.col("item") == F.col("o_orderkey")).withColumn("a", F.when(F.col("o_orderstatus") == "F", " Unanswerable ").otherwise("x"))
    return reports.item_table(rows, "p", "d", "m", "a").select("item", "answerable", "cross_document", "multi_page", "multimodal", "page_list", "modality_list")


@query("select n_regionkey as bundle, string_agg(n_nationkey::varchar, ',' order by n_nationkey::varchar) as ids, sha256('[' || string_agg('{\"qa_id\":\"' || n_nationkey || '\",\"question\":\"' || n_name || '\",\"answer\":\"' || lower(n_name) || '\"}', ',' order by n_nationkey::varchar) || ']') as payload from nation group by 1")
def review_payloads(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_regionkey").alias("bundle"), "n_nationkey", F.col("n_name").alias("question"), F.lower("n_name").alias("answer"))
    return reports.review_payload(rows, "bundle", "n_nationkey").select("bundle", F.array_join("ids", ",").alias("ids"), F.sha2("payload", 256).alias("payload"))


@query("""select o_orderpriority as dataset, count(distinct o_custkey) units, count(*) items, count(*) filter (o_orderkey % 9 = 0) blank, count(*) filter (o_orderstatus = 'F') refusals, max(o_custkey % 40) as last_page from orders group by 1""")
def dataset_summaries(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("dataset"), "o_custkey", F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise("q").alias("q"), F.when(F.col("o_orderstatus") == "F", "Unanswerable").otherwise("x").alias("a"), F.array(F.lit(0).cast("long"), F.col("o_custkey") % 40).alias("p"))
    return reports.dataset_profile(rows, "dataset", "o_custkey", "q", "a", "p")


@query("""with c as (select l_suppkey k, l_returnflag || l_linestatus v, count(*) n, min((l_orderkey, l_linenumber)) f from lineitem group by 1, 2), r as (select *, row_number() over (partition by k order by n desc, f, v) r from c) select k as l_suppkey, v as category from r where r = 1""")
def majority_categories(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("category"), "l_orderkey", "l_linenumber")
    return aggregates.first_seen_mode(rows, "l_suppkey", "category", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("l_suppkey", F.col("mode").alias("category"))


@query("select p_partkey, case when p_size % 4 = 3 then null else ['s', 'e', 'a'][(p_partkey % 3 + 1)::int] || (p_size % 4) end as category from part")
def role_categories(t: Tables) -> DataFrame:
    taxonomy = {f"c{i}": [f"s{i}", f"e{i}", f"a{i}"] for i in range(3)}
    role = F.element_at(F.array(F.lit("structural"), F.lit("empirical"), F.lit("analytical")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", reports.category_for(taxonomy, F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string")), role).alias("category"))


@query("""select event_id, case when event_id % 4 = 3 then null else '{"event":"' || event_type || '","n":' || user_id || '}' end as found from events""")
def embedded_objects(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit(', "event": "'), "event_type", F.lit('"}'))
    raw = F.when(F.col("event_id") % 4 == 0, body).when(F.col("event_id") % 4 == 1, F.concat(F.lit("so {x} ```json\n"), body, F.lit("``` {\"later\": 1}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{\"broken\": "), body)).otherwise(F.lit("none {"))
    return t.events.select("event_id", reports.embedded_object(raw).alias("found"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'a' || chr(92) || 'pi ' || p_size when p_partkey % 3 = 1 then 'a' || chr(10) || p_size else 'a' || chr(92) || p_size end as answer from part""")
def lenient_outputs(t: Tables) -> DataFrame:
    mark = F.when(F.col("p_partkey") % 3 == 0, "\\pi ").when(F.col("p_partkey") % 3 == 1, "\\n").otherwise("\\\\")
    raw = F.concat(F.lit('{"answer": "a'), mark, F.col("p_size").cast("string"), F.lit('"}'))
    return t.part.select("p_partkey", F.try_variant_get(reports.lenient_json(raw), "$.answer", "string").alias("answer"))


@query("""select n_nationkey, 'Question: ' || n_name || chr(10) || 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. ' || n_regionkey || chr(10) || 'Answer with the letter of one option.' as choice, 'Question: ' || n_name || chr(10) || 'Answer in as few words as the question needs.' as fill from nation""")
def question_prompts(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", reports.choice_prompt(F.col("n_name"), F.array(F.lit("x"), F.col("n_regionkey").cast("string"))).alias("choice"), reports.fill_prompt(F.col("n_name")).alias("fill"))


@query(f"""with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]+(?:-[a-z0-9]+)*')) t from benchmark)
select item_id, count(distinct t) as terms from w where length(t) >= 5 and not starts_with(t, 'paper') and t not in {text.STOPWORDS} group by 1""")
def scientific_terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.size(text.scientific_terms(F.col("text"))).cast("long").alias("terms")).where("terms > 0")


@query("""with p as (select l_orderkey item, l_suppkey s, list_sort(list_distinct(list(l_linenumber - 2))) p from lineitem group by 1, 2), f as (select item, s, list_filter(p, lambda x: x > 0) p from p)
select item, string_agg(array_to_string(p, ','), ';' order by s) as options from f where len(p) > 0 group by 1""")
def contribution_pages(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("item"), "l_suppkey").agg(pages.canonical_pages(F.collect_list(F.col("l_linenumber") - 2)).alias("p")).where(F.size("p") > 0)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", F.array_join("p", ",").alias("p")))), lambda x: x["p"])
    return rows.groupBy("item").agg(F.array_join(lists, ";").alias("options"))


@query("select l_orderkey as item, count(distinct l_suppkey) as documents from lineitem group by 1")
def source_document_counts(t: Tables) -> DataFrame:
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_list("l_suppkey").alias("d"))
    return docs.select("item", F.size(F.array_distinct("d")).cast("long").alias("documents"))


@query(f"""with x as (select item_id, unnest(string_split({CONTENT.format(x='text')}, ' ')) w from benchmark) select item_id, sha256(string_agg(distinct w, ' ' order by w)) as tokens from x where w <> '' group by 1""")
def question_token_sets(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.sha2(F.array_join(F.array_sort(text.word_tokens(F.col("text"))), " "), 256).alias("tokens"))
