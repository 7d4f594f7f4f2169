"""Lineage, bundle and release queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import recover, text
from folio.operators import lineage

from .queries_text import CONTENT
from .registry import Tables, query


@query("""with s as (select p_partkey k, p_brand, [p_size, p_size % 7 + 1] pages from part), d as (select l_orderkey item, l_partkey k from lineitem group by 1, 2), u as (select item, unnest(pages) p from d join s using (k))
select item, string_agg(distinct p::varchar, ',' order by p::varchar) pages from u group by item""")
def restore_evidence(t: Tables) -> DataFrame:
    derived = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_partkey").alias("source_ids"))
    sources = t.part.select(F.col("p_partkey").alias("k"), F.array("p_size", F.col("p_size") % 7 + 1).alias("pages"))
    out = lineage.restore_pages(derived, sources, "item", "source_ids", "k", "pages")
    return out.select("item", F.array_join(F.array_sort(F.transform("pages", lambda p: p.cast("string"))), ",").alias("pages"))


@query("""with w as (select p_brand bundle, p_partkey, p_size, row_number() over x doc_number, (sum(p_size) over x)::bigint e from part window x as (partition by p_brand order by p_partkey rows unbounded preceding))
select bundle, doc_number::int doc_number, p_partkey paper_id, (e - p_size + 1)::bigint merged_start_page, e merged_end_page, p_size source_page_count from w""")
def bundle_manifest(t: Tables) -> DataFrame:
    plan = lineage.bundle_plan(t.part.select(F.col("p_brand").alias("bundle"), "p_partkey", "p_size"), "bundle", "p_partkey", "p_size")
    return lineage.source_rows(plan, "bundle")


@query("""with w as (select p_brand bundle, p_partkey, (sum(p_size) over x - p_size + 1)::bigint s, (sum(p_size) over x)::bigint e from part window x as (partition by p_brand order by p_partkey rows unbounded preceding)),
i as (select p_brand bundle, p_partkey item, unnest([1, 1 + p_partkey % 10]) p from part)
select i.bundle, item, count(distinct w.p_partkey) n_documents from i join w on w.bundle = i.bundle and p between s and e group by 1, 2""")
def documents_of_pages(t: Tables) -> DataFrame:
    plan = lineage.source_rows(lineage.bundle_plan(t.part.select(F.col("p_brand").alias("bundle"), "p_partkey", "p_size"), "bundle", "p_partkey", "p_size"), "bundle")
    items = t.part.select(F.col("p_brand").alias("bundle"), F.col("p_partkey").alias("item"), F.array_distinct(F.array(F.lit(1).cast("long"), 1 + F.col("p_partkey") % 10)).alias("pages"))
    out = lineage.documents_of_pages(items, plan, "item", "bundle", "pages", "merged_start_page", "merged_end_page", "paper_id")
    return out.select("bundle", "item", F.size("documents").cast("long").alias("n_documents"))


@query("""with p as (select o_orderkey item, list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'R'))) g, max(o_custkey % 6 + 1) n from orders left join lineitem on o_orderkey = l_orderkey group by 1)
select item, case when coalesce(len(g), 0) > 0 then array_to_string(g, ',') else array_to_string(range(1, n + 1), ',') end as plan from p""")
def per_item_page_plan(t: Tables) -> DataFrame:
    gold = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_linenumber").alias("g"))
    items = t.orders.select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 6 + 1).alias("n")).join(gold, "item", "left")
    return lineage.per_item_page_plan(items, "g", "n").select("item", F.array_join("plan", ",").alias("plan"))


@query("select l_orderkey item, max(l_linenumber) - min(l_linenumber) >= 3 as separated, min(l_linenumber) as first, max(l_linenumber) as last from lineitem group by 1")
def separated_evidence(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_linenumber").alias("p"))
    return sets.select("item", lineage.separated_pages(F.col("p"), 3).alias("x")).select("item", "x.*")


@query("select user_id, case (user_id + 2) % 4 when 0 then 'bridge' when 1 then 'bridge' when 2 then 'compare' else 'count' end as choice from (select distinct user_id from events)")
def rotation_choice(t: Tables) -> DataFrame:
    cycle = ["causal", "bridge", "compare", "count"]
    supported = F.array(F.lit("bridge"), F.lit("compare"), F.lit("count"))
    return t.events.select("user_id").distinct().select("user_id", lineage.rotation_choice(F.col("user_id"), F.lit(2), cycle, supported).alias("choice"))


@query("select conv_id, turn, 'CQA_' || left(sha256(text), 16) as release_id, row_number() over (order by length(text) desc, conv_id, turn)::int as rank from conversations where role = 'user' and turn = 0")
def release_rows(t: Tables) -> DataFrame:
    rows = t.conversations.where("role = 'user' and turn = 0")
    return lineage.release_ids(rows, "CQA_", "text", F.desc(F.length("text")), F.col("conv_id"), F.col("turn")).select("conv_id", "turn", "release_id", "rank")


@query("""select code, count(*) n from (select unnest(list_concat(case when turn % 3 = 1 then ['attempt_numbers'] else [] end, list_concat(case when turn % 5 = 2 then ['raw_hash'] else [] end, case when turn % 2 = 1 then ['attempt_after_legal'] else [] end))) as code from conversations) group by code""")
def attempt_audit(t: Tables) -> DataFrame:
    from folio.operators.aggregates import count_codes

    n = F.when(F.col("turn") % 3 == 1, 5).otherwise(2)
    h = F.when(F.col("turn") % 5 == 2, "x").otherwise(F.sha2("text", 256))
    one = F.struct(F.lit(1).alias("number"), F.col("text").alias("raw"), F.sha2("text", 256).alias("sha256"), (F.col("turn") % 2 == 1).alias("legal"))
    two = F.struct(n.alias("number"), F.col("text").alias("raw"), h.alias("sha256"), F.lit(True).alias("legal"))
    return count_codes(lineage.audit_attempts(t.conversations.select(F.array(one, two).alias("a")), "a"), F.col("codes"))


@query(f"""with f as (select item_id % 5 g, item_id k, unnest(list_distinct(string_split({CONTENT.format(x='text')}, ' '))) term from benchmark), t as (select * from f where length(term) >= 2),
p as (select x.g, x.k a, y.k b, count(*) s from t x join t y on x.g = y.g and x.term = y.term and x.k < y.k group by 1, 2, 3 having count(*) >= 3),
l as (select g, a, b, s from p union all select g, b, a, s from p), x as (select m.g, list_sort([m.a, m.b, o.b]) members, max(m.s + o.s) shared from l m join l o on m.g = o.g and m.a = o.a and m.b < o.b group by 1, 2 union all select g, [a, b], s from p),
r as (select *, row_number() over (partition by g order by shared desc, len(members), members) r from x) select g as paper, array_to_string(members, ',') members, shared, r::int as rank from r where r <= 8""")
def semantic_groups(t: Tables) -> DataFrame:
    facts = t.benchmark.select((F.col("item_id") % 5).alias("paper"), "item_id", text.word_tokens(F.col("text"), 2).alias("terms"))
    out = lineage.semantic_groups(facts, "paper", "item_id", "terms", 3, 8)
    return out.select("paper", F.array_join("members", ",").alias("members"), "shared", "rank")


@query("select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as answer, case conv_id % 3 when 0 then 'json' when 1 then 'choices.message:content:raw_text' else 'content_blocks' end as status from conversations where text not like '%{%'")
def recover_nested_answers(t: Tables) -> DataFrame:
    said = F.col("text")
    plain = F.to_json(F.struct(F.to_json(F.struct(said.alias("answer_pre"))).alias("answer_pre")))
    chat = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")).alias("response")))
    blocks = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))).alias("output")))
    item = F.when(F.col("conv_id") % 3 == 0, plain).when(F.col("conv_id") % 3 == 1, chat).otherwise(blocks)
    rows = t.conversations.where("text not like '%{%'").select("conv_id", "turn", recover.recovered_answer(item).alias("r"))
    return rows.select("conv_id", "turn", "r.answer", "r.status")
