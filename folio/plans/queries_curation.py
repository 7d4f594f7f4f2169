"""Curation queries: acceptance, replacement reasons, aliases, classes, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import contracts, curation

from .registry import Tables, query


@query("""select doc_id, case when a is null or b is null then 'unreviewed' when not a then 'first_rejected' when not b then 'second_rejected' else 'accepted' end as state
from documents left join (select doc_id, quality = 1 a from labels) using (doc_id) left join (select doc_id, toxic = 0 b from labels where doc_id % 2 = 0) using (doc_id)""")
def accept_by_both(t: Tables) -> DataFrame:
    first = t.labels.select("doc_id", (F.col("quality") == 1).alias("keep"))
    second = t.labels.where("doc_id % 2 = 0").select("doc_id", (F.col("toxic") == 0).alias("keep"))
    return curation.accept_by_both(t.documents.select("doc_id"), first, second, "doc_id").select("doc_id", "state")


@query("""select doc_id, quality = 1 and toxic = 0 and doc_id % 10 >= 3 as keep from labels""")
def strict_keep(t: Tables) -> DataFrame:
    criteria = F.create_map(F.lit("clear"), F.col("quality") == 1, F.lit("grounded"), F.col("toxic") == 0)
    kept = contracts.strict_keep(F.lit("KEEP"), (F.col("doc_id") % 10) / 10, criteria, F.lit(False), 0.3)
    return t.labels.select("doc_id", kept.alias("keep"))


@query("""select code, count(*) n from (select unnest(list_concat(list_concat(case when doc_id % 4 = 3 then ['invalid_decision'] else [] end, case when doc_id % 7 > 4 then ['invalid_confidence'] else [] end),
 list_concat(case when source = 'src1' then ['empty_reason'] else [] end, case when doc_id % 4 = 1 then ['fix_without_correction'] else [] end))) as code from documents) group by code""")
def review_contract(t: Tables) -> DataFrame:
    from folio.operators.aggregates import count_codes

    decision = F.element_at(F.array(*[F.lit(x) for x in ("KEEP", "FIX", "DROP", "MAYBE")]), (F.col("doc_id") % 4 + 1).cast("int"))
    found = contracts.review_codes(decision, (F.col("doc_id") % 7) / 4, F.when(F.col("source") != "src1", F.col("source")), F.lit(""), F.create_map(F.lit("a"), F.lit(True)))
    return count_codes(t.documents, found)


@query("""with s as (select l_orderkey k, list_sort(list_distinct(list(l_linenumber))) p, sum(l_quantity) q, count(*) c from lineitem group by 1),
r as (select unnest(list_concat(list_concat(case when len(p) < 2 then ['fewer_than_two_evidence_pages'] else [] end, case when list_max(p) - list_min(p) < 2 then ['no_non_adjacent_source_evidence_selection'] else [] end),
 list_concat(case when q > 150 then ['source_or_final_answer_leaked_in_question'] else [] end, list_concat(case when c < 2 then ['missing_answer_visible_intermediate_fact_chain'] else [] end, case when k % 3 >= 2 then ['all_required_models_answered_correctly_without_pdf'] else [] end)))) as code from s)
select code, count(*) n from r group by code""")
def replacement_reasons(t: Tables) -> DataFrame:
    from folio.operators.aggregates import count_codes

    items = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("p"), F.sum("l_quantity").alias("q"), F.count("*").alias("c"))
    return count_codes(items, curation.replacement_reasons(F.col("p"), 2, F.col("q") > 150, F.col("c"), F.col("l_orderkey") % 3, 2))


@query("""with a as (select p_partkey id, unnest([p_partkey + 1, p_size + 100000]) alias from part where p_partkey % 2 = 0), l as (select alias, count(distinct id) n, min(id) id from a group by 1),
w as (select distinct l_partkey w from lineitem union select distinct p_size + 100000 from part), c as (select p_partkey id from part where p_partkey % 2 = 0)
select w as wanted, coalesce(c.id, case when n = 1 then l.id end)::varchar asset, case when c.id is not null then 'current' when n = 1 then 'alias' when n > 1 then 'ambiguous' else 'missing' end as how from w left join c on w = c.id left join l on w = alias""")
def resolve_aliases(t: Tables) -> DataFrame:
    assets = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.array(F.col("p_partkey") + 1, (F.col("p_size") + 100000).cast("long")).alias("aliases"))
    wanted = t.lineitem.select(F.col("l_partkey").alias("wanted")).union(t.part.select((F.col("p_size") + 100000).cast("long"))).distinct()
    return curation.resolve_aliases(wanted, assets, "p_partkey", "aliases").withColumn("asset", F.col("asset").cast("string"))


@query("""with p as (select o_custkey g, l_orderkey i, l_linenumber p from lineitem join orders on l_orderkey = o_orderkey)
select a.g as paper, max(abs(a.p - b.p)) as span from p a join p b on a.g = b.g and a.i <> b.i group by 1 having max(abs(a.p - b.p)) >= 5""")
def papers_with_span(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("paper"), "l_orderkey", "l_linenumber")
    return curation.groups_with_span(rows, "paper", "l_orderkey", "l_linenumber", 5)


@query("select class, count(*) n from (select case when regexp_matches(lower(p_type), 'brass|copper') then 'metal' when regexp_matches(lower(p_type), 'small|mini') then 'size' else 'other' end as class from part) group by class")
def category_fallback(t: Tables) -> DataFrame:
    return t.part.select(curation.first_match(F.col("p_type"), [("metal", "brass|copper"), ("size", "small|mini")], "other").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("select roles, count(*) n from (select array_to_string(list_concat(case when regexp_matches(lower(p_name), 'a') then ['cause'] else [] end, case when regexp_matches(lower(p_name), '[0-4]$') then ['effect'] else [] end), '+') as roles from part) group by roles")
def relation_roles(t: Tables) -> DataFrame:
    return t.part.select(F.array_join(curation.all_matches(F.col("p_name"), [("cause", "a"), ("effect", "[0-4]$")]), "+").alias("roles")).groupBy("roles").agg(F.count("*").alias("n"))


@query("select class, count(*) n from (select case when p_partkey % 3 = 0 then 'cross_pdf' when p_partkey % 3 = 1 then 'source_paper' else 'single_paper' end as class from part) group by class")
def path_classes(t: Tables) -> DataFrame:
    path = F.concat(F.element_at(F.array(F.lit("x/bundle_"), F.lit("source/"), F.lit("papers/")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return t.part.select(curation.path_class(path).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("""with r as (select s_suppkey, row_number() over (order by s_suppkey) - 1 r, count(*) over () n from supplier) select s_suppkey, ((r - ('0x' || left(sha256('w7'), 8))::bigint % n + n) % n)::bigint as turn from r""")
def claim_rotation(t: Tables) -> DataFrame:
    return curation.claim_order(t.supplier.select("s_suppkey"), "s_suppkey", "w7", 4).select("s_suppkey", F.col("turn").cast("long").alias("turn"))


@query("select l_orderkey as item, l_linenumber as old, case when l_linenumber = 2 and l_orderkey % 5 = 0 then 9 else l_linenumber end as page, l_linenumber = 2 and l_orderkey % 5 = 0 as changed from (select distinct l_orderkey, l_linenumber from lineitem)")
def page_remap(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("page")).distinct().withColumn("old", F.col("page"))
    mapping = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("item"), F.lit(2).alias("page"), F.lit(9).alias("new_page"))
    return curation.remap_pages(rows, mapping, "item", "page")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3 as within from orders")
def running_cap(t: Tables) -> DataFrame:
    return curation.capped(t.orders, "o_custkey", 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "within")


@query("select min(doc_id) doc_id from documents group by trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))")
def first_of_each_question(t: Tables) -> DataFrame:
    return curation.first_of_each_question(t.documents.select("doc_id", "text"), "text", F.col("doc_id")).select("doc_id")


@query("""select kind, cohort, count(*) n, sum(size)::bigint as total from (select 'new' cohort, p_brand kind, p_size size from part where p_partkey % 2 = 0 union all select 'old', p_brand, p_size from part where p_partkey % 2 = 1) group by 1, 2""")
def cohort_union(t: Tables) -> DataFrame:
    new = t.part.where("p_partkey % 2 = 0").withColumn("cohort", F.lit("new"))
    old = t.part.where("p_partkey % 2 = 1").withColumn("cohort", F.lit("old"))
    return new.unionByName(old).groupBy(F.col("p_brand").alias("kind"), "cohort").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query()
def accept_distinct(t: Tables) -> DataFrame:
    return curation.accept_distinct(t.documents.select("doc_id", "text"), "doc_id", "text", F.col("doc_id")).select("doc_id")


@query()
def balanced_pick(t: Tables) -> DataFrame:
    picked = curation.balanced_pick(t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey", "o_orderpriority", "o_custkey", 60, 1)
    return t.spark.createDataFrame([(k,) for k in picked], "o_orderkey long")
