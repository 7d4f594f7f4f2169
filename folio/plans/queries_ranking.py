"""Ranking, selection, sampling, term-graph and similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import hashing, pages, text
from folio.operators import graph, ranking

from .queries_text import CONTENT
from .registry import Tables, query


@query("select o_orderpriority as task, o_orderkey, o_totalprice, r::int as rank from (select *, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) r from orders) where r <= 5")
def smallest_per_task(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("task"), "o_orderkey", "o_totalprice")
    return ranking.top_k(rows, "task", 5, F.col("o_totalprice"), F.col("o_orderkey"))


@query("""with x as (select l_orderkey g, l_partkey p, greatest(l_quantity - 47, 0)::int s, l_linenumber n, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_quantity) dup from lineitem),
b as (select *, max(s) over (partition by g) best from x where dup = 1),
r as (select *, row_number() over (partition by g order by s desc, p) r from b where s > 0 or best <= 0) select g as item, p as part, s as score, r::int as rank from r where r <= 2""")
def topk_per_group_fallback(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    x = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("part"), F.greatest(F.col("l_quantity") - 47, F.lit(0)).cast("int").alias("score"), F.row_number().over(W.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_quantity")).alias("dup")).where("dup = 1").drop("dup")
    return ranking.top_k_with_fallback(x, "item", 2, "score", F.col("part"))


HARD = "case when o_orderstatus = 'F' then 100 else 0 end + case when o_totalprice > 2e5 then 25 else 0 end + case when o_orderpriority = '1-URGENT' then 8 else 0 end + case when o_custkey % 3 = 0 then 5 else 0 end"


def _hard(t: Tables) -> DataFrame:
    rules = {"manual_incorrect": (100, F.col("o_orderstatus") == "F"), "model_incorrect": (25, F.col("o_totalprice") > 2e5), "three_document": (8, F.col("o_orderpriority") == "1-URGENT"), "inferential": (5, F.col("o_custkey") % 3 == 0)}
    return ranking.hardness(t.orders, rules)


@query(f"""select o_orderkey, {HARD} as score, array_to_string(list_concat(list_concat(case when o_orderstatus = 'F' then ['manual_incorrect'] else [] end, case when o_totalprice > 2e5 then ['model_incorrect'] else [] end),
 list_concat(case when o_orderpriority = '1-URGENT' then ['three_document'] else [] end, case when o_custkey % 3 = 0 then ['inferential'] else [] end)), ',') reasons from orders""")
def hardness_score(t: Tables) -> DataFrame:
    return _hard(t).select("o_orderkey", "score", F.array_join("reasons", ",").alias("reasons"))


@query(f"""with s as (select o_orderkey, {HARD} as score, o_orderkey % 200 = 0 as fresh from orders), n as (select count(*) c from s where fresh),
r as (select *, row_number() over (order by score desc, o_orderkey) r from s where not fresh) select o_orderkey, score, fresh from s where fresh union all select o_orderkey, score, fresh from r, n where r <= greatest(0, 300 - c)""")
def recommended(t: Tables) -> DataFrame:
    rows = _hard(t).select("o_orderkey", "score", (F.col("o_orderkey") % 200 == 0).alias("fresh"))
    return ranking.recommended(rows, "o_orderkey", "fresh", "score", 300)


@query("""with r as (select o_orderkey, o_orderpriority = '1-URGENT' three, row_number() over (partition by o_orderpriority = '1-URGENT' order by o_totalprice desc, o_orderkey) r from orders),
x as (select *, case when three and r <= 40 then 0 when not three then 1 else 2 end tier from r where r <= 100), o as (select *, row_number() over (order by tier, r, o_orderkey) p from x)
select o_orderkey, three, tier from o where p <= 100""")
def stratified_quota(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").alias("three"))
    return ranking.stratified_quota(rows, "o_orderkey", "three", 100, 0.4, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "three", "tier")


@query("""with r as (select event_id, event_type, row_number() over (partition by event_type order by event_id) - 1 r from events)
select event_id, event_type as focus, (r + 0.5) * 20 / case event_type when 'view' then 9 when 'click' then 6 else 5 end as slot from r where event_type in ('view', 'click', 'purchase')""")
def interleave(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("event_type").alias("focus"))
    return ranking.interleave(rows, "focus", {"view": 9, "click": 6, "purchase": 5}, F.col("event_id"))


@query("select user_id, event_id, (row_number() over (partition by user_id order by ts, event_id) * 10)::int as position from events")
def renumber_positions(t: Tables) -> DataFrame:
    return ranking.renumber(t.events, "user_id", 10, F.col("ts"), F.col("event_id")).select("user_id", "event_id", "position")


@query("""with r as (select n_regionkey, n_nationkey, n_nationkey % 5 = 3 m, row_number() over (partition by n_regionkey, n_nationkey % 5 = 3 order by n_name) - 1 r from nation)
select n_regionkey, n_nationkey, case when m then 1 else r + case when r >= 1 then 1 else 0 end end::int place from r""")
def move_position(t: Tables) -> DataFrame:
    return ranking.move_to(t.nation, "n_regionkey", "n_nationkey", F.col("n_nationkey") % 5 == 3, 1, F.col("n_name")).select("n_regionkey", "n_nationkey", F.col("place").cast("int").alias("place"))


@query("select p_brand, row_number() over (order by substr(p_brand, 1, 6), substr(p_brand, 7)::int)::int as place from (select distinct p_brand from part)")
def natural_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    brands = t.part.select("p_brand").distinct()
    return brands.withColumn("place", F.row_number().over(W.orderBy(text.natural_key(F.col("p_brand")))))


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 50")
def recent_events(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("select l_orderkey as item, max(l_linenumber) - min(l_linenumber) as span from lineitem group by 1")
def evidence_span(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("p")).select("item", pages.evidence_span(F.col("p")).alias("span"))


@query("select c_custkey, (('0x' || left(sha256(c_custkey::varchar), 2))::int % 4)::int as choice, c_custkey % 8 as shard from customer")
def hash_assignment(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", hashing.hash_choice(F.col("c_custkey"), 4).alias("choice"), (F.col("c_custkey") % 8).alias("shard"))


@query("""with p as (select l_orderkey item, l_linenumber page, max((l_returnflag = 'R')::int) gold from lineitem group by 1, 2),
r as (select *, row_number() over (partition by item order by gold desc, sha256('7:' || item || ':' || page)) r from p) select item, page, gold from r where gold = 1 or r <= 3""")
def page_plan(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    p = t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("page")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("gold"))
    seed = F.sha2(F.concat_ws(":", F.lit("7"), F.col("item").cast("string"), F.col("page").cast("string")), 256)
    ranked = p.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("gold"), seed)))
    return ranked.where("gold = 1 or r <= 3").drop("r")


@query("""with s as (select user_id, sum(value) v, count(*) n from events group by 1), r as (select user_id, row_number() over (order by sha256('11:' || user_id)) r from s),
x as (select arg_min(user_id, (v, user_id)) u, 'min' reason from s union all select arg_max(user_id, (v, user_id)), 'max' from s union all select user_id, 'sample' from r where r <= 10)
select u as user_id, string_agg(reason, ',' order by reason) reasons from x group by 1""")
def purposive_sample(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id").agg(F.sum("value").alias("v"))
    best = s.agg(F.min_by("user_id", F.struct("v", "user_id")).alias("a"), F.max_by("user_id", F.struct("v", "user_id")).alias("b"))
    ends = best.select(F.explode(F.array(F.struct(F.col("a").alias("user_id"), F.lit("min").alias("reason")), F.struct(F.col("b").alias("user_id"), F.lit("max").alias("reason")))).alias("x")).select("x.*")
    drawn = s.orderBy(F.sha2(F.concat(F.lit("11:"), F.col("user_id").cast("string")), 256)).limit(10).select("user_id", F.lit("sample").alias("reason"))
    return ends.union(drawn).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))


TERMS = f"w as (select distinct item_id p, unnest(string_split({CONTENT.format(x='text')}, ' ')) term from benchmark), t as (select * from w where length(term) >= 3 and term not in ('about','after','between','could','their','there','these','those','using','where','which','while','would')), d as (select term, count(*) df from t group by 1 having count(*) between 2 and 12), n as (select count(*) c from benchmark), q as (select t.p, t.term, df from t join d using (term)), pairs as (select x.p a, y.p b, count(*) shared, sum(ln((c + 1.0) / (x.df + 1.0))) w from q x join q y on x.term = y.term and x.p < y.p, n group by 1, 2 having count(*) >= 2)"


def _pairs(t: Tables) -> DataFrame:
    postings = graph.term_postings(t.benchmark, "item_id", text.key_terms(F.col("text"), 3), 2, 12)
    return graph.related_pairs(postings, t.benchmark.count(), 2)


@query(f"with {TERMS} select a, b, shared, round(w, 6) as weight, round(w + shared, 6) as score from pairs")
def term_pairs(t: Tables) -> DataFrame:
    return _pairs(t)


@query(f"""with {TERMS}, s as (select a, b, round(w + shared, 6) score from pairs), e as (select a center, b other, score from s union all select b, a, score from s),
r as (select *, row_number() over (partition by center order by score desc, other) r from e), k as (select * from r where r <= 3),
x as (select list_sort([p.center, p.other, q.other]) t, round(p.score + q.score, 6) s from k p join k q on p.center = q.center and p.other < q.other)
select t[1] a, t[2] b, t[3] c, max(s) score from x group by t""")
def term_triples(t: Tables) -> DataFrame:
    return graph.ranked_triples(_pairs(t), 3)


@query(f"""with {TERMS}, e as (select a x, b y, round(w, 6) w from pairs)
select p.x, p.y, q.y z, round(p.w + q.w + r.w, 6) as weight from e p join e q on p.x = q.x and p.y < q.y join e r on r.x = p.y and r.y = q.y""")
def complete_triangles(t: Tables) -> DataFrame:
    return ranking.complete_triangles(_pairs(t), "a", "b", "weight").withColumn("weight", F.round("weight", 6))


@query(f"""with q as (select doc_id, list_sort(list_distinct(string_split({CONTENT.format(x='text')}, ' '))) s from documents), c as (select s, min(doc_id) a from q group by s), t as (select a, len(s) n, unnest(s) w from c),
p as (select x.a, y.a b, count(*) c, any_value(x.n) na, any_value(y.n) nb from t x join t y on x.w = y.w and x.a < y.a and least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80 group by 1, 2)
select a, b, c::int as common, (na + nb - c)::int as total from p where c * 100 >= (na + nb - c) * 80 union all select a, doc_id, len(q.s)::int, len(q.s)::int from q join c on q.s = c.s where doc_id <> a""")
def near_dup_jaccard(t: Tables) -> DataFrame:
    return graph.near_duplicate_questions(t.documents, "doc_id", "text")


@query()
def near_dup_ratio(t: Tables) -> DataFrame:
    return graph.ratio_pairs(t.documents, "doc_id", "text", 0.88)


@query()
def keep_first_questions(t: Tables) -> DataFrame:
    return graph.keep_distinct(t.documents.select("doc_id", "n_chars", "text"), "doc_id", "text", F.col("n_chars")).select("doc_id", "n_chars")


@query()
def greedy_bundles(t: Tables) -> DataFrame:
    ranked = graph.ranked_triples(_pairs(t), 3)
    picked = graph.greedy_reuse(ranked, ["a", "b", "c"], 20, 1, F.desc("score"), F.col("a"), F.col("b"), F.col("c"))
    return t.spark.createDataFrame(picked, ranked.schema)
