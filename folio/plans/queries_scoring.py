"""Scoring queries: orders are items, line numbers are pages, R-flagged lines are gold, discounted ones predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import aggregates, guards, lineage, scoring

from .registry import Tables, query

PAGES = """
gp as (select l_orderkey k, l_linenumber p from lineitem where l_returnflag = 'R' group by 1, 2),
pp as (select l_orderkey k, l_linenumber p from lineitem where l_discount >= 0.05 group by 1, 2),
g as (select k, count(*) n from gp group by k), q as (select k, count(*) n from pp group by k),
i as (select gp.k, count(*) n from gp join pp on gp.k = pp.k and gp.p = pp.p group by gp.k),
item as (select o.*, o.o_orderkey k, coalesce(g.n, 0) gn, coalesce(q.n, 0) pn, coalesce(i.n, 0) xn
  from orders o left join g on o.o_orderkey = g.k left join q on o.o_orderkey = q.k left join i on o.o_orderkey = i.k),
m as (select *,
  case when gn = 0 and pn = 0 then 1e0 when pn = 0 or gn = 0 then 0e0 else xn * 1e0 / pn end ep,
  case when gn = 0 and pn = 0 then 1e0 when pn = 0 or gn = 0 then 0e0 else xn * 1e0 / gn end er,
  case when gn = 0 and pn = 0 then 1e0 when xn = 0 then 0e0 else 2e0 * xn / (gn + pn) end ef,
  case when gn = xn and pn = xn then 1 else 0 end ex from item)
"""


def scored(t: Tables) -> DataFrame:
    pages = scoring.page_sets(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05)
    items = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("task"), "o_custkey", "o_orderstatus")
    return scoring.score_items(items, pages, "l_orderkey")


@query(f"""with {PAGES}
select coalesce(o_orderpriority, 'All') task, count(*) n, round(sum(ep) * 100 / 20000, 6) ep, round(sum(er) * 100 / 20000, 6) er,
  round(sum(ef) * 100 / 20000, 6) ef, sum(pn) / 20000e0 ap, sum(ex)::bigint ex
from m group by grouping sets ((o_orderpriority), ())""")
def agg_fixed_denominator(t: Tables) -> DataFrame:
    return scoring.fixed_denominator(scored(t), "task", 20000)


@query(f"with {PAGES} select k as item, ep as precision, er as recall, ef as f1, ex as exact, xn::int as common from m")
def evidence_by_item(t: Tables) -> DataFrame:
    return scored(t).select(F.col("l_orderkey").alias("item"), "e.precision", "e.recall", "e.f1", "e.exact", "e.common")


@query(f"""with {PAGES}, x as (select m.*, n_name, r_name from m join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
y as (select 'task' dimension, o_orderpriority as value, ex from x union all select 'field', n_name, ex from x union all select 'discipline', r_name, ex from x)
select dimension, value, count(*) n, sum(ex)::bigint exact, round(sum(ex) * 100e0 / count(*), 6) percent from y group by 1, 2""")
def score_breakdowns(t: Tables) -> DataFrame:
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = scored(t).join(places.select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("field"), F.col("r_name").alias("discipline")), "o_custkey")
    return scoring.breakdowns(rows, ["task", "field", "discipline"])


@query(f"""with {PAGES}, s as (select sum(xn)::bigint common, sum(gn)::bigint gold, sum(pn)::bigint pred from m), r as (select *, common * 1e0 / pred p, common * 1e0 / gold r from s)
select common, gold, pred, round(p, 9) as precision, round(r, 9) recall, round(2 * p * r / (p + r), 9) f1 from r""")
def micro_evidence(t: Tables) -> DataFrame:
    return scoring.micro_evidence(scored(t))


@query(f"""with {PAGES}, x as (select o_orderpriority task, gn = 0 g, pn = 0 p from m),
c as (select task, count(*) filter (g and p) tp, count(*) filter (not g and p) fp, count(*) filter (g and not p) fn, count(*) filter (not g and not p) tn from x group by task),
d as (select *, case when tp + fp = 0 then 0 else tp * 1e0 / (tp + fp) end pr, case when tp + fn = 0 then 0 else tp * 1e0 / (tp + fn) end re,
  case when tn + fn = 0 then 0 else tn * 1e0 / (tn + fn) end npr, case when tn + fp = 0 then 0 else tn * 1e0 / (tn + fp) end nre from c),
f as (select *, case when pr + re = 0 then 0 else 2 * pr * re / (pr + re) end a, case when npr + nre = 0 then 0 else 2 * npr * nre / (npr + nre) end b from d)
select task, tp, fp, fn, tn, round(pr, 9) as precision, round(re, 9) recall, round(a, 9) f1, round((a + b) / 2, 9) macro_f1 from f""")
def answerability_confusion(t: Tables) -> DataFrame:
    rows = scored(t).select("task", (F.size("gold_pages") == 0).alias("gold_refusal"), (F.size("pred_pages") == 0).alias("pred_refusal"))
    return scoring.refusal_confusion(rows, "task")


@query("""select c_mktsegment as cohort, count(*) subjects, count(*) filter (d.best is null) missing, coalesce(sum(best), 0)::bigint correct, round(coalesce(sum(best), 0) * 100e0 / count(*), 6) accuracy
from customer left join (select o_custkey, max((o_orderstatus = 'F')::int) best from orders where o_totalprice > 100000 group by 1) d on c_custkey = d.o_custkey group by 1""")
def join_cohort_accuracy(t: Tables) -> DataFrame:
    details = t.orders.where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("correct_flag"))
    return scoring.cohort_accuracy(t.customer.select("c_custkey", F.col("c_mktsegment").alias("cohort")), details, "c_custkey", "cohort", "correct_flag")


@query("""with a as (select o_orderpriority task, count(*) * 1e0 n, sum(o_totalprice > 1e5)::double big from orders group by 1),
b as (select o_orderpriority task, count(*) * 1e0 n, sum(o_totalprice > 1.2e5)::double big from orders group by 1)
select a.task, 'big' metric, a.big a, b.big b from a join b using (task) where abs(a.big - b.big) > 1e-12
union all select a.task, 'n', a.n, b.n from a join b using (task) where abs(a.n - b.n) > 1e-12""")
def join_summary_diff(t: Tables) -> DataFrame:
    side = lambda limit: t.orders.groupBy(F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > limit).alias("big"))
    return scoring.summary_differences(side(1e5), side(1.2e5), "task", ["n", "big"])


@query("""with d as (select o_orderstatus s, count(*) n, count(*) filter (o_totalprice > 1e5) k from orders group by 1)
select s as status, printf('%.2f', round_even(k * 100e0 / n, 2)) shown, printf('%.2f', round_even(round_even(k * 100e0 / n, 1), 2)) expected,
  printf('%.2f', round_even(k * 100e0 / n, 2)) = printf('%.2f', round_even(round_even(k * 100e0 / n, 1), 2)) matches from d""")
def compare_display(t: Tables) -> DataFrame:
    value = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg((F.count_if(F.col("o_totalprice") > 1e5) * 100.0 / F.count("*")).alias("value"))
    published = value.select("status", F.bround("value", 1).alias("published"))
    return scoring.display_matches(value, published, ["status"])


@query("""select source, count(*) n, sum(case when quality = 1 and toxic = 1 then 0.5 when quality = 1 then 1.0 else 0.0 end)::double weighted,
  round(sum(case when quality = 1 and toxic = 1 then 0.5 when quality = 1 then 1.0 else 0.0 end)::double * 100 / count(*), 6) score
from documents left join labels using (doc_id) group by source""")
def join_evidence_weighted(t: Tables) -> DataFrame:
    first = t.labels.select("doc_id", (F.col("quality") == 1).alias("joint_correct"))
    second = t.labels.select("doc_id", (F.col("toxic") == 1).alias("closed_correct"))
    return scoring.evidence_weighted(t.documents.select("doc_id", "source"), first, second, "doc_id", "source")


@query("""select count(*) paired, count(*) filter (quality = 1) left_correct, count(*) filter (toxic = 1) right_correct,
  count(*) filter (quality = 1 and toxic = 0) only_left, count(*) filter (quality = 0 and toxic = 1) only_right from labels""")
def join_paired_comparison(t: Tables) -> DataFrame:
    return scoring.paired_comparison(t.labels.select("doc_id", F.col("quality").alias("c")), t.labels.select("doc_id", F.col("toxic").alias("c")), "doc_id", "c")


@query("select doc_id from labels where not (quality = 1 and toxic = 1)")
def filter_all_models_correct(t: Tables) -> DataFrame:
    verdicts = t.labels.select("doc_id", F.explode(F.array(F.struct(F.lit("a").alias("model"), (F.col("quality") == 1).alias("ok")), F.struct(F.lit("b").alias("model"), (F.col("toxic") == 1).alias("ok")))).alias("v")).select("doc_id", "v.*")
    return scoring.all_models_correct(t.labels.select("doc_id"), verdicts, "doc_id", "model", "ok", 2)


@query("""select lang, count(*) n, count(*) filter (quality is null) pending, round(coalesce(sum(quality), 0) * 100e0 / count(*), 6) least,
  round((coalesce(sum(quality), 0) + count(*) filter (quality is null)) * 100e0 / count(*), 6) most,
  case when count(*) filter (quality is null) = 0 then round(coalesce(sum(quality), 0) * 100e0 / count(*), 6) end exact
from documents left join labels using (doc_id) group by lang""")
def accuracy_bounds(t: Tables) -> DataFrame:
    return scoring.accuracy_bounds(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"), "quality", "lang")


@query("""with x as (select n_chars >= 200 legal, quality is not null judged, coalesce(quality = 1, false) correct from documents left join labels using (doc_id))
select count(*) total, count(*) filter (legal) legal, count(*) filter (judged) judged, count(*) filter (correct) correct, round(count(*) filter (correct) * 100e0 / count(*), 6) of_total,
  round(count(*) filter (correct) * 100e0 / count(*) filter (legal), 6) of_legal, round(count(*) filter (correct) * 100e0 / count(*) filter (judged), 6) of_judged from x""")
def three_denominators(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select((F.col("n_chars") >= 200).alias("legal"), F.col("quality").isNotNull().alias("judged"), (F.col("quality") == 1).alias("correct"))
    return scoring.three_denominators(rows, "legal", "judged", "correct")


@query("""with c as (select source, count(*) filter (toxic = 1) k, count(*) n from documents join labels using (doc_id) group by source),
w as (select *, k * 1e0 / n s, 1.959963984540054 z from c)
select source, k, n, round(s * 100, 6) as share, round(greatest(0, least(1, (s + z * z / (2 * n) - z * sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / (1 + z * z / n))), 9) low,
  round(greatest(0, least(1, (s + z * z / (2 * n) + z * sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / (1 + z * z / n))), 9) high from w""")
def wilson_by_group(t: Tables) -> DataFrame:
    return scoring.wilson_by_group(t.documents.select("doc_id", "source").join(t.labels, "doc_id"), "source", F.col("toxic") == 1)


@query("select quality, toxic, count(*) n, (quality = toxic)::int agree, case when quality = 1 and toxic = 1 then 'both_keep' when quality = 0 and toxic = 0 then 'both_drop' else 'adjudicate' end tier from labels group by quality, toxic")
def agreement_matrix(t: Tables) -> DataFrame:
    return scoring.agreement_matrix(t.labels, "quality", "toxic")


@query("""with s as (select source, lang, count(*) n, avg(quality) m from documents join labels using (doc_id) group by 1, 2)
select lang, sum(n)::bigint samples, round(sum(m * n) / sum(n), 9) mean from s group by lang""")
def table_reaggregate(t: Tables) -> DataFrame:
    summary = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("quality").alias("m"))
    return scoring.weighted_reaggregate(summary, "lang", "n", "m")


@query("""select * from (select source, count(*) n, count(*) filter (n_chars < 200) illegal, round(count(*) filter (n_chars < 200) * 100e0 / count(*), 6) rate from documents group by source) where rate > 5""")
def illegal_rate_gate(t: Tables) -> DataFrame:
    return scoring.rate_gate(t.documents.select("source", "n_chars"), "source", F.col("n_chars") < 200, 5.0)


@query("select event_type, count(*) n, round(count(*) * 100e0 / sum(count(*)) over (), 6) as share from events group by event_type")
def share_table(t: Tables) -> DataFrame:
    return aggregates.share_table(t.events, "event_type")


@query("""select case when grouping(o_orderpriority) = 1 then 'Total' else o_orderpriority end as o_orderpriority, count(*) filter (o_orderstatus = 'F') "F", count(*) filter (o_orderstatus = 'O') "O", count(*) filter (o_orderstatus = 'P') "P", count(*) total
from orders group by rollup (o_orderpriority)""")
def matrix_total(t: Tables) -> DataFrame:
    return aggregates.matrix_with_totals(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""with d as (select n_nationkey, n_regionkey, count(c_custkey) n from nation left join (select * from customer where c_acctbal < 0) c on c_nationkey = n_nationkey group by 1, 2)
select n_nationkey as field, n_regionkey as parent, n, (sum(n) over (partition by n_regionkey))::bigint parent_total from d""")
def dense_domain_counts(t: Tables) -> DataFrame:
    domain = t.nation.select(F.col("n_nationkey").alias("field"), F.col("n_regionkey").alias("parent"))
    return aggregates.dense_domain_counts(domain, t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("field")), "field", "parent")


@query("select uses, count(*) sources from (select l_partkey, count(*) uses from lineitem group by 1) group by uses")
def reuse_histogram(t: Tables) -> DataFrame:
    return aggregates.reuse_histogram(t.lineitem, "l_partkey")


@query("select p_brand as bundle, count(*) items, count(distinct p_type) distinct_items, min(p_size) smallest, max(p_size) largest, median(p_size)::double middle, sum(p_size)::bigint total from part group by 1")
def bundle_profile(t: Tables) -> DataFrame:
    return aggregates.group_profile(t.part.withColumnRenamed("p_brand", "bundle"), "bundle", "p_type", "p_size")


@query("""with x as (select count(*) total, count(value) v, count(props) p, count(user_id) u from events)
select 'value' field, v as present, 'double' as type, round(v * 100e0 / total, 6) coverage from x union all select 'props', p, 'string', round(p * 100e0 / total, 6) from x union all select 'user_id', u, 'bigint', round(u * 100e0 / total, 6) from x""")
def field_profile(t: Tables) -> DataFrame:
    return aggregates.field_profile(t.events, ["value", "props", "user_id"])


@query("""with c as (select o_orderpriority as component, o_custkey num, count(*) c from orders group by 1, 2)
select component, sum(c)::bigint n, min(num) as first, max(num) as last, count(*) filter (c > 1) duplicated, max(num) - min(num) + 1 - count(*) absent from c group by component""")
def manifest_continuity(t: Tables) -> DataFrame:
    return aggregates.continuity(t.orders.select(F.col("o_orderpriority").alias("component"), "o_custkey"), "component", "o_custkey")


@query("""with c as (select l_suppkey, l_shipdate::date d, count(*) n, min(l_orderkey) seen from lineitem group by 1, 2)
select l_suppkey, d::varchar as mode, n from (select *, row_number() over (partition by l_suppkey order by n desc, seen) r from c) where r = 1""")
def first_seen_mode(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").cast("string").alias("d"), "l_orderkey")
    return aggregates.first_seen_mode(rows, "l_suppkey", "d", F.col("l_orderkey"))


@query("""with x as (select count(*) total, count(*) filter (o_totalprice > 1e5) a, count(*) filter (o_orderstatus = 'F') b from orders)
select 'expensive' as name, a yes, total - a no, round(a * 100e0 / total, 6) yes_share from x union all select 'finished', b, total - b, round(b * 100e0 / total, 6) from x""")
def pair_shares(t: Tables) -> DataFrame:
    return aggregates.pair_shares(t.orders, {"expensive": F.col("o_totalprice") > 1e5, "finished": F.col("o_orderstatus") == "F"})


@query("""select user_id as task, round(avg(value), 6) as percent, count(*) filter (event_type = 'purchase') done, count(*) stages,
  coalesce(min(event_id) filter (event_type = 'click'), min(event_id) filter (event_type <> 'purchase'), max(event_id)) as current from events group by user_id""")
def stage_rollup(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "done").otherwise("waiting")
    return aggregates.stage_rollup(t.events.withColumn("status", status).withColumnRenamed("user_id", "task"), "task", "event_id", "value", "status")


@query("""select p_brand as bundle, p_partkey, p_size, (sum(p_size) over w)::bigint as end_page, (sum(p_size) over w - p_size + 1)::bigint as start_page
from part window w as (partition by p_brand order by p_partkey)""")
def page_offsets(t: Tables) -> DataFrame:
    return aggregates.running_offsets(t.part.select(F.col("p_brand").alias("bundle"), "p_partkey", "p_size"), "bundle", "p_partkey", "p_size")


OFFSETS = "o as (select p_brand bundle, p_partkey, (sum(p_size) over w - p_size + 1)::bigint s, (sum(p_size) over w)::bigint e from part window w as (partition by p_brand order by p_partkey))"
PAGES_OF_LINES = "select distinct p_brand bundle, l_orderkey item, (l_linenumber * 13 + l_orderkey % 40)::int page from lineitem join part on l_partkey = p_partkey"
CITED = f"c as ({PAGES_OF_LINES} where l_quantity >= 45)"


def _ranges(t: Tables) -> DataFrame:
    return page_offsets(t).select("bundle", "p_partkey", F.col("start_page").alias("s"), F.col("end_page").alias("e"))


def _pages_of(t: Tables, lines: DataFrame) -> DataFrame:
    lines = lines.select("l_partkey", "l_orderkey", "l_linenumber")
    return lines.join(t.part.select("p_partkey", "p_brand"), lines.l_partkey == F.col("p_partkey")).select(F.col("p_brand").alias("bundle"), F.col("l_orderkey").alias("item"), (F.col("l_linenumber") * 13 + F.col("l_orderkey") % 40).cast("int").alias("page"))


def _cited(t: Tables) -> DataFrame:
    return _pages_of(t, t.lineitem.where("l_quantity >= 45")).distinct()


@query(f"with {OFFSETS}, {CITED} select c.bundle, item, page, p_partkey, page - s + 1 as local_page from c join o on c.bundle = o.bundle and page between s and e")
def range_page_to_doc(t: Tables) -> DataFrame:
    found = guards.range_lookup(_cited(t), _ranges(t), "bundle", "page", "s", "e")
    return found.select("bundle", "item", "page", "p_partkey", (F.col("page") - F.col("s") + 1).alias("local_page"))


@query(f"""with {OFFSETS}, c as ({PAGES_OF_LINES}) select c.bundle, item, count(distinct p_partkey) docs, count(distinct page) pages, count(distinct page) filter (p_partkey is null) unmapped
from c left join o on c.bundle = o.bundle and page between s and e group by 1, 2""")
def mapped_docs(t: Tables) -> DataFrame:
    return lineage.count_mapped(_pages_of(t, t.lineitem), _ranges(t), "bundle", "item", "page", "s", "e", "p_partkey")


@query(f"""with {OFFSETS}, {CITED}, f as (select c.bundle, item, page, s, e from c join o on c.bundle = o.bundle and page between s and e)
select distinct bundle, item, unnest(range(greatest(page - 2, s), least(page + 2, e) + 1))::int page from f""")
def context_pages(t: Tables) -> DataFrame:
    found = guards.range_lookup(_cited(t), _ranges(t), "bundle", "page", "s", "e")
    near = F.sequence(F.greatest(F.col("page") - 2, F.col("s")), F.least(F.col("page") + 2, F.col("e")))
    return found.select("bundle", "item", F.explode(near).alias("page")).select("bundle", "item", F.col("page").cast("int").alias("page")).distinct()


@query("""with s as (select o_custkey, o_orderkey from orders), p as (select distinct o_custkey, l_linenumber::int page from s join lineitem on o_orderkey = l_orderkey)
select o_custkey as item, count(*) n_pages, string_agg(page::varchar, ',' order by page) pages from p group by 1""")
def lineage_page_union(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey").join(t.lineitem.select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    pages = F.array_sort(F.collect_set("l_linenumber"))
    return rows.groupBy(F.col("o_custkey").alias("item")).agg(F.size(pages).cast("long").alias("n_pages"), F.array_join(pages, ",").alias("pages"))
