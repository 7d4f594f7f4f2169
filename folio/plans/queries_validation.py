"""Contract and guard queries: raw outputs, rule codes, key-set checks, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import hashing, pages
from folio.operators import contracts, guards, review

from .registry import Tables, query

OUTPUT = """case l_orderkey % 10 when 0 then '{"answer_pre": "a", "evidence_pages": [1' when 1 then '[1]' when 2 then '{"answer_pre": 5, "evidence_pages": [1]}'
 when 3 then '{"answer_pre": " ", "evidence_pages": [1]}' when 4 then '{"answer_pre": "a", "evidence_pages": "1"}' when 5 then '{"answer_pre": "a", "evidence_pages": [true, 1]}'
 when 6 then '{"answer_pre": "Unanswerable", "evidence_pages": [1]}' when 7 then '{"answer_pre": "unanswerable", "evidence_pages": []}'
 when 8 then '{"answer_pre": "a", "evidence_pages": [' || l_linenumber || ', ' || (l_linenumber - 2) || ']}' else '{"answer_pre": "a", "answer_pre": "b", "evidence_pages": [1]}' end"""


@query("""with x as (select l_orderkey, l_linenumber n, l_orderkey % 10 m from lineitem),
c as (select unnest(case m when 0 then ['invalid_json'] when 1 then ['wrong_object_type'] when 2 then ['answer_type'] when 3 then ['empty_answer'] when 4 then ['pages_type'] when 5 then ['page_type']
  when 6 then ['refusal_with_pages'] when 7 then ['answer_without_evidence', 'noncanonical_refusal'] when 8 then list_concat(case when n - 2 <= 0 then ['page_nonpositive'] else [] end, case when n > 5 then ['page_out_of_range'] else [] end)
  else ['invalid_json'] end) as code from x)
select code, count(*) n from c group by code""")
def contract_rule_codes(t: Tables) -> DataFrame:
    from folio.operators.aggregates import count_codes

    rows = t.lineitem.select("l_orderkey", "l_linenumber").select("*", F.expr(OUTPUT).alias("raw"))
    return count_codes(contracts.with_prediction_codes(rows, "raw", F.lit(5)), F.col("codes"))


@query("""with p as (select l_orderkey k, list_sort(list_distinct(list(l_linenumber))) a, list(l_linenumber order by l_shipdate, l_linenumber) r from lineitem group by 1),
c as (select unnest(list_concat(case when len(a) > 4 then ['too_many_pages'] else [] end, case when len(list_filter(a, lambda x: x > 6)) > 0 then ['page_not_allowed'] else [] end)) as code from p)
select code, count(*) n from c group by code""")
def pdf_prediction_rules(t: Tables) -> DataFrame:
    from folio.operators.aggregates import count_codes

    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("p"))
    found = contracts.prediction_rules(F.lit("answer"), F.col("p"), 4, F.sequence(F.lit(1), F.lit(6)))
    return count_codes(rows, found)


@query("""with c as (select unnest(list_concat(list_concat(case when n_chars < 200 then ['too_short'] else [] end, case when quality is null then ['unjudged'] else [] end),
  list_concat(case when quality = 0 then ['rejected'] else [] end, case when toxic = 1 then ['toxic'] else [] end))) as code from documents left join labels using (doc_id))
select code, count(*) n from c group by code""")
def contract_issue_counts(t: Tables) -> DataFrame:
    from folio.operators.aggregates import count_codes

    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    r = contracts.rule
    return count_codes(rows, contracts.codes(r(F.col("n_chars") < 200, "too_short"), r(F.col("quality").isNull(), "unjudged"), r(F.col("quality") == 0, "rejected"), r(F.col("toxic") == 1, "toxic")))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
k as (select doc_id, n as line_number, unnest(list_concat(case when regexp_matches(line, '-----BEGIN [A-Z ]*PRIVATE KEY-----') then ['private_key'] else [] end,
 list_concat(case when regexp_matches(line, '\b(AKIA|ASIA)[0-9A-Z]{16}\b') then ['access_key'] else [] end, list_concat(case when regexp_matches(line, '\b(sk|pk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,}') then ['api_key'] else [] end,
 list_concat(case when regexp_matches(line, '(?i)(api[_-]?key|secret|passwd|password|token)\s*[:=]\s*[''"]?[A-Za-z0-9/+_-]{8,}') then ['assignment'] else [] end,
 case when regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') then ['email'] else [] end))))) as kind from l)
select doc_id, line_number::int as line_number, kind from k""")
def scan_secret_locations(t: Tables) -> DataFrame:
    return contracts.secret_locations(t.documents, "doc_id", "text")


@query("""select status, count(*) n from (select coalesce(p.status, 'missing') status from orders left join (select l_orderkey, case when count(*) > 6 then 'illegal' else 'legal' end status from lineitem group by 1) p on o_orderkey = l_orderkey) group by status""")
def scan_submission_status(t: Tables) -> DataFrame:
    predictions = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.when(F.count("*") > 6, "illegal").otherwise("legal").alias("status"))
    return guards.bind_predictions(t.orders.select(F.col("o_orderkey").alias("item")), predictions, "item").groupBy("status").agg(F.count("*").alias("n"))


@query("select o_orderpriority as task, count(*) total, count(*) filter (o_totalprice >= 5e4) answerable, count(*) filter (not o_totalprice >= 5e4) unanswerable, sum(o_custkey % 5)::bigint as refs from orders group by 1")
def dataset_guard_counts(t: Tables) -> DataFrame:
    ok = F.col("o_totalprice") >= 5e4
    return t.orders.groupBy(F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("total"), F.count_if(ok).alias("answerable"), F.count_if(~ok).alias("unanswerable"), F.sum(F.col("o_custkey") % 5).alias("refs"))


@query("""with a as (select doc_id, quality q from labels where doc_id % 3 <> 0), b as (select doc_id, case when doc_id % 7 = 0 then null else quality end q from labels where doc_id % 4 <> 0),
f as (select coalesce(a.doc_id, b.doc_id) doc_id, case when a.doc_id is null then 'only_right' when b.doc_id is null then 'only_left' when a.q is distinct from b.q then 'quality' end as field from a full join b on a.doc_id = b.doc_id)
select doc_id, field from f where field is not null""")
def judge_binding_mismatch(t: Tables) -> DataFrame:
    left = t.labels.where("doc_id % 3 <> 0")
    right = t.labels.where("doc_id % 4 <> 0").withColumn("quality", F.when(F.col("doc_id") % 7 != 0, F.col("quality")))
    return guards.null_safe_mismatches(left, right, "doc_id", ["quality"])


@query("""select side, count(*) n from (select 'left' side from documents where doc_id not in (select doc_id from labels) union all select 'right' from labels where doc_id not in (select doc_id from documents)) group by side""")
def membership_difference(t: Tables) -> DataFrame:
    return guards.key_differences(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id").groupBy("side").agg(F.count("*").alias("n"))


@query("select count(distinct l_partkey) needed, count(distinct l_partkey) filter (l_partkey not in (select p_partkey from part where p_size > 10)) unmet from lineitem")
def required_decisions(t: Tables) -> DataFrame:
    needed = t.lineitem.select(F.col("l_partkey").alias("key")).distinct()
    known = t.part.where("p_size > 10").select(F.col("p_partkey").alias("key"), F.lit(1).alias("hit"))
    return needed.join(known, "key", "left").agg(F.count("*").alias("needed"), F.count_if(F.col("hit").isNull()).alias("unmet"))


@query("""with q as (select doc_id, text from documents), g as (select text, min(doc_id) doc_id from q group by text having count(*) = 1)
select q.doc_id, q.doc_id is not distinct from g.doc_id as unique_text from q left join g on q.text = g.text""")
def join_ambiguous_authority(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    known = guards.unambiguous(rows, "h").select("h", F.col("doc_id").alias("owner"))
    return rows.join(known, "h", "left").select("doc_id", F.col("doc_id").eqNullSafe(F.col("owner")).alias("unique_text"))


@query("""with g as (select doc_id, source s, n_chars n from documents where doc_id % 2 = 0), r as (select doc_id, case when doc_id % 3 = 0 then source else 'other' end s, n_chars n from documents),
e as (select s, n, min(doc_id) d from g group by 1, 2 having count(*) = 1), l as (select n, min(doc_id) d from g group by 1 having count(*) = 1)
select level, count(*) n from (select case when e.d is not null then 'exact' when l.d is not null then 'loose' else 'none' end as level from r left join e on r.s = e.s and r.n = e.n left join l on r.n = l.n) group by level""")
def match_gold_two_level(t: Tables) -> DataFrame:
    gold = t.documents.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("s"), F.col("n_chars").alias("n"))
    refs = t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("other").alias("s"), F.col("n_chars").alias("n"))
    exact = guards.unambiguous(gold, "s", "n").select("s", "n", F.col("doc_id").alias("e"))
    loose = guards.unambiguous(gold, "n").select("n", F.col("doc_id").alias("l"))
    both = refs.join(exact, ["s", "n"], "left").join(loose, "n", "left")
    return both.select(F.when(F.col("e").isNotNull(), "exact").when(F.col("l").isNotNull(), "loose").otherwise("none").alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query("select component, count(*) n, min(o_orderkey) as first, max(o_orderkey) as last from (select *, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'partial' end component from orders) group by component")
def union_disjoint(t: Tables) -> DataFrame:
    parts = {name: t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey") for s, name in (("F", "finished"), ("O", "open"), ("P", "partial"))}
    return guards.union_disjoint(parts, "o_orderkey").groupBy("component").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("""with x as (select doc_id, 'direct' tier, 0 r from labels where quality = 1 union all select doc_id, 'repaired', 1 from labels where toxic = 0 union all select doc_id, 'rest', 2 from documents)
select tier, count(*) n from (select doc_id, min_by(tier, r) tier from x group by doc_id) group by tier""")
def tiered_release(t: Tables) -> DataFrame:
    tiers = {"direct": t.labels.where("quality = 1").select("doc_id"), "repaired": t.labels.where("toxic = 0").select("doc_id"), "rest": t.documents.select("doc_id")}
    return guards.first_of_tiers(tiers, "doc_id").groupBy("tier").agg(F.count("*").alias("n"))


@query("select o_custkey, count(*) n from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY') group by 1")
def complement(t: Tables) -> DataFrame:
    calibration = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(calibration, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""with m as (select l_orderkey k, list_distinct(list(case l_linestatus when 'F' then 'figure' when 'O' then 'text' end)) a, max(l_returnflag = 'R') r from lineitem group by 1)
select k as item, array_to_string(list_filter(['text', 'table', 'figure', 'equation'], lambda x: list_contains(a, x) or (r and x = 'table')), '+') as modalities from m""")
def canonical_modalities(t: Tables) -> DataFrame:
    alias = F.create_map(*[F.lit(x) for kv in (("F", "figure"), ("O", "text"), ("R", "table")) for x in kv])
    said = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_linestatus").alias("a"), F.collect_set("l_returnflag").alias("b"))
    named = F.array_compact(F.transform(F.concat("a", "b"), lambda x: alias[x]))
    order = F.array(*[F.lit(x) for x in ("text", "table", "figure", "equation")])
    return said.select("item", F.array_join(F.array_intersect(order, named), "+").alias("modalities"))


@query("""with p as (select l_orderkey item, list_sort(list_distinct(list(l_linenumber))) p from lineitem group by 1 having count(distinct l_linenumber) >= 2)
select item, item || '__drop_p' || d as variant, d as dropped, array_to_string(list_filter(p, lambda x: x <> d), ',') as kept from (select item, p, unnest(p) d from p)""")
def ablation_variants(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("p"))
    out = sets.select("item", F.explode(pages.leave_one_out(F.col("p"))).alias("v"))
    return out.select("item", F.concat(F.col("item").cast("string"), F.lit("__drop_p"), F.col("v.dropped").cast("string")).alias("variant"), "v.dropped", F.array_join("v.kept", ",").alias("kept"))


@query("""with r as (select doc_id, case when doc_id % 5 = 0 then 'FIX' else 'KEEP' end d, case when doc_id % 10 = 0 then '  ' else 'src_new' end c from documents where doc_id % 2 = 0)
select doc_id, case when d = 'FIX' and trim(c) <> '' then c else source end source, d = 'FIX' and trim(c) <> '' and c <> source as fixed from documents left join r using (doc_id)""")
def apply_review_fixes(t: Tables) -> DataFrame:
    items = t.documents.select("doc_id", "source")
    decided = t.documents.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "FIX").otherwise("KEEP").alias("decision"), F.when(F.col("doc_id") % 10 == 0, "  ").otherwise("src_new").alias("corrected_source"))
    out = review.apply_fixes(items, decided, "doc_id", ["source"])
    return out.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.size("changed") > 0).alias("fixed"))


@query("""with b as (select o_orderkey k, o_orderstatus s, o_orderpriority p from orders), a as (select k, case when k % 11 = 0 then 'X' else s end s, case when k % 13 = 0 then null else p end p from b),
c as (select k, 's' as field, b.s as before, a.s as after from b join a using (k) where b.s is distinct from a.s union all select k, 'p', b.p, a.p from b join a using (k) where b.p is distinct from a.p) select * from c""")
def core_field_changes(t: Tables) -> DataFrame:
    before = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    after = before.withColumn("s", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("s"))).withColumn("p", F.when(F.col("k") % 13 != 0, F.col("p")))
    return review.field_changes(before, after, "k", ["s", "p"])


@query("select sha256(text) as content, min(doc_id) preferred, count(*) copies from documents group by text")
def asset_aliases(t: Tables) -> DataFrame:
    files = t.documents.select(F.sha2("text", 256).alias("content"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    return review.asset_aliases(files, "content", "path").select("content", F.col("preferred").cast("long").alias("preferred"), "copies")


@query("select o_orderpriority as component, count(*) n, sha256(string_agg(lpad(o_orderkey::varchar, 10, '0'), chr(10) order by o_orderkey)) as fingerprint from orders group by 1")
def distribution_fingerprint(t: Tables) -> DataFrame:
    ids = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    return t.orders.groupBy(F.col("o_orderpriority").alias("component")).agg(F.count("*").alias("n"), hashing.ordered_fingerprint(ids).alias("fingerprint"))


@query("select user_id, event_id % 4 = 0 as cached, count(*) n from events group by 1, 2")
def memoized_verdicts(t: Tables) -> DataFrame:
    requests = t.events.select("user_id", hashing.stable_key(F.col("event_id")).alias("key"))
    cache = t.events.where("event_id % 4 = 0").select(hashing.stable_key(F.col("event_id")).alias("key"), F.lit("correct").alias("verdict"))
    return review.memoized(requests, cache, "key", "verdict").groupBy("user_id", F.col("verdict").isNotNull().alias("cached")).agg(F.count("*").alias("n"))
