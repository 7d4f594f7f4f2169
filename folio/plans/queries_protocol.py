"""Protocol, resume, storage and service queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import hashing
from folio.functions.text import judge_label
from folio.operators import protocol

from .registry import Tables, query


@query("""select structured, evidence, count(*) n from (select o_orderkey % 3 < 2 as structured, o_orderkey % 3 < 2 and o_custkey % 4 <> 0 as evidence from orders) group by 1, 2""")
def protocol_requirements(t: Tables) -> DataFrame:
    mode = F.element_at(F.array(F.lit("pdf"), F.lit("pdf_pages"), F.lit("question_only")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    answer = F.when(F.col("o_custkey") % 4 == 0, " Unanswerable ").otherwise("x")
    return t.orders.select(protocol.requirements(mode, answer).alias("r")).select("r.*").groupBy("structured", "evidence").agg(F.count("*").alias("n"))


@query("""select verdict, count(*) n from (select case o_orderkey % 6 when 0 then 'exact' when 1 then 'blank' when 2 then 'refusal_mismatch' when 3 then 'numeric' when 4 then 'numeric_mismatch' else 'needs_judge' end as verdict from orders) group by verdict""")
def direct_verdicts(t: Tables) -> DataFrame:
    pairs = [("The Answer.", "the  answer"), ("a", "  "), ("a", "unanswerable"), ("3.0 km", "3 km"), ("3 km", "4 km"), ("a fox", "some foxes")]
    chosen = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = t.orders.select(chosen.alias("p"))
    return rows.select(protocol.direct_match(F.col("p.a"), F.col("p.b")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""select reason, count(*) n from (select case when n_chars < 100 then 'empty_output' when quality is null then 'missing_fields' when toxic = 1 then 'error_output' else 'ok' end as reason from documents left join labels using (doc_id)) group by reason""")
def result_acceptance(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    reason = protocol.first_failure((F.col("n_chars") < 100, "empty_output"), (F.col("quality").isNull(), "missing_fields"), (F.col("toxic") == 1, "error_output"))
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("select event_id, event_type = 'error' or event_id % 7 = 0 as rerun from events")
def resume_predicate(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    output = F.when(F.col("event_id") % 7 == 0, "[error] timeout").otherwise("fine")
    return t.events.select("event_id", protocol.must_rerun(status, output, True).alias("rerun"))


@query("""select n_regionkey, case when n_regionkey = 0 then 'PROVEN_MISMATCH' when n_regionkey = 1 then 'DISPLAY_MATCH' else 'UNSCORED' end as class from (select distinct n_regionkey from nation)""")
def bound_classes(t: Tables) -> DataFrame:
    r = F.col("n_regionkey")
    low = F.when(r == 0, 50.1).when(r == 1, 50.001).otherwise(40.0)
    high = F.when(r == 1, 50.004).otherwise(60.0)
    return t.nation.select("n_regionkey").distinct().select("n_regionkey", protocol.bound_class(low, high, F.lit(50.0)).alias("class"))


@query("""with r as (select *, row_number() over (partition by p_brand, p_type order by p_size desc, p_partkey) p from part), s as (select *, row_number() over (partition by p_brand order by (p > 1)::int, p_size desc, p_partkey) place from r)
select p_brand as bundle, p_partkey, place::int as place from s where place <= 8""")
def prefix_preference(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("bundle"), "p_partkey", "p_type", "p_size")
    return protocol.prefer_new_prefixes(rows, "bundle", "p_type", 8, F.desc("p_size"), F.col("p_partkey")).select("bundle", "p_partkey", "place")


@query("""with x as (select p_brand g, p_partkey k, p_size s from part), p as (select a.g, a.k a, b.k b, abs(a.s - b.s) span from x a join x b on a.g = b.g and a.k < b.k where abs(a.s - b.s) >= 10),
r as (select *, row_number() over (partition by g order by span desc, a, b) r from p) select g as paper, a, b, span, r::int as rank from r where r <= 5""")
def spread_subsets(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("paper"), "p_partkey", "p_size")
    return protocol.spread_subsets(rows, "paper", "p_partkey", "p_size", 10, 5)


@query("select origin, count(*) n, sum(doc_id)::bigint as ids from (select doc_id, 'current' origin from labels where quality = 1 union all select doc_id, 'imported' from documents where n_chars > 1000 and doc_id not in (select doc_id from labels where quality = 1)) group by origin")
def bootstrap_import(t: Tables) -> DataFrame:
    out = protocol.import_missing(t.labels.where("quality = 1").select("doc_id", F.lit(None).cast("long").alias("n_chars")), t.documents.select("doc_id", "n_chars"), "doc_id", F.col("n_chars") > 1000)
    return out.groupBy("origin").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("select c_custkey, case when c_custkey % 10 = 0 then 'vip' else c_mktsegment end as segment from customer union all select -n_nationkey - 1, 'vip' from nation")
def setting_upsert(t: Tables) -> DataFrame:
    current = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = t.customer.where("c_custkey % 10 = 0").select("c_custkey").union(t.nation.select((-F.col("n_nationkey") - 1).cast("long")))
    return protocol.upsert(current, changed.withColumn("segment", F.lit("vip")), "c_custkey")


@query("""select outcome, count(*) n from (select case when d.doc_id is null then 'unknown' when l.doc_id % 5 = 0 then 'stale' else 'applied' end as outcome from (select doc_id from labels union all select -1) l left join documents d on d.doc_id = l.doc_id) group by outcome""")
def optimistic_edits(t: Tables) -> DataFrame:
    items = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    wanted = items.join(t.labels.select("doc_id"), "doc_id").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha")).alias("expected"))
    edits = wanted.unionByName(t.spark.createDataFrame([(-1, "x")], "doc_id long, expected string"))
    return protocol.apply_edits(items, edits, "doc_id", "sha").groupBy("outcome").agg(F.count("*").alias("n"))


@query("select problem, count(*) n from (select unnest(list_concat(case when event_id % 9 = 0 then ['key_mismatch'] else [] end, case when event_id % 4 = 1 then ['label_mismatch'] else [] end)) as problem from events) group by problem")
def cache_verification(t: Tables) -> DataFrame:
    right = hashing.stable_key(F.col("event_id"), F.col("event_type"))
    cache = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 9 == 0, "bad").otherwise(right).alias("key"), F.when(F.col("event_id") % 4 == 1, "wrong").otherwise("correct").alias("verdict"))
    found = protocol.verify_cache(cache, "key", right, judge_label(F.lit("Verdict: CORRECT")), "verdict")
    return found.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("select s_suppkey, (select max(n_nationkey) from nation) + 10 * row_number() over (order by s_name) as position from supplier where s_acctbal > 0")
def appended_positions(t: Tables) -> DataFrame:
    added = t.supplier.where("s_acctbal > 0").select("s_suppkey", "s_name")
    out = protocol.new_positions(t.nation.withColumn("position", F.col("n_nationkey").cast("long")), added, "position", 10, F.col("s_name"))
    return out.select("s_suppkey", "position")


@query("select p_partkey, list_sort(list_distinct([p_size % 4 + 1, p_size % 3 + 1]))[1] as first_type, len(list_distinct([p_size % 4 + 1, p_size % 3 + 1]))::int as n_types from part")
def review_types(t: Tables) -> DataFrame:
    said = F.concat(F.lit("["), (F.col("p_size") % 4 + 1).cast("string"), F.lit(", "), (F.col("p_size") % 3 + 1).cast("string"), F.lit("]"))
    kinds = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))))
    return t.part.select("p_partkey", kinds[0].alias("first_type"), F.size(kinds).alias("n_types"))


@query("select event_id, case when props like '%\"k\"%' then 'object<k>' else 'object' end as kind, 'bigint' as k_type from events")
def value_types(t: Tables) -> DataFrame:
    v = F.try_parse_json("props")
    keys = F.array_join(F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))), ",")
    kind = F.when(keys == "", "object").otherwise(F.concat(F.lit("object<"), keys, F.lit(">")))
    return t.events.select("event_id", kind.alias("kind"), F.lower(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))).alias("k_type"))
