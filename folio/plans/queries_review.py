"""Event log, status, assignment, queue and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import review
from folio.streaming import heartbeats

from .registry import Tables, query


@query("select user_id, arg_max(event_type, (ts, event_id)) as status, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id")
def latest_status(t: Tables) -> DataFrame:
    return review.latest_status(t.events.select("user_id", "event_id", "ts", F.col("event_type").alias("status")), ["user_id"], "ts", "event_id").select("user_id", "status", "event_id")


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as action from events where event_type in ('click', 'purchase') and event_id % 3 <> 0 group by user_id")
def undo_target(t: Tables) -> DataFrame:
    can = F.col("event_type").isin("click", "purchase") & (F.col("event_id") % 3 != 0)
    return review.undo_target(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", can, "ts", "event_id").select("user_id", "event_id", F.col("event_type").alias("action"))


@query("""with g as (select *, coalesce((epoch_us(ts) - epoch_us(lag(ts) over w) > 3600000000)::int, 0) late from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(late) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from g)
select user_id, session, count(*) beats, min(ts)::varchar first_ts, max(ts)::varchar last_ts from s group by 1, 2""")
def heartbeat_sessions(t: Tables) -> DataFrame:
    out = review.gap_sessions(t.events, "user_id", "ts", "event_id", 3600)
    return out.select("user_id", "session", "beats", F.col("first_ts").cast("string").alias("first_ts"), F.col("last_ts").cast("string").alias("last_ts"))


@query("""with t as (select event_id id, case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'pending' end s from events), d as (select id, id - 1 n from t where id % 2 = 0 union all select id, id - 5 from t where id % 3 = 0),
b as (select distinct d.id from d left join t on d.n = t.id where t.s is null or t.s <> 'done') select id, s as status from t where s = 'pending' and id not in (select id from b)""")
def dag_ready(t: Tables) -> DataFrame:
    tasks = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"))
    needs = tasks.where("id % 2 = 0").select("id", (F.col("id") - 1).alias("needs")).union(tasks.where("id % 3 = 0").select("id", (F.col("id") - 5).alias("needs")))
    return review.ready_tasks(tasks, needs, "id", "status")


STATUS = "case o_orderstatus when 'F' then 'kept' when 'P' then 'edited' when 'O' then 'deleted' end"


@query(f"""select c_custkey as assignment, count(l.o) total, count(*) filter (s = 'kept') kept, count(*) filter (s = 'edited') edited, count(*) filter (s = 'deleted') deleted, count(*) filter (l.o is not null and s is null) as "open"
from customer left join (select o_custkey, o_orderkey o from orders) l on c_custkey = o_custkey left join (select o_orderkey, {STATUS} s from orders where o_orderkey % 4 <> 0) r on l.o = r.o_orderkey group by 1""")
def assignment_progress(t: Tables) -> DataFrame:
    members = t.orders.select(F.col("o_custkey").alias("assignment"), F.col("o_orderkey").alias("item"))
    reviews = t.orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("item"), F.expr(STATUS).alias("status"))
    return review.assignment_progress(t.customer.select(F.col("c_custkey").alias("assignment")), members, reviews, "assignment", "item", "status")


@query(f"""select c_nationkey as reviewer, count(distinct o.o_orderkey) assigned, count(distinct case when s = 'kept' then o.o_orderkey end) kept, count(distinct case when s = 'edited' then o.o_orderkey end) edited,
 count(distinct case when s = 'deleted' then o.o_orderkey end) deleted, max(o_orderdate)::varchar last_at from (select distinct c_nationkey from customer) u left join customer using (c_nationkey) left join orders o on c_custkey = o_custkey
 left join (select o_orderkey, {STATUS} s from orders) r on r.o_orderkey = o.o_orderkey group by 1""")
def reviewer_progress(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_nationkey").alias("reviewer")).distinct()
    owned = t.customer.select(F.col("c_nationkey").alias("reviewer"), "c_custkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey")).select("reviewer", F.col("o_orderkey").alias("item"))
    reviews = t.orders.select(F.col("o_orderkey").alias("item"), F.expr(STATUS).alias("status"), "o_orderdate")
    out = review.reviewer_progress(users, owned, reviews, "reviewer", "item", "status", "o_orderdate")
    return out.withColumn("last_at", F.col("last_at").cast("string"))


@query("select l_partkey as item, count(distinct l_suppkey) n, min(l_suppkey) as first, max(l_suppkey) as last from lineitem group by 1 having count(distinct l_suppkey) > 1")
def assignment_conflicts(t: Tables) -> DataFrame:
    return review.assignment_conflicts(t.lineitem, "l_suppkey", "l_partkey").withColumnRenamed("l_partkey", "item")


@query("""with r as (select event_id, event_type, row_number() over (partition by event_type order by value desc, event_id) turn from events where event_type in ('click', 'error', 'view'))
select event_id, event_type as resource, turn::int as turn from r where turn <= case event_type when 'click' then 8 when 'error' then 2 else 1 end""")
def admit_tasks(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("event_type").alias("resource"), "value")
    return review.admit(rows, "resource", {"click": 8, "error": 2, "view": 1}, F.desc("value"), F.col("event_id")).drop("value")


@query("""with c as (select user_id, max(epoch(ts)) u, count(*) filter (event_type = 'error') % 4 f from events group by 1), n as (select max(epoch(ts)) now from events)
select user_id, case when f >= 3 then 'quarantined' when now - u > 86400 then 'stale' when f > 0 then 'retryable' else 'claimed' end as state from c, n""")
def lease_states(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    claims = t.events.groupBy("user_id").agg(F.max(at).alias("updated"), (F.count_if(F.col("event_type") == "error") % 4).alias("failures"))
    now = t.events.agg(F.max(at).alias("now"))
    return review.lease_state(claims.crossJoin(F.broadcast(now)), F.col("now"), "updated", "failures", 86400, 3).select("user_id", "state")


@query("select o_orderkey, o_custkey from orders semi join (select c_custkey from customer where c_acctbal > 0) on o_custkey = c_custkey")
def permitted_items(t: Tables) -> DataFrame:
    owners = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(owners, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select s_name, s_acctbal < 0 as disabled, row_number() over (order by s_acctbal < 0, s_name)::int as place from supplier")
def list_accounts(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    off = F.col("s_acctbal") < 0
    return t.supplier.select("s_name", off.alias("disabled")).withColumn("place", F.row_number().over(W.orderBy("disabled", "s_name")))


@query("select time_bucket(interval '1 hour', ts)::varchar as hour, event_type, count(*) n from (select distinct on (event_id) * from events) group by 1, 2")
def stream_hourly_counts(t: Tables) -> DataFrame:
    return heartbeats.hourly_counts_by_stream(t.spark, t.sf_dir)


@query("""with f as (select user_id, max((ts, event_id)) filter (event_type = 'purchase') p, arg_max(event_type, (ts, event_id)) t from events group by 1),
n as (select f.user_id, t, count(*) filter (event_type = 'error' and (p is null or (ts, event_id) > p))::int n from f join events e on e.user_id = f.user_id group by 1, 2)
select user_id as unit, case when t = 'purchase' then 'complete' when n >= 3 then 'quarantined' when t = 'error' then 'retryable' else 'claimed' end as state, n as failures,
  case when t = 'error' and n < 3 then least(300, pow(2, least(n, 8)))::double else 0.0::double end as wait from n""")
def stream_lease_states(t: Tables) -> DataFrame:
    from folio.streaming import leases

    return leases.current(heartbeats.run_to_table(leases.lease_updates(heartbeats.read_events(t.spark, t.sf_dir))))
